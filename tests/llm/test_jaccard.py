import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reconcile.llm import graph, jaccard
from reconcile.llm.queries import op3_jaccard
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing, space_words


def _set(text):
    words = space_words(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def _slow(rows):
    """All pairs. rows: (doc_id, text)."""
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if _linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(sets[i]), least.get(root(i), None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str
    )


def _got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in as_dicts(df)), key=str)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert _got(jaccard.cluster(docs)) == _slow([(r["doc_id"], r["text"]) for r in as_dicts(docs)])
    assert jaccard.cluster(nothing(spark)).count() == 0


def test_query_against_all_pairs(spark):
    assert _got(op3_jaccard(spark, SF_DIR)) == _slow([(d["doc_id"], d["text"]) for d in documents()])


@pytest.mark.parametrize("block", [4, 1024])
def test_near_copies_at_the_threshold(spark, monkeypatch, block):
    """Chains of edits around the threshold, a shared passage, and groups above a block."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COMMON", block)
    monkeypatch.setattr(graph.with_tiles, "__defaults__", (block,))
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows, doc_id = [], 100
    for base in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 30, 90, 300]))]
        if base % 2:
            words = words + passage
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randrange(max(2, len(words) // 20))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((doc_id, " ".join(own)))
            doc_id += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(jaccard.cluster(docs)) == _slow(rows)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 50, 1000, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 10 :], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        n_a, n_b, both = len(a), len(b), len(np.intersect1d(a, b))
        words = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b)))
        x, y = jaccard.folded(jaccard.bitmap(a), words), jaccard.folded(jaccard.bitmap(b), words)
        assert n_a - np.bitwise_count(x & ~y).sum() >= both
        assert n_b - np.bitwise_count(y & ~x).sum() >= both


def test_least_overlap_is_the_threshold():
    for a in range(1, 60):
        for b in range(1, 60):
            least = jaccard.least_overlap(a, b)
            for o in range(min(a, b) + 1):
                assert (100 * o >= 75 * (a + b - o)) == (o >= least)


def test_shingles_of_slices_are_those_of_the_whole():
    texts = ["a b c d e f", "", None, "A B c d e", "x", "a  b\tc\nd e f"]
    sets = jaccard.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 2]
    assert np.array_equal(sets[0], sets[5]) and sets[3][0] in sets[0]


def test_one_of_each_keeps_columns_and_one_row_of_a_group(spark):
    docs = awkward(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in as_dicts(kept))
    assert ids == sorted(str(x) for x in (1, 3, 4, 5, 6, 8, 9, 11, None))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in as_dicts(graph.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("doc_id", ["7L", "cast(NULL AS long)", "id"])
def test_many_near_copies_under_one_id(spark, doc_id):
    words = " ".join(f"w{i}" for i in range(120))
    docs = spark.range(2000).selectExpr(f"{doc_id} AS doc_id", f"concat('{words} tail', id) AS text")
    # Also rows that are repeated as a whole.
    docs = docs.union(docs.filter("text LIKE '%tail5'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    rows = jaccard.cluster(docs)
    assert rows.count() == 2500
    assert rows.select("component_id").distinct().count() == 1
    assert jaccard.one_of_each(docs).count() == 1


def test_a_text_quoted_by_very_many_others(spark):
    """Its shingles are common, and all that a longer text shares with it; so is the one link of each."""
    quoted = " ".join(f"q{i}" for i in range(304))
    rows = [(0, quoted)] + [(i, quoted + " " + " ".join(f"u{i}x{j}" for j in range(96))) for i in range(1, 1500)]
    found = jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    sketch = spark.createDataFrame(
        [(1, 5, 10), (2, 5, 10), (3, 5, 11), (4, 6, 12), (5, None, None)], "doc_id long, node long, set_check long"
    )
    found = sorted((r["doc_id"], r["node"]) for r in jaccard._told_apart(sketch).collect())
    assert found == [(1, 5), (2, 5), (3, 11), (4, 6), (5, None)]
