"""The manifest against trees built leaf by leaf, and its ranks against sorting."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from reconcile.llm import manifest
from reconcile.llm.queries import op11_manifest
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    size = row["n_chars"]
    values = [row["doc_id"], row["source"], row["lang"], size if size is None else size + more, row["text"]]
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def _path(levels, at):
    return [(level[(at >> i) ^ 1] if (at >> i) ^ 1 < len(level) else None, (at >> i) & 1) for i, level in enumerate(levels[:-1])]


def _fold(node, path):
    for sibling, left in path:
        node = _h(sibling or "", node) if left else _h(node, sibling or "")
    return node


def _slow(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in order:
        own = groups[lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[lang] = _levels([_leaf(r) for r in own])
    top = _levels([trees[lang][-1][0] for lang in order])
    found = []
    for n, lang in enumerate(order):
        for i, r in enumerate(groups[lang]):
            path = _path(trees[lang], i) + _path(top, n)
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            root = _fold(_leaf(r, int(chosen)), path)
            proof = _h(*(s or "" for s, _ in path))
            found.append((r["doc_id"], _leaf(r), trees[lang][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(found, key=str)


def _fast(docs):
    rows = manifest.build(docs)
    rows = rows.withColumn("folded", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("p"), "folded", F.expr("folded = root AS v"))
    return sorted((tuple(r.values()) for r in as_dicts(rows)), key=str)


def test_query_against_trees(spark):
    got = sorted((tuple(r.values()) for r in as_dicts(op11_manifest(spark, SF_DIR))), key=str)
    assert got == _slow(documents())
    assert {r[6] for r in got} == {True, False}


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert _fast(docs) == _slow(as_dicts(docs))
    assert manifest.build(nothing(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 1024, 1025, 2051])
def test_sizes_of_trees(spark, size):
    docs = spark.range(size).selectExpr("id * 3 - 5000 AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert _fast(docs) == _slow(as_dicts(docs))


def test_a_hot_id_repeated_rows_and_far_ids(spark):
    ids = "CASE WHEN id < 700 THEN 7 WHEN id < 1100 THEN NULL ELSE 4611686018427387904 - xxhash64(id) % 9000000000000 * 500000 END"
    docs = spark.range(2000).selectExpr(
        f"{ids} AS doc_id", "cast(id % 400 AS string) AS text", "CASE WHEN id % 3 > 0 THEN 'en' END AS lang", "'s' AS source", "id % 2 AS n_chars"
    )
    assert _fast(docs) == _slow(as_dicts(docs))


def test_positions_do_not_depend_on_sorting(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in (-(2**63), -1, 0, 63, 64, 4095, 4096, 2**63 - 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = manifest.build(docs).orderBy("position").select("doc_id").collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_many_languages(spark):
    docs = spark.range(1500).selectExpr("id AS doc_id", "'t' AS text", "concat('l', id % 1200) AS lang", "'s' AS source", "id AS n_chars")
    assert _fast(docs) == _slow(as_dicts(docs))
