"""Repeated passages against every window of every text, and the paths they are compacted into."""

import hashlib
import random

from pyspark.sql import functions as F

from reconcile.llm import passages
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing


def _words(text):
    return (text or "").encode().split()


def _slow(rows):
    texts = [_words(r["text"]) for r in rows]
    places = {}
    for i, words in enumerate(texts):
        for at in range(len(words) - 34):
            places.setdefault(hashlib.blake2b(b" ".join(words[at : at + 35]), digest_size=16).digest(), []).append((i, at))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                gone[i].update(range(at, at + 35))
    return sorted(
        ((r["doc_id"], len(w), len(g), b" ".join(x for n, x in enumerate(w) if n not in g).decode()) for r, w, g in zip(rows, texts, gone, strict=True)),
        key=str,
    )


def _fast(docs):
    return sorted((tuple(r.values()) for r in as_dicts(passages.without_repeats(docs))), key=str)


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_query_against_every_window(spark):
    from reconcile.llm.queries import op13_passages

    got = sorted((tuple(r.values()) for r in as_dicts(op13_passages(spark, SF_DIR))), key=str)
    rows = _slow(documents())
    assert got == sorted(((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in rows), key=str)
    assert any(0 < c < b for _, b, c, _ in rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert _fast(docs) == _slow(as_dicts(docs))
    assert _fast(nothing(spark)) == []


def test_random_passages(spark):
    draw = random.Random(7)
    shared = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(draw.choice([20, 34, 35, 36, 50, 90]))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(40)))]
        for _ in range(draw.randrange(4)):
            words = draw.choice(shared).split()
            a, b = sorted((draw.randrange(len(words) + 1), draw.randrange(len(words) + 1)))
            parts += [" ".join(words[a:b] if draw.random() < 0.4 else words), " ".join(f"v{draw.randrange(10**6)}" for _ in range(draw.randrange(3)))]
        texts.append("\n".join(parts))
    docs = _frame(spark, texts)
    assert _fast(docs) == _slow(as_dicts(docs))


def test_texts_that_repeat_themselves(spark):
    one = " ".join(f"x{i}" for i in range(35))
    texts = ["same " * 34, "same " * 35, "other " * 36, "third " * 4000, "a b c " * 50, one + " y " + one, one[:-1], None, "a b " * 20 + "c"]
    docs = _frame(spark, texts)
    assert _fast(docs) == _slow(as_dicts(docs))


def test_a_window_in_very_many_texts_and_copies(spark):
    common = " ".join(f"c{i}" for i in range(40))
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", f"concat_ws(' ', CASE WHEN id % 3 > 0 THEN concat('u', id) END, '{common}', CASE WHEN id % 3 > 0 THEN concat('v', id) END) AS text"
    )
    rows = _fast(docs)
    assert {(b, c) for _, b, c, _ in rows} == {(40, 40), (42, 40)}


def test_paths_are_compacted(spark):
    long = [f"p{i}" for i in range(400)]
    texts = ["q " + " ".join(long) + " r", "s " + " ".join(long) + " t", "u v " + " ".join(long[100:200]) + " w"]
    docs = _frame(spark, texts)
    spans = passages.repeated_spans(docs)
    whole = spans.groupBy("k1", "k2").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count("*").alias("n"))
    assert sorted((r["a"], r["b"]) for r in whole.collect()) == [(1, 400), (1, 400), (2, 101)]
    # Texts branch where the third leaves the others, and nowhere else.
    assert max(r["n"] for r in whole.collect()) <= 8
    assert all(r["last"] - r["first"] >= 34 for r in spans.collect())
