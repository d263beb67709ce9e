import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconcile.llm import interpolation
from reconcile.llm.language import held_out
from reconcile.llm.queries import op5_interpolation
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing, space_words


def _tokens(text):
    return [*space_words(text), "</s>"]


def _slow(rows, weights):
    """rows: (doc_id, held, text). Scores from counts in dictionaries, and the held-out tokens' chances."""
    words, pairs, contexts = Counter(), Counter(), Counter()
    for _, held, text in rows:
        if not held:
            tokens = _tokens(text)
            words.update(tokens)
            before = ["<s>", *tokens[:-1]]
            contexts.update(before)
            pairs.update(zip(before, tokens, strict=True))
    # The end is a context of nothing; words are contexts wherever they stand.
    context = Counter(words)
    context["<s>"] = contexts["<s>"]
    n, v = sum(words.values()), len(words)
    out, held_tokens = [], []
    for doc_id, held, text in rows:
        tokens = _tokens(text)
        base, score = 0.0, 0.0
        for u, w in zip(["<s>", *tokens[:-1]], tokens, strict=True):
            base += math.log10((words[w] + 1) / (n + v + 1))
            c = context[u]
            b = min(math.frexp(c)[1], interpolation.BUCKETS - 1)
            p2 = pairs[u, w] / c if c else 0
            p1 = words[w] / n if n else 0
            score += math.log10(weights[b] @ np.array([p2, p1, 1 / (v + 1)]))
            if not held:
                held_tokens.append((u, w))
        known = sum(words[w] > 0 for w in tokens)
        out.append((doc_id, held, len(tokens), known, n, base, score))
    return out


def _check(df, rows, weights):
    got = sorted((tuple(r.values()) for r in as_dicts(df)), key=lambda r: str(r[:4]))
    expected = sorted(_slow(rows, weights), key=lambda r: str(r[:4]))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9)


@pytest.fixture
def learned(monkeypatch):
    kept = []
    learn = interpolation.learn_weights

    def keep(*args):
        kept.append(learn(*args))
        return kept[-1]

    monkeypatch.setattr(interpolation, "learn_weights", keep)
    return kept


@pytest.mark.parametrize(("chunk", "grams"), [(2_000_000, 2_000_000), (100, 700)])
def test_query_against_dictionaries(spark, monkeypatch, learned, chunk, grams):
    monkeypatch.setattr(interpolation, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(interpolation, "TASK_GRAMS", grams)
    rows = [(d["doc_id"], zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2, d["text"]) for d in documents()]
    _check(op5_interpolation(spark, SF_DIR), rows, learned[0])


def test_awkward_rows(spark, learned):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, r["text"]) for r in as_dicts(docs)]
    _check(interpolation.score_texts(docs, held_out(F.col("doc_id"), 7, 2)), rows, learned[0])
    assert interpolation.score_texts(nothing(spark), F.lit(False)).count() == 0


def test_without_training_texts(spark):
    got = as_dicts(interpolation.score_texts(awkward(spark), F.lit(True)))
    assert {r["train_tokens"] for r in got} == {0}
    assert {r["n_known"] for r in got} == {0}
    assert all(r["base_score"] == 0 for r in got)


def test_weights_raise_the_held_out_likelihood():
    rng = np.random.default_rng(5)
    bins = interpolation._BINS
    cells = np.unique(rng.integers(1, 4, 500) * bins * bins + rng.integers(0, 60, 500) * bins + rng.integers(30, 60, 500))
    n = rng.integers(1, 50, len(cells))
    weights = interpolation.learn_weights(cells, n, 1000)
    assert np.allclose(weights.sum(1), 1)

    def likelihood(w):
        b, rest = np.divmod(cells, bins * bins)
        x = np.stack(np.divmod(rest, bins), axis=1)
        p = np.column_stack([np.where(x > 0, np.exp2(-(x - 1) / interpolation._STEPS), 0), np.full(len(x), 1 / 1001)])
        return (n * np.log((p * w[b]).sum(1))).sum()

    even = np.tile([1 / 3, 1 / 3, 1 / 3], (interpolation.BUCKETS, 1))
    assert likelihood(weights) > likelihood(even)


def test_better_than_the_base_on_held_out_texts(spark):
    held = [r for r in as_dicts(op5_interpolation(spark, SF_DIR)) if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_chances_after_a_context_add_up(spark, learned):
    """Over all known words and one unknown, for a seen and an unseen context."""
    words = ["a", "b", "c", "a b", "b a"]
    train = [(i, False, w) for i, w in enumerate([*words, "a b c", "a a"])]
    scores = {}
    for first in ("a", "zzz"):
        probes = [(100 + i, True, f"{first} {w}".strip()) for i, w in enumerate(["a", "b", "c", "", "qqq"])]
        rows = train + probes
        df = spark.createDataFrame(rows, "doc_id long, held boolean, text string")
        got = {r["doc_id"]: r["score"] for r in as_dicts(interpolation.score_texts(df, F.col("held")))}
        _check(interpolation.score_texts(df, F.col("held")), rows, learned[-1])
        scores[first] = got
    assert all(s < 0 for own in scores.values() for s in own.values())
