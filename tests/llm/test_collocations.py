"""Mined phrases against all phrases of all pieces."""

import random
import re
from collections import Counter

import pytest

from reconcile.llm import collocations
from reconcile.llm.queries import op12_collocations
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, lowered, nothing


def _slow(rows, top=2000, least=30):
    counts, totals = {}, Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(r["text"])):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3, 4):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    found = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in phrases.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        most[p[i:j]] = max(most[p[i:j]], a)
        kept = []
        for p, a in phrases.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * most[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def _fast(df):
    return sorted(tuple(r.values()) for r in as_dicts(df))


def test_query_against_all_phrases(spark):
    got = _fast(op12_collocations(spark, SF_DIR))
    assert got == _slow(documents())
    assert len(got) > 30


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert _fast(collocations.mine(docs)) == _slow(as_dicts(docs))
    assert _fast(collocations.mine(docs, least_count=1)) == _slow(as_dicts(docs), least=1)
    assert _fast(collocations.mine(nothing(spark))) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("top", [3, 40])
def test_random_texts_need_several_rounds(spark, seed, top):
    draw = random.Random(seed)
    phrases = [" ".join(f"p{draw.randrange(60)}" for _ in range(draw.randrange(2, 6))) for _ in range(60)]
    texts = []
    for i in range(300):
        parts = []
        for _ in range(draw.randrange(60)):
            parts.append(draw.choice(phrases) if draw.random() < 0.5 else f"w{min(draw.randrange(60), draw.randrange(60))}")
            parts.append(draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]))
        texts.append(("".join(parts).title(), draw.choice(["en", "en", "fr", None, "und"])))
    docs = spark.createDataFrame(texts, "text string, lang string")
    rows = as_dicts(docs)
    assert _fast(collocations.mine(docs, top=top, least_count=5)) == _slow(rows, top, 5)


def test_small_chunks_of_many_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(f"alpha beta gamma{i % 3} delta alpha, beta", "en") for i in range(200)], "text string, lang string")
    whole = _fast(collocations.mine(docs))
    assert whole == _slow(as_dicts(docs))
    chunks = list(collocations._code(iter(docs.select("lang", "text").toArrow().to_batches())))
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 500)
    small = list(collocations._code(iter(docs.select("lang", "text").toArrow().to_batches())))
    assert len(small) > len(chunks) and sum(b.column("n_words")[0].as_py() for b in small) == 1200
