import duckdb

from reconcile.llm import licenses
from reconcile.llm.queries import op6_licenses
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing, plain_words

TEXTS = [
    "Released under the MIT License.",
    "the MIT license, the mit\nLICENSE and an Apache License, Version 2.0",
    "Licensed under the Apache License, Version 2.0.",
    "license mit apache public general",
    "This is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0",
    "cc by 4 0 cc by nc 4 0 cc by sa 4 0",
    "mit L\u0130CENSE mit licen\u212ae mit license",
    "Apache license version 2 0 apache license version 2 0",
    "é mit license ß " * 50,
    "permission to use, copy, modify, and/or distribute this software for any purpose",
    "general public license general public license",
    "license",
    "",
    None,
]


def _slow(text):
    words = plain_words(text)
    begins, base, labels, score = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        key = t.phrase.split()
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] == key:
                labels.add(t.label)
                if t.base:
                    begins.append(i)
                    base.add(t.label)
                    score = max(score, licenses.BASE_SCORE)
                    continue
                at = [i - t.start + j for j in range(len(t.words))]
                hits = sum(0 <= a < len(words) and words[a] == w for a, w in zip(at, t.words, strict=True))
                score = max(score, hits / len(at))
    ends = (min(begins), max(begins)) if begins else (None, None)
    return (len(words), len(begins), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score)


def _rows(df):
    return sorted((tuple(r.values()) for r in as_dicts(df.select(*NAMES))), key=str)


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_texts_against_every_place(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert _rows(licenses.scan(docs)) == sorted(((i, *_slow(t)) for i, t in enumerate(TEXTS)), key=str)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert _rows(licenses.scan(docs)) == sorted(((r["doc_id"], *_slow(r["text"])) for r in as_dicts(docs)), key=str)
    assert licenses.scan(nothing(spark)).count() == 0


def test_query_against_every_place_and_sql(spark):
    got = _rows(op6_licenses(spark, SF_DIR))
    assert got == sorted(((d["doc_id"], *_slow(d["text"])) for d in documents()), key=str)
    assert any(r[6] for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    rows = con.execute(f"SELECT {', '.join(NAMES)} FROM ({licenses.oracle()})").fetchall()
    assert sorted(rows, key=str) == got


def test_no_python_in_tasks(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("Python", "Pandas", "Arrow") if n in plan]
