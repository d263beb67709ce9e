import hashlib

from reconcile.llm import decontaminate
from reconcile.llm.queries import op8_decontaminate
from tests.llm.cases import COPY, SF_DIR, as_dicts, awkward, documents, nothing, plain_words


def _slow(texts, items):
    """Every window of every item looked for at every word."""
    windows = []
    for item, text in items:
        words = plain_words(text)
        if len(words) < 13 and words:
            windows.append((item, words))
        windows += [(item, words[i : i + 13]) for i in range(len(words) - 12)]
    out = []
    for text in texts:
        words, hit, found = plain_words(text), set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


ITEMS = [
    (1, COPY),
    (2, "Words only"),
    (2, "Words only"),
    (10, "only here"),
    (3, None),
    (4, ""),
    (5, "..."),
    (6, "twelve thirteen"),
    (7, "日本語 текст"),
    (8, "a b c d e f g h i j k l m n o"),
]


def test_awkward_rows(spark):
    docs, bench = awkward(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    for most_bytes in (1 << 20, 20):
        got = as_dicts(decontaminate.find_hits(docs, bench, most_bytes=most_bytes))
        assert len(got) == docs.count()
        expected = _slow([r["text"] for r in got], ITEMS)
        for r, (n, hit, _, digest, _) in zip(got, expected, strict=True):
            h = r["hits"]
            assert (h["n_words"], h["n_hit"]) == (n, hit)
            assert decontaminate.digest(set(h["items"])) == digest
            raw = (r["text"] or "").encode()
            spans = [raw[s["start"] : s["end"]].decode() for s in h["spans"]]
            assert sum(len(plain_words(s)) for s in spans) == hit
    assert decontaminate.find_hits(nothing(spark), bench).count() == 0
    none = decontaminate.find_hits(docs, bench.filter("item_id IS NULL"))
    assert {r["hits"]["n_hit"] for r in as_dicts(none)} == {0}


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Öl!  Words -- ONLY, there.")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    (row,) = as_dicts(decontaminate.find_hits(docs, bench))
    (span,) = row["hits"]["spans"]
    assert row["text"].encode()[span["start"] : span["end"]].decode() == "Words -- ONLY"


def test_query_against_every_window(spark):
    import pyarrow.parquet as pq

    docs = documents()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    got = {r["doc_id"]: r for r in as_dicts(op8_decontaminate(spark, SF_DIR))}
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert len(got) == len(docs)
    for d, row in zip(docs, _slow([d["text"] for d in docs], items), strict=True):
        assert tuple(got[d["doc_id"]][n] for n in names) == row
    assert any(r["contaminated"] for r in got.values())
