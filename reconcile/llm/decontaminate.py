"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words between single spaces, and every window of 13 item
words is one pattern. A document is scanned once, whatever the number of patterns; a hit's
position is brought back to the words, and so to the bytes, of the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.llm.bytes_of import made_once

WINDOW = 13

# Bytes of benchmark text that one automaton may hold; a larger benchmark is split into several.
MOST_BYTES = 32 << 20

# Bytes outside words become spaces, A-Z become a-z.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

HITS = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<start: long, end: long>>"
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    """Runs of ``window`` words; an item of fewer words, but not none, is one window."""
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def build(items: list[tuple[str, bytes]], window: int = WINDOW) -> ahocorasick.Automaton:
    """One automaton over the windows of all items; each pattern knows its words and its items."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for pattern in windows_of(normal_words(text), window):
            owners.setdefault(pattern, set()).add(item)
    automaton = ahocorasick.Automaton()
    for pattern, names in owners.items():
        # Latin-1 keeps one character per byte, so positions are those of the bytes.
        automaton.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, sorted(names)))
    automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, text: bytes) -> tuple[int, np.ndarray, set[str], list[tuple[int, int]]]:
    """Number of words, which are hit, the items found, and the hit runs as bytes of the text."""
    plain = text.translate(_NORMAL)
    words = plain.split()
    if not words or not len(automaton):
        return len(words), np.zeros(0, np.int64), set(), []
    joined = f" {b' '.join(words).decode('latin-1')} "
    found = [(end, value) for end, value in automaton.iter(joined)]
    if not found:
        return len(words), np.zeros(0, np.int64), set(), []
    lengths = np.array([len(w) for w in words])
    stops = np.cumsum(lengths + 1)  # where the space after each word stands
    change = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for end, (n, names) in found:
        last = bisect_left(stops, end)
        change[last - n + 1] += 1
        change[last + 1] -= 1
        items.update(names)
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return len(words), hit, items, _runs(plain, lengths, hit)


def _runs(plain: bytes, lengths: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    data = np.frombuffer(plain, np.uint8) != 32
    starts = np.flatnonzero(data & ~np.concatenate([[False], data[:-1]]))
    first = hit[np.concatenate([[True], np.diff(hit) > 1])]
    last = hit[np.concatenate([np.diff(hit) > 1, [True]])]
    return list(zip(starts[first].tolist(), (starts[last] + lengths[last]).tolist(), strict=True))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_bytes: int = MOST_BYTES,
    name: str = "hits",
) -> DataFrame:
    """Add ``name``: number of words, hit words, the items found, and the hit byte spans.

    A column of that name is replaced; other columns are kept and not looked at. A null or
    empty text has no words and no hits; a null item text has no windows, a null item
    id counts as the id ``null``. Repeated items count once by id. The benchmark's size is
    checked: beyond ``most_bytes`` its items are dealt to several automata, and the documents'
    hits are united, so none is lost. The benchmark itself must fit the driver.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")
    ).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // most_bytes))
    automata, key = [], uuid.uuid4().hex
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        rows = own.distinct().collect()
        automata.append(spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in rows]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = made_once(key, lambda: [build(shared.value, window) for shared in automata])
        for column in batches:
            rows = []
            for value in column:
                raw = value.as_py()
                n, hits, names, plain = 0, [], set(), (raw or "").encode()
                for automaton in ready:
                    n, hit, own, _ = scan(automaton, plain)
                    names |= own
                    if len(hit):
                        hits.append(hit)
                spans, every = [], np.zeros(0, np.int64)
                if hits:
                    every = np.unique(np.concatenate(hits))
                    words = plain.translate(_NORMAL)
                    spans = _runs(words, np.array([len(w) for w in words.split()]), every)
                rows.append(
                    {
                        "n_words": n,
                        "n_hit": len(every),
                        "items": sorted(names),
                        "spans": [{"start": a, "end": b} for a, b in spans],
                    }
                )
            yield pa.array(rows, _HIT_TYPE)

    hits = F.arrow_udf(find, HITS)
    return docs.withColumn(name, hits(F.col(text).cast("string")))


_HIT_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def contaminated(hits: str = "hits"):
    """At least a twentieth of the words stand inside a benchmark window."""
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    name = "benchmark_hits"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return find_hits(docs, benchmark, text, name=name).filter(~contaminated(name)).drop(name)


def items_digest(hits: str = "hits"):
    """SHA-256 of the sorted item ids, comma-joined; of the empty text if there are none."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.col(f"{hits}.items"))), 256)


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
