"""Passages that stand more than once, found by compacting a de Bruijn graph of words.

A window of 35 words is an edge, from its first 34 words to its last. Only edges that occur twice
matter, and few do, so windows are looked at in pieces: the least hash of six words within a
window is its anchor, and the windows in a row with the same anchor are one piece of a path. A
window that stands elsewhere has the same anchor there. So anchors are counted first, one number
for some sixteen windows, and only pieces whose anchor occurs twice are opened.

Repeated edges in a row are segments. Where a segment is always followed by the same one, and that
one never follows another, the two are compacted into one path. Every path is traced back to
where it stands in its texts, and must be at least a window long there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcile.llm.batches import written
from reconcile.llm.bytes_of import _Powers, mixed, text_bytes, text_slices, word_bounds, word_hashes
from reconcile.session import write_through

WINDOW = 35
ANCHOR = 6

# Bits of the filter over repeated anchors: 16 an anchor, and 32 MB at most. A full filter lets
# more pieces through to the join that decides; no result depends on it.
_FILTER_BITS = (1 << 16, 1 << 28)

_ANCHOR_SALT = np.uint64(0xA0761D6478BD642F)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept``.

    Removes every word inside a window of 35 words that starts anywhere else as well; ``kept`` is
    the words left, joined by single spaces. A null text has no words; a text of fewer than 35
    words keeps them all. Copies of a row are documents of their own, so nothing is left of copies
    of at least 35 words. A null id is kept as it is. Other columns are not looked at.
    """
    rows = _keyed(docs, doc_id, text)
    spans = repeated_spans(docs, text).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    rows = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Where the compacted paths of repeated windows stand in each distinct text.

    ``k1, k2`` are a text's key (as ``text_key`` gives it), ``first`` and ``last`` the positions of
    the span's words from 0, ``path`` is the same number for all spans that begin the same path.
    """
    keyed = _keyed(docs, None, text).select("k1", "k2", "text")
    anchors = _repeated_anchors(keyed)
    found = _pieces(keyed, anchors)
    segments = _segments(found)
    return _paths(write_through(found.drop("windows").join(segments, ["anchor", "piece"]), "segment-places"))


def text_key(text: str = "text") -> list:
    """Two 64-bit hashes, with different seeds, that stand for a text."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(value).alias("k1"), F.xxhash64(F.lit("passages"), value).alias("k2")]


def _keyed(docs: DataFrame, doc_id: str | None, text: str) -> DataFrame:
    key = [F.col(doc_id).cast("long").alias("doc_id")] if doc_id else []
    return docs.select(*key, *text_key(text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _repeated_anchors(texts: DataFrame) -> DataFrame:
    counted = texts.select("text").mapInArrow(_count_anchors, "anchor long, n long")
    counted = counted.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    return written(counted.select("anchor"), "anchors")


def _pieces(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct pieces of each distinct text whose anchors are repeated, with their copies."""
    bits, held = _filter_of(anchors)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit_pieces(batches, bits, held.value)

    rows = texts.mapInArrow(emit, "anchor long, k1 long, k2 long, start long, windows array<long>")
    rows = rows.join(anchors, "anchor").groupBy("k1", "k2", "start").agg(
        F.first("anchor").alias("anchor"), F.first("windows").alias("windows"), F.count("*").alias("copies")
    )
    return written(rows.withColumn("piece", F.xxhash64("windows")), "pieces")


def _segments(found: DataFrame) -> DataFrame:
    """``anchor, piece, low, high``: runs of windows, within a piece, that occur at least twice.

    The windows of one piece differ, as its anchor stands elsewhere in each. So a piece that its
    repeated anchor has no other beside is repeated as a whole, and only others are opened.
    """
    pieces = found.groupBy("anchor", "piece").agg(F.first("windows").alias("windows"), F.sum("copies").alias("n"))
    pieces = write_through(pieces, "distinct-pieces")
    several = pieces.groupBy("anchor").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("anchor")
    whole = pieces.join(several, "anchor", "left_anti").filter("n > 1")
    whole = whole.select("anchor", "piece", F.lit(0).alias("low"), (F.size("windows") - 1).alias("high"))
    opened = pieces.join(several, "anchor", "left_semi")
    edges = write_through(opened.select("anchor", "piece", "n", F.posexplode("windows").alias("at", "edge")), "edges")
    twice = edges.groupBy("anchor", "edge").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "edge")
    marked = edges.select("anchor", "piece", "at", "edge").join(twice, ["anchor", "edge"])
    order = Window.partitionBy("anchor", "piece").orderBy("at")  # a piece has at most 30 windows
    marked = marked.withColumn("run", F.col("at") - F.row_number().over(order))
    runs = marked.groupBy("anchor", "piece", "run").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    # Written, so that the join with all places of a piece can be split where a piece has many.
    return write_through(whole.unionByName(runs.drop("run")), "segments")


def _paths(places: DataFrame) -> DataFrame:
    """Compact segments that only ever follow one another; spans of the paths in each text."""
    segment = F.xxhash64("anchor", "piece", "low")
    places = places.select("k1", "k2", (F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high")).alias("b"), segment.alias("segment"))
    order = Window.partitionBy("k1", "k2").orderBy("a")  # the segments of one text
    follows = F.lag("b").over(order) + 1 == F.col("a")
    places = places.withColumn("previous", F.when(follows, F.lag("segment").over(order)))
    links = places.dropna(subset=["previous"]).groupBy("previous", "segment").agg(F.count("*").alias("texts"))
    links = write_through(links, "links")
    out = links.groupBy("previous").agg(F.count("*").alias("successors")).filter("successors = 1")
    into = links.groupBy("segment").agg(F.count("*").alias("predecessors")).filter("predecessors = 1")
    smooth = links.join(out, "previous").join(into, "segment").select("previous", "segment", F.lit(True).alias("smooth"))
    places = places.join(smooth, ["previous", "segment"], "left")
    places = places.withColumn("path_no", F.sum(F.when(F.col("smooth"), 0).otherwise(1)).over(order))
    spans = places.groupBy("k1", "k2", "path_no").agg(
        F.min("a").alias("first"), (F.max("b") + WINDOW - 1).alias("last"), F.min_by("segment", "a").alias("path")
    )
    return spans.drop("path_no")


def _filter_of(anchors: DataFrame):
    """A bitmap of the repeated anchors' hashes, broadcast; its size is bounded."""
    spark: SparkSession = anchors.sparkSession
    bits = _FILTER_BITS[0]
    wanted = 16 * anchors.count()
    while bits < min(wanted, _FILTER_BITS[1]):
        bits *= 2
    place = F.col("anchor").bitwiseAND(bits - 1) + 1  # Spark's buckets of 32,768 bits begin at 1
    rows = anchors.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")
    )
    held = bytearray(bits // 8)
    for bucket, part in rows.toLocalIterator():
        held[(bucket - 1) * 4096 : bucket * 4096] = part
    return bits, spark.sparkContext.broadcast(bytes(held))


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a slice: the row, the first word, the number of windows and the anchor of each piece, and all windows.

    Windows come text by text, so a piece's are in a row; the last array says where they begin.
    """
    data, offsets = text_bytes(batch.column("text"))
    starts, stops, first = word_bounds(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    words = word_hashes(data, starts, stops)
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none, none
    up, down = _Powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    windows = mixed((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1])
    least = mixed(((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1]) ^ _ANCHOR_SALT)
    at = np.arange(len(least))
    # The leftmost least hash of all six words that lie in a window.
    covered, span = 1, WINDOW - ANCHOR + 1
    while covered < span:
        step = min(covered, span - covered)
        left = least[:-step] <= least[step:]
        at = np.where(left, at[:-step], at[step:])
        least = np.minimum(least[:-step], least[step:])
        covered += step
    row = np.searchsorted(first, np.arange(n), "right") - 1
    whole = row[: n - WINDOW + 1] == row[WINDOW - 1 :]
    where = np.flatnonzero(whole)
    if not len(where):
        return none, none, none, none, none, none
    at, row = at[where], row[where]
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(begin, len(where)))
    anchor = least[where[begin]].view(np.int64)
    start = where[begin] - first[row[begin]]
    return row[begin], start, size, anchor, windows[where].view(np.int64), begin


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_windows(part)[3] for part in text_slices(batch, "text")]
        anchors, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(n, pa.int64())], ["anchor", "n"])


def _emit_pieces(batches: Iterator[pa.RecordBatch], bits: int, held: bytes) -> Iterator[pa.RecordBatch]:
    known = np.frombuffer(held, np.uint8)
    for batch in batches:
        for part in text_slices(batch, "text"):
            row, start, size, anchor, windows, begin = _windows(part)
            place = anchor & (bits - 1)
            kept = np.flatnonzero((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            if not len(kept):
                continue
            size = size[kept]
            offsets = np.concatenate([[0], np.cumsum(size)])
            inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(begin[kept], size)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(windows[inside], pa.int64()))
            rows = pa.array(row[kept])
            columns = [pa.array(anchor[kept]), part.column("k1").take(rows), part.column("k2").take(rows), pa.array(start[kept], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "k1", "k2", "start", "windows"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            n, removed, kept = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode().split()  # at the bytes 20 and 09 to 0D
                left, end = [], 0
                for span in spans or ():
                    left += words[end : max(end, span["first"])]
                    end = max(end, span["last"] + 1)
                left += words[end:]
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])
