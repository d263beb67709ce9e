"""Phrases of two to four words that belong together, mined best first.

Texts are coded once, in chunks, as the numbers of their frequent words; all counts are exact sums
over chunks, and no phrase is looked for whose words or pairs are not frequent. Pairs are all
counted. Longer phrases are grown from them by bounds: whatever follows a prefix, its score is at
most that of the prefix's own count against itself, since a phrase occurs no oftener than its
prefix and each cut costs at least that.

Every round takes a threshold score per language, low enough for a few thousand pairs, and grows
all prefixes whose bound reaches it. What scores at or above the threshold is then known in full,
as are the longer phrases that drop it. A language with enough survivors there is settled, ties
included; the others go on with four times as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcile.llm.batches import small_batches, written
from reconcile.llm.bytes_of import _LOWER, text_bytes, text_slices, word_bounds
from reconcile.session import write_through

LONGEST = 4
LEAST_COUNT = 30
TOP = 2000

# A phrase goes if a longer one around it has at least this share of its occurrences, in percent.
CONTAINED = 80

# Bytes of text in one chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20

# Rows that cross to the JVM at once; chunks are large, their counts small.
_CHUNKS, _ROWS = 1, 1 << 16

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True


def mine(docs: DataFrame, top: int = TOP, least_count: int = LEAST_COUNT, contained: int = CONTAINED) -> DataFrame:
    """The best phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    ``n`` counts the language's words, ``a`` the phrase, ``l`` and ``r`` its two parts at the cut
    of the lowest score; ``score`` is 2,000,000 a / (l + r), rounded down. Ranks go by score, then
    ``a``, both descending, then phrase. Reads ``lang`` and ``text`` only. A null language is
    ``und``, a null or empty text has no words, repeated rows count each. A language without
    phrases, and an empty table, have no rows.
    """
    chunks = _chunks(docs)
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    words = words.select("chunk", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    # The number that is written with a word is its code from here on.
    vocabulary = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= least_count)
    vocabulary = write_through(vocabulary.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    coded = _coded(chunks, words, vocabulary)
    corpus = _Corpus(coded, vocabulary.select("id", "f"), least_count)

    pairs = corpus.count_pairs().join(vocabulary.select(F.col("id").alias("w1"), "lang"), "w1")
    pairs = corpus.with_counts(pairs, {"f1": ["w1"], "f2": ["w2"]})
    pairs = pairs.withColumns({"score": _score("a", "f1", "f2"), "bound": _score("a", "f1", "a")})
    pairs = write_through(pairs, "pairs")
    corpus.pairs = pairs.select("w1", "w2", F.col("a").alias("f"))

    found, open_, wanted = [], pairs.select("lang").distinct(), 2 * top
    while True:
        limits = write_through(_thresholds(pairs.join(open_, "lang", "left_semi"), wanted), "thresholds")
        phrases = write_through(_round(corpus, pairs, limits, contained), "phrases")
        settled = limits.join(phrases.groupBy("lang").agg(F.count("*").alias("known")), "lang", "left")
        settled = write_through(settled.withColumn("done", (F.col("least") == 0) | (F.coalesce("known", F.lit(0)) >= top)), "settled")
        found.append(phrases.join(settled.filter("done"), "lang", "left_semi"))
        open_ = settled.filter("NOT done").select("lang")
        if not open_.head(1):
            break
        wanted *= 4
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return _ranked(rows, vocabulary, totals, top)


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"cast(2000000 AS decimal(7,0)) * cast({a} AS decimal(19,0)) div (cast({left} AS decimal(19,0)) + {right})")


def _chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "lang string, n_words long, codes binary, words array<string>, counts array<long>"
    return written(rows.mapInArrow(_code, schema).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts of one language as codes of their distinct words, 0 between pieces."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in text_slices(batch, "text", CHUNK_BYTES):
            own = int(text_bytes(part.column("text"))[1][-1])
            if held and size + own > CHUNK_BYTES:
                yield from _chunk_of(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield from _chunk_of(held)


def _chunk_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts).combine_chunks()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    own = langs.indices.to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        column = table.column("text").filter(pa.array(own == i)).combine_chunks()
        codes, words, counts, n = _words_of(column)
        if n:
            columns = [[lang], [n], [codes.tobytes()], [words], [counts.tolist()]]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "n_words", "codes", "words", "counts"])


def _words_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, int]:
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    is_word = ~(_SPACE[data] | _BREAK[data])
    starts, stops, _ = word_bounds(is_word, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int32), [], np.zeros(0, np.int64), 0
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(stops - starts, out=ends[1:])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[is_word])])
    del is_word
    coded = array.dictionary_encode()
    codes = coded.indices.to_numpy() + np.int32(1)
    # A new piece begins behind a mark, and with every text.
    marks = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    fresh = marks[1:] != marks[:-1]
    first = np.searchsorted(starts, offsets[1:-1])
    fresh[first[(first > 0) & (first < n)] - 1] = True
    codes = np.insert(codes, np.flatnonzero(fresh) + 1, 0)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    return codes, [w.decode() for w in words], np.bincount(codes, minlength=len(words) + 1)[1:], n


def _coded(chunks: DataFrame, words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each chunk's frequent words, ``ids`` ascending, and ``codes`` that count them from 1."""
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("id", "at")).alias("known"))
    rows = chunks.select("chunk", "lang", "codes").join(known, "chunk")
    with small_batches(chunks.sparkSession, _CHUNKS):
        return write_through(rows.mapInArrow(_recode, "chunk long, lang string, codes binary, ids array<long>"), "coded")


def _recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            known = batch.column("known")[i].values
            ids, at = known.field("id").to_numpy(), known.field("at").to_numpy()
            order = np.argsort(ids)
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
            new = np.zeros(max(int(codes.max(initial=0)), int(at.max(initial=0)) + 1) + 1, np.int32)
            new[at[order] + 1] = np.arange(1, len(ids) + 1, dtype=np.int32)
            codes = new[codes]
            gap = codes == 0
            codes = codes[~(gap & np.concatenate([[True], gap[:-1]]))]  # one gap stands for many
            columns = [
                batch.column("chunk").slice(i, 1), batch.column("lang").slice(i, 1),
                pa.array([codes.tobytes()], pa.binary()), pa.array([ids[order]], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "codes", "ids"])


def _rows(ids: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of phrases given as local codes, a row each, in batches."""
    names = [*(f"w{j + 1}" for j in range(grams.shape[1])), "n"]
    for a in range(0, len(n), _ROWS):
        part = ids[grams[a : a + _ROWS] - 1]
        columns = [pa.array(part[:, j], pa.int64()) for j in range(grams.shape[1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n[a : a + _ROWS], pa.int64())], names)


def _chunk_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
            yield codes.astype(np.int64), batch.column("ids")[i].values.to_numpy(), batch.slice(i, 1)


def _pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for codes, ids, _ in _chunk_arrays(batches):
        whole = (codes[:-1] > 0) & (codes[1:] > 0)
        m = len(ids) + 1
        keys, n = np.unique((codes[:-1] * m + codes[1:])[whole], return_counts=True)
        yield from _rows(ids, np.stack([keys // m, keys % m], axis=1), n)


def _grown(batches: Iterator[pa.RecordBatch], width: int, longer: bool) -> Iterator[pa.RecordBatch]:
    """Counts of phrases asked for by a chunk's row.

    ``asked`` are phrases of ``width`` words, each with ``right`` and ``left``. If ``longer``, what
    is counted are the phrases one word longer that begin with one marked ``right`` or end with one
    marked ``left``; else the phrases themselves.
    """
    for codes, ids, row in _chunk_arrays(batches):
        asked = row.column("asked")[0].values
        wanted = [asked.field(f"w{j + 1}").to_numpy() for j in range(width)]
        local = [np.minimum(np.searchsorted(ids, w), len(ids) - 1) for w in wanted]
        here = np.logical_and.reduce([ids[x] == w for x, w in zip(local, wanted, strict=True)])
        local = [x[here] + 1 for x in local]
        if not len(local[0]):
            continue
        at = _found(codes, local, len(ids) + 1)
        if longer:
            right = np.append(asked.field("right").to_numpy(zero_copy_only=False)[here], False)
            left = np.append(asked.field("left").to_numpy(zero_copy_only=False)[here], False)
            size = width + 1
            starts = np.flatnonzero((right[at[:-1]] | left[at[1:]]) & (codes[width:] > 0) & (codes[: len(codes) - width] > 0))
        else:
            size, starts = width, np.flatnonzero(at >= 0)
        if len(starts):
            grams = np.stack([codes[starts + j] for j in range(size)], axis=1)
            whole = (grams > 0).all(axis=1)
            grams, n = np.unique(grams[whole], axis=0, return_counts=True)
            yield from _rows(ids, grams, n)


def _found(codes: np.ndarray, asked: list[np.ndarray], m: int) -> np.ndarray:
    """For each place that ``width`` codes follow: the asked phrase that stands there, or -1."""
    width = len(asked)
    places = codes[: len(codes) - width + 1]
    prefix = asked[0]
    for j in range(1, width):
        keys, prefix = np.unique(prefix * m + asked[j], return_inverse=True)
        own = places * m + codes[j : len(codes) - width + 1 + j]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        places = np.where((keys[at] == own) & (places >= 0), at, -1 - m)
    which = np.empty(len(keys), np.int64)
    which[prefix] = np.arange(len(prefix))
    return np.where(places >= 0, which[np.maximum(places, 0)], -1)


class _Corpus:
    """The coded chunks, and exact counts of phrases over them."""

    def __init__(self, coded: DataFrame, vocabulary: DataFrame, least_count: int):
        self.coded, self.vocabulary, self.least_count = coded, vocabulary, least_count
        self.pairs: DataFrame | None = None

    def count_pairs(self) -> DataFrame:
        with small_batches(self.coded.sparkSession, _CHUNKS):
            rows = self.coded.mapInArrow(_pairs_in, "w1 long, w2 long, n long")
            return write_through(self._summed(rows, 2), "pair-counts")

    def _summed(self, rows: DataFrame, width: int) -> DataFrame:
        counted = rows.groupBy(*_words(width)).agg(F.sum("n").alias("a"))
        return counted.filter(F.col("a") >= self.least_count)

    def count_asked(self, asked: DataFrame, width: int, longer: bool) -> DataFrame:
        """Counts of the phrases that ``asked`` (``w1..``, ``right, left``) asks for, where frequent.

        A chunk is told of the phrases whose first word it has.
        """
        size = width + longer
        here = self.coded.select("chunk", F.explode("ids").alias("w1")).join(asked, "w1")
        here = here.groupBy("chunk").agg(F.collect_list(F.struct(*_words(width), "right", "left")).alias("asked"))
        schema = ", ".join(f"w{j + 1} long" for j in range(size)) + ", n long"

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _grown(batches, width, longer)

        with small_batches(self.coded.sparkSession, _CHUNKS):
            rows = self.coded.join(here, "chunk").select("codes", "ids", "asked").mapInArrow(grow, schema)
            return write_through(self._summed(rows, size), "phrase-counts")

    def with_counts(self, rows: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
        """Add the counts of words and pairs that stand in columns of ``rows``."""
        for name, columns in parts.items():
            known = self.vocabulary.select("id", "f") if len(columns) == 1 else self.pairs
            renamed = known.toDF(*columns, name)
            rows = rows.join(renamed, columns)
        return rows


def _words(width: int) -> list[str]:
    return [f"w{j + 1}" for j in range(width)]


def _thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """``lang, least``: the score that so many pairs of the language reach, 0 where there are fewer."""
    scores = pairs.groupBy("lang", "score").agg(F.count("*").alias("k"))  # at most 1,000,001 scores a language
    best = Window.partitionBy("lang").orderBy(F.col("score").desc())
    reached = scores.withColumn("reached", F.sum("k").over(best)).filter(F.col("reached") >= wanted)
    least = reached.groupBy("lang").agg(F.max("score").alias("least"))
    return pairs.select("lang").distinct().join(least, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))


def _lowest(cuts: list[tuple[str, str]]) -> tuple[Column, Column, Column]:
    """Score, l and r of the cut with the lowest score, the first of those that tie."""
    scores = [F.struct(_score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)]
    least = F.least(*scores) if len(scores) > 1 else scores[0]
    return least["score"], least["l"], least["r"]


def _with_score(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    score, left, right = _lowest(cuts)
    return rows.withColumns({"score": score, "l": left, "r": right})


def _round(corpus: _Corpus, pairs: DataFrame, limits: DataFrame, contained: int) -> DataFrame:
    """All surviving phrases that score at least their language's threshold."""
    pairs = pairs.join(limits, "lang")
    asked = pairs.select("w1", "w2", (F.col("bound") >= F.col("least")).alias("right"), (F.col("score") >= F.col("least")).alias("left"))
    threes = corpus.count_asked(asked.filter("right OR left"), 2, True)
    best = pairs.filter("score >= least").withColumns({"l": F.col("f1"), "r": F.col("f2")})

    # The language of a phrase is that of its words.
    named = pairs.select("w1", "w2", "lang", "least")
    scored = corpus.with_counts(threes.join(named, ["w1", "w2"]), {"f1": ["w1"], "f3": ["w3"], "f12": ["w1", "w2"], "f23": ["w2", "w3"]})
    scored = _with_score(scored, [("f1", "f23"), ("f12", "f3")])
    scored = scored.withColumn("bound", F.least(_score("a", "f1", "a"), _score("a", "f12", "a")))
    scored = write_through(scored, "threes")
    asked = scored.select(*_words(3), (F.col("bound") >= F.col("least")).alias("right"), (F.col("score") >= F.col("least")).alias("left"))
    fours = corpus.count_asked(asked.filter("right OR left"), 3, True)

    known = scored.select(*_words(3), "lang", "least", F.col("a").alias("f123"), "bound")
    rows = fours.join(known, _words(3)).filter("bound >= least").drop("bound")
    rows = corpus.with_counts(rows, {"f1": ["w1"], "f4": ["w4"], "f12": ["w1", "w2"], "f34": ["w3", "w4"]})
    rows = rows.withColumn("bound", F.least(_score("a", "f12", "f34"), _score("a", "f123", "f4"), _score("a", "f1", "a")))
    rows = write_through(rows.filter("bound >= least"), "fours")
    # The last three words of such a phrase need not have been counted yet.
    last = rows.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3")).distinct()
    missing = last.join(known.select(*_words(3)), _words(3), "left_anti")
    counted = corpus.count_asked(missing.withColumns({"right": F.lit(False), "left": F.lit(False)}), 3, False)
    counted = known.select(*_words(3), F.col("f123").alias("a")).unionByName(counted)
    rows = rows.join(counted.toDF("w2", "w3", "w4", "f234"), ["w2", "w3", "w4"])
    rows = _with_score(rows, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])

    columns = ["lang", *_words(4), "a", "l", "r", "score"]
    none = F.lit(None).cast("long")
    twos = _survivors(best, threes, 2, contained).withColumns({"w3": none, "w4": none})
    threes = _survivors(scored.filter("score >= least"), fours, 3, contained).withColumn("w4", none)
    parts = [x.select(*columns) for x in (twos, threes, rows.filter("score >= least"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _survivors(rows: DataFrame, longer: DataFrame, width: int, contained: int) -> DataFrame:
    """``rows`` without the phrases that hardly occur outside one that is a word longer.

    A phrase inside one that is two words longer is inside one between them that is as frequent.
    """
    own = _words(width)
    begins = longer.groupBy(*own).agg(F.max("a").alias("most"))
    ends = longer.groupBy(*[f"w{j + 2}" for j in range(width)]).agg(F.max("a").alias("most")).toDF(*own, "most")
    most = begins.unionByName(ends).groupBy(*own).agg(F.max("most").alias("most"))
    rows = rows.join(most, own, "left")
    share = f"100 * cast(most AS decimal(19,0)) >= {contained} * cast(a AS decimal(19,0))"
    return rows.filter(f"most IS NULL OR NOT ({share})").drop("most")


def _ranked(rows: DataFrame, vocabulary: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    for j in range(LONGEST):
        rows = rows.join(vocabulary.select(F.col("id").alias(f"w{j + 1}"), F.col("word").alias(f"word{j + 1}")), f"w{j + 1}", "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"word{j + 1}" for j in range(LONGEST)]))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)
