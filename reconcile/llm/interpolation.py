"""Language-model scores by deleted interpolation of bigrams.

The chance of a word after another mixes the bigram's relative frequency, the word's, and an
even share for every known word and one unknown. The weights depend on how often the context
was seen, in buckets by powers of two, and are learned by expectation-maximisation on held-out
counts: each training token is held out in turn, so that its own occurrence is taken off all
counts before its chances are looked up.

Counts are those of the whole corpus, so no task holds them all. Documents are cut to chunks;
each chunk asks for the counts of its distinct words and bigrams, by ranges of their hashes, and
is sent the corpus totals back. What is shuffled is a chunk's distinct n-grams, not its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcile.llm.batches import written
from reconcile.llm.bytes_of import group_sums, mixed, space_words, text_slices
from reconcile.llm.graph import tiles_of
from reconcile.session import write_through

# Tokens after which a task begins another chunk; a longer document is not divided.
CHUNK_TOKENS = 800_000

# N-grams that one task totals.
TASK_GRAMS = 1_000_000

# Buckets of contexts: never seen, then by the power of two of their count.
BUCKETS = 24

# Steps of the logarithms under which held-out tokens are pooled for the weights: four an octave.
_STEPS, _BINS = 4, 4 * 40

_END, _START = (mixed(np.array([x], np.uint64)) for x in (0xE0D, 0x57A27))
_PAIR = np.uint64(0xD6E8FEB86659FD93)

_CHUNK = (
    "chunk long, part int, docs array<long>, held array<boolean>, lengths array<long>, words binary, ids binary, "
    "n_ids long, n_grams long"
)


def _shrunk(values: np.ndarray) -> bytes:
    """An array of unsigned integers, byte by byte of all values, compressed; its type goes first."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    raw = np.ascontiguousarray(planes).tobytes()
    head = np.array([values.dtype.itemsize, len(values)], "<u8").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _grown(data: bytes) -> np.ndarray:
    size, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
    raw = pa.decompress(data[16:], decompressed_size=size * n, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n)


def _least(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, count = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in text_slices(batch, "text"):
            hashes, first = space_words(part.column("text"))
            lengths = np.diff(first) + 1
            held.append((part.column("doc_id"), part.column("held_out"), lengths, np.insert(hashes, first[1:], _END)))
            size += int(lengths.sum())
            if size >= CHUNK_TOKENS:
                yield _chunk(task << 32 | count, held)
                held, size, count = [], 0, count + 1
    if held:
        yield _chunk(task << 32 | count, held)


def _chunk(chunk: int, held: list[tuple]) -> pa.RecordBatch:
    words, ids = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
    lengths = np.concatenate([h[2] for h in held])
    pairs = len(np.unique(_bigrams(ids, lengths, len(words))))
    row = {
        "chunk": chunk,
        "part": -1,
        "docs": [x for h in held for x in h[0].to_pylist()],
        "held": [x for h in held for x in h[1].to_pylist()],
        "lengths": lengths.tolist(),
        "words": _shrunk(words),
        "ids": _shrunk(ids.astype(np.uint32)),
        "n_ids": len(ids),
        "n_grams": len(words) + 1 + pairs,
    }
    types = [
        pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(),
        pa.binary(), pa.int64(), pa.int64(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def _bigrams(ids: np.ndarray, lengths: np.ndarray, n_words: int) -> np.ndarray:
    """Context and word of each token as one number; the start of a document is word ``n_words``."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = n_words
    return before * (n_words + 1) + ids


@dataclass
class _Grams:
    """The distinct n-grams of a chunk in the order in which it asks for their counts."""

    words: np.ndarray  # hashes of words, and of the start
    pairs: np.ndarray  # numbers of bigrams
    keys: np.ndarray  # hashes of words, then of bigrams
    order: np.ndarray  # of keys by hash
    in_training: np.ndarray  # counts of keys in the chunk's training texts
    pair_of: np.ndarray  # the bigram of each token
    training: np.ndarray  # whether each token is of a training text


def _grams(row: dict) -> _Grams:
    words, ids = np.append(_grown(row["words"]), _START), _grown(row["ids"]).astype(np.int64)
    lengths = np.array(row["lengths"], np.int64)
    pairs, pair_of = np.unique(_bigrams(ids, lengths, len(words) - 1), return_inverse=True)
    training = np.repeat(~np.array(row["held"], bool), lengths)
    n_words = np.bincount(ids[training], minlength=len(words))
    n_words[-1] = (~np.array(row["held"], bool)).sum()
    n_pairs = np.bincount(pair_of[training], minlength=len(pairs))
    left, right = np.divmod(pairs, len(words))
    keys = np.concatenate([words, mixed(words[left] * _PAIR + words[right])])
    order = np.argsort(keys, kind="stable")
    return _Grams(words, pairs, keys, order, np.concatenate([n_words, n_pairs]), pair_of, training)


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of hashes that each key belongs to."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_ASK = "part int, chunk long, keys binary, is_word binary, n binary"


def _asks(chunks: DataFrame, parts: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = _grams(row)
                keys = g.keys[g.order]
                # The start is a context only: it is not among the words to be told apart.
                is_word = (g.order < len(g.words) - 1)
                n = g.in_training[g.order].astype(np.uint64)
                bounds = np.searchsorted(_parts(keys, parts), np.arange(parts + 1))
                rows = []
                for part in range(parts):
                    a, b = bounds[part], bounds[part + 1]
                    if a < b:
                        steps = np.diff(keys[a:b], prepend=np.zeros(1, np.uint64))
                        flags = np.packbits(is_word[a:b]).tobytes()
                        rows.append((part, row["chunk"], _shrunk(steps), flags, _shrunk(_least(n[a:b]))))
                columns = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                names = [f.split()[0] for f in _ASK.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return chunks.mapInArrow(ask, _ASK)


_REPLY = "chunk long, part int, totals binary, n_words long, n_tokens long"


def _replies(asks: DataFrame, parts: int) -> DataFrame:
    """The corpus totals of the keys asked for; each part's first reply has its words and tokens."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, ["part"]):
            part = tile.column("part")[0].as_py()
            keys = [np.cumsum(_grown(k.as_py()), dtype=np.uint64) for k in tile.column("keys")]
            n = np.concatenate([_grown(x.as_py()).astype(np.int64) for x in tile.column("n")])
            sizes = [len(k) for k in keys]
            words = np.concatenate(
                [np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=s) for f, s in zip(tile.column("is_word"), sizes, strict=True)]
            )
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(place, n, len(every)).astype(np.int64)
            a_word = np.zeros(len(every), bool)
            a_word[place[words > 0]] = True
            n_words, n_tokens = int((totals[a_word] > 0).sum()), int(totals[a_word].sum())
            at = 0
            for chunk, size in zip(tile.column("chunk").to_pylist(), sizes, strict=True):
                own = _shrunk(_least(totals[place[at : at + size]].astype(np.uint64)))
                columns = [[chunk], [part], [own], [n_words], [n_tokens]]
                types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                names = [f.split()[0] for f in _REPLY.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                at += size
                n_words = n_tokens = 0

    return asks.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(reply, _REPLY)


@dataclass(frozen=True)
class Frozen:
    """Corpus totals and the mixture weights of each context bucket."""

    n_tokens: int
    n_words: int
    weights: np.ndarray | None = None  # [bucket, (bigram, word, even)]


def _answered(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each chunk followed by its replies, in one task."""
    names = [f.split()[0] for f in _CHUNK.split(", ")]
    answers = replies.select("chunk", "part", F.col("totals").alias("words"))
    rows = chunks.select(*names).unionByName(answers, allowMissingColumns=True)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "part")


def _counts(tile: pa.Table) -> tuple[dict, _Grams, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk, its n-grams, and for each token the counts of bigram, context and word."""
    row, *answers = tile.to_pylist()
    g = _grams(row)
    totals = np.empty(len(g.keys), np.int64)
    totals[g.order] = np.concatenate([_grown(a["words"]).astype(np.int64) for a in answers])
    left, right = np.divmod(g.pairs, len(g.words))
    pair = totals[len(g.words) :]
    return row, g, pair[g.pair_of], totals[left][g.pair_of], totals[right][g.pair_of]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two of its count."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _share(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=np.asarray(whole) > 0)


def _binned(chance: np.ndarray) -> np.ndarray:
    """Bin 0 for a chance of nothing, else by its logarithm."""
    with np.errstate(divide="ignore"):
        steps = np.rint(-np.log2(chance) * _STEPS)
    return np.where(chance > 0, 1 + np.clip(steps, 0, _BINS - 2), 0).astype(np.int64)


def _held_out(rows: DataFrame, frozen: Frozen) -> DataFrame:
    """How many held-out tokens have which context bucket, bigram chance and word chance."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, ["chunk"]):
            _, g, pair, context, word = _counts(tile)
            pair, context, word = (x[g.training] - 1 for x in (pair, context, word))
            of_pair = _binned(_share(pair, context))
            of_word = _binned(_share(word, frozen.n_tokens - 1))
            cells = (_bucket(context) * _BINS + of_pair) * _BINS + of_word
            cells, n = group_sums(cells, np.ones(len(cells), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    return rows.mapInArrow(pool, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, n: np.ndarray, n_words: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation over pooled held-out tokens."""
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    weights[0] = [0, 0.5, 0.5]
    bucket, rest = np.divmod(cells, _BINS * _BINS)
    bins = np.stack(np.divmod(rest, _BINS), axis=1)
    chances = np.where(bins > 0, np.exp2(-(bins - 1) / _STEPS), 0)
    chances = np.column_stack([chances, np.full(len(cells), 1 / (n_words + 1))])
    for b in np.unique(bucket):
        own, times = chances[bucket == b], n[bucket == b].astype(np.float64)
        w = weights[b]
        for _ in range(rounds):
            parts = own * w
            parts /= parts.sum(1, keepdims=True)
            w = (parts * times[:, None]).sum(0) / times.sum()
        # A weight of nothing would make a text impossible that only that part knows.
        w = np.maximum(w, 1e-6) if b else np.array([0, *np.maximum(w[1:], 1e-6)])
        weights[b] = w / w.sum()
    return weights


def _scores(rows: DataFrame, frozen: Frozen) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, ["chunk"]):
            row, _, pair, context, word = _counts(tile)
            lengths = np.array(row["lengths"], np.int64)
            first = np.cumsum(lengths) - lengths
            w = frozen.weights[_bucket(context)]
            chance = w[:, 0] * _share(pair, context) + w[:, 1] * _share(word, frozen.n_tokens)
            chance += w[:, 2] / (frozen.n_words + 1)
            base = np.log10((word + 1) / (frozen.n_tokens + frozen.n_words + 1))
            columns = [
                pa.array(row["docs"], pa.int64()),
                pa.array(row["held"], pa.bool_()),
                pa.array(lengths),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
                pa.array(np.full(len(lengths), frozen.n_tokens, np.int64)),
                pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(np.log10(chance), first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(score, schema)


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all texts under a model of those not held out.

    One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end.
    ``base_score`` is the add-one unigram score and ``score`` the model's log10 probability. A
    null text is empty: its only token is the end. Repeated rows are documents of their own.
    Without any training text every count is zero. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text")
    )
    chunks = written(rows.mapInArrow(_chunks, _CHUNK), "chunks")
    parts = max(1, -(-(chunks.agg(F.sum("n_grams")).first()[0] or 0) // TASK_GRAMS))
    replies = write_through(_replies(_asks(chunks, parts), parts), "replies")
    totals = replies.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    frozen = Frozen(totals[0] or 0, totals[1] or 0)
    # At most one row per bucket and pair of bins, however large the corpus.
    pooled = _held_out(_answered(chunks, replies), frozen).toPandas()
    weights = learn_weights(pooled["cell"].to_numpy(np.int64), pooled["n"].to_numpy(np.int64), frozen.n_words)
    return _scores(_answered(chunks, replies), Frozen(frozen.n_tokens, frozen.n_words, weights))
