"""Token ids of whole texts, and their files: Simple-8b words in Parquet rows.

The tokenizer splits at white space and drops it, so a text's ids are those of its words one
after another. Each task asks the library for the words that it has not met, and copies the ids of
the others.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from reconcile.llm.batches import small_batches
from reconcile.llm.bytes_of import made_once, text_slices

END_ID = 2

# Words of a generation that a worker remembers, and the longest of them. A word that does not
# come in a whole generation is forgotten, so memory is bounded and frequent words stay known.
_KNOWN_WORDS = 200_000
_LONGEST_KNOWN = 48

# Unknown words that the library codes in one call, and the end of a word's last token.
_CODED_TOGETHER = 500
_WORD_END = "</w>"

# What each byte is to the cutting of texts into words. Between a letter, of ASCII or of two bytes
# that begin with C3, and one of these marks the tokenizer always cuts. The apostrophe is not among
# them, as it may begin a contraction. The signs for times and division are not letters.
_BLANKS = bytes([32, *range(9, 14)])
_BLANK, _OTHER, _LETTER, _MARK, _LEAD, _LATIN = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(_BLANKS)] = _BLANK
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_KINDS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _MARK
_KINDS[0x80:0xC0] = _LATIN
_KINDS[[0x97, 0xB7]] = _OTHER
_KINDS[0xC3] = _LEAD
_KIND_OF = _KINDS.tobytes()


class _Known:
    """Ids of words, end to end in one array, and where those of each word begin."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = array("I")
        self.begins = array("q", [0])

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append the ids of words, which are end to end as well; the place of each word."""
        at = len(self.begins) - 1
        stops = len(self.ids) + np.cumsum(sizes, dtype=np.int64)
        self.ids.frombytes(ids.astype("<u4").tobytes())
        self.begins.frombytes(stops.tobytes())
        self.place.update((word, i) for i, word in enumerate(words, at) if len(word) <= _LONGEST_KNOWN)
        return np.arange(at, at + len(words))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 if there is none."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def ids_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the places, end to end, and where those of each place begin and end."""
        begins = np.frombuffer(self.begins, np.int64)
        first = begins[places]
        sizes = (begins[places + 1] - first).astype(np.int32)
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        # Where each id is found: the places of a word's ids, one behind another.
        at = np.repeat((first - stops[:-1]).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return np.frombuffer(self.ids, "<u4")[at] if len(at) else np.zeros(0, "<u4"), stops


class WordIds:
    """Ids of texts under one tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        # A task has one core; threads of the library's own would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # The same model for words of small ASCII letters, which nothing normalizes or cuts.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.known, self.older = _Known(), _Known()

    def of(self, texts: list[str | None], end_id: int = END_ID) -> list[bytes]:
        """The ids of each text and one end id; a null text is an empty one.

        The distinct words of all texts are looked up once, and their ids copied to every place.
        """
        codes, words, first = _words([(text or "").encode() for text in texts])
        if len(self.known.place) > _KNOWN_WORDS:
            self.known, self.older = _Known(), self.known
        ids, stops = self.known.ids_at(self._places(words)[codes])
        end = np.array([end_id], "<u4").tobytes()
        bounds = stops[first].tolist()
        return [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each word begin in ``known``, to which those that it lacks are added."""
        found = self.known.places(words)
        lacking = np.flatnonzero(found < 0)
        before = self.older.places([words[i] for i in lacking])
        again = lacking[before >= 0]
        ids, stops = self.older.ids_at(before[before >= 0])
        found[again] = self.known.add([words[i] for i in again], ids, np.diff(stops))
        plain, letters, others = [], [], []
        for i in lacking[before < 0].tolist():
            word = words[i]
            kind = plain if word.isalpha() and word.islower() else letters if word.decode().lower().isalpha() else others
            kind.append(i)
        for kind, code in ((plain, self._plain), (letters, self._together), (others, self._apart)):
            for at in range(0, len(kind), _CODED_TOGETHER):
                own = kind[at : at + _CODED_TOGETHER]
                new = [words[i] for i in own]
                found[own] = self.known.add(new, *code(new))
        return found

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._together(words, self.plain)

    def _together(self, words: list[bytes], tokenizer: Tokenizer | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words of letters alone, end to end, and how many each word has.

        Such a word is one part to the tokenizer, and the last id of a part is told by its token.
        """
        text = b" ".join(words).decode()
        ids = np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words) and stops[-1] == len(ids):
            return ids, np.diff(stops, prepend=0)
        return self._apart(words)

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of any words, end to end, and how many each word has."""
        coded = self.tokenizer.encode_batch_fast([word.decode() for word in words], add_special_tokens=False)
        ids = [word.ids for word in coded]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


def _words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of the words of all texts, the distinct words, and each text's first word.

    Words are parts that the tokenizer codes one by one, in fewer spellings than the text's. White
    space is cut away. As the tokenizer lower-cases and cuts before marks, so does this for ASCII,
    and cuts so behind letters of two bytes that begin with C3.
    Texts in which that could change what the tokenizer sees, by a special token or a combining
    mark after a letter, are cut at white space only.
    """
    as_is = [b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts]
    low = [t if keep else t.lower() for t, keep in zip(texts, as_is, strict=True)]
    data = b"".join(low)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    kind = np.frombuffer(data.translate(_KIND_OF), np.uint8)
    is_word = kind != _BLANK
    letter = kind == _LETTER
    letter[1:] |= (kind[1:] == _LATIN) & (kind[:-1] == _LEAD)
    cut = np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & (kind[1:] == _MARK)
    for i in np.flatnonzero(as_is):
        cut[offsets[i] : offsets[i + 1]] = False
    cut[1:] |= ~is_word[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = is_word & cut
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | begin[1:]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(len(texts) + 1, np.int64)
    ends = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    body = pa.py_buffer(data.translate(None, _BLANKS))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), body]).dictionary_encode()
    _, bounds, distinct = coded.dictionary.buffers()
    distinct = distinct.to_pybytes()
    bounds = np.frombuffer(bounds, np.int64, len(coded.dictionary) + 1).tolist()
    words = [distinct[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return coded.indices.to_numpy(), words, np.searchsorted(starts, offsets)


def word_ids(path: str) -> WordIds:
    return made_once(f"tokenizer {path}", lambda: WordIds(path))


# Fixed values of the word layout: how many integers of how many bits a selector stands for.
# The last selector is the escape: its payload is the place of one value among the block's
# larger values, which follow the words.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60)
ESCAPE = 14
_PAYLOAD = np.uint64((1 << 60) - 1)
# The narrowest width for values of each number of bits; 61 is none.
_WIDTH_FOR = np.array([min((w for w in WIDTHS if w >= bits), default=61) for bits in range(65)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """The width that each value needs. Doubles tell the bits of what they hold exactly."""
    bits = np.frexp(values.astype(np.float64))[1]
    for i in np.flatnonzero(values >= np.uint64(1 << 53)):
        bits[i] = int(values[i]).bit_length()
    return _WIDTH_FOR[bits]


# Integers per block. Blocks are coded apart from each other.
BLOCK = 1024
_MAGIC = b"S8B1"

# Blocks that are coded side by side.
_BLOCKS = 512


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Simple-8b: a header, the word and escape offsets of each block, then words and escapes.

    Values are unsigned 64-bit; those of more than 60 bits are escapes.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    words, first_word, escapes, first_escape = [], [0], [], [0]
    for at in range(0, n, _BLOCKS * block):
        own, counts, large, larges = _encode_blocks(values[at : at + _BLOCKS * block], block)
        words.append(own)
        escapes.append(large)
        first_word.extend((first_word[-1] + np.cumsum(counts)).tolist())
        first_escape.extend((first_escape[-1] + np.cumsum(larges)).tolist())
    head = np.array([n, block, -(-n // block)], "<u8").tobytes()
    index = np.array(first_word + first_escape, "<u8").tobytes()
    body = b"".join(x.astype("<u8").tobytes() for x in (*words, *escapes))
    return _MAGIC + head + index + body


def _encode_blocks(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(values)
    blocks = -(-n // block)
    # Bits of each value, with room after each block that fits no word.
    bits = np.full((blocks, block + COUNTS[0]), 255, np.uint8)
    flat = np.full(blocks * block, 255, np.uint8)
    flat[:n] = _widths(values)
    bits[:, :block] = flat.reshape(blocks, block)
    # The widest value of the run of each length from each place on; the longest that fits is best.
    selector = np.where(flat.reshape(blocks, block) > 60, ESCAPE, ESCAPE - 1).astype(np.uint8)
    widest, length = bits, 1
    for s in range(ESCAPE - 2, -1, -1):
        more = COUNTS[s] - length
        while more:
            step = min(more, length)
            widest = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            length, more = length + step, more - step
        np.copyto(selector, np.uint8(s), where=widest[:, :block] <= WIDTHS[s])
    selector = selector.reshape(-1)
    taken = np.array(COUNTS)[selector]
    # Follow the words of all blocks side by side.
    at = np.arange(blocks) * block
    stop = np.minimum(at + block, n)
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + taken[at]
        going = at < stop
        at, stop = at[going], stop[going]
    place = np.flatnonzero(begins)
    counts = np.bincount(place // block, minlength=blocks)
    chosen = selector[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(zip(COUNTS[:-1], WIDTHS[:-1], strict=True)):
        at_s = np.flatnonzero(chosen == s)
        for i in range(count if len(at_s) else 0):
            words[at_s] |= values[place[at_s] + i] << np.uint64(width * i)
    large = np.flatnonzero(values > _PAYLOAD)
    larges = np.bincount(large // block, minlength=blocks)
    rank = np.arange(len(large)) - np.concatenate([[0], np.cumsum(larges)])[large // block]
    words[chosen == ESCAPE] |= rank.astype(np.uint64)
    return words, counts, values[large], larges


def decode(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The integers of the given blocks, all of them by default; other blocks are not touched."""
    if data[:4] != _MAGIC:
        raise ValueError("not a Simple-8b file")
    n, block, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 4))
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    index = np.frombuffer(data, "<u8", 2 * (blocks + 1), 28).astype(np.int64)
    first_word, first_escape = index[: blocks + 1], index[blocks + 1 :]
    base = 28 + 16 * (blocks + 1)
    low, high = first_word[first_block], first_word[last_block]
    words = np.frombuffer(data, "<u8", high - low, base + 8 * low)
    escapes = np.frombuffer(data, "<u8", first_escape[-1], base + 8 * first_word[-1])
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen]
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS[:-1], WIDTHS[:-1], strict=True)):
        at_s = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << bits) - 1)
        for i in range(count if len(at_s) else 0):
            out[place[at_s] + i] = (words[at_s] >> np.uint64(bits * i)) & mask
    at_s = np.flatnonzero(chosen == ESCAPE)
    if len(at_s):
        of_block = np.searchsorted(first_word, at_s + low, "right") - 1
        out[place[at_s]] = escapes[first_escape[of_block] + (words[at_s] & _PAYLOAD).astype(np.int64)]
    return out


# Ids that one file row holds at most before a new row begins, but for one longer document.
ROW_IDS = 1 << 19


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None
) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order under ``path``.

    A Parquet row is one run of documents: their ids in ``doc_ids``, their lengths in
    ``lengths``, and all their token ids in ``ids`` as Simple-8b. ``shard`` and ``row`` give the
    order, and ``before`` counts the ids of the shard before the row. A null text is empty and has the end id only; a null id comes first; documents of
    equal id are ordered by a hash of their text, and those of equal text too are alike. An empty table writes
    no rows.
    """
    spark = docs.sparkSession
    n = partitions or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    rows = rows.withColumn("shard", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        names, blobs, shard, row, held, before = [], [], 0, 0, 0, 0
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 22):
                shard = part.column("shard")[0].as_py()
                names += part.column("doc_id").to_pylist()
                new = ids.of(part.column("text").to_pylist())
                blobs += new
                held += sum(map(len, new)) // 4
                if held >= ROW_IDS:
                    yield _file_row(shard, row, before, names, blobs)
                    names, blobs, row, held, before = [], [], row + 1, 0, before + held
        if names:
            yield _file_row(shard, row, before, names, blobs)

    schema = "shard int, row int, before long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"
    with small_batches(spark):
        rows.mapInArrow(pack, schema).write.parquet(path)


def _file_row(shard: int, row: int, before: int, names: list, blobs: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(blobs), "<u4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()),
            pa.array([row], pa.int32()),
            pa.array([before], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([names], pa.list_(pa.int64())),
            pa.array([[len(b) // 4 for b in blobs]], pa.list_(pa.int64())),
            pa.array([encode(ids)], pa.binary()),
        ],
        ["shard", "row", "before", "n_ids", "doc_ids", "lengths", "ids"],
    )


def read_ids(spark, path: str) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit).

    ``start`` counts the ids of all documents before.
    """
    files = spark.read.parquet(path)
    return _positioned(files).mapInArrow(_unpack, "doc_id long, start long, n_tokens long, ids binary")


def read_digests(spark, path: str) -> DataFrame:
    """As ``read_ids``, with the ids' unsigned crc32 in place of the ids."""
    files = spark.read.parquet(path)
    return _positioned(files).mapInArrow(
        _unpack_digests, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _positioned(files: DataFrame) -> DataFrame:
    # One row per shard, so no more than the partitions that were written: small enough for a
    # window in one task and for a broadcast.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(earlier), F.lit(0)).alias("first"))
    return files.join(F.broadcast(shards), "shard").withColumn("first", F.col("first") + F.col("before"))


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, bytes]]:
    for row in batch.to_pylist():
        lengths = np.array(row["lengths"], np.int64)
        stops = np.cumsum(lengths)
        yield row["doc_ids"], row["first"] + stops - lengths, lengths, decode(row["ids"]).astype("<u4").tobytes()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, starts, lengths, data in _spans(batch):
            own = [data[4 * b - 4 * n : 4 * b] for b, n in zip(np.cumsum(lengths), lengths, strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def _unpack_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, starts, lengths, data in _spans(batch):
            view, stops = memoryview(data), np.cumsum(lengths)
            crc = [zlib.crc32(view[4 * b - 4 * n : 4 * b]) for b, n in zip(stops, lengths, strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
