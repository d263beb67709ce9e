"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: for every context of up to three bytes
that its training texts contain, how often each byte followed. A text's code length in a
language is exact: each byte is coded in its longest seen context, and a context that has not
seen the byte codes an escape first and leaves the byte to the next shorter one (method C, with
the bytes already ruled out excluded). The statistics are frozen before any text is scored, so
the code length of a byte depends on its context alone and is looked up in a table. All counts
are kept and every byte value is a symbol of its own. The tables are a file that the driver makes
language by language and Spark hands to each executor, where the workers map it into memory.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcile.llm import bytes_of
from reconcile.llm.batches import written
from reconcile.llm.bytes_of import made_once, text_bytes, text_slices

UNKNOWN = "und"

# Four-byte sequences that the driver fetches at a time, but for a language that has more.
FETCHED = 2_000_000

# Byte values: each has a symbol of its own.
SYMBOLS = 256
_ORDER = 3
_PAD = 32


@dataclass(frozen=True)
class Model:
    """Four-byte sequences of the training texts with their counts, by language, in scratch."""

    languages: list[str]
    sizes: list[int]
    counts: DataFrame

    def by_language(self, fetched: int = FETCHED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sequences of each language in order, and their counts; few languages at a time."""
        start = 0
        while start < len(self.languages):
            end, size = start + 1, self.sizes[start]
            while end < len(self.languages) and size + self.sizes[end] <= fetched:
                size += self.sizes[end]
                end += 1
            table = self.counts.filter(F.col("lang").isin(self.languages[start:end])).toArrow()
            for name in self.languages[start:end]:
                own = table.filter(pc.equal(table["lang"], name)).sort_by("gram")
                yield own["gram"].to_numpy(), own["n"].to_numpy().astype(np.float64)
            start = end

    @cached_property
    def _rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(self.by_language())

    # All of the model at once, for small ones.

    @property
    def language(self) -> np.ndarray:
        return np.repeat(np.arange(len(self._rows)), [len(gram) for gram, _ in self._rows])

    @property
    def gram(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(gram for gram, _ in self._rows)])

    @property
    def count(self) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(n for _, n in self._rows)])


def fit(training: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count what follows each context in the texts of each language.

    Rows with a null text or language teach nothing; an empty text has no bytes. With no
    training bytes at all the model has no language and predicts ``und`` for everything.
    """
    rows = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = {r["lang"]: r["size"] for r in counts.groupBy("lang").agg(F.count("*").alias("size")).collect()}
    languages = sorted(sizes)
    return Model(languages, [sizes[name] for name in languages], counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in text_slices(batch, "text"):
            names = np.array(part.column("lang").to_pylist(), dtype=object)
            grams, owner = _grams(part.column("text"))
            for name in set(names):
                own, n = np.unique(grams[(names == name)[owner]], return_counts=True)
                if name in held:
                    own, n = bytes_of.group_sums(
                        np.concatenate([held[name][0], own]), np.concatenate([held[name][1], n])
                    )
                held[name] = own, n
    for name, (own, n) in held.items():
        columns = [pa.array([name] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with three pads before each text; each byte's place, its text, and offsets."""
    data, offsets = text_bytes(column)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    stream = np.full(len(data) + _ORDER * (len(offsets) - 1), _PAD, np.uint8)
    place = np.arange(len(data)) + _ORDER * (owner + 1)
    stream[place] = bytes_of._LOWER[data]
    return stream, place, owner, offsets


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    stream, place, owner, _ = _padded(column)
    stream = stream.astype(np.int64)
    grams = np.zeros(len(place), np.int64)
    for back in range(_ORDER, -1, -1):
        grams = (grams << 8) | stream[place - back]
    return grams, owner


class _Tree(NamedTuple):
    """Code lengths in one language. Sequences are numbers of their bytes, in order."""

    low: np.ndarray  # of the second of any two bytes, in the first as its context
    escape2: np.ndarray  # from each context of two bytes; 0 if it was not seen
    gram3: np.ndarray  # sequences of three bytes seen
    bits3: np.ndarray
    context3: np.ndarray  # contexts of three bytes seen
    escape3: np.ndarray
    gram4: np.ndarray  # sequences of four bytes seen
    bits4: np.ndarray

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each four, the others being its context."""
        bits = self.low[gram & 0xFFFF]
        seen, at = _find(self.gram3, gram & 0xFFFFFF)
        bits = np.where(seen, self.bits3[at], bits + self.escape2[(gram >> 8) & 0xFFFF])
        seen, at = _find(self.context3, gram >> 8)
        bits += np.where(seen, self.escape3[at], np.float32(0))
        seen, at = _find(self.gram4, gram)
        return np.where(seen, self.bits4[at], bits)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass(frozen=True)
class _Table:
    trees: list[_Tree]

    # The same as dense arrays, for checks of small models.

    @property
    def symbol(self) -> np.ndarray:
        """Of each byte: its place among those seen in any language, 0 if it was not."""
        seen = np.unique(np.concatenate([tree.gram3 & 0xFF for tree in self.trees]))
        symbol = np.zeros(256, np.int64)
        symbol[seen] = np.arange(1, len(seen) + 1)
        return symbol

    @property
    def bits(self) -> np.ndarray:
        """[context * SYMBOLS + symbol, language] for all contexts seen; unseen bytes are alike."""
        symbol = self.symbol
        byte = np.full(SYMBOLS, np.flatnonzero(symbol == 0)[0], np.uint32)
        byte[symbol[symbol > 0]] = np.flatnonzero(symbol)
        seen = np.unique(np.concatenate([tree.context3 for tree in self.trees]))
        gram = (seen[:, None] << 8 | byte[None, :]).ravel()
        return np.stack([tree.bits(gram) for tree in self.trees], 1)


def _code_lengths(model: Model) -> _Table:
    return _Table([_tree(*rows) for rows in model.by_language()])


def _tree(gram: np.ndarray, n: np.ndarray) -> _Tree:
    """The code length of every byte in every context of one language."""
    chance = np.full((1, 256), 1 / 256)
    for order in range(2):
        counts = np.bincount(gram % 256 ** (order + 1), n, 256 ** (order + 1)).reshape(-1, 256)
        chance = _with_escape(counts, np.tile(chance, (len(counts) // len(chance), 1)))
    low = chance.ravel()
    gram3, n3 = bytes_of.group_sums(gram & 0xFFFFFF, n)
    chance3, escape2 = _seen(gram3 >> 8, n3, low[gram3 & 0xFFFF], 1 << 16)
    context3, context = np.unique(gram >> 8, return_inverse=True)
    chance4, escape3 = _seen(context, n, chance3[np.searchsorted(gram3, gram & 0xFFFFFF)], len(context3))
    bits = [_bits(chance).astype(np.float32) for chance in (low, escape2, chance3, escape3, chance4)]
    gram3, context3, gram4 = (keys.astype(np.uint32) for keys in (gram3, context3, gram))
    return _Tree(bits[0], bits[1], gram3, bits[2], context3, bits[3], gram4, bits[4])


def _seen(context: np.ndarray, n: np.ndarray, shorter: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Chances of bytes seen in their contexts, and by what each context's escape multiplies the shorter's.

    What is left of the shorter context is at least the chance of its own escape, so the
    difference below is never near the precision of a number, unless all bytes were seen.
    """
    total, distinct = np.bincount(context, n, size), np.bincount(context, minlength=size)
    escape = np.where(distinct < 256, distinct, 0)
    rest = 1 - np.bincount(context, shorter, size)
    factor = np.ones(size)
    left = escape > 0
    factor[left] = escape[left] / (total + escape)[left] / np.maximum(rest[left], 1e-30)
    return n / (total + escape)[context], factor


def _bits(chance: np.ndarray) -> np.ndarray:
    return -np.log2(np.maximum(chance, 1e-30))


def _with_escape(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances in contexts with these counts; what is unseen there follows the shorter context."""
    total, seen = counts.sum(1, keepdims=True), counts > 0
    distinct = seen.sum(1, keepdims=True)
    left = np.where(seen, 0, shorter)
    rest = left.sum(1, keepdims=True)
    escape = np.where(rest > 0, distinct, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(seen, counts / (total + escape), left / rest * (escape / (total + escape)))
    return np.where(total > 0, own, shorter)


def _handed_out(model: Model) -> tuple[str, list[list[tuple[str, int, int]]]]:
    """A file of all trees, added to the session's files: its name, and where each array of a tree is."""
    folder = tempfile.mkdtemp(prefix="reconcile-language-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"language-{uuid.uuid4().hex}"
    path, places = os.path.join(folder, name), []
    with open(path, "wb") as file:
        for rows in model.by_language():
            places.append([])
            for part in _tree(*rows):
                places[-1].append((part.dtype.str, file.tell(), len(part)))
                part.tofile(file)
    model.counts.sparkSession.sparkContext.addFile(path)
    return name, places


def _opened(name: str, places: list[list[tuple[str, int, int]]]) -> _Table:
    data = np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    trees = []
    for parts in places:
        arrays = (np.frombuffer(data, kind, size, start) for kind, start, size in parts)
        trees.append(_Tree(*arrays))
    return _Table(trees)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the chance of that language if all were equally likely.

    A text that is null or has no letter, and any text under a model without languages, is
    ``und`` with score 0. Of languages with equal code lengths the first by name is taken.
    Repeated rows are predicted alike. Columns of ``docs`` are kept, but for those of the two new
    names, which are replaced.
    """
    names = model.languages
    key, places = _handed_out(model) if names else ("", [])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = made_once(key, lambda: _opened(key, places))
        for texts in batches:
            column = pa.array(texts, pa.large_string())
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            bits = [_text_bits(table, part.column(0)) for part in text_slices(batch, "text")]
            total = np.concatenate(bits) if bits else np.zeros((0, len(names)))
            best = total.argmin(1)
            with np.errstate(over="ignore"):
                share = 1 / np.exp2(total.min(1, keepdims=True) - total).sum(1)
            yield pd.DataFrame({"lang": np.array(names, dtype=object)[best], "share": share})

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not names:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    scored = F.pandas_udf(score, "lang string, share double")(F.coalesce(F.col(text), F.lit("")))
    free = _free_name(docs)
    return (
        docs.withColumn(free, scored)
        .withColumns(
            {
                "lang_pred": F.when(known, F.col(f"{free}.lang")).otherwise(UNKNOWN),
                "score": F.when(known, F.col(f"{free}.share")).otherwise(0.0),
            }
        )
        .drop(free)
    )


def _free_name(df: DataFrame) -> str:
    name = "language_scores"
    while name in df.columns:
        name += "_"
    return name


def _text_bits(table: _Table, column: pa.Array) -> np.ndarray:
    """Code length of each text in each language."""
    offsets = text_bytes(column)[1]
    distinct, at = np.unique(_grams(column)[0].astype(np.uint32), return_inverse=True)
    total = np.zeros((len(offsets) - 1, len(table.trees)))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        for i, tree in enumerate(table.trees):
            total[filled, i] = np.add.reduceat(tree.bits(distinct)[at], offsets[:-1][filled], dtype=np.float64)
    return total


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
