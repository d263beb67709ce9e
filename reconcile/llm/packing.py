"""Bounded-space online packing of documents into sequences of token ids.

Each task keeps a fixed number of open windows. A document's ids go into the window that they
fit best; when they fit none, the fullest window is filled with their head and emitted, and the
rest goes on. What is left open at the end of the tasks is merged in small groups of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.llm.batches import written
from reconcile.llm.bytes_of import text_slices
from reconcile.llm.token_ids import word_ids

LENGTH = 4096
WINDOWS = 32

# Gaps below this are left as padding, not filled with a document's head.
LEAST_CUT = 16

# Tasks whose open windows one merge takes in: at most this many times WINDOWS sequences.
MERGED_TASKS = 64

_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, task long, ids binary"
)


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: memoryview

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.doc_tokens, self.ids[: 4 * length])
        return head, Piece(self.doc_id, self.start + length, self.doc_tokens, self.ids[4 * length :])


@dataclass
class Packer:
    """The open windows of one task; ``closed`` gathers sequences until they are taken."""

    length: int = LENGTH
    windows: int = WINDOWS
    open: list[tuple[int, list[Piece]]] = field(default_factory=list)  # ids held, pieces
    closed: list[list[Piece]] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        while piece.length > self.length:
            head, piece = piece.cut(self.length)
            self.closed.append([head])
        while piece.length:
            fitting = [i for i, (held, _) in enumerate(self.open) if held + piece.length <= self.length]
            if fitting:
                best = max(fitting, key=lambda i: self.open[i][0])
                held, pieces = self.open[best]
                self.open[best] = held + piece.length, [*pieces, piece]
                if self.open[best][0] == self.length:
                    self.closed.append(self.open.pop(best)[1])
                return
            if len(self.open) < self.windows:
                self.open.append((0, []))
                continue
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            held, pieces = self.open.pop(fullest)
            if self.length - held >= LEAST_CUT:
                head, piece = piece.cut(self.length - held)
                pieces = [*pieces, head]
            self.closed.append(pieces)

    def merge(self) -> None:
        """Close all windows, the fullest first, each filled up from those after it."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        held, pieces = 0, []
        for piece in rest:
            while held + piece.length > self.length:
                head, piece = piece.cut(self.length - held)
                self.closed.append([*pieces, head])
                held, pieces = 0, []
            if piece.length:
                held, pieces = held + piece.length, [*pieces, piece]
            if held == self.length:
                self.closed.append(pieces)
                held, pieces = 0, []
        if pieces:
            self.closed.append(pieces)


def _rows(sequences: list[list[Piece]], first: int | None, task: int, keep_ids: bool) -> pa.RecordBatch:
    """Rows of whole sequences numbered from ``first``, or of open windows if that is None."""
    rows = []
    for i, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            sequence = None if first is None else first + i
            ids = bytes(p.ids) if keep_ids else None
            rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence, offset, task, ids))
            offset += p.length
    columns = list(zip(*rows, strict=True)) or [()] * 9
    types = [pa.int64()] * 8 + [pa.binary()]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    windows: int = WINDOWS,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack the ids of all documents, each with its end id, into sequences of ``length``.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``,
    and ``ids`` (little-endian unsigned 32-bit) if asked for. A null text is empty and has only
    its end id. Repeated rows are packed once each; null ids stay null. An empty table has no
    pieces. Only the two named columns are read, so others may have any name.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, count = Packer(length, windows), 0
        ids = word_ids(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                names = part.column("doc_id").to_pylist()
                for name, own in zip(names, ids.of(part.column("text").to_pylist()), strict=True):
                    packer.add(Piece(name, 0, len(own) // 4, memoryview(own)))
                yield _rows(packer.closed, task << 32 | count, task, keep_ids)
                count += len(packer.closed)
                packer.closed = []
        yield _rows([pieces for _, pieces in packer.open], None, task, True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, Packer(length, windows)
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if group is not None:
                        packer.merge()
                        yield _rows(packer.closed, 1 << 62 | group << 32, group, keep_ids)
                    group, packer = row["group"], Packer(length, windows)
                packer.add(Piece(row["doc_id"], row["start"], row["doc_tokens"], memoryview(row["ids"])))
        if group is not None:
            packer.merge()
            yield _rows(packer.closed, 1 << 62 | group << 32, group, keep_ids)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    filled = written(rows.mapInArrow(fill, _SCHEMA), "packed")
    left = filled.filter("sequence_id IS NULL").withColumn("group", F.floor(F.col("task") / MERGED_TASKS))
    left = left.repartition("group").sortWithinPartitions("group", F.col("length").desc(), "task", "doc_id", "start")
    packed = filled.filter("sequence_id IS NOT NULL").unionByName(left.mapInArrow(merge, _SCHEMA))
    return packed.drop("task") if keep_ids else packed.drop("task", "ids")
