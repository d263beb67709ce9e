"""Connected components over links, and groups of rows that one task compares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcile.session import write_through

# Rows of a group that one task compares with one another; larger groups are cut into blocks,
# and every pair of blocks is a tile of its own.
BLOCK = 1024


def with_tiles(rows: DataFrame, group: list[str], member: Column, block: int = BLOCK) -> DataFrame:
    """Deal the rows of each group to tiles so that every two of a group meet in one tile.

    Adds ``tile_a``, ``tile_b`` and ``block``: a tile compares its rows of block ``tile_a`` with
    those of block ``tile_b``. Two rows of one block meet in the tile (b, b) only, two of blocks
    a < b in (a, b) only, so each pair is compared once. ``member`` spreads rows over blocks. No
    group column may be null.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    rows = rows.join(sizes, group)
    rows = rows.withColumn("block", F.pmod(member, F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns(
        {"tile_a": F.least("block", "other"), "tile_b": F.greatest("block", "other")}
    ).drop("other", "blocks")


def tiles_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive runs of rows with equal keys, across batches. Rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over the rows of one tile."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], np.int64)


def star_edges(nodes: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """An edge ``a, b`` from every linked node to the smallest node of its part of the tile."""
    roots = forest.roots()
    order = np.lexsort((nodes, roots))
    first = np.concatenate([[True], roots[order][1:] != roots[order][:-1]])
    least = nodes[order][first][np.cumsum(first) - 1]
    linked = nodes[order] != least
    a, b = least[linked], nodes[order][linked]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; a component is its smallest node.

    Alternates large-star and small-star steps until nothing changes. Edges stay in Spark, each
    step is written to scratch, so that a lost executor costs no more than one step.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = write_through(edges, "edges")
    state = _state(edges)
    while True:
        edges = write_through(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.union(least).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()
