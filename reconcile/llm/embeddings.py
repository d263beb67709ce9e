"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of unit length are projected on many random lines. Two vectors of cosine c differ on a
line by a normal number of variance 2 - 2c, so a window around the query's projection that
reaches far enough holds a near vector on nearly every line, and any other on few. Pairs that
collide on at least a calibrated number of lines are verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.llm.graph import Forest, components, star_edges, tiles_of, with_tiles
from reconcile.session import write_through

THRESHOLD = 0.98
LINES = 24

# Lines on which the vectors are sorted into strips; a pair is compared only if it lies in
# neighbouring strips of all of them.
SORTED = 2

# Chance that a pair at the threshold itself is found.
RECALL = 0.99

_SEED = 20_240_229


@dataclass(frozen=True)
class Windows:
    """Half-widths of the windows and the collisions a pair needs."""

    strip: float
    window: float
    count: int


def calibrate(threshold: float = THRESHOLD, lines: int = LINES, recall: float = RECALL) -> Windows:
    """Windows under which a pair at the threshold is found with the given chance.

    A third of the allowed loss goes to the strips, the rest to the count over all lines.
    """
    spread = math.sqrt(2 - 2 * threshold)
    loss = (1 - recall) / 3
    strip = _half_width(1 - loss / SORTED)
    window = 2.0
    hit = math.erf(window / math.sqrt(2))
    count = lines
    missed = 1 - hit**lines
    while missed > 2 * loss and count > 1:
        count -= 1
        missed -= math.comb(lines, count) * hit**count * (1 - hit) ** (lines - count)
    return Windows(strip * spread, window * spread, count)


def _half_width(chance: float) -> float:
    low, high = 0.0, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < chance else (low, middle)
    return high


def _lines(dims: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dims]).standard_normal((dims, LINES))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square overflows or vanishes.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def link(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null and they have as many
    dimensions. A vector that is null, empty or zero, or has a null or non-finite component,
    links with nothing: it has no links and is its own component. Equal vectors are compared as
    one and all link with each other. Repeated rows are vectors of their own, each a link of the
    other. A component's id is its smallest ``vec_id``; a null id is kept only where all are null.
    """
    windows = calibrate(threshold, LINES, recall)
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("label")
    )
    sound = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    able = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    key = F.when(able, F.xxhash64("label", F.transform("x", lambda c: c + F.lit(0.0))))
    rows = rows.withColumn("node", key)
    # Equal vectors are one node: first() sees the same vector whichever row it takes.
    nodes = rows.dropna(subset=["node"]).groupBy("node").agg(
        F.count("*").alias("copies"), F.first("x").alias("x"), F.first("label").alias("label")
    )
    nodes = write_through(nodes.withColumn("dims", F.size("x")), "vectors")
    found = _in_strips(nodes, windows, threshold)
    found = write_through(found, "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    parts = components(found.filter("b IS NOT NULL"))
    ids = nodes.select("node", "copies").join(links, "node", "left").join(parts, "node", "left")
    ids = ids.select(
        "node",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("part"),
    )
    rows = rows.select("vec_id", "node").join(ids, "node", "left")
    least = rows.dropna(subset=["part"]).groupBy("part").agg(F.min("vec_id").alias("least"))
    out = rows.join(least, "part", "left")
    component = F.when(F.col("part").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _in_strips(nodes: DataFrame, windows: Windows, threshold: float) -> DataFrame:
    """Rows ``a, b`` that join linked nodes, and rows ``a, n`` with links to add to a node."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dims in sorted(set(table.column("dims").to_pylist())):
                own = table.filter(pc.equal(table.column("dims"), dims))
                strips = np.floor(_unit(_matrix(own.column("x"))) @ _lines(dims)[:, :SORTED] / windows.strip)
                strips = strips.astype(np.int64)
                # Each row is at home in its own strips and visits those that come before, on the
                # first line on which they differ; so two strips meet in one place only.
                moves = [m for m in np.ndindex(*[3] * SORTED)]
                for move in np.array(moves) - 1:
                    first = next((int(x) for x in move if x), 0)
                    if first > 0:
                        continue
                    names = [pa.array(own.column(c).combine_chunks()) for c in ("node", "copies", "label", "dims", "x")]
                    at = strips + move
                    cells = [pa.array(at[:, i]) for i in range(SORTED)]
                    home = pa.array(np.full(len(own), first == 0))
                    yield pa.RecordBatch.from_arrays([*names, *cells, home], [*_NODE, *_CELLS, "home"])

    label = dict(nodes.dtypes)["label"]
    schema = f"node long, copies long, label {label}, dims int, x array<double>"
    schema += "".join(f", {c} long" for c in _CELLS) + ", home boolean"
    placed = nodes.select(*_NODE).mapInArrow(place, schema)
    placed = placed.withColumn("cell", F.xxhash64("label", "dims", *_CELLS))
    placed = with_tiles(placed, ["cell"], F.xxhash64("node"))
    keys = ["cell", "tile_a", "tile_b"]
    dealt = placed.select(*keys, "block", "home", "node", "copies", "label", "dims", "x", *_CELLS)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, keys):
            yield from _compare(tile, windows, threshold)

    return dealt.mapInArrow(compare, "a long, b long, n long")


_NODE = ["node", "copies", "label", "dims", "x"]
_CELLS = [f"strip_{i}" for i in range(SORTED)]


def _compare(tile: pa.Table, windows: Windows, threshold: float) -> Iterator[pa.RecordBatch]:
    node = tile.column("node").to_numpy()
    home = tile.column("home").to_numpy(zero_copy_only=False)
    block = tile.column("block").to_numpy()
    a, b = tile.column("tile_a")[0].as_py(), tile.column("tile_b")[0].as_py()
    if len(node) < 2 or not home.any():
        return
    # A cell is a hash, so cells that merely share it are told apart.
    cell = np.array([tile.column(c).to_numpy() for c in ("dims", *_CELLS)]).T
    label = np.unique(np.array(tile.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
    cell = np.column_stack([cell, label])
    copies = tile.column("copies").to_numpy()
    forest, links = Forest(len(node)), np.zeros(len(node), np.int64)
    for own in np.unique(cell, axis=0):
        at = np.flatnonzero((cell == own).all(1))
        unit = _unit(_matrix(tile.column("x").take(pa.array(at))))
        spots = (unit @ _lines(unit.shape[1])).astype(np.float32)
        for i in range(len(at)):
            other = np.arange(i + 1, len(at))
            # Home with home, home with visitor; and the blocks that this tile compares.
            other = other[home[at[i]] | home[at[other]]]
            mine, theirs = block[at[i]], block[at[other]]
            other = other[((mine == a) & (theirs == b)) | ((mine == b) & (theirs == a))]
            hits = (np.abs(spots[other] - spots[i]) <= windows.window).sum(1)
            other = other[hits >= windows.count]
            other = other[unit[other] @ unit[i] >= threshold]
            links[at[i]] += copies[at[other]].sum()
            links[at[other]] += copies[at[i]]
            for j in at[other]:
                forest.join(int(at[i]), int(j))
    edges = star_edges(node, forest)
    if edges.num_rows:
        linked = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([edges["a"], edges["b"], pa.nulls(edges.num_rows, pa.int64())], ["a", "b", "n"])
        counts = [pa.array(node[linked]), pa.nulls(len(linked), pa.int64()), pa.array(links[linked])]
        yield pa.RecordBatch.from_arrays(counts, ["a", "b", "n"])
