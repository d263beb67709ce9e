"""N-gram Jaccard join: texts whose sets of word shingles overlap by 0.75 or more.

Texts are dealt to tiles, sorted by set size, and two are compared only if their sizes allow
the similarity. A hashed bitmap of each set bounds the overlap from above by counting bits; the
pairs that pass are verified by intersecting the sorted shingle arrays.

Comparing all texts of like size would grow with the square of the corpus, so tiles are keyed
by a shingle as well. Each set is represented by its ``SAMPLE`` least shingles in hash order, a
uniform sample, and two texts meet in a tile if they share one. With a similarity of 0.75 no
shared one among 40 has a chance below 1e-23, far less than that two shingles hash alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcile.llm.batches import written
from reconcile.llm.bytes_of import mixed, space_words, text_slices
from reconcile.llm.graph import BLOCK, Forest, components, star_edges, tiles_of, with_tiles
from reconcile.session import write_through

WORDS = 5

# The similarity as a ratio of whole numbers: PERCENT / 100.
PERCENT = 75

SAMPLE = 40

# A shingle of more sets than this is common. A set with no more than a fifth of its sample common
# is found by the rest. At worst the common ones are just those that it shares with another set, and
# a quarter of all are its own; that 32 or more of 40 are among those has a chance below 1e-12.
COMMON = BLOCK
_COMMON_SHARE = 0.2

# Bits of the bitmaps of sets up to so many shingles, four times as many for four times the size.
_BITS, _BITS_FOR = 1024, 1024

_SEED = np.uint64(0x2545F4914F6CDD1D)
_CHECK = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    hashes, first = space_words(column)
    sets = []
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, np.uint64)
        for i in range(words):
            rolled = rolled * _STEP + hashes[i : i + len(rolled)]
        rolled = mixed(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64) * _SEED
            for h in range(a, b):
                whole = whole * _STEP + hashes[h : h + 1]
            sets.append(mixed(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(shingles: np.ndarray, seed: np.uint64 = _SEED) -> int:
    """A hash of a whole set, alike for equal sets, as a signed integer."""
    total = mixed(shingles ^ seed).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total]))[0].astype(np.int64))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle's hash; the number of bits follows the set's size."""
    bits = _BITS
    while len(shingles) * _BITS > bits * _BITS_FOR:
        bits *= 4
    out = np.zeros(bits // 64, np.uint64)
    low = shingles & np.uint64(bits - 1)
    np.bitwise_or.at(out, (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    return out


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap, or rows of them, brought to fewer 64-bit words."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, size), axis=-2)


def least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least intersection with which sets of these sizes are linked."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            columns = [
                part.column("doc_id"),
                part.column("row_key"),
                pa.array([len(s) for s in sets], pa.int64()),
                part.column("row_check"),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([set_key(s, _CHECK) if len(s) else None for s in sets], pa.int64()),
                pa.array([s[:SAMPLE].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n", "row_check", "node", "set_check", "sample", "bits"])


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Texts of equal sets are one node, so copies cost one row each and are never paired. A null
    or empty text, or one without words, has no shingles, links with nothing and is its own
    component. Repeated rows and equal ids are rows of their own; a null id takes part in links,
    and is a component's id only where all are null. An empty table gives no rows.
    """
    parts = _parts(docs, doc_id, text)
    least = parts.dropna(subset=["part"]).groupBy("part").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return parts.join(least, "part", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def _parts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, row_key, row_check, part`` of each row; rows of one component share a part."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    key, check = _row_hashes("doc_id", "text")
    rows = rows.withColumns({"row_key": key, "row_check": check})
    sketches = rows.mapInArrow(
        _sketch,
        "doc_id long, row_key long, n long, row_check long, node long, set_check long, sample array<long>, bits binary",
    )
    sketches = _told_apart(written(sketches, "sketches"))
    # Whichever row of a node is taken, its set is the same.
    heads = sketches.dropna(subset=["node"]).groupBy("node").agg(F.min("row_key").alias("row_key"))
    nodes = sketches.dropna(subset=["node"]).dropDuplicates(["node"]).select("node", "n", "sample", "bits")
    nodes = write_through(nodes, "nodes")
    candidates = components(write_through(_candidates(nodes), "candidates"))
    links = components(written(_verified(rows.select("row_key", "text"), heads, candidates), "links"))
    parts = sketches.select("doc_id", F.col("n").alias("n_shingles"), "row_key", "row_check", "node").join(links, "node", "left")
    return parts.withColumn("part", F.coalesce("component", "node"))


def _row_hashes(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text, with different seeds, that together tell rows apart."""
    value = [F.col(doc_id).cast("long"), F.col(text).cast("string")]
    return F.xxhash64(*value), F.xxhash64(F.lit("check"), *value)


def _told_apart(sketches: DataFrame) -> DataFrame:
    """Sets whose first hash is that of another set too go by their second one."""
    same = sketches.groupBy("node").agg(F.min("set_check").alias("own"), F.max("set_check").alias("last"))
    same = write_through(same.filter("own <> last").drop("last"), "shared-hashes")
    if not same.head(1):
        return sketches
    rows = sketches.join(same, "node", "left")
    other = F.col("own").isNotNull() & (F.col("own") != F.col("set_check"))
    return rows.withColumn("node", F.when(other, F.col("set_check")).otherwise(F.col("node"))).drop("own", "set_check")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges between nodes that the bitmaps of a common tile do not tell apart."""
    tokens = nodes.select("node", F.explode("sample").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    tokens = write_through(tokens.join(shared, "token"), "tokens")
    common = tokens.filter(F.col("sets") > COMMON).groupBy("node").agg(F.count("*").alias("n_common"))
    size = F.least(F.col("n"), F.lit(SAMPLE))
    rare_enough = common.join(nodes.select("node", "n"), "node").filter(F.col("n_common") <= _COMMON_SHARE * size)
    rare_enough = rare_enough.select("node", F.lit(True).alias("skips"))
    kept = tokens.join(rare_enough, "node", "left").filter(f"skips IS NULL OR sets <= {COMMON}")
    # Near copies share many shingles; of those in just the same nodes one is enough.
    members = kept.groupBy("token").agg(
        F.count("*").alias("sets"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node") % 1_000_003).alias("y")
    )
    picks = members.filter("sets > 1").groupBy("sets", "x", "y").agg(F.min("token").alias("token"))
    kept = kept.select("token", "node").join(picks.select("token"), "token", "left_semi")
    rows = with_tiles(kept, ["token"], F.xxhash64("node"))
    return _compared(rows.join(nodes.select("node", "n", "bits"), "node"), "token", _bitmap_edges, "bits binary")


def _verified(docs: DataFrame, heads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges between nodes of one candidate component whose shingle arrays overlap enough."""
    rows = candidates.join(heads, "node").select("node", "component", "row_key")
    # Rows that are repeated as a whole have one hash: one of them is enough.
    texts = docs.join(rows, "row_key").select("node", "component", "text").dropDuplicates(["node"])
    tiles = with_tiles(texts.withColumn("n", F.length("text").cast("long")), ["component"], F.xxhash64("node"))
    return _compared(tiles, "component", _exact_edges, "text string")


def _compared(rows: DataFrame, group: str, edges, payload: str) -> DataFrame:
    keys = [group, "tile_a", "tile_b"]
    rows = rows.select(*keys, "block", "node", "n", payload.split()[0])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, keys):
            yield edges(tile)

    return rows.mapInArrow(compare, "a long, b long")


class _Tile:
    """The nodes of a tile in order of size, with their bitmaps, and which of them may be compared."""

    def __init__(self, tile: pa.Table, kept: np.ndarray, n: np.ndarray, maps: list[np.ndarray]):
        node, block = (tile.column(c).to_numpy()[kept] for c in ("node", "block"))
        order = np.lexsort((node, n))
        keep = np.ones(len(order), bool)
        keep[1:] = node[order][1:] != node[order][:-1]
        self.order = order[keep]
        self.node, self.n, self.block = node[self.order], n[self.order], block[self.order]
        self.a, self.b = tile.column("tile_a")[0].as_py(), tile.column("tile_b")[0].as_py()
        self.forest = Forest(len(self.node))
        self.maps = [maps[i] for i in self.order]
        # Bitmaps of one length side by side, and at which places of the tile they are.
        sizes = np.array([len(m) for m in self.maps], np.int64)
        self.places = {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}
        self.rows = {size: np.stack([self.maps[i] for i in at]) for size, at in self.places.items()}

    def partners(self, i: int) -> np.ndarray:
        """Later nodes in the band of sizes of the similarity that the bitmaps do not rule out.

        A bit that only one of two bitmaps has stands for a shingle that the other set lacks.
        """
        end = np.searchsorted(self.n, self.n[i] * 100 // PERCENT, "right")
        passed = []
        for size, places in self.places.items():
            first, last = np.searchsorted(places, (i + 1, end))
            if first >= last:
                continue
            words = min(len(self.maps[i]), size)
            mine, theirs = folded(self.maps[i], words), folded(self.rows[size][first:last], words)
            only_mine = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64)
            only_theirs = np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
            other = places[first:last]
            most = np.minimum(self.n[i] - only_mine, self.n[other] - only_theirs)
            passed.append(other[most >= least_overlap(self.n[i], self.n[other])])
        other = np.concatenate(passed) if passed else np.zeros(0, np.int64)
        mine, theirs = self.block[i], self.block[other]
        return other[((mine == self.a) & (theirs == self.b)) | ((mine == self.b) & (theirs == self.a))]


def _bitmap_edges(tile: pa.Table) -> pa.RecordBatch:
    maps = [np.frombuffer(bits, np.uint64) for bits in tile.column("bits").to_pylist()]
    t = _Tile(tile, np.arange(len(maps)), tile.column("n").to_numpy(), maps)
    for i in range(len(t.node)):
        for j in t.partners(i).tolist():
            t.forest.join(i, j)
    return star_edges(t.node, t.forest)


def _exact_edges(tile: pa.Table) -> pa.RecordBatch:
    node = tile.column("node").to_numpy()
    sets: list[np.ndarray] = []
    for batch in tile.select(["text"]).combine_chunks().to_batches():
        for part in text_slices(batch, "text"):
            sets += shingle_sets(part.column("text"))
    # Should two rows share a hash, only the text of the node's own set counts.
    own = np.array([i for i, s in enumerate(sets) if len(s) and node[i] in (set_key(s), set_key(s, _CHECK))], np.int64)
    sizes = np.array([len(sets[i]) for i in own], np.int64)
    t = _Tile(tile, own, sizes, [bitmap(sets[i]) for i in own])
    arrays = [sets[own[i]] for i in t.order]
    for i in range(len(t.node)):
        for j in t.partners(i).tolist():
            if t.forest.root(i) == t.forest.root(j):
                continue
            both = len(np.intersect1d(arrays[i], arrays[j], assume_unique=True))
            if 100 * both >= PERCENT * (len(arrays[i]) + len(arrays[j]) - both):
                t.forest.join(i, j)
    return star_edges(t.node, t.forest)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component one row of its smallest id.

    All columns of ``docs`` are kept. Rows without shingles all stay, repeated or not. A null id
    comes after all others. Of rows of equal id, and of repeated ones, an arbitrary but fixed
    text's row stays.
    """
    key, check, bare = (_free_name(docs, n) for n in ("row_key", "row_check", "row_without_shingles"))
    parts = _parts(docs, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "row_check"))
    heads = parts.filter("n_shingles > 0").groupBy("part").agg(first.alias("row"))
    heads = heads.select(F.col("row.row_key").alias(key), F.col("row.row_check").alias(check), F.lit(False).alias(bare))
    empty = parts.filter("n_shingles = 0").select(F.col("row_key").alias(key), F.col("row_check").alias(check)).distinct()
    of_key, of_check = _row_hashes(doc_id, text)
    kept = docs.withColumns({key: of_key, check: of_check}).join(heads.union(empty.withColumn(bare, F.lit(True))), [key, check])
    # Partitioned by the key already: keeping one row of a key costs no further shuffle.
    single = kept.filter(~F.col(bare)).dropDuplicates([key, check])
    return single.unionByName(kept.filter(F.col(bare))).select(*docs.columns)


def _free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
