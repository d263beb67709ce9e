"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels from slot arrays.

Documents are never sorted. The ids of a group are merged into compressed bitmaps, one per 4,096
consecutive ids: a mask of the 64-bit words that are not empty, those words, and a directory of
how many ids stand before each. Above them a trie of counts, 17 or 18 bits a level, says how many ids
stand before a bitmap. So the coordinate of a leaf is a sum of a few counts and of two popcounts,
all looked up by key, and no group of entries that a task sees at once is larger than a level.

Leaves then go into slot arrays of 1,024 by their coordinate. An array is reduced by up to ten
levels within its row, and the nodes that are left are dealt to arrays again, so 100 billion
leaves take four rounds. On the way back each array hands its slots the siblings above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcile.operators.diff import with_ordinals
from reconcile.session import write_through

# A slot array holds 2 ** SLOT_BITS nodes.
SLOT_BITS = 10

# Bits of an id below a bitmap, below a word of it, and below each level of the trie above.
_BITMAP, _WORD, _LEVELS = 12, 6, (12, 29, 46)

# Copies of one row that one step of numbering lays out.
_COPIES = 65_536


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def build(docs: DataFrame) -> DataFrame:
    """Every row's leaf, its coordinate, and its proof up to the root of all languages.

    Reads ``doc_id, lang, source, n_chars, text`` and looks at no other column. Returns a row for
    each row: ``doc_id, lang, position`` (from 0 in its language), ``leaf, tampered`` (the leaf of
    a row whose n_chars is one more, where the id is chosen for tampering; else null), ``path``
    (from the leaf up: the siblings at that level as hex text, null where there are none, and
    whether they stand to the left), ``subroot, root``.

    Leaves of a language ascend by id; a null id comes first, and rows of one id ascend by leaf.
    Copies of one row are leaves of their own, next to one another. A null language is a group of
    its own, before all others; a null or empty text is a leaf as any other. An empty table has
    no rows and no root.
    """
    leaves = write_through(_leaves(docs), "leaves")
    placed = _placed(leaves).withColumnRenamed("leaf", "node")
    rounds = _up(placed, ["doc_id", "lang", "tampered"], "leaf-slots")
    top = F.element_at("layers", -1)[0]
    tops = rounds[-1].select("group", top.alias("node"), "first_lang")
    langs = with_ordinals(tops, ["first_lang"], "ordinal", ties=False)
    langs = langs.select(F.lit("").alias("group"), (F.col("ordinal") - 1).alias("position"), "node", F.col("group").alias("member"))
    langs = langs.withColumns({"leaves": F.lit(tops.count()).cast("long"), "lang": F.lit("")})
    above = _up(langs, ["member"], "language-slots")
    roots = _down(above, above[-1].select("group", top.alias("root"), _no_path().alias("above")), ["root"])
    roots = roots.select(F.col("member").alias("group"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))
    found = _down(rounds, roots, ["subroot", "root"])
    return found.select("doc_id", "lang", "position", F.col("node").alias("leaf"), "tampered", "path", "subroot", "root")


def proof(path: Column) -> Column:
    """Digest of the siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: p["sibling"]), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def step(node: Column, p: Column) -> Column:
        sibling = F.coalesce(p["sibling"], F.lit(""))
        return F.sha2(F.when(p["left"], F.concat(sibling, node)).otherwise(F.concat(node, sibling)), 256)

    return F.aggregate(path, leaf, step)


def _leaves(docs: DataFrame) -> DataFrame:
    """Distinct leaves with their number of copies."""
    doc_id, source, lang, size, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    more = size.cast("decimal(20,0)") + 1
    chosen = F.crc32(doc_id.cast("string")) % 7 == 0
    rows = docs.select(
        field(lang).alias("group"),
        lang.cast("string").alias("lang"),
        doc_id.cast("long").alias("doc_id"),
        leaf_of(doc_id, source, lang, size, text).alias("leaf"),
        F.when(chosen, leaf_of(doc_id, source, lang, more, text)).alias("tampered"),
    )
    return rows.groupBy("group", "lang", "doc_id", "leaf", "tampered").agg(F.count("*").alias("copies"))


def _placed(leaves: DataFrame) -> DataFrame:
    """A row for each leaf with its position in its group, and the group's number of ``leaves``."""
    ids = leaves.groupBy("group", F.col("doc_id").alias("id")).agg(F.sum("copies").alias("n"), F.count("*").alias("different"))
    ids = write_through(ids, "ids")
    several = ids.filter("different > 1").select(F.col("group").alias("of"), F.col("id").alias("of_id"))
    same = (F.col("group") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    # Leaves of one id are a group of their own, ranked by the first 60 bits of their digest.
    own = F.concat("group", F.lit("|"), field(F.col("doc_id")))
    prefix = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    tied = leaves.join(several, same, "left_semi").select(own.alias("own"), prefix.alias("prefix"), "leaf", "copies")
    alike = Window.partitionBy("own", "prefix").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    tied = write_through(tied.withColumn("rest", F.coalesce(F.sum("copies").over(alike), F.lit(0))), "tied")
    prefixes = tied.groupBy(F.col("own").alias("group"), F.col("prefix").alias("id")).agg(F.sum("copies").alias("n"))
    ranks = write_through(_ranks(ids.drop("different").unionByName(prefixes)), "ranks")

    among = ranks.select(F.col("group").alias("own"), F.col("id").alias("prefix"), F.col("before").alias("among"))
    tied = tied.join(among, ["own", "prefix"]).select("own", "leaf", (F.col("among") + F.col("rest")).alias("among"))
    ranks = ranks.toDF("of", "of_id", "before", "leaves")
    rows = leaves.join(ranks, same).withColumn("own", own).join(tied, ["own", "leaf"], "left")
    rows = rows.withColumn("position", F.col("before") + F.coalesce("among", F.lit(0)))
    rows = rows.select("group", "lang", "doc_id", "leaf", "tampered", "copies", "position", "leaves")
    single = rows.filter("copies = 1")
    blocks = rows.filter("copies > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)")))
    blocks = blocks.repartition("group", "position", "block")
    last = F.least(F.col("copies") - 1, F.col("block") + _COPIES - 1)
    copies = blocks.withColumn("position", F.explode(F.sequence(F.col("position") + F.col("block"), F.col("position") + last)))
    return single.unionByName(copies.drop("block")).drop("copies")


def _ranks(ids: DataFrame) -> DataFrame:
    """``group, id, before, leaves`` for each distinct ``group, id`` of ``n`` rows.

    ``before`` are the rows of lesser ids of the group, nulls first; ``leaves`` all its rows.
    """
    known = ids.withColumns({"known": F.col("id").isNotNull(), "id": F.coalesce("id", F.lit(0))})
    bitmap = F.shiftright("id", _BITMAP)
    bit = F.expr("shiftleft(1L, cast(id & 63 AS int))")
    more = F.when(F.col("n") > 1, F.struct(F.col("id").bitwiseAND(63).alias("bit"), (F.col("n") - 1).alias("more")))
    words = known.groupBy("group", "known", F.shiftright("id", _WORD).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.sum("n").alias("n"), F.collect_list(more).alias("ties")
    )
    place = F.expr("cast(word & 63 AS int)")
    maps = words.groupBy("group", "known", F.shiftright("word", _BITMAP - _WORD).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(word & 63 AS int))")).alias("present"),
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "bits", "n", "ties"))).alias("words"),
        F.sum("n").alias("n"),
    )
    directory = F.expr("transform(words, (w, i) -> aggregate(slice(words, 1, i), 0L, (s, x) -> s + x.n))")
    maps = write_through(maps.withColumn("directory", directory), "bitmaps")
    maps = maps.drop("n").join(_trie(maps.select("group", "known", "at", "n")), ["group", "known", "at"])

    rows = known.select("group", "known", "id", bitmap.alias("at")).join(maps, ["group", "known", "at"])
    below = "bit_count({0} & ~shiftleft(-1L, {1}))"
    rows = rows.withColumns(
        {"place": F.expr("cast(shiftright(id, 6) & 63 AS int)"), "bit": F.expr("cast(id & 63 AS int)")}
    ).withColumn("i", F.expr(below.format("present", "place")))
    ties = "aggregate(filter(words[i].ties, t -> t.bit < bit), 0L, (s, t) -> s + t.more)"
    rank = F.expr(f"above + directory[i] + {below.format('words[i].bits', 'bit')} + {ties}")
    return rows.select("group", F.when(F.col("known"), F.col("id")).alias("id"), rank.alias("before"), "leaves")


def _trie(maps: DataFrame) -> DataFrame:
    """``above``, the rows of the group in bitmaps before ``at``, summed level by level, and ``leaves``."""
    entries = maps
    levels = []
    for low, high in zip(_LEVELS, (*_LEVELS[1:], 64), strict=True):
        parent = F.shiftright("at", high - low) if high < 64 else F.lit(0).cast("long")
        levels.append(entries.withColumn("parent", parent))
        entries = entries.groupBy("group", "known", parent.alias("at")).agg(F.sum("n").alias("n"))
    # Of a group there are two entries left at most: its null ids, and all others.
    sums = entries.groupBy("group").agg(F.sum("n").alias("leaves"), F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("nulls"))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("known"), F.lit(0).cast("long").alias("above")), F.struct(F.lit(True).alias("known"), F.col("nulls").alias("above"))))
    before = sums.select("group", "leaves", sides.alias("side")).select("group", "side.*", "leaves", F.lit(0).cast("long").alias("parent"))
    for level in reversed(levels):
        own = _running(level).join(before, ["group", "known", "parent"])
        before = own.select("group", "known", F.col("at").alias("parent"), (F.col("above") + F.col("own")).alias("above"), "leaves")
    return before.withColumnRenamed("parent", "at")


def _running(level: DataFrame) -> DataFrame:
    """``own``: rows of entries with the same parent that stand before; a parent's entries are bounded."""
    before = Window.partitionBy("group", "known", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return level.select("group", "known", "parent", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own"))


def _no_path() -> Column:
    return F.expr("cast(array() AS array<struct<sibling: string, left: boolean>>)")


def _up(nodes: DataFrame, payload: list[str], label: str) -> list[DataFrame]:
    """The slot arrays of each round, written: ``group, array, slots, layers, steps, first_lang``.

    ``nodes`` has ``group, position, node, leaves, lang``; ``leaves`` are the group's. ``layers``
    are an array's nodes level by level, ``steps`` above the first. An array that is full, or the
    last of a group that has more levels, is reduced to one node.
    """
    # The logarithm of a large count is rounded; the powers next to it decide.
    near = F.ceil(F.log2(F.col("leaves").cast("double"))).cast("int")
    exact = "CASE WHEN shiftleft(1L, near) < leaves THEN near + 1 WHEN near > 0 AND shiftleft(1L, near - 1) >= leaves THEN near - 1 ELSE near END"
    nodes = nodes.withColumn("near", near).withColumn("levels", F.expr(exact)).withColumn("first_lang", F.col("lang"))
    size = 1 << SLOT_BITS
    rounds: list[DataFrame] = []
    while True:
        done = len(rounds) * SLOT_BITS
        slot = F.struct(F.col("position").bitwiseAND(size - 1).cast("int").alias("slot"), "node", *(payload if not rounds else []))
        arrays = nodes.groupBy("group", F.shiftright("position", SLOT_BITS).alias("array")).agg(
            F.array_sort(F.collect_list(slot)).alias("slots"),
            F.first("levels").alias("levels"),
            F.first("first_lang").alias("first_lang"),
        )
        arrays = arrays.withColumn("steps", F.greatest(F.lit(0), F.least(F.lit(SLOT_BITS), F.col("levels") - done)))
        hashed = "transform(sequence(0, (size(last) - 1) div 2), j -> sha2(concat(last[2 * j], coalesce(get(last, 2 * j + 1), '')), 256))"
        layers = (
            "aggregate(array_repeat(0, steps), array(transform(slots, s -> s.node)), "
            f"(all, x) -> concat(all, transform(array(all[size(all) - 1]), last -> {hashed})))"
        )
        arrays = write_through(arrays.withColumn("layers", F.expr(layers)), label)
        rounds.append(arrays)
        if not arrays.filter("array > 0").head(1):
            return rounds
        nodes = arrays.select(
            "group", F.col("array").alias("position"), F.element_at("layers", -1)[0].alias("node"), "levels", "first_lang"
        )


def _down(rounds: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """Each slot of the first round with its whole ``path``; ``tops`` has a group's path above."""

    def slots_of(arrays: DataFrame) -> DataFrame:
        sibling = "get(layers[l], shiftright(slot.slot, l) ^ 1) AS sibling, (shiftright(slot.slot, l) & 1) = 1 AS left"
        own = f"transform(slice(sequence(0, {SLOT_BITS}), 1, steps), l -> struct({sibling}))"
        rows = arrays.withColumn("slot", F.explode("slots")).withColumn("path", F.expr(f"concat({own}, above)"))
        position = F.shiftleft("array", SLOT_BITS) + F.col("slot.slot")
        return rows.select("group", position.alias("position"), "slot.*", "path", *carried).drop("slot")

    above = tops.withColumn("array", F.lit(0).cast("long"))

    def further(above: DataFrame, arrays: DataFrame) -> DataFrame:
        found = slots_of(arrays.join(above, ["group", "array"]))
        return found.select("group", F.col("position").alias("array"), *carried, F.col("path").alias("above"))

    above = reduce(further, reversed(rounds[1:]), above)
    return slots_of(rounds[0].join(above, ["group", "array"]))
