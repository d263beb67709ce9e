"""License scan with a positional index of rare words, in DataFrame operations only.

Each licence template has a notice and, in it, a mandatory key phrase. The index holds, for each
template, the words of its phrase with the highest inverse document frequency over the scanned
files, and where in the notice they stand. A file's words are looked up in it; postings of one
template that agree on where the notice would begin are intersected by that relative position,
and a place is reported if the whole mandatory phrase stands there. As a phrase cannot stand
anywhere without its rare words in place, the index loses none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcile.session import write_through

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Index words per template.
RARE_WORDS = 3


@dataclass(frozen=True)
class Template:
    """``phrase`` is the mandatory part of ``notice``; both are lower-case words."""

    label: str
    notice: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def start(self) -> int:
        key = self.phrase.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)


# Wordings of public licences.
TEMPLATES = (
    Template("mit", "mit license", "mit license", base=True),
    Template("apache", "apache license", "apache license", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "hereby granted free of charge to any person obtaining a copy",
    ),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
        "copy modify and or distribute this software for any purpose",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software released into the public domain",
    ),
    Template("cc0-1.0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
)

# Places of base phrases alone are worth this much; a template's place its share of the notice.
BASE_SCORE = 0.5


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased.

    ``lower`` also changes letters beyond ASCII, which leaves words as they are cut and spelled
    in ASCII, but for the two letters that it would turn into ASCII ones.
    """
    for letter, other in (("\u212a", "\ue000"), ("\u0130", "\ue001")):
        text = F.replace(text, F.lit(letter), F.lit(other))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def scan(
    files: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """One row per file: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of base phrases; ``first_word`` and ``last_word`` are their
    least and greatest starts in words from 0, null if there are none. Labels are distinct,
    sorted and comma-joined, empty if there are none. A null text is empty: it has no words and
    no labels. Repeated rows and equal or null ids are files of their own. Only the two named
    columns are read, so others may have any name.
    """
    spark = files.sparkSession
    vocabulary = sorted({w for t in templates for w in t.phrase.split()})
    # Each step needs the one before more than once, so they are projections of their own.
    read = files.select(
        F.col(doc_id).alias("doc_id"), words_of(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words")
    )
    read = read.withColumn("present", F.array_intersect("words", _array(vocabulary)))
    has_phrase = F.lit(False)
    for phrase in sorted({t.phrase for t in templates}):
        has_phrase |= F.size(F.array_except(_array(sorted(set(phrase.split()))), F.col("present"))) == 0
    read = read.select(
        "doc_id",
        F.monotonically_increasing_id().alias("file"),
        F.size("words").cast("long").alias("n_words"),
        "present",
        F.when(has_phrase, F.col("words")).alias("words"),
    )
    read = write_through(read, "licence-words")
    places = _places(spark, read, templates)
    found = places.groupBy("file").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("begin"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("begin"))).alias("last_word"),
        _joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        _joined(F.col("label")).alias("labels"),
        F.max(F.when(F.col("base"), F.lit(BASE_SCORE)).otherwise(F.col("share"))).alias("score"),
    )
    out = read.select("doc_id", "file", "n_words").join(found, "file", "left").drop("file")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def _array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _joined(label: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.collect_set(label)))


def _fixed(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A table of a few given rows."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _index(spark: SparkSession, read: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """The rarest words of each template's phrase and their places in the notice."""
    files = read.agg(F.count("*").alias("files"))
    seen = read.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    posting = [
        (i, t.words[at], at) for i, t in enumerate(templates) for at in range(t.start, t.start + len(t.phrase.split()))
    ]
    postings = _fixed(spark, posting, "template", "word", "at")
    # One row for the number of files, one for each word of the vocabulary.
    rated = postings.join(F.broadcast(seen), "word", "left").join(F.broadcast(files))
    rated = rated.withColumn("idf", F.log((F.col("files") + 1) / (F.coalesce("n", F.lit(0)) + 1)))
    rank = F.dense_rank().over(Window.partitionBy("template").orderBy(F.desc("idf"), "word"))
    index = rated.withColumn("rank", rank).filter(F.col("rank") <= RARE_WORDS)
    needed = F.count("*").over(Window.partitionBy("template"))
    return index.select("template", "word", "at", needed.alias("needed"))


def _places(spark: SparkSession, read: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Verified places: ``file, label, base, begin, share``."""
    index = _index(spark, read, templates)
    words = read.filter("words IS NOT NULL")
    looked_up = words.select("file", F.posexplode("words").alias("pos", "word")).join(F.broadcast(index), "word")
    aligned = looked_up.groupBy("file", "template", (F.col("pos") - F.col("at")).alias("origin")).agg(
        F.count("*").alias("hits"), F.first("needed").alias("needed")
    )
    aligned = aligned.filter("hits = needed").select("file", "template", "origin")
    rows = [(i, t.label, t.base, t.words, t.start, t.phrase.split()) for i, t in enumerate(templates)]
    fixed = _fixed(spark, rows, "template", "label", "base", "notice", "start", "phrase")
    there = aligned.join(F.broadcast(fixed), "template").join(words.select("file", "words"), "file")
    begin = F.col("origin") + F.col("start")
    there = there.filter(F.slice("words", begin + 1, F.size("phrase")) == F.col("phrase"))
    same = F.filter(
        "notice",
        lambda word, i: (F.col("origin") + i >= 0) & (F.get("words", (F.col("origin") + i).cast("int")) == word),
    )
    return there.select(
        "file", "label", "base", begin.cast("long").alias("begin"), (F.size(same) / F.size("notice")).alias("share")
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every template tried at every word."""
    rows = ", ".join(
        f"({i}, '{t.label}', {str(t.base).lower()}, {t.words}, {t.start}, {t.phrase.split()})"
        for i, t in enumerate(templates)
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH templates(template, label, base, notice, start, phrase) AS (VALUES {rows}),
files AS (
  SELECT row_number() OVER () AS file, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS words
  FROM documents
),
origins AS (
  SELECT file, template, label, base, notice, start, words,
    unnest(list_filter(range(0, len(words) - len(phrase) + 1),
      lambda i: words[i + 1 : i + len(phrase)] = phrase)) - start AS origin
  FROM files JOIN templates ON list_has_all(words, phrase)
),
places AS (
  SELECT file, label, base, origin + start AS begin_word,
    len(list_filter(range(0, len(notice)),
      lambda j: origin + j >= 0 AND words[CASE WHEN origin + j >= 0 THEN origin + j + 1 END] = notice[j + 1]))
      / len(notice) AS share
  FROM origins
),
found AS (
  SELECT file, count(*) FILTER (WHERE base) AS n_base,
    min(begin_word) FILTER (WHERE base) AS first_word, max(begin_word) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(CASE WHEN base THEN {BASE_SCORE} ELSE share END) AS score
  FROM places GROUP BY file
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM files LEFT JOIN found USING (file)
"""
