"""Small awkward tables that every operator has to take, and readers for brute-force checks."""

import re

import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"

# Nulls in any column, empty and very long texts, ties, repeated rows, and other columns whose
# names are those that operators might use inside.
ROWS = [
    (1, COPY, "en", "src1", 10, "a", 1),
    (1, COPY, "en", "src1", 10, "a", 1),
    (2, COPY + " sixteen", "en", None, None, None, None),
    (3, None, None, None, None, "b", 2),
    (4, "", "en", "src1", 0, "c", 3),
    (5, " \t\n", "fr", "src2", 3, "d", 4),
    (None, COPY.upper(), None, "src2", 5, "e", 5),
    (None, None, None, None, None, None, None),
    (6, LONG, "en", "src3", len(LONG), "f", 6),
    (7, LONG + " end", "en", "src3", len(LONG), "f", 6),
    (8, "çà été Ünïcode ßtraße 日本語 текст 123-456 a b", "fr", "src4", 40, "g", 7),
    (9, "four words only here", "en", "src4", 20, "h", 8),
    (10, "FOUR words only here", "en", "src4", 20, "h", 8),
    (11, "!!! ... ???", "de", "src5", 11, "i", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, node string, hits int"


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
