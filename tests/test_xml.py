"""Well-formed documents, documents as values, and columns in which all are well-formed."""

import pytest
from pyspark.sql import functions as F

from reconcile.functions import values
from reconcile.operators import xml
from reconcile.plans.reconcile import Pair
from reconcile.operators import diff

GOOD = [
    "<p><k>5</k><k a='x'>6</k></p>", "<p/>", "<p b='1'>t</p> \n ", "<p><![CDATA[x]]></p>", "<a/><!-- c -->", "<?pi x?><a><b><c/></b></a>",
    "<r> <a/> mixed <a/> </r>", " <a/>", "<a><b>1</b><b>2</b></a>", "<ns:a xmlns:ns='u'/>", "<?xml version='1.0'?>\n<a/>",
    "<!DOCTYPE p [<!ENTITY e 'v'>]><p>&e; &amp; &e;</p>", "<!DOCTYPE p SYSTEM 'p.dtd'><p/>", "<text/>", "<a>" * 300 + "</a>" * 300,
    "<p>1e400</p>", "<p>" + "9" * 60 + "</p>", "<p>&#65;</p>", "<a>" + "<b>x</b>" * 5000 + "</a>",
]
BAD = [
    "<p><k>5</k>", "<p/>junk", "junk<p/>", "", "<a/><a/>", "<a/><b/>", "junk", "<a>1</a><a>2</a>", "<x/><![CDATA[x]]>", "<a x=1/>", "<a>&e;</a>",
    "<a></reconcile_document>", "<a/><A/>",
]


def _frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "i int, doc string")


@pytest.mark.parametrize("by_path", [False, True])
def test_forms(spark, monkeypatch, by_path):
    if by_path:
        monkeypatch.setattr(values, "XML_VALUE_BYTES", 0)
    docs = [(d, True) for d in GOOD] + [(d, False) for d in BAD] + [(None, True)]
    if by_path:
        docs = [(d, v) for d, v in docs if d]
    rows = xml.check_xml(_frame(spark, [d for d, _ in docs]), "doc").orderBy("i").collect()
    wrong = [r["doc"] for r, (_, valid) in zip(rows, docs, strict=True) if r["is_valid"] != valid]
    assert wrong == []


def test_documents_as_values(spark, tmp_path):
    docs = ["<p id='7'><k>5</k><k>6</k><s>a &lt; b</s></p>", "<p>", None, "<q/>"]
    path = str(tmp_path / "docs")
    xml.with_variant(_frame(spark, docs), "doc", "value").drop("doc").write.parquet(path)
    rows = spark.read.parquet(path).orderBy("i").select(
        "i", F.expr("value IS NULL AS none"), *[F.expr(f"try_variant_get(value, '$.p.{f}', 'string')").alias(n) for n, f in (("id", "_id"), ("k", "k[1]"), ("s", "s"))]
    )
    assert [tuple(r) for r in rows.collect()] == [(0, False, "7", "6", "a < b"), (1, True, None, None, None), (2, True, None, None, None), (3, False, None, None, None)]


def test_whole_columns(spark):
    source = spark.createDataFrame([(1, "<a/>", "<b/>"), (2, None, "<b>"), (3, "<a x='1'/>", "<c/>")], "id int, good string, mixed string")
    target = spark.createDataFrame([(1, "<a></a>", "<b/>"), (2, None, "<b>"), (3, None, "<d/>")], "ID int, GOOD string, MIXED string")
    assert xml.valid_columns(source, target, ["GOOD", "mixed", "gone"]) == ["GOOD"]
    assert xml.valid_columns(source, target, []) == []
    pair = Pair("t", source, target, ["id"], xml_columns=["good", "mixed"])
    cells = diff.cells_of(diff.surplus_rows(*pair.sides()), ["id"]).collect()
    # A lost document differs, as do those of a column that is not well-formed throughout.
    assert sorted((r["id"], r["column_name"], r["source_value"], r["target_value"]) for r in cells) == [
        (3, "good", "VALID", None), (3, "mixed", "<c/>", "<d/>"),
    ]
