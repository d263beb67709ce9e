import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reconcile.llm import quality
from reconcile.llm.queries import op4_quality
from tests.llm.cases import SF_DIR, as_dicts, awkward, nothing

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in as_dicts(op4_quality(spark, LARGER))}


def test_every_document_is_scored(scored):
    assert len(scored) == 1000
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_accuracy_on_labels_left_out(spark):
    """Trained on the labels of even ids, held against those of odd ids."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    odd = {r["doc_id"]: r["quality"] for r in as_dicts(labels.filter("doc_id % 2 = 1"))}
    kept = {r["doc_id"] for r in as_dicts(quality.keep_good(docs, model))}
    good = [d for d, q in odd.items() if q == 1]
    bad = [d for d, q in odd.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d in bad) <= 0.3 * len(bad)


def test_predictions_do_not_read_the_label_or_id(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit(docs, labels)
    a = sorted(r["s"] for r in as_dicts(quality.with_score(docs, model, "s").select("s")))
    b = sorted(r["s"] for r in as_dicts(quality.with_score(docs.selectExpr("-doc_id doc_id", "text", "lang", "source", "n_chars"), model, "s")))
    assert np.allclose(a, b)


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (6, 1), (7, 0), (7, 1), (8, 0), (9, 0), (None, 1), (10, None), (11, 5)], "doc_id long, quality int"
    )
    model = quality.fit(docs, labels)
    got = quality.with_score(docs, model, "hits")
    assert got.columns == docs.columns
    assert all(0 <= r["hits"] <= 1 for r in as_dicts(got))
    kept = quality.keep_good(docs.withColumnRenamed("node", "quality_score"), model)
    assert "quality_score" in kept.columns and kept.count() <= docs.count()
    assert quality.with_score(nothing(spark), model).count() == 0


def test_without_labels_of_both_classes_all_stay(spark):
    docs = awkward(spark)
    one = spark.createDataFrame([(1, 1), (6, 1)], "doc_id long, quality int")
    for labels in (one, one.limit(0)):
        assert quality.fit(docs, labels) is None
    assert quality.fit(nothing(spark), one) is None
    assert quality.keep_good(docs, None).count() == docs.count()


def test_views_teach_each_other():
    """Each view alone decides half of the rows; the pool carries what one knows to the other."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    text = np.column_stack([y + rng.normal(0, 0.4, 400), rng.normal(0, 1, 400)]).astype(np.float32)
    record = np.column_stack([y + rng.normal(0, 0.6, 400), rng.normal(0, 1, 400)]).astype(np.float32)
    pool = rng.integers(0, 2, 2000)
    pools = [np.column_stack([pool + rng.normal(0, s, 2000), rng.normal(0, 1, 2000)]).astype(np.float32) for s in (0.4, 0.6)]
    calibrates = np.arange(400) % 5 == 0
    model = quality.co_train(text, record, y, *pools, calibrates)
    both = ((model.score(*pools) > 0.5) == (pool == 1)).mean()
    alone = max(((v.margin(p) > 0) == (pool == 1)).mean() for v, p in zip((model.text, model.record), pools, strict=True))
    assert both >= alone - 0.005
    assert both > 0.9


def test_features_of_a_slice_are_those_of_each_text():
    column = pq.read_table(f"{SF_DIR}/documents.parquet").column("text").combine_chunks()
    texts = pa.concat_arrays([column, pa.array([None, "", "A b", "\n\n", "é"])])
    together = quality.text_features(texts)
    assert together.shape == (len(texts), quality.TEXT_FEATURES)
    for i in range(0, len(texts), 17):
        assert np.allclose(quality.text_features(texts.slice(i, 1))[0], together[i], rtol=1e-4, atol=1e-5)
    assert np.isfinite(together).all()


def test_the_pool_is_summed_alike_by_tasks_and_in_one(spark):
    """All unlabelled documents teach, whatever their number, ids and partitions."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    a, b = (quality.fit(frame, labels) for frame in (docs.repartition(1), docs.repartition(7)))
    assert np.allclose(a.text.weights, b.text.weights, atol=1e-6) and np.allclose(a.record.weights, b.record.weights, atol=1e-6)
    assert a.threshold == pytest.approx(b.threshold, abs=1e-6)
    assert a.lost <= 0.01 and a.kept <= 0.3
    # A label counts as much beside a pool in many copies.
    many = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))
    known = labels.select("doc_id").withColumn("known", F.lit(True))
    many = many.join(known, "doc_id", "left").filter("known IS NULL OR copy = 1").drop("known", "copy")
    c = quality.fit(many, labels)
    one, other = ({r["doc_id"]: r["s"] for r in as_dicts(quality.with_score(docs, m, "s"))} for m in (a, c))
    assert np.mean([abs(one[d] - other[d]) for d in one]) < 0.02


def test_against_sums_over_plain_rows():
    """Rounds of co-training, written out row by row."""
    rng = np.random.default_rng(3)
    views = (rng.normal(0, 1, (60, 2)), rng.normal(0, 1, (60, 3)))
    models = tuple(quality.Logistic(np.zeros(n), np.ones(n), rng.normal(0, 3, n + 1)) for n in (2, 3))
    counts = quality._sureness([], models, views)
    assert counts[-1] == 60
    past = quality.Round(models, quality._first_steps(counts, 0.5))
    for teacher in (0, 1):
        margin = models[teacher].margin(views[teacher])
        label = quality._given([past], views)[1 - teacher]
        for value, sure in ((1.0, margin), (0.0, -margin)):
            chosen = np.flatnonzero(label == value)
            assert (sure[chosen] >= quality._SURE_MARGIN).all()
            left = np.isnan(label)
            assert not len(chosen) or not left.any() or sure[chosen].min() > sure[left].max() - quality._STEP or len(chosen) <= 2
    sums = quality._added([past], models, views)
    at = 0
    for view, label in enumerate(quality._given([past], views)):
        n = views[view].shape[1] + 1
        gradient, curvature = np.zeros(n), np.zeros((n, n))
        for row, value in zip(views[view], label, strict=True):
            if not np.isnan(value):
                z = np.concatenate([[1.0], np.clip(row, -8, 8)])
                p = 1 / (1 + np.exp(-z @ models[view].weights))
                gradient += z * (value - p)
                curvature += np.outer(z, z) / 4
        assert np.allclose(sums[at : at + n], gradient) and np.allclose(sums[at + n : at + n + n * n].reshape(n, n), curvature)
        at += n + n * n


def test_a_labelled_id_of_very_many_rows_is_bounded(spark):
    docs = spark.range(5000).selectExpr("if(id < 3000, 1, id) AS doc_id", "concat('word ', id) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    labels = spark.range(2000).selectExpr("if(id = 0, 1, id + 3000) AS doc_id", "cast(id % 2 AS int) AS quality")
    taken = []
    whole = quality.train
    quality.train = lambda text, *rest: taken.append(len(text)) or whole(text, *rest)
    try:
        assert quality.fit(docs, labels, most_labelled=500) is not None
    finally:
        quality.train = whole
    assert taken == [500]
