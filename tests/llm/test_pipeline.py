import importlib.util
import os

import pytest
import pyarrow.parquet as pq

import corpus_pipeline
from reconcile.llm.surrogates import find
from tests.llm.cases import SF_DIR, as_dicts, awkward, nothing
from tests.llm.test_decontaminate import _slow as slow_hits
from tests.llm.test_jaccard import _slow as slow_components
from tests.llm.test_token_ids import _check_packing

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, by name; ``documents`` is what the first one was given."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{root}/{name}")
        out[name] = docs = spark.read.parquet(f"{root}/{name}")
    return {name: as_dicts(df) for name, df in out.items()}


def _before(name):
    return ["documents", *NAMES][NAMES.index(name)]


def test_order_of_stages():
    assert NAMES == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", NAMES[:-1])
def test_columns_stay_and_nothing_is_invented(stages, name):
    before, after = stages[_before(name)], stages[name]
    assert after and list(after[0]) == list(before[0])
    ids = {r["doc_id"] for r in before}
    assert len({r["doc_id"] for r in after}) == len(after) and {r["doc_id"] for r in after} <= ids


def test_quality_rejects_and_keeps(stages):
    labels = pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()
    kept = {r["doc_id"] for r in stages["quality"]}
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert len(kept) < len(stages["documents"])


def test_one_of_each_group_stays(stages):
    before, after = stages["quality"], {r["doc_id"] for r in stages["near_duplicates"]}
    expected = {d if n == 0 else c for d, n, c in slow_components([(r["doc_id"], r["text"]) for r in before])}
    assert after == expected


def test_contaminated_documents_go(stages):
    before = stages["near_duplicates"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    expected = {r["doc_id"] for r, hit in zip(before, slow_hits([r["text"] for r in before], items), strict=True) if not hit[-1]}
    assert {r["doc_id"] for r in stages["decontamination"]} == expected


def test_personal_data_is_replaced(stages):
    before = {r["doc_id"]: r for r in stages["decontamination"]}
    assert len(before) == len(stages["personal_data"])
    for r in stages["personal_data"]:
        old = before[r["doc_id"]]["text"] or ""
        gone = [old[m.start : m.end] for m in find(old)]
        assert (r["text"] == before[r["doc_id"]]["text"]) == (not gone)
        assert not any(len(g) > 6 and g in r["text"] for g in gone)
        assert r["n_chars"] == len(r["text"] or "")


def test_everything_left_is_packed(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["personal_data"]]
    _check_packing(stages["packing"], rows)


def test_run_is_the_stages(spark, stages):
    got = sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in as_dicts(corpus_pipeline.run(spark, SF_DIR).filter("start = 0")))
    assert [g[0] for g in got] == sorted(r["doc_id"] for r in stages["personal_data"])


@pytest.mark.parametrize("name", NAMES)
def test_stages_take_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (awkward(spark), nothing(spark)):
        got = stage(spark, docs, SF_DIR)
        if name != NAMES[-1]:
            assert got.columns == docs.columns
        assert got.count() <= max(2 * docs.count(), 200)


def test_it_lies_beside_the_entry_point():
    assert os.path.dirname(importlib.util.find_spec("corpus_pipeline").origin) == os.path.dirname(
        importlib.util.find_spec("__spark_entry__").origin
    )
