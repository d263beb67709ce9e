import numpy as np
import pyarrow.parquet as pq
import pytest

from reconcile.llm import embeddings, graph
from reconcile.llm.queries import op9_embeddings
from tests.llm.cases import SF_DIR, as_dicts


def _slow(rows):
    """All pairs of one label. rows: (vec_id, vector, label)."""
    usable = [
        label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, label in rows
    ]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if u else None for (_, v, _), u in zip(rows, usable, strict=True)]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(root(i)), rows[i][0] == least.get(root(i))) for i in range(n)), key=str)


def _got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in as_dicts(df)), key=str)


def _planted(seed, groups=20, copies=8, dims=64, distance=0.1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dims)
        base /= np.linalg.norm(base)
        for _ in range(copies):
            v = base + rng.standard_normal(dims) * distance / np.sqrt(dims)
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).tolist(), g % 3))
    return rows


def test_awkward_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1),
        (1, [1.0, 0.0], 1),
        (2, [5.0, 0.1], 1),
        (3, [1.0, 0.0], None),
        (4, None, 1),
        (5, [], 1),
        (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1),
        (8, [1.0, float("nan")], 1),
        (9, [float("inf"), 0.0], 1),
        (None, [2.0, 0.0], 1),
        (10, [1.0, 0.0, 0.0], 1),
        (11, [1e-300, 0.0], 1),
        (12, [-1.0, 0.0], 1),
        (13, [0.0, -0.0, 1.0], 2),
        (14, [0.0, 0.0, 1.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, node string, x int")
    assert _got(embeddings.link(df)) == _slow(rows)
    assert embeddings.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [5, 1024])
def test_groups_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(graph.with_tiles, "__defaults__", (block,))
    rows = _planted(1, copies=25)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert _got(embeddings.link(df)) == _slow(rows)


def test_recall_near_the_threshold(spark):
    """Pairs just above the threshold, where the windows lose most."""
    rows = _planted(2, groups=400, copies=2, distance=0.13)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    expected = {r[0]: r[1] for r in _slow(rows)}
    got = {r[0]: r[1] for r in _got(embeddings.link(df))}
    assert sum(expected.values()) > 300
    assert all(got[v] <= n for v, n in expected.items())
    assert sum(got.values()) >= 0.97 * sum(expected.values())


def test_query_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pylist()]
    assert _got(op9_embeddings(spark, SF_DIR)) == _slow(rows)
