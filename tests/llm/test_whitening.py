"""Whitening against a plain eigendecomposition with exact sums."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import whitening as w
from hirelens.llm.queries import op11_embedding_whitening

ROWS = "vec_id long, embedding array<double>, id string, x int, w string"


def vectors(spark, values):
    return spark.createDataFrame([(i, v, "a", 1, "b") for i, v in values], ROWS)


def plain(rows, most=8):
    """(id, component) -> (n, deviation, whitened, explained) of the usable rows."""
    x = {i: [math.floor(1024 * c) + 100000 for c in v] for i, v in rows}
    n, d = len(x), len(next(iter(x.values())))
    total = [sum(v[k] for v in x.values()) for k in range(d)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, total)] for v in x.values()])
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:most]
    out = {}
    for row, (i, v) in zip(centred, x.items()):
        for k, at in enumerate(order, 1):
            out[i, k] = (n, sum((n * c - s) ** 2 for c, s in zip(v, total)),
                         row @ vector[:, at] / math.sqrt(value[at]), value[at] / np.trace(cov))
    return out


def same(got, want, tol=1e-8):
    got = {(r["vec_id"], r["component"]): r for r in got}
    assert got.keys() == want.keys()
    for k in {c for _, c in want}:
        ids = [i for i, c in want if c == k]
        a = np.array([got[i, k]["whitened"] for i in ids])
        b = np.array([want[i, k][2] for i in ids])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tol      # either sign, the same for all rows
    for key, (n, deviation, _, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-6


def test_equals_plain_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(300)]
    same(w.whiten(vectors(spark, rows)).collect(), plain(rows))


def test_whole_table(spark):
    got = op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    same(got, plain([(r["vec_id"], r["embedding"]) for r in table.collect()]))


def test_unusable_rows_take_no_part(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [1.0, float("inf"), 2.0]),
           (55, [1.0, 2.0]), (56, [1e200, 0.0, 0.0])]
    same(w.whiten(vectors(spark, good + bad)).collect(), plain(good))


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(None, rng.standard_normal(2).tolist()) for _ in range(5)] + [(1, [0.5, 2.0])] * 3
    got = w.whiten(vectors(spark, rows)).groupBy("vec_id", "component").count().collect()
    assert {(r["vec_id"], r["component"]): r["count"] for r in got} == {(None, 1): 5, (None, 2): 5, (1, 1): 3, (1, 2): 3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, rows):
    assert w.whiten(vectors(spark, rows)).collect() == []


def test_flat_dimensions_are_left_out(spark):
    rows = [(i, [float(i), 7.0, -float(i)]) for i in range(9)]
    got = w.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in got} == {1}
    assert got[0]["explained"] == pytest.approx(1.0)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** 40 + i * 2 ** 30), -float(3 ** i), 0.25 * i]) for i in range(12)]
    x = w.whole_numbers(vectors(spark, rows), "vec_id", "embedding")
    n, total = w.sums(x)
    ints = {i: [math.floor(1024 * c) + 100000 for c in v] for i, v in rows}
    assert (n, total) == (12, [sum(v[k] for v in ints.values()) for k in range(3)])
    v = w.covariance(x, n, total)
    for i in range(3):
        for j in range(3):
            exact = sum((n * a[i] - total[i]) * (n * a[j] - total[j]) for a in ints.values())
            assert v[i, j] == exact / n ** 3
    beyond = w.whiten(vectors(spark, rows)).where(F.col("deviation").isNull()).count()
    assert beyond == sum(sum((n * c - s) ** 2 for c, s in zip(v, total)) >= 1 << 63 for v in ints.values()) * 2


def test_products_of_limbs():
    y = np.random.default_rng(6).integers(-2 ** 52, 2 ** 52, (200, 4))
    assert (w.products(y) == y.astype(object).T.dot(y.astype(object))).all()


@pytest.mark.parametrize("values", [np.full(20, 3.0), np.r_[np.full(10, 5.0), np.linspace(1, 2, 30)],
                                    np.r_[1e6, 1e3, 1.0, 1e-3, np.zeros(30)], np.linspace(1, 1.01, 40)])
def test_clusters_gaps_and_wide_ranges(values):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, u = w.components(v, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > w.NO_VARIANCE * want[0]]
    assert np.allclose(e, want, rtol=0, atol=1e-13 * want[0] * len(v))
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
    assert np.linalg.norm(v @ u - u * e) < 1e-12 * want[0]


def test_inertia_counts():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((15, 15))
    v = a @ a.T
    e = np.linalg.eigvalsh(v)
    form = w.tridiagonal(v)
    for shift in rng.uniform(0, e[-1] * 1.1, 50):
        assert w.count_above(form, shift) == (e > shift).sum()
