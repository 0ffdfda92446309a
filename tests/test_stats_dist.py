"""N9 tail probabilities against textbook critical values and numeric integration; ranks in ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.functions import dist
from hirelens.operators import inference


def values(spark, expr, *args):
    names = [f"a{i}" for i in range(len(args[0]))]
    rows = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in args],
                                 ", ".join(f"{n} double" for n in names))
    return [r[0] for r in rows.select(expr(*[F.col(n) for n in names])).collect()]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 10.0, 150.5, 1e6, 5e11, 1e25]
    got = values(spark, dist.log_gamma, *[(x,) for x in xs])
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-12)


def test_beta_inc_symmetry_and_closed_forms(spark):
    one = lambda a, b, x: dist.beta_inc(a, b, x, 1 - x)                                # noqa: E731
    got = values(spark, one, (2, 3, 0.4), (3, 2, 0.6), (1, 4, 0.3), (5, 1, 0.7), (2, 2, 0.0), (2, 2, 1.0), (2, 1, 0.9))
    assert got[0] + got[1] == pytest.approx(1.0, abs=1e-14)
    assert got[2:] == pytest.approx([1 - 0.7 ** 4, 0.7 ** 5, 0.0, 1.0, 0.81], abs=1e-14)


def test_t_critical_values(spark):
    got = values(spark, dist.t_two_sided, (2.228, 10), (1.96, 1e6), (-1.96, 1e6), (0, 5), (None, 5), (1, 0), (40, 8e8))
    assert got[0] == pytest.approx(0.05, abs=1e-3) and got[1] == pytest.approx(0.05, abs=1e-3)
    assert got[2] == got[1] and got[3] == 1.0 and got[4] is None and got[5] is None and 0 <= got[6] < 1e-300


def test_f_against_integration(spark):
    cases = [(3.316, 2, 30), (0.2, 5, 400), (1.1, 24, 42_000), (0.9, 24, 4_000_000), (7.5, 3, 90), (1.0, 40, 2)]
    got = values(spark, dist.f_tail, *cases)
    for (f, d1, d2), p in zip(cases, got):
        u = np.linspace(0, f, 400_001)[1:]          # density up to f by the midpoint rule
        x = u - f / 800_000
        log = (math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
               + (d1 / 2 - 1) * np.log(x) - (d1 + d2) / 2 * np.log1p(d1 * x / d2))
        assert p == pytest.approx(1 - np.exp(log).sum() * f / 400_000, abs=2e-8)
    assert values(spark, dist.f_tail, (4.0, 1, 1e6))[0] == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-6)
    assert values(spark, dist.f_tail, (0, 2, 9), (None, 2, 9), (1, 0, 9)) == [1.0, None, None]


def test_rho_p(spark):
    got = values(spark, dist.rho_p, (1.0, 50), (0.3, 50), (0.3, 2), (None, 50))
    assert got[0] == 0.0 and 0.0 < got[1] < 0.05 and got[2:] == [None, None]


def test_no_python_in_the_plan(spark, capsys):
    df = spark.range(3).select(dist.f_tail(F.col("id"), F.lit(2), F.lit(9)))
    df.explain()
    assert "Python" not in capsys.readouterr().out


@pytest.mark.parametrize("ranges", [1, 2, 7, 256])
def test_ranks_in_ranges_equal_average_ranks(spark, monkeypatch, ranges):
    monkeypatch.setattr(inference, "RANK_RANGES", max(ranges, 2))
    rng = np.random.default_rng(ranges)
    x = np.concatenate([rng.integers(0, 40, 500), rng.normal(0, 5, 200).round(1), [0.0] * 300])
    cells = spark.createDataFrame([(float(v),) for v in x], "x double").groupBy("x").agg(F.count("*").alias("__n"))
    got = {r.x: r.r for r in inference.rank_table(cells, "x", "r").collect()}
    order = np.sort(x)
    for v, r in got.items():
        at = np.flatnonzero(order == v)
        assert r == (at[0] + at[-1]) / 2 + 1
    assert len(got) == len(set(x.tolist()))
