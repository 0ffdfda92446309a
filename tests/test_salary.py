"""C1 parse_salary: the reference's own cases plus documented quirks."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hirelens.functions.salary import with_salary

D = Decimal

# (text, (min, max, avg))
CASES = [
    ("15-25K", (D("15"), D("25"), D("20"))),
    ("8千-1.2万", (D("8"), D("12"), D("10"))),
    ("1.5-3万", (D("15"), D("30"), D("22.5"))),
    ("15-25K·13薪", (D("16.25"), D("27.08"), D("21.66"))),
    ("30-60万/年", (D("25"), D("50"), D("37.5"))),
    ("800元/天", (D("17.4"), D("17.4"), D("17.4"))),
    ("20K以上", (D("20"), None, D("20"))),
    ("面议", (None, None, None)),
    (None, (None, None, None)),
    ("", (None, None, None)),
    ("   ", (None, None, None)),
    ("薪资电议", (None, None, None)),
    # listed but unasserted in the reference self-test
    ("18-30万/年", (D("15"), D("25"), D("20"))),
    ("40-80万/年", (D("33.33"), D("66.67"), D("50"))),
    ("200元/天", (D("4.35"), D("4.35"), D("4.35"))),
    ("500元/天", (D("10.88"), D("10.88"), D("10.88"))),
    # fixture goldens
    ("30-50万/年", (D("25"), D("41.67"), D("33.34"))),
    ("220元/天", (D("4.79"), D("4.79"), D("4.79"))),
    # quirk X1 (deliberate deviation): months suffix is not read as a number
    ("20K·13薪", (D("21.67"), D("21.67"), D("21.67"))),
    # quirk X2: w counts as 10k for the missing unit
    ("1.5-3w", (D("15"), D("30"), D("22.5"))),
    # quirk X3: yuan/month and hourly pay are read as thousands (audits catch them)
    ("8000-12000元/月", (D("8000"), D("12000"), D("10000"))),
    ("200元/小时", (D("200"), D("200"), D("200"))),
    # open ended with '+', unicode blanks around
    ("　20K+\t", (D("20"), None, D("20"))),
]


def _norm(v):
    return None if v is None else v.normalize()


def test_reference_cases(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "salary_text string")
    out = with_salary(df).select("salary_text", "salary_min", "salary_max", "salary_avg")
    got = {r[0]: tuple(_norm(x) for x in r[1:]) for r in out.collect()}
    for text, exp in CASES:
        assert got[text] == tuple(_norm(x) for x in exp), text


def test_large_and_finely_divided_numbers(spark):
    want = {"123456789K": 123456789.0, "100000000元/天": 2175000.0, "99999999999元/年": 8333333333.25, "1.23495K": 1.23}
    df = spark.createDataFrame([(t,) for t in want], "salary_text string")
    got = {r.salary_text: float(r.salary_avg) for r in with_salary(df).collect()}
    assert got == want


def test_bounds_property(spark):
    from hirelens.sources.tables import silver
    from conftest import SF_SMALL
    s = silver(spark, SF_SMALL)
    bad = s.where(F.col("salary_max").isNotNull() & ~(
        (F.col("salary_min") <= F.col("salary_avg")) & (F.col("salary_avg") <= F.col("salary_max"))))
    assert bad.count() == 0
