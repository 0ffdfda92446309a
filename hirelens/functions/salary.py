"""C1 parse_salary as native Column expressions (no Python UDF).

Result columns ``salary_min, salary_max, salary_avg`` in K CNY / month,
``decimal(20,2)``. Arithmetic is decimal so results are exact and identical
to the SQL oracle; the average of the two bounds is rounded half-even on
cents (``bround``), the other roundings half-up (``round``).

Deliberate deviations (documented in the README): a ``·N薪`` months suffix is
removed before the numbers are read (so ``20K·13薪`` is one number), and
``w``/``W`` count as 万 when filling a missing unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.dims import WORK_DAYS_PER_MONTH
from hirelens.functions.text import ustrip

NUM_UNIT = r"(\d+\.?\d*)\s*([Kk千万wW]?)"
UNITS = ("K", "k", "千", "万", "w", "W")
BLANKS = " \t\n\x0b\f\r"          # what \s matches
MONTHS_SUFFIX = r"[·xX*,，/、](\d{1,2})薪"
NUM_TYPE = "decimal(28,8)"
OUT_TYPE = "decimal(20,2)"
SALARY_COLS = ("salary_min", "salary_max", "salary_avg")


def compact(text: Column) -> Column:
    """Strip Unicode blanks at both ends, then drop ASCII spaces."""
    return F.replace(ustrip(text), F.lit(" "), F.lit(""))


def _months(t: Column) -> Column:
    """Months of pay from a ``·N薪`` suffix, default 12.

    The cast only runs on a non-empty match: casting the empty no-match string
    goes through Spark's exception path and costs microseconds per row.
    """
    m = F.regexp_extract(t, MONTHS_SUFFIX, 1)
    return F.coalesce(F.when(t.contains("薪"), F.when(m != "", m.try_cast("int"))), F.lit(12))


# Integer-cent arithmetic: a usual number (at most 8 characters, 4 decimals) is carried
# as ten-thousandths in a long; each rounding is an exact half-up integer division
# (2a + b) div 2b, free of BigDecimal. Any other number goes the same way in wide decimals.
_CENTS = {
    # day rate: x * 21.75 / 1000 K  -> cents = x_u * 2175 / 10^7
    1: "(2 * {x} * 2175 + 10000000) div 20000000",
    # year: x / 12 K -> cents = y_u / 1200
    2: "(2 * {y} + 1200) div 2400",
    # month: x * months / 12 K -> cents = y_u * months / 1200
    0: "(2 * {y} * __months + 1200) div 2400",
}


_USUAL = "length({n}) <= 8 AND (instr({n}, '.') = 0 OR length({n}) - instr({n}, '.') <= 4)"
#: A usual number without its point, times ten for every decimal that it lacks.
_TEN_THOUSANDTHS = """CASE WHEN {usual} THEN CASE WHEN instr({n}, '.') = 0 THEN cast({n} as bigint) * 10000
  ELSE cast(replace({n}, '.', '') as bigint) * element_at(array(10000, 1000, 100, 10, 1), length({n}) - instr({n}, '.') + 1)
  END END"""
_ROUNDED = "round({x} * {u} * {m} / cast(12 as decimal(2,0)), 2) * 100"


def _wide_cents(i: int) -> Column:
    """Cents of number ``i`` in decimal arithmetic; NULL beyond what a long holds."""
    x = f"try_cast(__m{i} as {NUM_TYPE})"
    u = f"cast(if(__u{i} in ('万', 'w', 'W'), 10, 1) as decimal(2,0))"
    one = "cast(1 as decimal(2,0))"
    day = f"round({x} * cast({WORK_DAYS_PER_MONTH} / 10 as decimal(4,3)), 0)"
    year = _ROUNDED.format(x=x, u=u, m=one)
    month = _ROUNDED.format(x=x, u=u, m="cast(__months as decimal(2,0))")
    return F.expr(f"try_cast(CASE __period WHEN 1 THEN {day} WHEN 2 THEN {year} ELSE {month} END as bigint)")


def with_salary(df: DataFrame, text_col: str = "salary_text") -> DataFrame:
    """Add salary_min/max/avg (decimal(20,2)) through staged projections.

    Every intermediate is a column used more than once by the next stage, so
    Catalyst keeps the stages apart instead of inlining (and re-evaluating) the
    regex extraction inside every CASE branch. A filter on the results would be pushed
    through all stages and multiply at each; the row id test, true for every row, keeps
    it above them. Filter on other columns before the call, so that the scan gets them.
    """
    t, d = F.col("__t"), F.col("__d")
    st = df.withColumn("__t", compact(F.col(text_col)))
    st = st.withColumn("__d", F.when(t.contains("薪"), F.regexp_replace(t, MONTHS_SUFFIX, "")).otherwise(t))
    st = st.withColumns({
        "__hits": F.regexp_extract_all(d, F.lit(NUM_UNIT), F.lit(0)),
        "__months": _months(t),
        # 0 = month, 1 = day, 2 = year
        "__period": F.when(t.contains("/天") | t.contains("/日"), F.lit(1))
                     .when(t.contains("/年"), F.lit(2)).otherwise(F.lit(0)),
        "__fill": F.when(t.contains("万") | t.contains("w") | t.contains("W"), F.lit("万"))
                   .when(t.contains("K") | t.contains("k") | t.contains("千"), F.lit("K"))
                   .otherwise(F.lit("")),
        "__open": t.contains("以上") | t.contains("+"),
    })
    # a hit is a number, perhaps blanks, perhaps a unit: the first two are taken apart
    st = st.withColumns({"__n": F.size("__hits"), "__h0": F.get(F.col("__hits"), 0), "__h1": F.get(F.col("__hits"), 1)})
    for i in (0, 1):
        hit = F.col(f"__h{i}")
        st = st.withColumn(f"__e{i}", F.when(F.right(hit, F.lit(1)).isin(*UNITS), F.right(hit, F.lit(1))))
    st = st.withColumns({f"__m{i}": F.btrim(F.when(F.col(f"__e{i}").isNull(), F.col(f"__h{i}")).otherwise(
        F.substr(F.col(f"__h{i}"), F.lit(1), F.length(f"__h{i}") - 1)), F.lit(BLANKS)) for i in (0, 1)})
    st = st.withColumns({f"__x{i}": F.expr(_TEN_THOUSANDTHS.format(n=f"__m{i}", usual=_USUAL.format(n=f"__m{i}")))
                         for i in (0, 1)} | {f"__u{i}": F.coalesce(F.col(f"__e{i}"), F.col("__fill")) for i in (0, 1)})
    st = st.withColumns({
        f"__y{i}": F.when(F.col(f"__u{i}").isin("万", "w", "W"), F.col(f"__x{i}") * 10)
                    .otherwise(F.col(f"__x{i}")) for i in (0, 1)})

    def cents(i: int) -> Column:
        x, y = f"__x{i}", f"__y{i}"
        usual = (F.when(F.col("__period") == 1, F.expr(_CENTS[1].format(x=x)))
                 .when(F.col("__period") == 2, F.expr(_CENTS[2].format(y=y)))
                 .otherwise(F.expr(_CENTS[0].format(y=y))))
        return F.when(F.col(x).isNotNull(), usual).otherwise(_wide_cents(i))

    st = st.withColumn("__c0", cents(0))
    st = st.withColumn("__c1", F.when(F.col("__n") == 1, F.col("__c0")).otherwise(cents(1)))
    c0, c1, n = F.col("__c0"), F.col("__c1"), F.col("__n")
    limit = F.lit(4_000_000_000_000_000_000)  # so that the sum of both bounds fits a long
    st = st.withColumns({
        "__ok": (F.monotonically_increasing_id() >= 0) & (n > 0) & c0.isNotNull() & c1.isNotNull() & (c0 < limit) & (c1 < limit),
        "__oe": (n == 1) & F.col("__open"),
        "__s": c0 + c1,
    })
    ok, oe = F.col("__ok"), F.col("__oe")
    q = F.expr("__s div 2")
    avg_c = q + F.when((F.col("__s") % 2 == 1) & (q % 2 == 1), F.lit(1)).otherwise(F.lit(0))

    def dec(c: Column) -> Column:
        return (c.cast("decimal(19,0)") * F.lit(0.01).cast("decimal(2,2)")).cast(OUT_TYPE)

    null_dec = F.lit(None).cast(OUT_TYPE)
    out = st.withColumns({
        "salary_min": F.when(ok, dec(c0)).otherwise(null_dec),
        "salary_max": F.when(ok & ~oe, dec(c1)).otherwise(null_dec),
        "salary_avg": F.when(ok & oe, dec(c0)).when(ok, dec(avg_c)).otherwise(null_dec),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__")])
