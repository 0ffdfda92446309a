"""C2 education, C3 experience, C14 ordinal codes, C15 blank label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.text import any_substring, ustrip


def _education_case(t: Column, raw: Column) -> Column:
    expr = None
    for kw, label in dims.EDUCATION_RULES:
        cond = F.instr(t, kw) > 0
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    # a null/empty raw text matches no rule; it is checked last so that ``t``
    # sits in the first condition and is evaluated once per row
    return (expr.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
            .otherwise(F.lit(dims.EDUCATION_DEFAULT)))


def clean_education(text: Column) -> Column:
    """Ordered first-match substring rules; unmatched -> 不限; null/'' -> null."""
    return _education_case(ustrip(text), text)


def _tier_from_cap(cap: Column) -> Column:
    return (F.when(cap <= 1, "1年以下").when(cap <= 3, "1-3年").when(cap <= 5, "3-5年")
            .when(cap <= 10, "5-10年").otherwise("10年以上"))


def _tier_containing(years: Column) -> Column:
    return (F.when(years < 1, "1年以下").when(years < 3, "1-3年").when(years < 5, "3-5年")
            .when(years < 10, "5-10年").otherwise("10年以上"))


def _digits(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)).try_cast("array<bigint>")


def _experience_case(t: Column, nums: Column, raw: Column) -> Column:
    n = F.coalesce(F.size(nums), F.lit(0))
    first = F.get(nums, 0)
    years = F.when(F.size(nums) > 1, F.array_min(nums)).otherwise(first)
    return (F.when((n == 0) & (raw.isNull() | (raw == "")), F.lit(None).cast("string"))
            .when((n == 0) | any_substring(t, dims.EXPERIENCE_ANY_KWS), F.lit(dims.EXPERIENCE_ANY))
            .when(F.instr(t, "以下") > 0, _tier_from_cap(first))
            .otherwise(_tier_containing(years)))


def clean_experience(text: Column) -> Column:
    """Experience tier.

    blank -> null; "no requirement" phrases or no digits -> 应届/不限;
    ``N以下`` -> tier whose upper bound is N; otherwise the smallest number
    (single number as is) -> tier containing it.
    """
    t = ustrip(text)
    return _experience_case(t, _digits(t), text)


def with_levels(df: DataFrame, exp_col: str = "experience", edu_col: str = "education",
                exp_out: str = "experience", edu_out: str = "education") -> DataFrame:
    """C2 + C3 as staged projections: stripped texts and the digit array are real
    columns, so each is computed once per row."""
    st = df.withColumns({"__xt": ustrip(F.col(exp_col)), "__et": ustrip(F.col(edu_col))})
    st = st.withColumn("__xn", _digits(F.col("__xt")))
    st = st.withColumns({
        "__exp": _experience_case(F.col("__xt"), F.col("__xn"), F.col(exp_col)),
        "__edu": _education_case(F.col("__et"), F.col(edu_col)),
    })
    return (st.withColumns({exp_out: F.col("__exp"), edu_out: F.col("__edu")})
            .drop("__xt", "__et", "__xn", "__exp", "__edu"))


def _rank_map(ranks: dict) -> Column:
    items = []
    for k, v in ranks.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def education_rank(edu: Column) -> Column:
    """1..5 for known labels, null otherwise."""
    return F.try_element_at(_rank_map(dims.EDU_RANK), edu)


def experience_rank(exp: Column) -> Column:
    """0..5 for known tiers, null otherwise."""
    return F.try_element_at(_rank_map(dims.EXP_RANK), exp)


def order_index(c: Column, order: list[str]) -> Column:
    """Position of ``c`` in ``order``; unknown values sort last."""
    expr = None
    for i, v in enumerate(order):
        expr = F.when(c == v, F.lit(i)) if expr is None else expr.when(c == v, F.lit(i))
    return expr.otherwise(F.lit(len(order)))


def blank_label(c: Column) -> Column:
    """null/blank label shown as (空)."""
    t = ustrip(c)
    return F.when(t.isNull() | (t == ""), F.lit(dims.BLANK_LABEL)).otherwise(t)
