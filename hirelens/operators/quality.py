"""Q1-Q9 read-only audits and D1-D5 preview/apply clean-up jobs.

A clean-up never deletes row by row: the doomed keys form a DataFrame and
both tables are rewritten as ``table LEFT ANTI JOIN doomed`` on
``(source, job_key)``. ``apply=False`` returns the preview only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.flags import in_whitelist, nontech_flag
from hirelens.functions.levels import blank_label
from hirelens.operators.stats import mean, med
from hirelens.functions.text import ustrip
from hirelens.sources.sinks import write_snapshot

KEYS = ["source", "job_key"]


def _labelled(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Both tables stacked with a ``tbl`` label (narrow columns only)."""
    cols = ["source", "job_key", "city"]
    return (silver.select(F.lit("job").alias("tbl"), *cols)
            .unionByName(bronze.select(F.lit("raw_job").alias("tbl"), *cols)))


# Q1 ---------------------------------------------------------------------------
def hc_counts(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    c = _labelled(silver, bronze).groupBy().agg(
        F.count_if(F.col("tbl") == "job").alias("job_rows"),
        F.count_if(F.col("tbl") == "raw_job").alias("raw_job_rows"))
    return c.withColumn("consistent", F.col("job_rows") == F.col("raw_job_rows"))


# Q2 ---------------------------------------------------------------------------
def hc_duplicates(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Duplicate key groups per table: each table is aggregated on its own key
    (co-partitioned with its buckets, no shuffle) before the one-row results meet."""
    def dup(t: DataFrame, name: str) -> DataFrame:
        per_key = t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("c"))
        return per_key.agg(F.count_if(F.col("c") > 1).alias("dup_groups")).select(
            F.lit(name).alias("tbl"), "dup_groups")
    return dup(silver, "job").unionByName(dup(bronze, "raw_job"))


# Q3 ---------------------------------------------------------------------------
def hc_sources(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    return _labelled(silver, bronze).groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("n"))


# Q4 ---------------------------------------------------------------------------
def hc_offlist(silver: DataFrame, bronze: DataFrame, cities: list[str]) -> DataFrame:
    """Rows per (table, city) whose city is null or off the whitelist."""
    off = F.col("city").isNull() | ~F.col("city").isin(cities)
    return (_labelled(silver, bronze).where(off).groupBy("tbl", "city")
            .agg(F.count(F.lit(1)).alias("n")))


# Q5 ---------------------------------------------------------------------------
def hc_nulls(silver: DataFrame) -> DataFrame:
    """Seven null/blank checks in one pass, unpivoted to (check, n)."""
    def blank(c):
        return F.col(c).isNull() | (F.col(c) == "")
    checks = [
        ("salary_avg_null", F.col("salary_avg").isNull()),
        ("salary_avg_le_0", F.col("salary_avg") <= 0),
        ("city_blank", blank("city")),
        ("experience_blank", blank("experience")),
        ("education_blank", blank("education")),
        ("title_blank", blank("title")),
        ("keyword_blank", blank("keyword")),
    ]
    wide = silver.agg(*[F.count_if(cond).alias(name) for name, cond in checks])
    stack = "stack({}, {}) as (check_name, n)".format(
        len(checks), ", ".join(f"'{n}', {n}" for n, _ in checks))
    return wide.selectExpr(stack)


# Q6 ---------------------------------------------------------------------------
def hc_salary(silver: DataFrame, threshold: float = 200.0) -> DataFrame:
    s = silver.where(F.col("salary_avg").isNotNull())
    a = F.col("salary_avg")
    return s.agg(
        F.count_if(a > threshold).alias("gt_threshold"),
        F.count_if((a < 1) & (a > 0)).alias("lt1"),
        F.count_if(F.col("salary_min") > F.col("salary_max")).alias("min_gt_max"),
        F.min(a).cast("double").alias("min_avg"),
        F.max(a).cast("double").alias("max_avg"),
        mean("salary_avg").alias("mean_avg"))


# Q7 / Q8 / Q9 -------------------------------------------------------------------
def _nz_label(c: str):
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(dims.BLANK_LABEL))


def hc_cities(silver: DataFrame) -> DataFrame:
    return silver.groupBy(_nz_label("city").alias("city")).agg(F.count(F.lit(1)).alias("n"))


def hc_keywords(silver: DataFrame) -> DataFrame:
    return silver.groupBy(_nz_label("keyword").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


def hc_experience(silver: DataFrame) -> DataFrame:
    return (silver.groupBy(_nz_label("experience").alias("experience"))
            .agg(F.count(F.lit(1)).alias("n"), mean("salary_avg").alias("avg_salary")))


# D1 ---------------------------------------------------------------------------
def intern_flagged(silver: DataFrame, source: str, keywords=None, negations=None) -> DataFrame:
    kws = keywords if keywords is not None else dims.INTERN_KWS
    negs = negations if negations is not None else dims.INTERN_NEGATIONS
    from hirelens.functions.text import any_substring
    t = F.col("title")
    flag = F.coalesce((t != "") & ~any_substring(t, negs) & any_substring(t, kws), F.lit(False))
    return silver.where(F.col("source") == source).withColumn("flag", flag)


def clean_intern_report(silver: DataFrame, source: str, keywords=None, negations=None) -> DataFrame:
    """Preview: total, flagged, kept, median salary before and after (0 when none)."""
    f = intern_flagged(silver, source, keywords, negations)
    s = F.col("salary_avg").cast("double")
    return f.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("flag")).alias("flagged"),
        F.count_if(~F.col("flag")).alias("kept"),
        F.coalesce(F.round(F.median(s), 6), F.lit(0.0)).alias("median_before"),
        F.coalesce(F.round(F.median(F.when(~F.col("flag"), s)), 6), F.lit(0.0)).alias("median_after"))


def doomed_intern(silver, source, keywords=None, negations=None) -> DataFrame:
    return intern_flagged(silver, source, keywords, negations).where("flag").select(*KEYS)


def apply_delete(silver: DataFrame, bronze: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key-aligned delete on both tables: ``LEFT ANTI JOIN`` on (source, job_key)."""
    return (silver.join(doomed, KEYS, "left_anti"), bronze.join(doomed, KEYS, "left_anti"))


def delete_summary(silver: DataFrame, bronze: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows deleted/kept for both tables: one left join of each with the distinct doomed keys."""
    gone = doomed.select(*KEYS).distinct().withColumn("gone", F.lit(1))
    parts = [t.select(*KEYS).join(gone, KEYS, "left").select(F.lit(name).alias("tbl"), "gone")
             for name, t in (("job", silver), ("raw_job", bronze))]
    return parts[0].unionByName(parts[1]).groupBy("tbl").agg(
        F.count("gone").alias("deleted"), F.count_if(F.col("gone").isNull()).alias("kept"))


# D2 ---------------------------------------------------------------------------
def clean_offlist_report(silver: DataFrame, cities: list[str]) -> DataFrame:
    """Off-whitelist rows per (source, city); blank city shown as <空>."""
    off = silver.where(~in_whitelist(F.col("city"), cities))
    # (city or "<空>").strip(): only null/empty become <空>; blanks strip to ""
    c = F.col("city")
    label = F.when(c.isNull() | (c == ""), F.lit("<空>")).otherwise(ustrip(c))
    return off.groupBy("source", label.alias("city")).agg(F.count(F.lit(1)).alias("n"))


def clean_offlist_keep(silver: DataFrame, bronze: DataFrame, cities: list[str]) -> tuple[DataFrame, DataFrame]:
    """The whitelist predicate applied to each table independently."""
    return (silver.where(in_whitelist(F.col("city"), cities)),
            bronze.where(in_whitelist(F.col("city"), cities)))


# D3 ---------------------------------------------------------------------------
def nontech_flagged(silver: DataFrame, keyword: str, tech=None, nontech=None) -> DataFrame:
    return (silver.where(F.col("keyword") == keyword)
            .withColumn("flag", nontech_flag(F.col("title"), tech, nontech)))


def clean_nontech_report(silver: DataFrame, keyword: str, tech=None, nontech=None) -> DataFrame:
    f = nontech_flagged(silver, keyword, tech, nontech)
    sal = F.col("salary_avg")
    return f.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("flag")).alias("n_delete"),
        F.coalesce(F.round(F.avg(F.when(F.col("flag"), sal)), 6).cast("double"), F.lit(0.0))
        .alias("avg_delete"),
        F.count_if(~F.col("flag")).alias("n_keep"),
        F.coalesce(F.round(F.avg(F.when(~F.col("flag"), sal)), 6).cast("double"), F.lit(0.0))
        .alias("avg_keep"))


def doomed_nontech(silver, keyword, tech=None, nontech=None) -> DataFrame:
    return nontech_flagged(silver, keyword, tech, nontech).where("flag").select(*KEYS)


def nontech_dump(silver, keyword, tech=None, nontech=None) -> DataFrame:
    """One text line per row to delete (the full list, not a sample)."""
    f = nontech_flagged(silver, keyword, tech, nontech).where("flag")
    return f.select(F.format_string("[%s] %s  (%sK)  %s", F.col("city"), F.col("title"),
                                    F.coalesce(F.col("salary_avg").cast("double").cast("string"),
                                               F.lit("None")),
                                    F.col("salary_text")).alias("value"))


# D4 ---------------------------------------------------------------------------
def clean_outlier_report(silver: DataFrame, bronze: DataFrame, threshold: float = 200.0) -> DataFrame:
    """Rows with salary_avg above the threshold, with how many bronze rows share the key."""
    hits = silver.where(F.col("salary_avg") > threshold).select(
        *KEYS, "city", "title", "salary_text", F.col("salary_avg").cast("double").alias("salary_avg"))
    # the few hit keys thin out bronze before anything of it is counted
    b = (bronze.select(*KEYS).join(hits.select(*KEYS).distinct(), KEYS, "left_semi")
         .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("raw_hits")))
    return (hits.join(b, KEYS, "left")
            .withColumn("raw_hits", F.coalesce(F.col("raw_hits"), F.lit(0)))
            .orderBy(F.col("salary_avg").desc(), *KEYS))


def doomed_outlier(silver: DataFrame, threshold: float = 200.0) -> DataFrame:
    return silver.where(F.col("salary_avg") > threshold).select(*KEYS)


# D5 / S15 -----------------------------------------------------------------------
def run_cleanup(silver: DataFrame, bronze: DataFrame, doomed: DataFrame, apply: bool = False,
                out: str | None = None) -> DataFrame:
    """Preview/apply switch shared by the clean-up jobs.

    Preview (default) only returns the deleted/kept counts. ``apply=True`` also
    writes both tables without the doomed keys as one snapshot below ``out``;
    readers switch to it afterwards, the old one stays intact.
    """
    summary = delete_summary(silver, bronze, doomed)
    if apply:
        if not out:
            raise ValueError("apply=True needs out")
        write_snapshot(out, *apply_delete(silver, bronze, doomed))
    return summary


def preview_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of a preview in a fixed order (deterministic sample)."""
    return df.orderBy(*(order or KEYS)).limit(n)
