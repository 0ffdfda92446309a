"""Dashboard aggregates over the silver table.

Conventions shared with the SQL oracle:
* salaries leave as ``double``; averages and shares are rounded to 6 dp,
  medians are exact (``median`` = interpolated percentile 0.5) rounded to 6 dp;
* every top-k orders by the value desc, then the name asc (a total order, so
  membership of the top-k is deterministic);
* filters come first so Parquet pushdown and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.levels import blank_label, order_index
from hirelens.functions.tags import stored_tags
from hirelens.functions.text import ustrip


def sal(c: str = "salary_avg"):
    return F.col(c).cast("double")


def r6(c):
    return F.round(c, 6)


def med(c: str = "salary_avg"):
    """Exact median; its buffer holds a count per distinct salary, which has two decimals."""
    return F.round(F.median(sal(c)), 6)


def mean(c: str = "salary_avg"):
    return F.round(F.avg(F.col(c)), 6).cast("double")


def pct(n, total):
    """n * 100 / total, exact decimal, half-up to 6 dp, as double."""
    return F.round(n.cast("decimal(20,0)") * F.lit(100) / total.cast("decimal(20,0)"),
                   6).cast("double")


def top(df: DataFrame, n: int, value: str, name: str) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(name).asc()).limit(n)


def with_salary_only(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("salary_avg").isNotNull())


# A1 ---------------------------------------------------------------------------
def overview(silver: DataFrame) -> DataFrame:
    """Rows, distinct non-null cities, mean salary, max salary_max (0 when none)."""
    return silver.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.col("city")).alias("city_count"),
        F.coalesce(mean("salary_avg"), F.lit(0.0)).alias("avg_salary"),
        F.coalesce(F.max(sal("salary_max")), F.lit(0.0)).alias("max_salary"))


# A2 ---------------------------------------------------------------------------
def salary_by_keyword(silver: DataFrame) -> DataFrame:
    return (silver.where(F.col("salary_avg").isNotNull() & F.col("keyword").isNotNull())
            .groupBy("keyword")
            .agg(mean("salary_avg").alias("avg_salary"), F.count(F.lit(1)).alias("n")))


# A3 ---------------------------------------------------------------------------
def jobs_by_city(silver: DataFrame, cities: list[str], top_n: int = 10) -> DataFrame:
    agg = (silver.where(F.col("city").isin(cities)).groupBy("city")
           .agg(F.count(F.lit(1)).alias("n")))
    return top(agg, top_n, "n", "city")


# A4 ---------------------------------------------------------------------------
def salary_by_city(silver: DataFrame, cities: list[str], top_n: int = 10,
                   min_samples: int = 20) -> DataFrame:
    """Exact median salary per whitelisted city, n >= min_samples, top n by median."""
    agg = (silver.where(F.col("salary_avg").isNotNull() & F.col("city").isin(cities))
           .groupBy("city")
           .agg(med().alias("median_salary"), F.count(F.lit(1)).alias("n"))
           .where(F.col("n") >= min_samples))
    return top(agg, top_n, "median_salary", "city")


# A5 / A6 / A9 -----------------------------------------------------------------
def distribution(silver: DataFrame, col: str) -> DataFrame:
    return (silver.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")))


def education_dist(silver):
    return distribution(silver, "education")


def experience_dist(silver):
    return distribution(silver, "experience")


def jobs_by_source(silver):
    return distribution(silver, "source")


# A7 ---------------------------------------------------------------------------
def exploded_tags(silver: DataFrame, with_salary: bool = False) -> DataFrame:
    """One row per tag occurrence (raw tags, not alias-normalised)."""
    cols = [F.explode(stored_tags(F.col("tags"))).alias("tag")]
    if with_salary:
        cols.append(F.col("salary_avg"))
    return silver.where(F.col("tags").isNotNull() & (F.col("tags") != "")).select(*cols)


def top_skills(silver: DataFrame, top_n: int = 20) -> DataFrame:
    agg = exploded_tags(silver).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return top(agg, top_n, "n", "tag")


# A8 ---------------------------------------------------------------------------
def salary_by_skill(silver: DataFrame, top_n: int = 15, min_samples: int = 5) -> DataFrame:
    agg = (exploded_tags(with_salary_only(silver), with_salary=True).groupBy("tag")
           .agg(med().alias("median_salary"), F.count(F.lit(1)).alias("n"))
           .where(F.col("n") >= min_samples))
    return top(agg, top_n, "median_salary", "tag")


# A10 --------------------------------------------------------------------------
def salary_by_source(silver: DataFrame) -> DataFrame:
    return (silver.where(F.col("salary_avg").isNotNull() & F.col("source").isNotNull())
            .groupBy("source").agg(med().alias("median_salary"), F.count(F.lit(1)).alias("n")))


# A11 --------------------------------------------------------------------------
def every_pair(rows: DataFrame, cols: DataFrame, slots: int = 16) -> DataFrame:
    """All combinations of two small tables: ``cols`` is dealt to slots, ``rows`` goes to each of them."""
    spread = rows.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = cols.withColumn("__slot", F.pmod(F.xxhash64(*cols.columns), F.lit(slots)).cast("int"))
    return spread.join(dealt, "__slot").drop("__slot")


def grid(cells: DataFrame, row: str, col: str, configured: list[str], fill: dict) -> DataFrame:
    """Long form of a matrix: every ``row`` with every ``col`` label that is seen at all.

    ``fill`` gives the values of empty cells. ``ord`` is the label's place: configured labels in their
    order, then the others by name. ``cells`` has one row per seen cell and is read three times.
    """
    rows, labels = cells.select(row).distinct(), cells.select(col).distinct()
    known = order_index(F.col(col), configured)     # one past the configured labels for all others
    by_name = F.dense_rank().over(Window.partitionBy("__known").orderBy(col)) - 1     # over the distinct labels
    extra = F.col("__known") == len(configured)
    labels = labels.withColumn("__known", F.coalesce(known, F.lit(len(configured)))).withColumn(
        "ord", (F.col("__known") + F.when(extra, by_name).otherwise(0)).cast("int")).drop("__known")
    return every_pair(rows, labels).join(cells, [row, col], "left").fillna(fill)


EDU_COLUMNS = tuple(zip(dims.EDU_ORDER, ("pct_doctor", "pct_master", "pct_bachelor",
                                         "pct_college", "pct_highschool", "pct_any")))


def education_by_source(silver: DataFrame) -> DataFrame:
    """Row-percent matrix source x education over the labels that the cleaner emits (missing = 0).

    One grouped pass with conditional counts: no pivot discovery job, no grid join.
    ``education_grid`` is the form for tables with other labels.
    """
    base = silver.where(F.col("source").isNotNull() & F.col("education").isNotNull())
    total = F.count(F.lit(1))
    cols = [pct(F.count_if(F.col("education") == lab), total).alias(name)
            for lab, name in EDU_COLUMNS]
    return base.groupBy("source").agg(total.alias("n"), *cols)


def education_grid(silver: DataFrame) -> DataFrame:
    """Long row-percent matrix source x education, whatever labels the table holds."""
    base = silver.where(F.col("source").isNotNull() & F.col("education").isNotNull())
    counts = base.groupBy("source", "education").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("source"))           # over a source's labels
    cells = counts.withColumn("pct", pct(F.col("n"), total))
    return grid(cells, "source", "education", dims.EDU_ORDER, {"n": 0, "pct": 0.0})


# A12 --------------------------------------------------------------------------
def salary_by_source_keyword(silver: DataFrame, keywords: list[str]) -> DataFrame:
    """Long form of the source x keyword mean-salary matrix; an empty cell has a NULL mean and n 0."""
    base = silver.where(F.col("salary_avg").isNotNull() & F.col("source").isNotNull()
                        & F.col("keyword").isNotNull())
    cells = base.groupBy("source", "keyword").agg(mean("salary_avg").alias("avg_salary"),
                                                  F.count(F.lit(1)).alias("n"))
    # every configured keyword that is seen at all, for every source, and the seen cells
    wanted = F.explode(F.array(*[F.lit(k) for k in keywords]))
    known = cells.select("keyword").distinct()
    grid = (cells.select("source").distinct().withColumn("keyword", wanted).join(known, "keyword", "left_semi")
            .select("source", "keyword").union(cells.select("source", "keyword")).distinct())
    return (grid.join(cells, ["source", "keyword"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("kw_ord", order_index(F.col("keyword"), keywords)))


# A13 --------------------------------------------------------------------------
def city_geo(silver: DataFrame, dim_city: DataFrame, min_samples: int = 5) -> DataFrame:
    """Per city with coordinates: all-row count, median of known salaries, lon/lat."""
    agg = (silver.where(F.col("city").isNotNull()).groupBy("city")
           .agg(F.count(F.lit(1)).alias("n"), med().alias("median_salary"))
           .where(F.col("n") >= min_samples))
    coords = dim_city.select(F.col("name").alias("city"), "lon", "lat")
    return agg.join(coords, "city", "inner").select(
        "city", "n", "median_salary", "lon", "lat")


# A14 --------------------------------------------------------------------------
def salary_histogram(silver: DataFrame, bin_width: int = 5, cap: int = 50) -> DataFrame:
    """Counts per bin of width ``bin_width`` up to ``cap`` plus an overflow bin; empty bins kept."""
    if cap % bin_width:
        raise ValueError("bin_width must divide cap")
    n_bins = cap // bin_width
    spark = silver.sparkSession
    counts = (with_salary_only(silver)
              .select(F.least(F.floor(sal() / F.lit(bin_width)), F.lit(n_bins)).cast("int")
                      .alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    # the bin domain is fixed by the parameters (n_bins + 1 rows)
    bins = spark.range(n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    label = F.when(F.col("bin") == n_bins, F.lit(f"{cap}K+")).otherwise(
        F.concat((F.col("bin") * bin_width).cast("string"), F.lit("-"),
                 ((F.col("bin") + 1) * bin_width).cast("string"), F.lit("K")))
    # counts has at most n_bins + 1 rows (one per bin)
    return (bins.join(F.broadcast(counts), "bin", "left")
            .select("bin", label.alias("label"), F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def salary_hist_summary(silver: DataFrame) -> DataFrame:
    s = with_salary_only(silver)
    return s.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(med(), F.lit(0.0)).alias("median_salary"),
                 F.coalesce(mean("salary_avg"), F.lit(0.0)).alias("mean_salary"))


# A17 --------------------------------------------------------------------------
def experience_tiers(silver: DataFrame, source: str | None = None) -> DataFrame:
    """Per experience tier: count, share %, median/mean of known salaries, imbalance flag.

    Shares use a window over the aggregated tiers (a handful of rows), not over postings.
    """
    base = silver if source is None else silver.where(F.col("source") == source)
    agg = (base.select(blank_label(F.col("experience")).alias("tier"), "salary_avg")
           .groupBy("tier")
           .agg(F.count(F.lit(1)).alias("n"), med().alias("median_salary"),
                mean("salary_avg").alias("mean_salary"),
                F.count("salary_avg").alias("n_salary")))
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    return agg.select(
        "tier", order_index(F.col("tier"), dims.EXP_ORDER).alias("tier_ord"), "n",
        pct(F.col("n"), total).alias("pct"), "median_salary", "mean_salary", "n_salary",
        (F.max("n").over(everything) * F.lit(100.0) / total >= 50).alias("imbalanced"))


# A18 --------------------------------------------------------------------------
def group_values(silver: DataFrame, col: str) -> DataFrame:
    """N1 grouping rule: trimmed label; blank, 'None' and '不限' dropped; salary known."""
    key = ustrip(F.col(col))
    return (silver.where(F.col("salary_avg").isNotNull())
            .select(key.alias("grp"), "salary_avg")
            .where(F.col("grp").isNotNull() & (F.col("grp") != "")
                   & ~F.col("grp").isin(dims.GROUP_EXCLUDE)))


def group_describe(silver: DataFrame, col: str, min_n: int = dims.MIN_GROUP_N) -> DataFrame:
    """n / median / mean per group; ``valid`` marks groups entering the tests (n >= min_n)."""
    return (group_values(silver, col).groupBy("grp")
            .agg(F.count(F.lit(1)).alias("n"), med().alias("median_salary"),
                 mean("salary_avg").alias("mean_salary"))
            .withColumn("valid", F.col("n") >= min_n))


# A19 --------------------------------------------------------------------------
def feature_options(frame: DataFrame, cities: list[str]) -> DataFrame:
    """Distinct options per categorical feature: cities in whitelist order, others sorted."""
    # one scan: a row gives one (feature, value) pair per categorical column
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                      for c in dims.CAT_FEATURES])
    out = (frame.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")
           .where(F.col("value").isNotNull()
                  & ((F.col("feature") != "city") | F.col("value").isin(cities))).distinct())
    return out.withColumn(
        "city_ord", F.when(F.col("feature") == "city", order_index(F.col("value"), cities)))
