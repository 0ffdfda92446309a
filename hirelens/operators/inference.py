"""ANOVA + eta squared, Welch t + Cohen's d, Spearman correlations.

Everything is computed from per-group moments (count, mean, sample variance)
or from a distinct-value rank table, so no task ever holds a whole group:
the group aggregates combine map-side and the tables derived from them are
bounded by the number of groups / distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.dist import f_tail, rho_p, t_two_sided
from hirelens.functions.flags import d_label, eta_label, p_stars, rho_direction, rho_strength
from hirelens.functions.levels import education_rank, experience_rank, order_index
from hirelens.functions.tags import skill_count
from hirelens.functions.text import ustrip
from hirelens.operators.stats import group_values
from hirelens.session import work_root


def group_moments(silver: DataFrame, col: str) -> DataFrame:
    """n, mean, sample variance and exact median of salary per N1 group."""
    v = F.col("salary_avg").cast("double")
    return (group_values(silver, col).groupBy("grp")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
                 F.var_samp(v).alias("var"), F.median(v).alias("median")))


def anova(silver: DataFrame, col: str, min_n: int = dims.MIN_GROUP_N) -> DataFrame:
    """One-way ANOVA over groups with n >= min_n: k, N, F, eta^2 (null when k < 2)."""
    g = group_moments(silver, col).where(F.col("n") >= min_n)
    everything = Window.partitionBy()
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(everything)
                     / F.sum("n").over(everything))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"),
              F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"),
              F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    k, n = F.col("k"), F.col("n_total")
    f = F.when((k >= 2) & (n > k) & (F.col("ssw") > 0),
               (F.col("ssb") / (k - 1)) / (F.col("ssw") / (n - k)))
    sst = F.col("ssb") + F.col("ssw")
    eta = F.when(k >= 2, F.when(sst > 0, F.col("ssb") / sst).otherwise(F.lit(0.0)))
    return a.select(F.lit(col).alias("factor"), "k", F.coalesce(n, F.lit(0)).alias("n_total"),
                    F.round(f, 6).alias("f_stat"), F.round(eta, 6).alias("eta_sq"))


def anova_report(silver: DataFrame, col: str, min_n: int = dims.MIN_GROUP_N) -> DataFrame:
    """ANOVA with p-value (F tail) and the effect-size label."""
    a = anova(silver, col, min_n)
    p = f_tail(F.col("f_stat"), F.col("k") - 1, F.col("n_total") - F.col("k"))
    return a.withColumn("p_value", p).withColumn("stars", p_stars(F.col("p_value"))) \
            .withColumn("effect", eta_label(F.col("eta_sq")))


def _pair_rows(silver: DataFrame, col: str, pairs, min_n: int) -> DataFrame:
    """(a, b) and the moments of both groups, from one pass over the group table.

    Given pairs become a literal list exploded over the groups, so a group's row goes to its pairs and
    each pair picks its two sides by a conditional aggregate. Without pairs it is the group with the
    highest median against the one with the lowest, among those of ``min_n`` rows (the name breaks ties).
    """
    g = group_moments(silver, col).withColumn("s", F.struct("n", "mean", "var", "median"))
    if pairs is None:
        place = F.struct("median", "grp")
        both = g.where(F.col("n") >= min_n).agg(
            F.max_by("grp", place).alias("a"), F.min_by("grp", place).alias("b"),
            F.max_by("s", place).alias("sa"), F.min_by("s", place).alias("sb")).where(F.col("a").isNotNull())
    else:
        wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                           for i, (a, b) in enumerate(pairs)])
        sides = g.select("grp", "s", F.explode(wanted).alias("p"))
        found = sides.groupBy("p.i").agg(*[F.max(F.when(F.col("grp") == F.col(f"p.{x}"), F.col("s"))).alias(f"s{x}")
                                           for x in "ab"])
        listed = silver.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                                     "i int, a string, b string")
        both = listed.join(found, "i", "left")          # a pair without rows stays, as skipped
    return both.select("a", "b", *[F.col(f"s{x}.{c}").alias(f"{c}_{x}")
                                   for x in "ab" for c in ("n", "mean", "var", "median")])


def posthoc_pairs(silver: DataFrame, col: str, pairs=None,
                  min_n: int = dims.MIN_GROUP_N) -> DataFrame:
    """Welch t and Cohen's d for each pair; 'skipped' when a side has n < min_n."""
    j = _pair_rows(silver, col, pairs, min_n)
    na, nb = F.col("n_a"), F.col("n_b")
    va, vb = F.col("var_a"), F.col("var_b")
    ok = na.isNotNull() & nb.isNotNull() & (na >= min_n) & (nb >= min_n)
    se2 = va / na + vb / nb
    t = F.when(ok & (se2 > 0), (F.col("mean_a") - F.col("mean_b")) / F.sqrt(se2))
    dfree = F.when(ok & (se2 > 0), se2 * se2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)))
    sp = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    d = F.when(ok, F.when((na >= 2) & (nb >= 2) & (sp > 0),
                          (F.col("mean_a") - F.col("mean_b")) / sp).otherwise(F.lit(0.0)))
    return j.select(
        F.lit(col).alias("factor"), F.col("a").alias("group_a"), F.col("b").alias("group_b"),
        F.when(ok, "ok").otherwise("skipped").alias("status"),
        F.when(ok, na).alias("n_a"), F.when(ok, nb).alias("n_b"),
        F.when(ok, F.round(F.col("median_a"), 6)).alias("median_a"),
        F.when(ok, F.round(F.col("median_b"), 6)).alias("median_b"),
        F.round(t, 6).alias("t_stat"), F.round(dfree, 6).alias("df"),
        F.round(d, 6).alias("cohens_d"))


def posthoc_report(silver: DataFrame, col: str, pairs=None, min_n: int = dims.MIN_GROUP_N):
    r = posthoc_pairs(silver, col, pairs, min_n)
    p = t_two_sided(F.col("t_stat"), F.col("df"))
    return (r.withColumn("p_value", p).withColumn("stars", p_stars(F.col("p_value")))
            .withColumn("effect", d_label(F.col("cohens_d"))))


# Spearman ---------------------------------------------------------------------

#: Ranges that ranks are counted in side by side.
RANK_RANGES = 256


def rank_table(cells: DataFrame, col: str, out: str) -> DataFrame:
    """(value, average 1-based rank) for ``col`` of rows counted in ``__n``.

    Distinct values are counted, dealt into at most RANK_RANGES ranges at their own quantiles and
    summed up in order within each; a table of one row per range says what lies before it.
    """
    # stored, or the test for the range, a filter on the key, is pushed below the aggregate to every row
    counts = cells.groupBy(col).agg(F.sum("__n").alias("__c")).checkpoint()
    shares = [i / RANK_RANGES for i in range(1, RANK_RANGES)]
    splits = counts.agg(F.percentile_approx(col, shares, 100 * RANK_RANGES)).scalar()
    ranged = counts.withColumn("__s", splits).withColumn(
        "__b", F.size(F.filter("__s", lambda s: s < F.col(col)))).drop("__s")
    totals = ranged.groupBy("__b").agg(F.sum("__c").alias("__t"))
    lower = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)    # RANK_RANGES rows at most
    before = totals.select("__b", F.coalesce(F.sum("__t").over(lower), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__w", F.coalesce(F.sum("__c").over(within), F.lit(0))).join(before, "__b")
    return placed.select(col, (F.col("__before") + F.col("__w") + (F.col("__c") + 1) / 2.0).alias(out))


def with_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct combinations of ``cols`` with their row count ``__n`` and ``r_<col>`` of every column.

    Rows are collapsed by one aggregate that combines map-side; ranks are joined to the
    combinations, so a value that most rows share is one key of few rows. The combinations are
    stored: the rows are read once, not once per rank table and range.
    """
    work_root(df.sparkSession)
    cells = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).checkpoint()
    out = cells
    for c in cols:
        out = out.join(rank_table(cells, c, f"r_{c}"), c, "inner")
    return out


def _pearson(x: str, y: str):
    """Correlation of two columns of average ranks, each row counted ``__n`` times.

    The mean of average ranks is (n + 1) / 2; 0 when a column is constant.
    """
    n = F.sum("__n").cast("double")
    centre = n * (n + 1) * (n + 1) / 4.0

    def moment(a, b):
        return F.sum(F.col("__n") * F.col(a) * F.col(b)) - centre
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, moment(x, y) / F.sqrt(moment(x, x) * moment(y, y))).otherwise(F.lit(0.0))


FACTORS = ["education", "experience", "skill_count", "salary"]


def spearman_frame(silver: DataFrame) -> DataFrame:
    return (silver.where(F.col("salary_avg").isNotNull())
            .select(education_rank(F.col("education")).alias("education"),
                    experience_rank(F.col("experience")).alias("experience"),
                    skill_count(F.col("tags")).alias("skill_count"),
                    F.col("salary_avg").cast("double").alias("salary")))


def spearman_matrix(silver: DataFrame) -> DataFrame:
    """4x4 Spearman matrix (education, experience, skill count, salary).

    Rows whose education/experience label has no ordinal code are dropped and
    counted (n_dropped). 0 for n < 2 or a constant column, 1 on the diagonal.
    """
    base = spearman_frame(silver)
    known = F.col("education").isNotNull() & F.col("experience").isNotNull()
    rows = with_ranks(base.where(known), FACTORS)
    pairs = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]]
    stats = rows.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"),
                     *[_pearson(f"r_{a}", f"r_{b}").alias(f"{a}__{b}") for a, b in pairs])
    dropped = base.where(~known).agg(F.count(F.lit(1)).alias("n_dropped"))
    cells = []
    for a in FACTORS:
        for b in FACTORS:
            if a == b:
                v = F.lit(1.0)
            else:
                key = f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}"
                v = F.when(F.col("n") >= 2, F.col(key)).otherwise(F.lit(0.0))
            cells.append(F.struct(F.lit(a).alias("factor_x"), F.lit(b).alias("factor_y"),
                                  F.round(v, 6).alias("rho")))
    m = stats.select(F.col("n").alias("n_samples"), F.explode(F.array(*cells)).alias("c"))
    # both sides are single-row aggregates: attach n_dropped as a scalar subquery
    return m.select("c.*", "n_samples", dropped.scalar().alias("n_dropped"))


def spearman_exp_salary(silver: DataFrame, min_n: int = dims.MIN_GROUP_N) -> DataFrame:
    """rho between experience tier index and salary; null when n < min_n."""
    lab = ustrip(F.col("experience"))
    rows = (silver.where(F.col("salary_avg").isNotNull() & lab.isin(dims.EXP_ORDER))
            .select(order_index(lab, dims.EXP_ORDER).alias("x"),
                    F.col("salary_avg").cast("double").alias("y")))
    a = with_ranks(rows, ["x", "y"]).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"),
                                         _pearson("r_x", "r_y").alias("rho"))
    rho = F.when(F.col("n") >= min_n, F.round(F.col("rho"), 6))
    return a.select("n", rho.alias("rho"),
                    F.when(F.col("n") >= min_n, rho_direction(F.col("rho"))).alias("direction"),
                    F.when(F.col("n") >= min_n, rho_strength(F.col("rho"))).alias("strength"))


def spearman_report(silver: DataFrame, min_n: int = dims.MIN_GROUP_N) -> DataFrame:
    r = spearman_exp_salary(silver, min_n)
    return r.withColumn("p_value", rho_p(F.col("rho"), F.col("n")))
