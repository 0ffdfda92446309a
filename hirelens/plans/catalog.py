"""Registered queries: key -> (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables (through
the stored bronze/silver tables derived from them). Parameters that the
original application exposed (top_n, min_samples, whitelist, ...) are fixed
here to the values the fixture needs; the library functions keep them as
arguments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.operators import stats
from hirelens.plans import oracle as O
from hirelens.sources import tables

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

# fixture parameters ---------------------------------------------------------
FX_CITIES = dims.fixture_cities(20)
FX_KEYWORDS = ["STANDARD", "PROMO", "LARGE"]      # configured order; others are extras
CITY_IN = O.in_list(FX_CITIES)


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[key] = (fn, None if sql is None else O.q(sql))
        return fn
    return deco


def silver(spark, sf_dir):
    return tables.silver(spark, sf_dir)


# ---------------------------------------------------------------------------
# A: dashboard aggregates
# ---------------------------------------------------------------------------

@register("overview", f"""
SELECT count(*) AS total, count(DISTINCT city) AS city_count,
       coalesce({O.mean6('salary_avg_c')}, 0.0) AS avg_salary,
       coalesce(max(salary_max), 0.0) AS max_salary
FROM silver""")
def q_overview(spark, sf_dir):
    return stats.overview(silver(spark, sf_dir))


@register("salary_by_keyword", f"""
SELECT keyword, {O.mean6('salary_avg_c')} AS avg_salary, count(*) AS n
FROM silver WHERE salary_avg IS NOT NULL AND keyword IS NOT NULL GROUP BY keyword""")
def q_salary_by_keyword(spark, sf_dir):
    return stats.salary_by_keyword(silver(spark, sf_dir))


@register("jobs_by_city", f"""
SELECT city, count(*) AS n FROM silver WHERE city IN {CITY_IN}
GROUP BY city ORDER BY n DESC, city ASC LIMIT 10""")
def q_jobs_by_city(spark, sf_dir):
    return stats.jobs_by_city(silver(spark, sf_dir), FX_CITIES, 10)


@register("salary_by_city", f"""
SELECT city, {O.med6()} AS median_salary, count(*) AS n
FROM silver WHERE salary_avg IS NOT NULL AND city IN {CITY_IN}
GROUP BY city HAVING count(*) >= 20
ORDER BY median_salary DESC, city ASC LIMIT 10""")
def q_salary_by_city(spark, sf_dir):
    return stats.salary_by_city(silver(spark, sf_dir), FX_CITIES, 10, 20)


@register("education_dist", """
SELECT education, count(*) AS n FROM silver WHERE education IS NOT NULL GROUP BY education""")
def q_education_dist(spark, sf_dir):
    return stats.education_dist(silver(spark, sf_dir))


@register("experience_dist", """
SELECT experience, count(*) AS n FROM silver WHERE experience IS NOT NULL GROUP BY experience""")
def q_experience_dist(spark, sf_dir):
    return stats.experience_dist(silver(spark, sf_dir))


@register("top_skills", f"""
, tag_rows AS (SELECT unnest({O.stored_tags_sql()}) AS tag FROM silver
               WHERE tags IS NOT NULL AND tags <> '')
SELECT tag, count(*) AS n FROM tag_rows GROUP BY tag ORDER BY n DESC, tag ASC LIMIT 20""")
def q_top_skills(spark, sf_dir):
    return stats.top_skills(silver(spark, sf_dir), 20)


@register("salary_by_skill", f"""
, tag_rows AS (SELECT unnest({O.stored_tags_sql()}) AS tag, salary_avg FROM silver
               WHERE tags IS NOT NULL AND tags <> '' AND salary_avg IS NOT NULL)
SELECT tag, {O.med6()} AS median_salary, count(*) AS n FROM tag_rows GROUP BY tag
HAVING count(*) >= 5 ORDER BY median_salary DESC, tag ASC LIMIT 15""")
def q_salary_by_skill(spark, sf_dir):
    return stats.salary_by_skill(silver(spark, sf_dir), 15, 5)


@register("jobs_by_source", """
SELECT source, count(*) AS n FROM silver WHERE source IS NOT NULL GROUP BY source""")
def q_jobs_by_source(spark, sf_dir):
    return stats.jobs_by_source(silver(spark, sf_dir))


@register("salary_by_source", f"""
SELECT source, {O.med6()} AS median_salary, count(*) AS n
FROM silver WHERE salary_avg IS NOT NULL AND source IS NOT NULL GROUP BY source""")
def q_salary_by_source(spark, sf_dir):
    return stats.salary_by_source(silver(spark, sf_dir))


_EDU_PCT = ",\n".join(
    f"  {O.pct6(f'count_if(education = {chr(39)}{lab}{chr(39)})', 'count(*)')} AS {name}"
    for lab, name in stats.EDU_COLUMNS)


@register("education_by_source", f"""
SELECT source, count(*) AS n,
{_EDU_PCT}
FROM silver WHERE source IS NOT NULL AND education IS NOT NULL GROUP BY source""")
def q_education_by_source(spark, sf_dir):
    return stats.education_by_source(silver(spark, sf_dir))


_KW_ORD = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(FX_KEYWORDS))


@register("salary_by_source_keyword", f"""
, cells AS (SELECT source, keyword, {O.mean6('salary_avg_c')} AS avg_salary, count(*) AS n
  FROM silver WHERE salary_avg IS NOT NULL AND source IS NOT NULL AND keyword IS NOT NULL
  GROUP BY source, keyword)
SELECT s.source, k.keyword, c.avg_salary, coalesce(c.n, 0) AS n,
       CASE k.keyword {_KW_ORD} ELSE {len(FX_KEYWORDS)} END AS kw_ord
FROM (SELECT DISTINCT source FROM cells) s CROSS JOIN (SELECT DISTINCT keyword FROM cells) k
LEFT JOIN cells c ON c.source = s.source AND c.keyword = k.keyword
WHERE c.source IS NOT NULL OR k.keyword IN ({", ".join(f"'{k}'" for k in FX_KEYWORDS)})""")
def q_salary_by_source_keyword(spark, sf_dir):
    return stats.salary_by_source_keyword(silver(spark, sf_dir), FX_KEYWORDS)


@register("city_geo", f"""
, agg AS (SELECT city, count(*) AS n, {O.med6()} AS median_salary FROM silver
          WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 5)
SELECT a.city, a.n, a.median_salary, 100.0 + n.n_nationkey * 1.5 AS lon,
       20.0 + n.n_regionkey * 4.0 AS lat
FROM agg a JOIN nation n ON a.city = n.n_name WHERE n.n_nationkey < 20""")
def q_city_geo(spark, sf_dir):
    return stats.city_geo(silver(spark, sf_dir), dims.dim_city_fixture(spark, sf_dir), 5)


@register("salary_histogram", """
, bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(11)),
  counts AS (SELECT CAST(least(floor(salary_avg / 5), 10) AS INTEGER) AS bin, count(*) AS n
             FROM silver WHERE salary_avg IS NOT NULL GROUP BY 1)
SELECT b.bin,
       CASE WHEN b.bin = 10 THEN '50K+'
            ELSE concat(CAST(b.bin * 5 AS VARCHAR), '-', CAST((b.bin + 1) * 5 AS VARCHAR), 'K') END AS label,
       coalesce(c.n, 0) AS n
FROM bins b LEFT JOIN counts c ON b.bin = c.bin""")
def q_salary_histogram(spark, sf_dir):
    return stats.salary_histogram(silver(spark, sf_dir), 5, 50)


@register("salary_hist_summary", f"""
SELECT count(*) AS n, coalesce({O.med6()}, 0.0) AS median_salary,
       coalesce({O.mean6('salary_avg_c')}, 0.0) AS mean_salary
FROM silver WHERE salary_avg IS NOT NULL""")
def q_salary_hist_summary(spark, sf_dir):
    return stats.salary_hist_summary(silver(spark, sf_dir))


_EXP_ORD = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(dims.EXP_ORDER))


def _blank_label_sql(x):
    t = O.ustrip(x)
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN '(空)' ELSE {t} END"


@register("experience_tiers", f"""
, base AS (SELECT {_blank_label_sql('experience')} AS tier, salary_avg, salary_avg_c FROM silver),
  agg AS (SELECT tier, count(*) AS n, {O.med6()} AS median_salary,
                 {O.mean6('salary_avg_c')} AS mean_salary, count(salary_avg) AS n_salary
          FROM base GROUP BY tier)
SELECT tier, CASE tier {_EXP_ORD} ELSE {len(dims.EXP_ORDER)} END AS tier_ord, n,
       {O.pct6('n', 'sum(n) OVER ()')} AS pct, median_salary, mean_salary, n_salary,
       max(n) OVER () * 100.0 / sum(n) OVER () >= 50 AS imbalanced
FROM agg""")
def q_experience_tiers(spark, sf_dir):
    return stats.experience_tiers(silver(spark, sf_dir))


def _group_sql(col: str) -> str:
    t = O.ustrip(col)
    return f"""
, grp_rows AS (SELECT {t} AS grp, salary_avg, salary_avg_c FROM silver
               WHERE salary_avg IS NOT NULL)
SELECT grp, count(*) AS n, {O.med6()} AS median_salary, {O.mean6('salary_avg_c')} AS mean_salary,
       count(*) >= 30 AS valid
FROM grp_rows WHERE grp IS NOT NULL AND grp <> '' AND grp NOT IN ('None', '不限')
GROUP BY grp"""


@register("group_describe_city", _group_sql("city"))
def q_group_describe_city(spark, sf_dir):
    return stats.group_describe(silver(spark, sf_dir), "city")


@register("group_describe_education", _group_sql("education"))
def q_group_describe_education(spark, sf_dir):
    return stats.group_describe(silver(spark, sf_dir), "education")


@register("group_describe_experience", _group_sql("experience"))
def q_group_describe_experience(spark, sf_dir):
    return stats.group_describe(silver(spark, sf_dir), "experience")


# ---------------------------------------------------------------------------
# Q: data-quality audit, D: clean-up previews and key-aligned deletes
# ---------------------------------------------------------------------------
from hirelens.operators import quality  # noqa: E402

FX_INTERN = dict(keywords=["widget", "gear"], negations=["red"])
FX_NONTECH = dict(tech=["red"], nontech=["widget", "gear", "bolt"])
FX_NONTECH_KEYWORD = "STANDARD"
FX_OUTLIER = 50.0


def bronze(spark, sf_dir):
    return tables.bronze(spark, sf_dir)


_LABELLED = """
, labelled AS (SELECT 'job' AS tbl, source, job_key, city FROM silver
               UNION ALL SELECT 'raw_job' AS tbl, source, job_key, city FROM bronze)"""


@register("hc_counts", _LABELLED + """
SELECT count_if(tbl = 'job') AS job_rows, count_if(tbl = 'raw_job') AS raw_job_rows,
       count_if(tbl = 'job') = count_if(tbl = 'raw_job') AS consistent FROM labelled""")
def q_hc_counts(spark, sf_dir):
    return quality.hc_counts(silver(spark, sf_dir), bronze(spark, sf_dir))


@register("hc_duplicates", _LABELLED + """
, per_key AS (SELECT tbl, source, job_key, count(*) AS c FROM labelled GROUP BY tbl, source, job_key)
SELECT tbl, count_if(c > 1) AS dup_groups FROM per_key GROUP BY tbl""")
def q_hc_duplicates(spark, sf_dir):
    return quality.hc_duplicates(silver(spark, sf_dir), bronze(spark, sf_dir))


@register("hc_sources", _LABELLED + """
SELECT tbl, source, count(*) AS n FROM labelled GROUP BY tbl, source""")
def q_hc_sources(spark, sf_dir):
    return quality.hc_sources(silver(spark, sf_dir), bronze(spark, sf_dir))


@register("hc_offlist", _LABELLED + f"""
SELECT tbl, city, count(*) AS n FROM labelled WHERE city IS NULL OR city NOT IN {CITY_IN}
GROUP BY tbl, city""")
def q_hc_offlist(spark, sf_dir):
    return quality.hc_offlist(silver(spark, sf_dir), bronze(spark, sf_dir), FX_CITIES)


_NULL_CHECKS = [
    ("salary_avg_null", "salary_avg IS NULL"), ("salary_avg_le_0", "salary_avg <= 0"),
    ("city_blank", "city IS NULL OR city = ''"),
    ("experience_blank", "experience IS NULL OR experience = ''"),
    ("education_blank", "education IS NULL OR education = ''"),
    ("title_blank", "title IS NULL OR title = ''"),
    ("keyword_blank", "keyword IS NULL OR keyword = ''")]


@register("hc_nulls", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS check_name, count_if({c}) AS n FROM silver" for n, c in _NULL_CHECKS))
def q_hc_nulls(spark, sf_dir):
    return quality.hc_nulls(silver(spark, sf_dir))


@register("hc_salary", f"""
SELECT count_if(salary_avg > {FX_OUTLIER}) AS gt_threshold,
       count_if(salary_avg < 1 AND salary_avg > 0) AS lt1,
       count_if(salary_min > salary_max) AS min_gt_max,
       min(salary_avg) AS min_avg, max(salary_avg) AS max_avg,
       {O.mean6('salary_avg_c')} AS mean_avg
FROM silver WHERE salary_avg IS NOT NULL""")
def q_hc_salary(spark, sf_dir):
    return quality.hc_salary(silver(spark, sf_dir), FX_OUTLIER)


def _nz_sql(c):
    return f"coalesce(CASE WHEN {c} <> '' THEN {c} END, '(空)')"


@register("hc_cities", f"""
SELECT {_nz_sql('city')} AS city, count(*) AS n FROM silver GROUP BY 1""")
def q_hc_cities(spark, sf_dir):
    return quality.hc_cities(silver(spark, sf_dir))


@register("hc_keywords", f"""
SELECT {_nz_sql('keyword')} AS keyword, count(*) AS n FROM silver GROUP BY 1""")
def q_hc_keywords(spark, sf_dir):
    return quality.hc_keywords(silver(spark, sf_dir))


@register("hc_experience", f"""
SELECT {_nz_sql('experience')} AS experience, count(*) AS n,
       {O.mean6('salary_avg_c')} AS avg_salary FROM silver GROUP BY 1""")
def q_hc_experience(spark, sf_dir):
    return quality.hc_experience(silver(spark, sf_dir))


def _contains_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_INTERN_F = f"""
, f AS (SELECT *, coalesce(title <> '' AND NOT {_contains_any('title', FX_INTERN['negations'])}
                           AND {_contains_any('title', FX_INTERN['keywords'])}, false) AS flag
        FROM silver WHERE source = 'site_a')"""


def _delete_summary_sql(doomed_rel: str) -> str:
    return f"""
, doomed AS ({doomed_rel})
, marks AS (
  SELECT 'job' AS tbl, d.job_key IS NOT NULL AS gone FROM silver s
    LEFT JOIN doomed d ON s.source = d.source AND s.job_key = d.job_key
  UNION ALL
  SELECT 'raw_job' AS tbl, d.job_key IS NOT NULL AS gone FROM bronze b
    LEFT JOIN doomed d ON b.source = d.source AND b.job_key = d.job_key)
SELECT tbl, count_if(gone) AS deleted, count_if(NOT gone) AS kept FROM marks GROUP BY tbl"""


@register("clean_intern_report", _INTERN_F + """
SELECT count(*) AS total, count_if(flag) AS flagged, count_if(NOT flag) AS kept,
       coalesce(round(median(salary_avg), 6), 0.0) AS median_before,
       coalesce(round(median(CASE WHEN NOT flag THEN salary_avg END), 6), 0.0) AS median_after
FROM f""")
def q_clean_intern_report(spark, sf_dir):
    return quality.clean_intern_report(silver(spark, sf_dir), "site_a", **FX_INTERN)


@register("clean_intern_keep", _INTERN_F + _delete_summary_sql(
    "SELECT source, job_key FROM f WHERE flag"))
def q_clean_intern_keep(spark, sf_dir):
    s, b = silver(spark, sf_dir), bronze(spark, sf_dir)
    return quality.delete_summary(s, b, quality.doomed_intern(s, "site_a", **FX_INTERN))


def _wl_sql(col):
    return f"coalesce({O.ustrip(col)} IN {CITY_IN}, false)"


@register("clean_offlist_report", f"""
SELECT source, CASE WHEN city IS NULL OR city = '' THEN '<空>' ELSE {O.ustrip('city')} END AS city,
       count(*) AS n
FROM silver WHERE NOT {_wl_sql('city')} GROUP BY 1, 2""")
def q_clean_offlist_report(spark, sf_dir):
    return quality.clean_offlist_report(silver(spark, sf_dir), FX_CITIES)


@register("clean_offlist_keep", f"""
SELECT 'job' AS tbl, count(*) AS kept FROM silver WHERE {_wl_sql('city')}
UNION ALL SELECT 'raw_job' AS tbl, count(*) AS kept FROM bronze WHERE {_wl_sql('city')}""")
def q_clean_offlist_keep(spark, sf_dir):
    s, b = quality.clean_offlist_keep(silver(spark, sf_dir), bronze(spark, sf_dir), FX_CITIES)
    return (s.select(F.lit("job").alias("tbl")).unionByName(b.select(F.lit("raw_job").alias("tbl")))
            .groupBy("tbl").agg(F.count(F.lit(1)).alias("kept")))


_NONTECH_F = f"""
, f AS (SELECT *, coalesce(title <> '' AND NOT {_contains_any('title', FX_NONTECH['tech'])}
                           AND {_contains_any('title', FX_NONTECH['nontech'])}, false) AS flag
        FROM silver WHERE keyword = '{FX_NONTECH_KEYWORD}')"""


@register("clean_nontech_report", _NONTECH_F + f"""
SELECT count(*) AS total, count_if(flag) AS n_delete,
       coalesce({O.mean6('CASE WHEN flag THEN salary_avg_c END')}, 0.0) AS avg_delete,
       count_if(NOT flag) AS n_keep,
       coalesce({O.mean6('CASE WHEN NOT flag THEN salary_avg_c END')}, 0.0) AS avg_keep
FROM f""")
def q_clean_nontech_report(spark, sf_dir):
    return quality.clean_nontech_report(silver(spark, sf_dir), FX_NONTECH_KEYWORD, **FX_NONTECH)


@register("clean_nontech_keep", _NONTECH_F + _delete_summary_sql(
    "SELECT source, job_key FROM f WHERE flag"))
def q_clean_nontech_keep(spark, sf_dir):
    s, b = silver(spark, sf_dir), bronze(spark, sf_dir)
    return quality.delete_summary(s, b, quality.doomed_nontech(s, FX_NONTECH_KEYWORD, **FX_NONTECH))


@register("nontech_dump", _NONTECH_F + """
SELECT format('[{}] {}  ({}K)  {}', city, title,
              coalesce(CAST(salary_avg AS VARCHAR), 'None'), salary_text) AS value
FROM f WHERE flag""")
def q_nontech_dump(spark, sf_dir):
    return quality.nontech_dump(silver(spark, sf_dir), FX_NONTECH_KEYWORD, **FX_NONTECH)


@register("clean_outlier_report", f"""
, hits AS (SELECT source, job_key, city, title, salary_text, salary_avg FROM silver
           WHERE salary_avg > {FX_OUTLIER}),
  b AS (SELECT source, job_key, count(*) AS raw_hits FROM bronze GROUP BY source, job_key)
SELECT h.*, coalesce(b.raw_hits, 0) AS raw_hits FROM hits h
LEFT JOIN b ON h.source = b.source AND h.job_key = b.job_key""")
def q_clean_outlier_report(spark, sf_dir):
    return quality.clean_outlier_report(silver(spark, sf_dir), bronze(spark, sf_dir), FX_OUTLIER)


@register("clean_outlier_keep", _delete_summary_sql(
    f"SELECT source, job_key FROM silver WHERE salary_avg > {FX_OUTLIER}"))
def q_clean_outlier_keep(spark, sf_dir):
    s, b = silver(spark, sf_dir), bronze(spark, sf_dir)
    return quality.delete_summary(s, b, quality.doomed_outlier(s, FX_OUTLIER))


# ---------------------------------------------------------------------------
# N: statistical inference
# ---------------------------------------------------------------------------
from hirelens.operators import inference  # noqa: E402


def _grp_rows_sql(col: str) -> str:
    t = O.ustrip(col)
    return f"""
, grp_rows AS (SELECT {t} AS grp, salary_avg FROM silver
               WHERE salary_avg IS NOT NULL AND {t} IS NOT NULL AND {t} <> ''
                 AND {t} NOT IN ('None', '不限'))"""


def _anova_sql(col: str) -> str:
    return _grp_rows_sql(col) + f"""
, g AS (SELECT grp, count(*) AS n, avg(salary_avg) AS mean, var_samp(salary_avg) AS var
        FROM grp_rows GROUP BY grp HAVING count(*) >= 30),
  gm AS (SELECT *, sum(n * mean) OVER () / sum(n) OVER () AS grand FROM g),
  a AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n_total,
               sum(n * (mean - grand) * (mean - grand)) AS ssb, sum((n - 1) * var) AS ssw FROM gm)
SELECT '{col}' AS factor, k, coalesce(n_total, 0) AS n_total,
  round(CASE WHEN k >= 2 AND n_total > k AND ssw > 0
             THEN (ssb / (k - 1)) / (ssw / (n_total - k)) END, 6) AS f_stat,
  round(CASE WHEN k >= 2 THEN CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0.0 END END, 6)
    AS eta_sq
FROM a"""


for _col in ("city", "education", "experience"):
    def _mk(col):
        def fn(spark, sf_dir):
            return inference.anova(silver(spark, sf_dir), col)
        return fn
    register(f"anova_{_col}", _anova_sql(_col))(_mk(_col))


def _posthoc_sql(col: str, pairs) -> str:
    if pairs is None:
        p = """p AS (SELECT (SELECT grp FROM g WHERE n >= 30 ORDER BY median DESC, grp DESC LIMIT 1) AS a,
                    (SELECT grp FROM g WHERE n >= 30 ORDER BY median ASC, grp ASC LIMIT 1) AS b),
  p2 AS (SELECT * FROM p WHERE a IS NOT NULL)"""
    else:
        vals = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
        p = f"p2 AS (SELECT * FROM (VALUES {vals}) t(a, b))"
    ok = "(n_a IS NOT NULL AND n_b IS NOT NULL AND n_a >= 30 AND n_b >= 30)"
    se2 = "(var_a / n_a + var_b / n_b)"
    sp = "sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2))"
    return _grp_rows_sql(col) + f"""
, g AS (SELECT grp, count(*) AS n, avg(salary_avg) AS mean, var_samp(salary_avg) AS var,
               median(salary_avg) AS median FROM grp_rows GROUP BY grp),
  {p},
  j AS (SELECT p2.a, p2.b, ga.n AS n_a, gb.n AS n_b, ga.mean AS mean_a, gb.mean AS mean_b,
               ga.var AS var_a, gb.var AS var_b, ga.median AS median_a, gb.median AS median_b
        FROM p2 LEFT JOIN g ga ON p2.a = ga.grp LEFT JOIN g gb ON p2.b = gb.grp)
SELECT '{col}' AS factor, a AS group_a, b AS group_b,
  CASE WHEN {ok} THEN 'ok' ELSE 'skipped' END AS status,
  CASE WHEN {ok} THEN n_a END AS n_a, CASE WHEN {ok} THEN n_b END AS n_b,
  CASE WHEN {ok} THEN round(median_a, 6) END AS median_a,
  CASE WHEN {ok} THEN round(median_b, 6) END AS median_b,
  round(CASE WHEN {ok} AND {se2} > 0 THEN (mean_a - mean_b) / sqrt({se2}) END, 6) + 0.0 AS t_stat,
  round(CASE WHEN {ok} AND {se2} > 0 THEN {se2} * {se2} /
        ((var_a / n_a) * (var_a / n_a) / (n_a - 1) + (var_b / n_b) * (var_b / n_b) / (n_b - 1)) END, 6) AS df,
  round(CASE WHEN {ok} THEN CASE WHEN n_a >= 2 AND n_b >= 2 AND {sp} > 0
        THEN (mean_a - mean_b) / {sp} ELSE 0.0 END END, 6) + 0.0 AS cohens_d
FROM j"""


_POSTHOC = {"city": None, "education": dims.EDU_PAIRS, "experience": dims.EXP_PAIRS}
for _col, _pairs in _POSTHOC.items():
    def _mk(col, pairs):
        def fn(spark, sf_dir):
            return inference.posthoc_pairs(silver(spark, sf_dir), col, pairs)
        return fn
    register(f"posthoc_{_col}", _posthoc_sql(_col, _pairs))(_mk(_col, _pairs))


def _case_map(x: str, mapping: dict) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


def _rank_sql(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


def _pearson_sql(a: str, b: str) -> str:
    return (f"CASE WHEN var_samp({a}) > 0 AND var_samp({b}) > 0 "
            f"THEN covar_samp({a}, {b}) / sqrt(var_samp({a}) * var_samp({b})) ELSE 0.0 END")


def _spearman_matrix_sql() -> str:
    f = inference.FACTORS
    pairs = [(a, b) for i, a in enumerate(f) for b in f[i + 1:]]
    cells = []
    for a in f:
        for b in f:
            if a == b:
                v = "1.0"
            else:
                k = f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}"
                v = f"CASE WHEN n >= 2 THEN {k} ELSE 0.0 END"
            cells.append(f"SELECT '{a}' AS factor_x, '{b}' AS factor_y, round({v}, 6) + 0.0 AS rho, "
                         f"n AS n_samples FROM s")
    return f"""
, base AS (SELECT {_case_map('education', dims.EDU_RANK)} AS education,
                  {_case_map('experience', dims.EXP_RANK)} AS experience,
                  len({O.stored_tags_sql()}) AS skill_count, salary_avg AS salary
           FROM silver WHERE salary_avg IS NOT NULL),
  rows_ AS (SELECT * FROM base WHERE education IS NOT NULL AND experience IS NOT NULL),
  r AS (SELECT {", ".join(f"{_rank_sql(x)} AS r_{x}" for x in f)} FROM rows_),
  s AS (SELECT count(*) AS n, {", ".join(f"{_pearson_sql('r_' + a, 'r_' + b)} AS {a}__{b}" for a, b in pairs)} FROM r),
  cells AS ({" UNION ALL ".join(cells)})
SELECT cells.*, (SELECT count(*) FROM base WHERE education IS NULL OR experience IS NULL) AS n_dropped
FROM cells"""


@register("spearman_matrix", _spearman_matrix_sql())
def q_spearman_matrix(spark, sf_dir):
    return inference.spearman_matrix(silver(spark, sf_dir))


_EXP_IDX = {k: i for i, k in enumerate(dims.EXP_ORDER)}


_EXP_SALARY_SQL = f"""
, rows_ AS (SELECT {_case_map(O.ustrip('experience'), _EXP_IDX)} AS x, salary_avg AS y FROM silver
            WHERE salary_avg IS NOT NULL AND {O.ustrip('experience')} IN {O.in_list(dims.EXP_ORDER)}),
  r AS (SELECT {_rank_sql('x')} AS rx, {_rank_sql('y')} AS ry FROM rows_),
  a AS (SELECT count(*) AS n, {_pearson_sql('rx', 'ry')} AS rho FROM r)
SELECT n, CASE WHEN n >= 30 THEN round(rho, 6) + 0.0 END AS rho,
  CASE WHEN n >= 30 THEN CASE WHEN rho > 0 THEN '递增' ELSE '递减' END END AS direction,
  CASE WHEN n >= 30 THEN CASE WHEN abs(rho) >= 0.5 THEN '强' WHEN abs(rho) >= 0.3 THEN '中' ELSE '弱' END END
    AS strength
FROM a"""


@register("spearman_exp_salary", _EXP_SALARY_SQL)
def q_spearman_exp_salary(spark, sf_dir):
    return inference.spearman_exp_salary(silver(spark, sf_dir))


# p-values: the oracle integrates the densities numerically (Simpson's rule over a grid that
# reaches 60 beyond the statistic, where nothing is left of the tails here)
_GRID = """
, grid AS (SELECT i, CASE WHEN i = 0 OR i = 30000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.002 / 3 AS w
           FROM range(0, 30001) r(i))"""


def _tail_sql(stat: str, log_density: str) -> str:
    """Integral of a density of x from ``stat`` on, for the row ``st``."""
    return (f"(SELECT sum(w * exp({log_density})) FROM (SELECT w, {stat} + i * 0.002 AS x FROM grid) "
            f"WHERE {stat} IS NOT NULL)")


_F_TAIL = _tail_sql("f_stat", """lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2)
  + (d1 / 2 - 1) * ln(greatest(x, 1e-300)) - (d1 + d2) / 2 * ln(1 + d1 * x / d2)""")
_T_TAIL = _tail_sql("abs_t", """ln(2) + lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2
  - (df + 1) / 2 * ln(1 + x * x / df)""")
_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars"


def _each_factor_sql(sqls: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {sql.strip().removeprefix(',')})" for sql in sqls)


def _rounded_p(df):
    return df.withColumn("p_value", F.round("p_value", 6))


@register("anova_pvalues", _GRID + f"""
, st AS (SELECT *, (k - 1)::DOUBLE AS d1, (n_total - k)::DOUBLE AS d2
         FROM ({_each_factor_sql([_anova_sql(c) for c in ("city", "education", "experience")])})),
  ps AS (SELECT *, {_F_TAIL} AS p FROM st)
SELECT factor, k, n_total, f_stat, eta_sq, round(p, 6) + 0.0 AS p_value, {_STARS},
       CASE WHEN eta_sq >= 0.14 THEN '大' WHEN eta_sq >= 0.06 THEN '中' WHEN eta_sq >= 0.01 THEN '小' ELSE '极小' END AS effect
FROM ps""")
def q_anova_pvalues(spark, sf_dir):
    s = silver(spark, sf_dir)
    return _rounded_p(reduce(DataFrame.unionByName,
                             [inference.anova_report(s, c) for c in ("city", "education", "experience")]))


@register("posthoc_pvalues", _GRID + f"""
, st AS (SELECT *, abs(t_stat) AS abs_t FROM ({_each_factor_sql([_posthoc_sql(c, p) for c, p in _POSTHOC.items()])})),
  ps AS (SELECT *, {_T_TAIL} AS p FROM st)
SELECT * EXCLUDE (abs_t, p), round(p, 6) + 0.0 AS p_value, {_STARS},
       CASE WHEN abs(cohens_d) >= 0.8 THEN '大' WHEN abs(cohens_d) >= 0.5 THEN '中'
            WHEN abs(cohens_d) >= 0.2 THEN '小' ELSE '极小' END AS effect
FROM ps""")
def q_posthoc_pvalues(spark, sf_dir):
    s = silver(spark, sf_dir)
    return _rounded_p(reduce(DataFrame.unionByName,
                             [inference.posthoc_report(s, c, p) for c, p in _POSTHOC.items()]))


@register("spearman_pvalue", _GRID + f"""
, st AS (SELECT *, (n - 2)::DOUBLE AS df, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS abs_t
         FROM ({_each_factor_sql([_EXP_SALARY_SQL])})),
  ps AS (SELECT *, {_T_TAIL} AS p FROM st)
SELECT * EXCLUDE (df, abs_t, p), round(p, 6) + 0.0 AS p_value FROM ps""")
def q_spearman_pvalue(spark, sf_dir):
    return _rounded_p(inference.spearman_report(silver(spark, sf_dir)))


# ---------------------------------------------------------------------------
# G: skill graph
# ---------------------------------------------------------------------------
from hirelens.operators import skills  # noqa: E402


def _jobs(spark, sf_dir):
    return skills.postings_skills(silver(spark, sf_dir))


_NORM = ("CASE lower(v) " + " ".join(
    "WHEN '{}' THEN '{}'".format(k.replace("'", "''"), w.replace("'", "''"))
    for k, w in dims.TAG_ALIASES.items()) + " ELSE v END")

_JOBS_SQL = f"""
, jobs AS (SELECT list_distinct(list_transform({O.stored_tags_sql()}, lambda v: {_NORM})) AS skills,
                  salary_avg
           FROM silver WHERE tags IS NOT NULL),
  jobs2 AS (SELECT * FROM jobs WHERE len(skills) > 0),
  sk AS (SELECT unnest(skills) AS skill, salary_avg FROM jobs2),
  counts AS (SELECT skill, count(*) AS n FROM sk GROUP BY skill),
  top25 AS (SELECT skill FROM counts ORDER BY n DESC, skill ASC LIMIT 25)"""

_EDGES_SQL = _JOBS_SQL + """,
  jr AS (SELECT row_number() OVER () AS rid, skills FROM jobs2),
  u AS (SELECT rid, unnest(skills) AS v FROM jr),
  t AS (SELECT rid, v FROM u WHERE v IN (SELECT skill FROM top25)),
  pairs AS (SELECT a.v AS source, b.v AS target FROM t a JOIN t b ON a.rid = b.rid AND a.v < b.v),
  edges AS (SELECT source, target, count(*) AS weight FROM pairs GROUP BY source, target
            HAVING count(*) >= 8)"""


@register("skill_nodes", _JOBS_SQL + """
SELECT skill, n FROM counts ORDER BY n DESC, skill ASC LIMIT 25""")
def q_skill_nodes(spark, sf_dir):
    return skills.skill_nodes(_jobs(spark, sf_dir), 25)


@register("skill_edges", _EDGES_SQL + """
SELECT * FROM edges""")
def q_skill_edges(spark, sf_dir):
    return skills.skill_edges(_jobs(spark, sf_dir), 25, 8)


@register("skill_edges_top", _EDGES_SQL + """
SELECT * FROM edges ORDER BY weight DESC, source ASC, target ASC LIMIT 15""")
def q_skill_edges_top(spark, sf_dir):
    return skills.skill_edges_top(_jobs(spark, sf_dir), 15, 25, 8)


@register("skill_premium", _JOBS_SQL + """,
  paid AS (SELECT * FROM sk WHERE salary_avg IS NOT NULL),
  overall AS (SELECT coalesce(median(salary_avg), 0.0) AS m
              FROM jobs2 WHERE salary_avg IS NOT NULL),
  per AS (SELECT skill, count(*) AS n, median(salary_avg) AS med FROM paid GROUP BY skill
          HAVING count(*) >= 20)
SELECT skill, n, round(med, 6) AS median_salary,
       round(CASE WHEN o.m <> 0 THEN (med - o.m) / o.m * 100 ELSE 0.0 END, 6) + 0.0 AS premium_pct,
       round(o.m, 6) AS overall_median
FROM per, overall o ORDER BY premium_pct DESC, skill ASC LIMIT 20""")
def q_skill_premium(spark, sf_dir):
    return skills.skill_premium(_jobs(spark, sf_dir), 20, 20)


@register("skill_freq", _JOBS_SQL + """
SELECT skill, n FROM counts ORDER BY n DESC, skill ASC LIMIT 80""")
def q_skill_freq(spark, sf_dir):
    return skills.skill_freq(_jobs(spark, sf_dir), 80)


# ---------------------------------------------------------------------------
# C: cleaning functions over the real tables; I: ingest maintenance
# ---------------------------------------------------------------------------
from hirelens.functions.flags import make_job_key  # noqa: E402
from hirelens.functions.levels import clean_education, clean_experience  # noqa: E402
from hirelens.functions.salary import with_salary  # noqa: E402
from hirelens.functions.tags import normalize_tag, skill_count, split_tags, with_skills  # noqa: E402
from hirelens.operators import extract, ingest  # noqa: E402
from hirelens.sources import sinks  # noqa: E402

# dictionary for tagging the multilingual documents table (canonical, aliases)
FX_DICT = [("English", ["the", "and"]), ("German", ["und", "der"]),
           ("French", ["les", "et"]), ("Spanish", ["los", "el"]), ("Symbols", ["&", "c++"])]


@register("parse_salary", """
, texts AS (SELECT DISTINCT salary_text FROM bronze)
, """ + O.salary_ctes("texts", "pt").strip() + """
SELECT salary_text, salary_min_c / 100.0 AS salary_min, salary_max_c / 100.0 AS salary_max,
       salary_avg_c / 100.0 AS salary_avg FROM pt""")
def q_parse_salary(spark, sf_dir):
    t = bronze(spark, sf_dir).select("salary_text").distinct()
    return with_salary(t).select("salary_text", *[F.col(c).cast("double").alias(c)
                                                  for c in ("salary_min", "salary_max", "salary_avg")])


@register("clean_education", f"""
SELECT DISTINCT education AS education_text, {O.education_sql('education')} AS education FROM bronze""")
def q_clean_education(spark, sf_dir):
    t = bronze(spark, sf_dir).select(F.col("education").alias("education_text")).distinct()
    return t.select("education_text", clean_education(F.col("education_text")).alias("education"))


@register("clean_experience", f"""
SELECT DISTINCT experience AS experience_text, {O.experience_sql('experience')} AS experience
FROM bronze""")
def q_clean_experience(spark, sf_dir):
    t = bronze(spark, sf_dir).select(F.col("experience").alias("experience_text")).distinct()
    return t.select("experience_text", clean_experience(F.col("experience_text")).alias("experience"))


@register("split_tags", f"""
SELECT DISTINCT tags AS tags_text, {O.tags_sql('tags')} AS tags FROM bronze""")
def q_split_tags(spark, sf_dir):
    t = bronze(spark, sf_dir).select(F.col("tags").alias("tags_text")).distinct()
    return t.select("tags_text", split_tags(F.col("tags_text")).alias("tags"))


@register("extract_skills", f"""
SELECT doc_id, {O.skills_sql("lower(coalesce(text, ''))", FX_DICT)} AS skills FROM documents""")
def q_extract_skills(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_skills(docs, ["text"], "skills", FX_DICT).select("doc_id", "skills")


@register("make_job_key", """
, k AS (SELECT source, job_key,
          CASE WHEN source = 'site_b' AND job_key <> '' THEN job_key
               ELSE 'h' || md5(concat_ws('|', coalesce(title, 'None'), coalesce(company, 'None'),
                                          coalesce(city, 'None'))) END AS key0
        FROM bronze)
SELECT source, job_key, CASE WHEN length(key0) > 128 THEN 'h' || md5(key0) ELSE key0 END AS derived_key
FROM k""")
def q_make_job_key(spark, sf_dir):
    b = bronze(spark, sf_dir)
    official = F.when(F.col("source") == "site_b", F.col("job_key"))
    return b.select("source", "job_key",
                    make_job_key(official, F.lit(None).cast("string"), F.col("title"),
                                 F.col("company"), F.col("city")).alias("derived_key"))


_TAG_NORM_SQL = "CASE lower(tag) " + " ".join(
    "WHEN '{}' THEN '{}'".format(k.replace("'", "''"), w.replace("'", "''"))
    for k, w in dims.TAG_ALIASES.items()) + " ELSE tag END"


@register("normalize_tag", f"""
, t AS (SELECT DISTINCT unnest({O.stored_tags_sql()}) AS tag FROM silver)
SELECT tag, {_TAG_NORM_SQL} AS normalized FROM t""")
def q_normalize_tag(spark, sf_dir):
    t = stats.exploded_tags(silver(spark, sf_dir)).distinct()
    return t.select("tag", normalize_tag(F.col("tag")).alias("normalized"))


@register("skill_count", f"""
SELECT len({O.stored_tags_sql()}) AS skill_count, count(*) AS n FROM silver GROUP BY 1""")
def q_skill_count(spark, sf_dir):
    return (silver(spark, sf_dir).groupBy(skill_count(F.col("tags")).alias("skill_count"))
            .agg(F.count(F.lit(1)).alias("n")))


FX_PAGE_INTERN = dict(keywords=["The", "Le"], url_mark="spam-farm")
_PAGE_TITLE_SQL = O.unescape_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@register("flag_intern", f"""
SELECT page_id, coalesce(contains({_PAGE_TITLE_SQL}, 'The') OR contains({_PAGE_TITLE_SQL}, 'Le'), false)
       OR coalesce(contains(url, 'spam-farm'), false) AS flagged
FROM pages""")
def q_flag_intern(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", extract.flag_intern(extract.page_title(F.col("html")), F.col("url"),
                                                       **FX_PAGE_INTERN).alias("flagged"))


@register("page_cards", f"""
SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
       {_PAGE_TITLE_SQL} AS title,
       len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links,
       {O.url_job_id_sql('url')} AS job_id
FROM pages""")
def q_page_cards(spark, sf_dir):
    return extract.page_summary(tables.table(spark, sf_dir, "pages"))


@register("url_job_id", f"""
SELECT page_id, url, {O.url_job_id_sql('url')} AS job_id FROM pages""")
def q_url_job_id(spark, sf_dir):
    from hirelens.functions.flags import url_job_id
    p = tables.table(spark, sf_dir, "pages")
    return p.select("page_id", "url", url_job_id(F.col("url")).alias("job_id"))


@register("area_to_city", f"""
, a AS (SELECT n.n_nationkey, concat(n.n_name, '-', r.r_name) AS area, n.n_name AS search_city
        FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT n_nationkey, area,
       coalesce(nullif({O.ustrip("split_part(area, '-', 1)")}, ''), search_city) AS city FROM a""")
def q_area_to_city(spark, sf_dir):
    areas = extract.nation_areas(tables.table(spark, sf_dir, "nation"),
                                 tables.table(spark, sf_dir, "region"))
    return extract.area_cities(areas, "-")


@register("worklist_remaining", """
, pr AS (SELECT city, keyword, ord1 FROM postings_raw),
  c AS (SELECT DISTINCT city FROM pr WHERE city IS NOT NULL),
  k AS (SELECT DISTINCT keyword FROM pr WHERE keyword IS NOT NULL),
  done AS (SELECT DISTINCT city, keyword FROM pr WHERE ord1 < 5 AND keyword IS NOT NULL)
SELECT c.city, k.keyword FROM c CROSS JOIN k
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.city = c.city AND d.keyword = k.keyword)""")
def q_worklist_remaining(spark, sf_dir):
    raw = tables.postings_raw(spark, sf_dir).select("city", "keyword", "ord1")
    return extract.worklist_remaining(raw, F.col("ord1") < 5)


@register("export_rows", """
SELECT source, keyword, title, company, city, education, experience, salary_text,
       salary_min, salary_max, salary_avg, tags FROM silver""")
def q_export_rows(spark, sf_dir):
    return sinks.export_frame(silver(spark, sf_dir))


_CUT = f"TIMESTAMP '{tables.SNAPSHOT_CUTOFF} 00:00:00'"


@register("insert_if_absent", f"""
, batch AS (SELECT DISTINCT source, job_key FROM postings_raw),
  b AS (SELECT source, job_key, 1 AS hit FROM bronze WHERE crawled_at < {_CUT}),
  s AS (SELECT source, job_key, 1 AS hit FROM silver WHERE crawled_at < {_CUT})
SELECT count(*) AS batch_rows, count_if(b.hit IS NULL) AS new_bronze, count_if(s.hit IS NULL) AS new_silver
FROM batch LEFT JOIN b ON batch.source = b.source AND batch.job_key = b.job_key
LEFT JOIN s ON batch.source = s.source AND batch.job_key = s.job_key""")
def q_insert_if_absent(spark, sf_dir):
    return ingest.insert_if_absent_counts(tables.postings_raw(spark, sf_dir),
                                          tables.bronze_snapshot(spark, sf_dir),
                                          tables.silver_snapshot(spark, sf_dir))


_RECLEAN = f"""
, j AS (SELECT s.experience, s.education, s.tags, b.experience AS raw_experience,
               b.education AS raw_education, b.title AS raw_title
        FROM silver s JOIN bronze b ON s.source = b.source AND s.job_key = b.job_key),
  r AS (SELECT *, {O.experience_sql('raw_experience')} AS new_experience,
               {O.education_sql('raw_education')} AS new_education,
               {O.skills_sql("lower(coalesce(nullif(raw_title, ''), ''))", dims.SKILL_DICT)} AS new_tags
        FROM j)"""


@register("reclean_diff", _RECLEAN + """
SELECT count(*) AS n_rows,
       count_if(experience IS DISTINCT FROM new_experience) AS experience_changed,
       count_if(education IS DISTINCT FROM new_education) AS education_changed,
       count_if(coalesce(tags, '') <> new_tags) AS tags_changed
FROM r""")
def q_reclean_diff(spark, sf_dir):
    return ingest.reclean_diff(silver(spark, sf_dir), bronze(spark, sf_dir))


@register("reclean_hist", _RECLEAN + """,
  bf AS (SELECT experience AS tier, count(*) AS n_before FROM r GROUP BY 1),
  af AS (SELECT new_experience AS tier, count(*) AS n_after FROM r GROUP BY 1)
SELECT coalesce(bf.tier, af.tier) AS tier, coalesce(bf.n_before, 0) AS n_before,
       coalesce(af.n_after, 0) AS n_after
FROM bf FULL JOIN af ON bf.tier IS NOT DISTINCT FROM af.tier""")
def q_reclean_hist(spark, sf_dir):
    return ingest.reclean_hist(silver(spark, sf_dir), bronze(spark, sf_dir))


@register("resalary_diff", """
, sv AS (SELECT salary_text, salary_min_c AS old_min, salary_max_c AS old_max,
                salary_avg_c AS old_avg FROM silver)
, """ + O.salary_ctes("sv", "rs").strip() + """
SELECT count(*) AS n_rows,
       count_if(old_min IS DISTINCT FROM salary_min_c OR old_max IS DISTINCT FROM salary_max_c
                OR old_avg IS DISTINCT FROM salary_avg_c) AS changed,
       count_if(salary_avg_c IS NULL AND old_avg IS NOT NULL) AS cleared
FROM rs""")
def q_resalary_diff(spark, sf_dir):
    return ingest.resalary_diff(silver(spark, sf_dir))


@register("backfill_bronze", f"""
SELECT s.source, s.job_key, s.title, s.salary_text, s.city, s.experience, s.education, s.tags,
       s.keyword, s.crawled_at
FROM silver s WHERE NOT EXISTS (
  SELECT 1 FROM bronze b WHERE b.crawled_at < {_CUT} AND b.source = s.source AND b.job_key = s.job_key)""")
def q_backfill_bronze(spark, sf_dir):
    rows = ingest.backfill_bronze(silver(spark, sf_dir), tables.bronze_snapshot(spark, sf_dir))
    return rows.select("source", "job_key", "title", "salary_text", "city", "experience",
                       "education", "tags", "keyword", "crawled_at")


# ---------------------------------------------------------------------------
# M: salary models (training is iterative -> rows-only checks, except M1/M2)
# ---------------------------------------------------------------------------
from hirelens.operators import ml  # noqa: E402
from hirelens.session import work_path, work_root  # noqa: E402

_ML_FRAME_SQL = f"""
, frame AS (SELECT coalesce(source, 'unknown') AS source, job_key, city, education, experience,
                   keyword, len({O.stored_tags_sql()}) AS skill_count, salary_avg
            FROM silver WHERE salary_avg IS NOT NULL AND city IS NOT NULL
              AND education IS NOT NULL AND experience IS NOT NULL AND keyword IS NOT NULL)"""


@register("ml_frame", _ML_FRAME_SQL + "\nSELECT * FROM frame")
def q_ml_frame(spark, sf_dir):
    return ml.ml_frame(silver(spark, sf_dir))


@register("ml_weights", _ML_FRAME_SQL + """
, c AS (SELECT experience, count(*) AS n FROM frame GROUP BY experience)
SELECT experience, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""")
def q_ml_weights(spark, sf_dir):
    return ml.class_weights(ml.ml_frame(silver(spark, sf_dir)))


@register("ml_split", _ML_FRAME_SQL + """
, c AS (SELECT experience, count(*) AS n FROM frame GROUP BY experience),
  k AS (SELECT experience, n, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS k FROM c)
SELECT experience, true AS is_test, k AS n FROM k WHERE k > 0
UNION ALL SELECT experience, false, n - k FROM k WHERE n > k""")
def q_ml_split(spark, sf_dir):
    s = ml.stratified_split(ml.ml_frame(silver(spark, sf_dir)))
    return s.groupBy("experience", "is_test").agg(F.count(F.lit(1)).alias("n"))


MODEL_SIZES = ml.ModelSizes()


def _trained(spark, sf_dir):
    """The models of this input, trained by the first query that needs them."""
    tag = hashlib.sha1(f"{tables.state_tag(spark, sf_dir, 'operators/ml.py', 'operators/trees.py')}:{MODEL_SIZES}".encode()).hexdigest()[:16]
    return ml.selected(ml.ml_frame(silver(spark, sf_dir)), work_path(spark, "models", tag), MODEL_SIZES)


@register("ml_scores")
def q_ml_scores(spark, sf_dir):
    res, _ = _trained(spark, sf_dir)
    rows = [(s["model"], float(s["cv_r2"]), float(s["test_r2"]), float(s["test_mae"]),
             s["model"] == res.best) for s in res.scores]
    return spark.createDataFrame(rows, "model string, cv_r2 double, test_r2 double, "
                                       "test_mae double, best boolean")


@register("ml_importance")
def q_ml_importance(spark, sf_dir):
    res, test = _trained(spark, sf_dir)
    return ml.permutation_importance(res.model, test, repeats=10, seed=42)


@register("ml_score_batch")
def q_ml_score_batch(spark, sf_dir):
    res, test = _trained(spark, sf_dir)
    frame = ml.ml_frame(silver(spark, sf_dir))
    options = stats.feature_options(frame, FX_CITIES)
    requests = test.select("city", "education", "experience", "keyword")
    return ml.score_batch(res.model, requests, options, default_source="site_b")


# Requests that go wrong in every way, made of the postings by rule: the field named by the
# remainder is blank, missing or unknown, and source and skill count are given to some only.
_REQUEST_SQL = """
, req AS (
  SELECT source AS from_source, job_key,
         CASE WHEN m = 1 THEN NULL WHEN m = 2 THEN '  ' WHEN m = 3 THEN 'nowhere' ELSE city END AS city,
         CASE WHEN m = 4 THEN '' WHEN m = 5 THEN 'none' ELSE education END AS education,
         CASE WHEN m = 6 THEN NULL WHEN m = 3 THEN 'none' ELSE experience END AS experience,
         CASE WHEN m = 7 THEN ' ' WHEN m = 8 THEN 'none' ELSE keyword END AS keyword,
         CASE WHEN m % 2 = 0 THEN source END AS source,
         CASE WHEN m % 3 = 0 THEN m END AS skill_count
  FROM (SELECT *, length(job_key) * 3 % 11 + ascii(right(job_key, 1)) % 3 AS m FROM frame))"""


def _requests(frame):
    m = (F.length("job_key") * 3) % 11 + F.ascii(F.substring(F.col("job_key"), -1, 1)) % 3
    t = frame.withColumn("m", m)
    none, m = F.lit(None).cast("string"), F.col("m")
    return t.select(
        F.col("source").alias("from_source"), "job_key",
        F.when(m == 1, none).when(m == 2, "  ").when(m == 3, "nowhere").otherwise(F.col("city")).alias("city"),
        F.when(m == 4, "").when(m == 5, "none").otherwise(F.col("education")).alias("education"),
        F.when(m == 6, none).when(m == 3, "none").otherwise(F.col("experience")).alias("experience"),
        F.when(m == 7, " ").when(m == 8, "none").otherwise(F.col("keyword")).alias("keyword"),
        F.when(m % 2 == 0, F.col("source")).alias("source"),
        F.when(m % 3 == 0, m).alias("skill_count"))


@register("request_validation", _ML_FRAME_SQL + _REQUEST_SQL + f"""
SELECT from_source, job_key, coalesce(source, 'site_b') AS source, coalesce(skill_count, 2) AS skill_count,
       CASE WHEN coalesce(trim(city), '') = '' THEN 'city is blank'
            WHEN city NOT IN (SELECT city FROM frame WHERE city IN {CITY_IN}) THEN 'city not in options'
            WHEN coalesce(trim(education), '') = '' THEN 'education is blank'
            WHEN education NOT IN (SELECT education FROM frame) THEN 'education not in options'
            WHEN coalesce(trim(experience), '') = '' THEN 'experience is blank'
            WHEN experience NOT IN (SELECT experience FROM frame) THEN 'experience not in options'
            WHEN coalesce(trim(keyword), '') = '' THEN 'keyword is blank'
            WHEN keyword NOT IN (SELECT keyword FROM frame) THEN 'keyword not in options' END AS reason
FROM req""")
def q_request_validation(spark, sf_dir):
    frame = ml.ml_frame(silver(spark, sf_dir))
    v = ml.with_defaults(ml.validate_requests(_requests(frame), stats.feature_options(frame, FX_CITIES)), "site_b")
    return v.select("from_source", "job_key", "source", "skill_count", "reason")


@register("ml_checks", _ML_FRAME_SQL + f"""
, c AS (SELECT experience, count(*) AS n FROM frame GROUP BY experience),
  t AS (SELECT sum(CAST(floor(n * 0.2 + 0.5) AS BIGINT)) AS n_test, sum(n) AS n_rows FROM c)
SELECT n_rows, n_test, 'gradient_boosting,linear,random_forest' AS models, 1 AS n_best, true AS best_has_highest_cv,
       6 AS n_features, true AS shares_sum_to_one, true AS shares_in_range, n_test AS n_scored, 0 AS n_negative,
       0 AS n_unpredicted, 0 AS n_predicted_invalid
FROM t""")
def q_ml_checks(spark, sf_dir):
    """What must hold of scores, importances and batch predictions, whatever the models learn."""
    res, test = _trained(spark, sf_dir)
    imp = q_ml_importance(spark, sf_dir).agg(
        F.count(F.lit(1)).cast("int").alias("n_features"), F.round(F.sum("importance"), 6).isin(0.0, 1.0).alias("shares_sum_to_one"),
        F.min(F.col("importance").between(0, 1)).alias("shares_in_range"))
    bad = F.col("reason").isNotNull()
    scored = q_ml_score_batch(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("predicted_salary") < 0).cast("int").alias("n_negative"),
        F.count_if(~bad & F.col("predicted_salary").isNull()).cast("int").alias("n_unpredicted"),
        F.count_if(bad & F.col("predicted_salary").isNotNull()).cast("int").alias("n_predicted_invalid"))
    best = [s for s in res.scores if s["model"] == res.best]
    head = spark.createDataFrame([(res.n_rows, ",".join(sorted(s["model"] for s in res.scores)), len(best),
                                   best[0]["cv_r2"] == max(s["cv_r2"] for s in res.scores))],
                                 "n_rows long, models string, n_best int, best_has_highest_cv boolean")
    parts = [head, test.agg(F.count(F.lit(1)).alias("n_test")), imp, scored]
    one = [p.withColumn("one", F.lit(1)) for p in parts]     # a row each
    return reduce(lambda a, b: a.join(b, "one"), one).drop("one")


@register("feature_options", _ML_FRAME_SQL + f"""
, opts AS (
  SELECT DISTINCT 'city' AS feature, city AS value FROM frame WHERE city IN {CITY_IN}
  UNION SELECT DISTINCT 'education', education FROM frame
  UNION SELECT DISTINCT 'experience', experience FROM frame
  UNION SELECT DISTINCT 'keyword', keyword FROM frame
  UNION SELECT DISTINCT 'source', source FROM frame)
SELECT feature, value,
       CASE WHEN feature = 'city' THEN CAST(replace(value, 'NATION_', '') AS INTEGER) END AS city_ord
FROM opts""")
def q_feature_options(spark, sf_dir):
    return stats.feature_options(ml.ml_frame(silver(spark, sf_dir)), FX_CITIES)


# ---------------------------------------------------------------------------
# Streaming ingest of the events table (landing files -> foreachBatch upsert)
# ---------------------------------------------------------------------------
from hirelens.streaming import ingest_stream  # noqa: E402

_EV_ROWS = """
, ev AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS job_key,
                concat('user-', CAST(user_id AS VARCHAR)) AS title,
                json_extract_string(props, '$.k') AS keyword,
                concat(CAST(value AS VARCHAR), 'K') AS salary_text, ts AS crawled_at
         FROM events
         QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1)"""
_EV = _EV_ROWS + "\n, " + O.salary_ctes("ev", "evs").strip() + """
SELECT source, job_key, title, keyword, salary_text, salary_min_c / 100.0 AS salary_min,
       salary_max_c / 100.0 AS salary_max, salary_avg_c / 100.0 AS salary_avg, crawled_at
FROM evs"""


@register("ingest_stream", _EV)
def q_ingest_stream(spark, sf_dir):
    work_root(spark)
    t = ingest_stream.ingest_events(spark, sf_dir)["job"]
    return t.select("source", "job_key", "title", "keyword", "salary_text",
                    *[F.col(c).cast("double").alias(c) for c in ("salary_min", "salary_max", "salary_avg")],
                    "crawled_at")


@register("ingest_stream_raw", _EV_ROWS + """
SELECT source, job_key, title, keyword, salary_text, crawled_at FROM ev""")
def q_ingest_stream_raw(spark, sf_dir):
    work_root(spark)
    t = ingest_stream.ingest_events(spark, sf_dir)["raw_job"]
    return t.select("source", "job_key", "title", "keyword", "salary_text", "crawled_at")


from hirelens.plans import derived  # noqa: E402, F401  (registers its queries)
