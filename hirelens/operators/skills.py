"""Normalised skill sets, co-occurrence graph, salary premium, word-cloud feed.

Pairs are generated inside each posting from its (bounded, top-n) skill set with
higher-order array functions: no self-join, no shuffle until the pair counts.
The top-n list reaches every task as a scalar subquery (broadcast once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.tags import skill_set
from hirelens.functions.text import WS_CLASS


def postings_skills(silver: DataFrame, aliases: dict | None = None) -> DataFrame:
    """G1: (skills: distinct normalised set, salary_avg) for postings with >= 1 skill.

    "At least one skill" is tested on the raw text (some character that is neither
    a comma nor a blank): equivalent to a non-empty set, and unlike a filter on the
    derived array it does not make Catalyst evaluate the normalisation twice.
    """
    has_tag = F.col("tags").rlike("[^," + WS_CLASS + "]")
    return (silver.where(F.col("tags").isNotNull() & has_tag)
            .select(skill_set(F.col("tags"), aliases).alias("skills"), "salary_avg"))


def skill_counts(jobs: DataFrame) -> DataFrame:
    return (jobs.select(F.explode("skills").alias("skill")).groupBy("skill")
            .agg(F.count(F.lit(1)).alias("n")))


def skill_nodes(jobs: DataFrame, top_n: int = 25) -> DataFrame:
    """The top-n skills by number of postings (name breaks ties)."""
    return skill_counts(jobs).orderBy(F.col("n").desc(), F.col("skill").asc()).limit(top_n)


def skill_edges(jobs: DataFrame, top_n: int = 25, min_edge: int = 8) -> DataFrame:
    """Unordered pairs (a < b) among the top-n skills co-occurring >= min_edge times."""
    top_list = skill_nodes(jobs, top_n).select(F.sort_array(F.collect_list("skill"))).scalar()
    inter = jobs.select(F.sort_array(F.array_intersect(F.col("skills"), top_list)).alias("s"))
    s = F.col("s")
    pairs = F.filter(
        F.flatten(F.transform(s, lambda a: F.transform(
            s, lambda b: F.struct(a.alias("source"), b.alias("target"))))),
        lambda p: p["source"] < p["target"])
    return (inter.select(F.explode(pairs).alias("p")).select("p.*")
            .groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
            .where(F.col("weight") >= min_edge))


def skill_edges_top(jobs: DataFrame, k: int = 15, top_n: int = 25, min_edge: int = 8) -> DataFrame:
    """The k strongest edges."""
    return (skill_edges(jobs, top_n, min_edge)
            .orderBy(F.col("weight").desc(), F.col("source").asc(), F.col("target").asc())
            .limit(k))


def skill_premium(jobs: DataFrame, min_samples: int = 20, top_n: int = 20) -> DataFrame:
    """Per-skill median salary vs the median over tagged postings, in percent."""
    paid = jobs.where(F.col("salary_avg").isNotNull()).select(
        "skills", F.col("salary_avg").cast("double").alias("s"))
    overall = paid.select(F.coalesce(F.median("s"), F.lit(0.0))).scalar()
    per = (paid.select(F.explode("skills").alias("skill"), "s").groupBy("skill")
           .agg(F.count(F.lit(1)).alias("n"), F.median("s").alias("med"))
           .where(F.col("n") >= min_samples))
    prem = F.when(overall != 0, (F.col("med") - overall) / overall * 100).otherwise(F.lit(0.0))
    out = per.select("skill", "n", F.round("med", 6).alias("median_salary"),
                     F.round(prem, 6).alias("premium_pct"),
                     F.round(overall, 6).alias("overall_median"))
    return out.orderBy(F.col("premium_pct").desc(), F.col("skill").asc()).limit(top_n)


def skill_freq(jobs: DataFrame, max_words: int = 80) -> DataFrame:
    """Normalised skill frequencies for a word cloud."""
    return (skill_counts(jobs).orderBy(F.col("n").desc(), F.col("skill").asc())
            .limit(max_words))
