"""Dedupe, bronze/silver projections, insert-if-absent, re-clean, backfill.

All maintenance jobs are joins on the composite key ``(source, job_key)``
(semi/anti/inner), never per-row lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions.flags import make_job_key
from hirelens.functions.levels import clean_education, clean_experience, with_levels
from hirelens.functions.salary import SALARY_COLS, with_salary
from hirelens.functions.tags import split_tags, with_skills

KEYS = ["source", "job_key"]

BRONZE_COLS = ["source", "job_key", "title", "salary_text", "city", "area", "experience",
               "education", "company", "company_size", "industry", "tags", "keyword",
               "detail_url", "crawled_at"]
SILVER_COLS = ["source", "job_key", "title", "keyword", "salary_text", "city", "company",
               "company_size", "industry", "salary_min", "salary_max", "salary_avg",
               "experience", "education", "tags", "crawled_at"]


def with_defaults(raw: DataFrame) -> DataFrame:
    """Add any missing raw-card column as null string, default source 'unknown' (I4)."""
    wanted = ["source", "job_key", "title", "company", "city", "industry", "salary_text",
              "education_text", "experience_text", "tags_text", "keyword", "url", "area",
              "company_size"]
    for c in wanted:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    if "crawled_at" not in raw.columns:
        raw = raw.withColumn("crawled_at", F.lit(None).cast("timestamp_ntz"))
    return raw.withColumn("source", F.coalesce(F.col("source"), F.lit("unknown")))


def keyed(raw: DataFrame) -> DataFrame:
    """Replace job_key by the derived key (official id / url / hash)."""
    raw = with_defaults(raw)
    return raw.withColumn("job_key", make_job_key(F.col("job_key"), F.col("url"), F.col("title"),
                                                  F.col("company"), F.col("city")))


def dedupe_first(raw: DataFrame, keys=KEYS, order=("ord1", "ord2")) -> DataFrame:
    """Keep the first-written row per key, "first" being the total order ``order``.

    Implemented as ``min(struct(order..., rest...))`` per key: an aggregate with a
    map-side partial step, so a key holding a large share of the rows is collapsed
    before the shuffle (unlike ``row_number`` over a window, which ships every copy).
    """
    missing = [c for c in order if c not in raw.columns]
    if missing:
        raise ValueError(f"no order columns {missing}: which row came first is not known")
    order = list(order)
    others = [c for c in raw.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *others)).alias("__first")
    out = raw.groupBy(*keys).agg(packed).select(*keys, "__first.*")
    return out.drop(*order).select(*keys, *others)


def bronze_from_raw(raw: DataFrame) -> DataFrame:
    """Raw card -> bronze row: text kept verbatim."""
    raw = with_defaults(raw)
    return raw.select(
        "source", "job_key", "title", "salary_text", "city", "area",
        F.col("experience_text").alias("experience"),
        F.col("education_text").alias("education"),
        "company", "company_size", "industry",
        F.col("tags_text").alias("tags"), "keyword",
        F.col("url").alias("detail_url"), "crawled_at")


def silver_from_bronze(bronze: DataFrame) -> DataFrame:
    """The single cleaning projection (C1-C4) from bronze text columns."""
    df = with_levels(with_salary(bronze, "salary_text"))
    return df.select(
        "source", "job_key", "title", "keyword", "salary_text", "city", "company",
        "company_size", "industry", *SALARY_COLS, "experience", "education",
        split_tags(F.col("tags")).alias("tags"),
        "crawled_at")


def silver_from_raw(raw: DataFrame) -> DataFrame:
    return silver_from_bronze(bronze_from_raw(raw))


def ingest_batch(raw: DataFrame, bronze: DataFrame, silver: DataFrame,
                 order=("ord1", "ord2"), stored=None) -> tuple[DataFrame, DataFrame]:
    """I2 (+I1): rows of one batch that are new to bronze and to silver, separately.

    A key present in bronze but missing in silver is still written to silver.
    Returns (bronze_new, silver_new); the caller appends them atomically. ``stored``, if
    given, writes the deduplicated batch (DataFrame -> DataFrame), so that both results read
    it instead of making it.
    """
    batch = dedupe_first(keyed(raw) if "url" in raw.columns else with_defaults(raw),
                         KEYS, order)
    if stored is not None:
        batch = stored(batch)
    b_new = bronze_from_raw(batch.join(bronze.select(*KEYS), KEYS, "left_anti"))
    s_new = silver_from_raw(batch.join(silver.select(*KEYS), KEYS, "left_anti"))
    return b_new, s_new


def insert_if_absent_counts(raw: DataFrame, bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """One row: distinct keys in the batch, how many are new to bronze and to silver.

    Each existence check is one left join on the key (no per-row lookups).
    """
    batch = with_defaults(raw).select(*KEYS).distinct()
    b_keys = bronze.select(*KEYS).withColumn("__in_b", F.lit(1))
    s_keys = silver.select(*KEYS).withColumn("__in_s", F.lit(1))
    j = batch.join(b_keys, KEYS, "left").join(s_keys, KEYS, "left")
    return j.agg(
        F.count(F.lit(1)).alias("batch_rows"),
        F.count_if(F.col("__in_b").isNull()).alias("new_bronze"),
        F.count_if(F.col("__in_s").isNull()).alias("new_silver"))


def reclean_diff(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """I6 preview: recompute experience/education from bronze text and tags from the
    title, report how many silver rows would change per field."""
    j = recleaned(silver, bronze)
    return j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("experience").eqNullSafe(F.col("new_experience"))).alias("experience_changed"),
        F.count_if(~F.col("education").eqNullSafe(F.col("new_education"))).alias("education_changed"),
        F.count_if(F.coalesce(F.col("tags"), F.lit("")) != F.col("new_tags")).alias("tags_changed"))


def recleaned(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """silver JOIN bronze on the key, with experience/education re-derived from the
    bronze texts and tags re-extracted from the title (staged projections)."""
    b = bronze.select(*KEYS, F.col("experience").alias("raw_experience"),
                      F.col("education").alias("raw_education"),
                      F.col("title").alias("raw_title"))
    j = silver.select(*KEYS, "experience", "education", "tags").join(b, KEYS, "inner")
    j = with_levels(j, "raw_experience", "raw_education", "new_experience", "new_education")
    j = with_skills(j, ["raw_title"], "new_tags")
    return j.select(*KEYS, "experience", "education", "tags",
                    "new_experience", "new_education", "new_tags")


def reclean_hist(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Experience histogram before vs after re-clean (full outer join of two counts)."""
    j = recleaned(silver, bronze)
    before = j.groupBy(F.col("experience").alias("tier")).agg(F.count(F.lit(1)).alias("n_before"))
    after = j.groupBy(F.col("new_experience").alias("tier")).agg(F.count(F.lit(1)).alias("n_after"))
    out = before.join(after, before.tier.eqNullSafe(after.tier), "full")
    return out.select(F.coalesce(before.tier, after.tier).alias("tier"),
                      F.coalesce(F.col("n_before"), F.lit(0)).alias("n_before"),
                      F.coalesce(F.col("n_after"), F.lit(0)).alias("n_after"))


def reclean_apply(silver: DataFrame, bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I6 apply: new silver (re-cleaned fields) and bronze with tags synced.

    Each table is joined once with the other's columns that it needs and cleaned where it
    stands: a task sorts two tables per result, not a third that was joined before.
    """
    raw = bronze.select(*KEYS, F.col("experience").alias("raw_experience"), F.col("education").alias("raw_education"),
                        F.col("title").alias("raw_title"), F.lit(True).alias("__found"))
    s = with_levels(silver.join(raw, KEYS, "left"), "raw_experience", "raw_education", "new_experience", "new_education")
    s = with_skills(s, ["raw_title"], "new_tags")
    s = (s.withColumn("experience", F.coalesce(F.col("new_experience"), F.col("experience")))
         .withColumn("education", F.coalesce(F.col("new_education"), F.col("education")))
         .withColumn("tags", F.when(F.col("__found"), F.col("new_tags")).otherwise(F.col("tags")))
         .select(*silver.columns))
    b = with_skills(bronze.join(silver.select(*KEYS, F.lit(True).alias("__found")), KEYS, "left"), ["title"], "new_tags")
    b = (b.withColumn("tags", F.when(F.col("__found"), F.col("new_tags")).otherwise(F.col("tags")))
         .select(*bronze.columns))
    return s, b


def _reparsed(silver: DataFrame) -> DataFrame:
    """Silver keys with stored (old_*) and recomputed salaries.

    Each distinct salary text is parsed once and joined back null-safely: far
    fewer parses than rows, and filters on the comparison stay above the join.
    """
    texts = silver.select("salary_text").distinct()
    parsed = with_salary(texts, "salary_text").select(
        F.col("salary_text").alias("__text"), *SALARY_COLS)
    old = silver.select(*KEYS, "salary_text", *[F.col(c).alias(f"old_{c}") for c in SALARY_COLS])
    j = old.join(parsed, old.salary_text.eqNullSafe(parsed["__text"]), "left").drop("__text")
    same = F.lit(True)
    for c in SALARY_COLS:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(c))
    return j.withColumn("__same", same)


def resalary_diff(silver: DataFrame) -> DataFrame:
    """Recompute C1 over silver salary_text; rows changed and cleared."""
    j = _reparsed(silver)
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(~F.col("__same")).alias("changed"),
                 F.count_if(F.col("salary_avg").isNull() & F.col("old_salary_avg").isNotNull())
                 .alias("cleared"))


def backfill_bronze(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """I8: bronze rows rebuilt from silver for keys bronze lacks (left anti join)."""
    missing = silver.join(bronze.select(*KEYS), KEYS, "left_anti")
    return missing.select(
        "source", "job_key", "title", "salary_text", "city",
        F.lit(None).cast("string").alias("area"),
        "experience", "education", "company", "company_size", "industry", "tags", "keyword",
        F.lit(None).cast("string").alias("detail_url"), "crawled_at")


def resalary_samples(silver: DataFrame, n: int = 15) -> DataFrame:
    """I7 preview: up to ``n`` changed rows, salary text with old -> new average."""
    j = _reparsed(silver)
    return (j.where(~F.col("__same")).select(*KEYS, "salary_text", "old_salary_avg", "salary_avg")
            .orderBy(*KEYS).limit(n))


# Change tables (I6, I7): what an apply would write, one row per key and field
def _changes(rows: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    """(source, job_key, field, old, new) of the ``fields`` (name -> old and new Column) that differ."""
    told = F.array(*[F.struct(F.lit(name).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"))
                     for name, (old, new) in fields.items()])
    differ = F.filter(told, lambda c: ~c["old"].eqNullSafe(c["new"]))
    return rows.select(*KEYS, F.explode(differ).alias("c")).select(*KEYS, "c.*")


def reclean_changes(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """I6 as a change table of silver."""
    return _changes(recleaned(silver, bronze),
                    {f: (F.col(f), F.col(f"new_{f}")) for f in ("experience", "education", "tags")})


def resalary_changes(silver: DataFrame) -> DataFrame:
    """I7 as a change table of silver."""
    return _changes(_reparsed(silver), {c: (F.col(f"old_{c}"), F.col(c)) for c in SALARY_COLS})


def commit_batch(rows: DataFrame, table_path: str, batch_id: int) -> None:
    """All-or-nothing append of one batch as its own ``batch_id=N`` partition.

    The output committer publishes the files only when the whole write job
    succeeds; a retried batch overwrites its own partition, never duplicates it.
    """
    rows.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")
