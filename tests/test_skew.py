"""A key holding a third of all rows: dedupe collapses it map-side, results stay whole."""

from pyspark.sql import functions as F

from hirelens.operators import ingest


def test_hot_key_dedupe(spark):
    n = 30_000
    df = (spark.range(n)
          .select(F.lit("site_a").alias("source"),
                  F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string"))
                  .alias("job_key"),
                  (F.lit(n) - F.col("id")).alias("ord1"), F.col("id").alias("ord2"),
                  F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
          .repartition(8))
    out = ingest.dedupe_first(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan                      # combined before the shuffle
    rows = out.collect()
    assert len(rows) == 1 + (n - n // 3)              # every non-hot row kept, hot key once
    hot = [r for r in rows if r.job_key == "HOT"][0]
    assert hot.title == f"t{3 * ((n - 1) // 3)}"     # smallest ord1 = largest id among hot rows


def test_key_joins_are_colocated(spark):
    """silver JOIN bronze on (source, job_key) reads both bucketed tables without a shuffle."""
    from conftest import SF_SMALL
    from hirelens.sources import tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # the large-table case
    try:
        df = ingest.reclean_diff(tables.silver(spark, SF_SMALL), tables.bronze(spark, SF_SMALL))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan
    exchanges = [l for l in plan.splitlines() if "Exchange" in l]
    assert all("SinglePartition" in l for l in exchanges), exchanges
