"""Incremental ingest as Structured Streaming.

Landing files are read with ``readStream``; rows get their keys (C7), and a keyed state, that of a streaming
aggregate, says whether a key was written by an earlier batch (I2). A new key's first row in the order of the rows (I1) goes
on, is cleaned (I3) and written to both tables through ``foreachBatch``.

The work of a batch depends on its own rows alone: the state is looked up by key in Spark's state
store (RocksDB, so it need not fit in memory, and is checkpointed with the stream), and nothing of
the tables is read. Exactly-once: batch ``N`` writes its rows to ``<table>/batch_id=N`` with
overwrite; a replayed batch starts from the state before it and rewrites the same rows in both tables.

``upsert_batch`` is the writer for tables that others fill too: it compares a batch with
the keys of the table itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.operators.ingest import KEYS, bronze_from_raw, dedupe_first, keyed, silver_from_bronze
from hirelens.session import path_exists, work_path

EVENT_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                "value double, props string")


#: Table -> projection of new bronze rows into it.
TARGETS = {"raw_job": lambda rows: rows, "job": silver_from_bronze}


def event_cards(events: DataFrame) -> DataFrame:
    """Events as raw cards: key (event_type, user_id), first write = earliest (ts, event_id)."""
    return events.select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("job_key"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("title"),
        F.get_json_object(F.col("props"), "$.k").alias("keyword"),
        F.concat(F.col("value").cast("string"), F.lit("K")).alias("salary_text"),
        F.col("ts").alias("crawled_at"),
        F.col("ts").alias("ord1"), F.col("event_id").alias("ord2"))


def land_events(spark: SparkSession, sf_dir: str, landing: str, parts: int = 5) -> None:
    """Split ``events`` into ``parts`` time-ordered landing files (arrival simulation)."""
    ev = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    # one scan; the ranges of ts (null first) become files written, and so read, in order
    ordered = ev.repartitionByRange(parts, F.col("ts").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    shared = ordered.persist()
    for part in range(parts):
        # one partition, so one file: an empty file beside it would be a batch of its own
        shared.where(F.col("part") == part).drop("part").repartition(1).write.mode("append").parquet(landing)
    shared.unpersist()


def upsert_batch(base: str):
    """Writer of one micro-batch into the two tables ``raw_job`` and ``job`` below ``base``,
    each with its own existence check: a key one of them lacks is still written there."""
    keys = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("batch_id", T.IntegerType())])

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = bronze_from_raw(dedupe_first(keyed(batch), KEYS, ("ord1", "ord2"))).persist()
        for name, clean in TARGETS.items():
            path, rows = f"{base}/{name}", fresh
            if path_exists(spark, path):
                # with a schema: a batch that died while writing left a folder without a data file
                seen = spark.read.schema(keys).parquet(path).where(F.col("batch_id") < batch_id).select(*KEYS)
                rows = rows.join(seen, KEYS, "left_anti")
            clean(rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        fresh.unpersist()
    return run


def first_writes(cards: DataFrame, order: tuple[str, ...] = ("ord1", "ord2")) -> DataFrame:
    """The first row, in ``order`` (nulls first), of every key that no earlier batch of the stream had.

    A streaming aggregate: rows are combined before the shuffle, the state holds a row per key. All rows of a
    batch carry the batch's time, which a replay keeps, so a key is new where its first
    batch is also its last.
    """
    cards = keyed(cards)
    others = [c for c in cards.columns if c not in (*KEYS, *order)]
    at = F.current_timestamp()
    first = cards.withColumn("__at", at).groupBy(*KEYS).agg(
        F.min(F.struct("__at", *order, *others)).alias("__first"), F.max("__at").alias("__last"))
    return (first.where(F.col("__first.__at") == F.col("__last"))
            .select(*KEYS, "__first.*").select(*cards.columns))


def write_batch(base: str):
    """Writer of the new rows of one micro-batch into the tables below ``base``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = bronze_from_raw(batch).persist()
        for name, clean in TARGETS.items():
            clean(fresh).write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
        fresh.unpersist()
    return run


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_ingest_stream(spark: SparkSession, landing: str, base: str, checkpoint: str,
                      files_per_batch: int = 1, write=write_batch) -> dict[str, DataFrame]:
    stream = (spark.readStream.schema(EVENT_SCHEMA)
              .option("maxFilesPerTrigger", files_per_batch).parquet(landing))
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)                # a query keeps the setting it starts with
    try:
        q = (first_writes(event_cards(stream)).writeStream.outputMode("update").foreachBatch(write(base))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    q.awaitTermination()
    return {name: spark.read.parquet(f"{base}/{name}") for name in TARGETS}


def ingest_events(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """Land the events, stream them into fresh tables, return the tables by name."""
    run_id = run_id or uuid.uuid4().hex[:10]
    base = work_path(spark, f"stream-{run_id}")
    land_events(spark, sf_dir, f"{base}/landing")
    return run_ingest_stream(spark, f"{base}/landing", f"{base}/tables", f"{base}/checkpoint")
