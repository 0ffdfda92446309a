"""S11-S14 sinks and presentation rounding.

Writers go to a caller-given (shared) folder; nothing is collected to the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.session import path_exists
from hirelens.sources.tables import register_bucketed, table_name


def export_frame(silver: DataFrame) -> DataFrame:
    """S11 rows: the 12 export columns in fixed order, salaries as double."""
    cols = []
    for c, _ in dims.EXPORT_COLUMNS:
        col = F.col(c)
        if c.startswith("salary_") and c != "salary_text":
            col = col.cast("double")
        cols.append(col.alias(c))
    return silver.select(*cols)


def export_csv(silver: DataFrame, path: str) -> None:
    """CSV with the display headers (UTF-8; Spark writes no BOM)."""
    frame = export_frame(silver)
    frame = frame.select(*[F.col(c).alias(h) for c, h in dims.EXPORT_COLUMNS])
    (frame.write.mode("overwrite").option("header", True).option("emptyValue", "")
     .csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (graph nodes / edges / premium)."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, col: str = "value") -> None:
    """One line per row (e.g. the full delete-preview list)."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_report(spark, report: dict, path: str) -> None:
    """A training report as a one-row JSON table next to the saved model."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "report string") \
        .write.mode("overwrite").text(path)


def read_report(spark, path: str) -> dict | None:
    """The saved report, or None when no model has been trained."""
    if not path_exists(spark, path):
        return None
    row = spark.read.text(path).first()
    return json.loads(row.value) if row else None


def display_round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """C17: presentation rounding (1/2/4 dp) applied only when showing results."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


# I5 / D5 ------------------------------------------------------------------------
POINTER = "CURRENT"
SNAPSHOT_TABLES = ("silver", "bronze")


def _jvm_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written aside, then renamed over what is there."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    aside = _jvm_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = aside.getFileSystem(sc._jsc.hadoopConfiguration()).create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), sc._jsc.hadoopConfiguration())
    context.rename(aside, _jvm_path(spark, path), over)


def write_snapshot(out: str, silver: DataFrame, bronze: DataFrame, buckets: int | None = None) -> str:
    """Both tables as a new version below ``out``, all or nothing; the version's name.

    The tables keep the bucket layout of the stored ones, so key joins between
    them need no shuffle. A pointer file is replaced last, by one rename: readers see the version before
    until then, and that version stays as it is. A table's versions are partitions of its folder: read plainly, it
    shows all of them, told apart by the column ``version``. ``buckets`` is by default the number of
    shuffle partitions, 16 at least.
    """
    spark = silver.sparkSession
    n = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    version = f"v-{uuid.uuid4().hex}"
    folders = {name: f"{name}/version={version}" for name in SNAPSHOT_TABLES}
    for name, table in zip(SNAPSHOT_TABLES, (silver, bronze)):
        path = f"{out}/{folders[name]}"
        (table.repartition(n, "source", "job_key").write.mode("overwrite").format("parquet")
         .bucketBy(n, "source", "job_key").option("path", path).saveAsTable(table_name(path)))
    _put(spark, f"{out}/{POINTER}", json.dumps({"version": version, "buckets": n, "folders": folders}))
    return version


def read_snapshot(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(silver, bronze) of the version that the pointer names; ValueError for a folder without one."""
    if not path_exists(spark, f"{out}/{POINTER}"):
        raise ValueError(f"{out} holds no complete snapshot")
    current = json.loads(spark.read.text(f"{out}/{POINTER}").first().value)
    found = []
    for name in SNAPSHOT_TABLES:
        folders = current.get("folders", {})        # without them: as they were laid out before
        path = f"{out}/{folders.get(name, current['version'] + '/' + name)}"
        if not spark.catalog.tableExists(table_name(path)):
            register_bucketed(spark, table_name(path), path, current["buckets"])
        found.append(spark.table(table_name(path)))
    return found[0], found[1]


# Change tables merged into a table whose folders are key ranges --------------
BUCKET = "bucket"


def write_by_key(df: DataFrame, path: str, buckets: int, keys: tuple[str, ...] = ("source", "job_key")) -> None:
    """``df`` with one folder per key hash, so that a merge can rewrite some of them."""
    dealt = df.withColumn(BUCKET, F.pmod(F.hash(*keys), F.lit(buckets)))
    dealt.repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    _put(df.sparkSession, f"{path}.buckets", str(buckets))


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def merge_changes(changes: DataFrame, path: str, keys: tuple[str, ...] = ("source", "job_key")) -> str:
    """Merge (keys, field, new) rows into a table of ``write_by_key``; the folder of the change table.

    The changes are stored first. Only folders that hold a changed key are read and rewritten
    (dynamic partition overwrite: their new files replace the old ones when all are written). The merge of a
    stored change table gives the same rows however often it runs, so one that died is run again.
    """
    spark = changes.sparkSession
    n = int(spark.read.text(f"{path}.buckets").first().value)
    log = f"{path}.changes/{uuid.uuid4().hex}"
    changes.select(*keys, "field", "new", F.pmod(F.hash(*keys), F.lit(n)).alias(BUCKET)).write.parquet(log)
    replay_changes(spark, log, path, keys)
    return log


def replay_changes(spark: SparkSession, log: str, path: str, keys: tuple[str, ...] = ("source", "job_key")) -> None:
    stored = spark.read.parquet(log)
    touched = [r[BUCKET] for r in stored.select(BUCKET).distinct().collect()]      # one number per folder at most
    if not touched:
        return
    table = spark.read.parquet(path)
    per_key = stored.groupBy(*keys).agg(                # at most one entry per field
        F.map_from_entries(F.collect_set(F.struct("field", "new"))).alias("__new"))
    joined = table.where(F.col(BUCKET).isin(touched)).join(per_key, list(keys), "left")
    said = F.coalesce(F.map_keys("__new"), F.array().cast("array<string>"))
    cols = [F.when(F.array_contains(said, f.name), F.col("__new")[f.name].cast(f.dataType))
            .otherwise(F.col(f.name)).alias(f.name) if f.name not in (*keys, BUCKET) else F.col(f.name)
            for f in table.schema.fields]
    (joined.select(*cols).repartition(len(touched), BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
