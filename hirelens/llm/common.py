"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.session import work_path

#: Texts handed to one numpy pass are grouped up to about this many characters.
GROUP_CHARS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what was computed survives lost executors, and later plans
    start from a table whose rows Spark may deal out as it likes.
    """
    path = work_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(nullable(df.schema)).parquet(path)
    out.staged_path = path
    return out


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "staged_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def coded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... and what they were: no name of a plan clashes with those."""
    codes = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*codes.values()), codes


def decoded(df: DataFrame, codes: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(code).alias(c) for c, code in codes.items()])


def one_of_each(df: DataFrame, keys: list[str], codes: dict[str, str], apart: list[str]) -> DataFrame:
    """Of the rows of ``df`` equal in ``keys`` the one whose other columns hash lowest.

    The columns ``apart`` are equal in such rows and not hashed. Combines before the shuffle.
    """
    others = [c for c in codes.values() if c not in apart]
    place = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    row = F.min_by(F.struct(*codes.values()), place).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*", *[k for k in keys if k not in codes.values()])


def batches(it: Iterator[pa.RecordBatch], text: str | None = None,
            rows: int = 512, held_bytes: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, cut earlier once ``text`` holds ``held_bytes`` bytes.

    A slice always has a row, so a text longer than that is a slice of its own.
    """
    for batch in it:
        if text is None:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > held_bytes or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, col, sizes
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType) -> DataFrame:
    return df.mapInArrow(fn, nullable(schema))
