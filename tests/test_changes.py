"""Change tables rewrite the folders of changed keys only."""

import glob
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from hirelens.operators import ingest
from hirelens.session import scratch_dir
from hirelens.sources import sinks, tables


def _files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def _old(silver):
    """A few stale rows: one field wrong, one missing."""
    some = F.col("job_key").isin([r.job_key for r in silver.orderBy("job_key").limit(3).collect()])
    return silver.withColumns({"experience": F.when(some, F.lit("x")).otherwise(F.col("experience")),
                               "education": F.when(~some, F.col("education")),
                               "salary_avg": F.when(some, F.lit(None)).otherwise(F.col("salary_avg")).cast("decimal(20,2)")})


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_reclean_rewrites_changed_folders_only(spark):
    silver, bronze = tables.silver(spark, SF_SMALL), tables.bronze(spark, SF_SMALL)
    path = os.path.join(scratch_dir(), "silver")
    # tags of the stored table are those of the site, a re-clean takes them from titles: every row has changed once
    sinks.write_by_key(_old(ingest.reclean_apply(silver, bronze)[0]), path, 16)
    before = _files(path)
    stale = sinks.read_by_key(spark, path)
    want, _ = ingest.reclean_apply(stale, bronze)
    want = _rows(want)
    changes = ingest.reclean_changes(stale, bronze)
    assert {r.field for r in changes.collect()} >= {"experience"}
    n_folders = changes.select(F.pmod(F.hash("source", "job_key"), F.lit(16))).distinct().count()
    log = sinks.merge_changes(changes, path)
    after = _files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert 0 < n_folders < 16 and len(same) >= 16 - n_folders       # the other files were not touched
    assert _rows(sinks.read_by_key(spark, path)) == want
    sinks.replay_changes(spark, log, path)                          # as after a merge that died
    assert _rows(sinks.read_by_key(spark, path)) == want
    assert ingest.reclean_changes(sinks.read_by_key(spark, path), bronze).count() == 0


def test_resalary_changes_are_merged_with_their_types(spark):
    silver = tables.silver(spark, SF_SMALL)
    path = os.path.join(scratch_dir(), "silver")
    sinks.write_by_key(_old(silver).withColumn("experience", F.col("experience")), path, 8)
    stale = sinks.read_by_key(spark, path)
    sinks.merge_changes(ingest.resalary_changes(stale), path)
    got = sinks.read_by_key(spark, path)
    assert _rows(got.select("source", "job_key", "salary_min", "salary_max", "salary_avg")) == \
        _rows(silver.select("source", "job_key", "salary_min", "salary_max", "salary_avg"))
    assert got.schema["salary_avg"].dataType == silver.schema["salary_avg"].dataType


def test_no_changes_touch_nothing(spark):
    silver, bronze = tables.silver(spark, SF_SMALL), tables.bronze(spark, SF_SMALL)
    path = os.path.join(scratch_dir(), "silver")
    sinks.write_by_key(ingest.reclean_apply(silver, bronze)[0], path, 4)
    before = _files(path)
    sinks.merge_changes(ingest.reclean_changes(sinks.read_by_key(spark, path), bronze), path)
    assert _files(path) == before
