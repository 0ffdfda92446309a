"""The command line runs the batch jobs on stored tables."""

import os

import pytest

from conftest import SF_SMALL
from hirelens import cli
from hirelens.session import scratch_dir


def test_cli_outlier_apply_and_health(spark, capsys):
    out = os.path.join(scratch_dir(), "snap")
    assert cli.main(["--sf-dir", SF_SMALL, "--cities", ",".join(f"NATION_{i}" for i in range(20)),
                     "clean-outlier", "--threshold", "50", "--apply", "--out", out]) == 0
    from hirelens.sources.sinks import read_snapshot
    s, b = read_snapshot(spark, out)
    assert s.where("salary_avg > 50").count() == 0
    reports = os.path.join(out, "reports")
    assert cli.main(["--snapshot", out, "--reports", reports, "health-check"]) == 0
    text = capsys.readouterr().out
    assert "duplicate key groups" in text and "null / blank checks" in text
    whole = spark.read.json(os.path.join(reports, "keywords"))
    assert whole.count() == s.select("keyword").distinct().count()


def test_reports_print_a_bounded_head(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "LINES", 3)
    cli.Reports(None)("some rows", spark.range(10).orderBy("id"))
    text = capsys.readouterr().out
    assert "only the first 3 lines" in text and "|2 " in text.replace("  ", " ") and "|3 " not in text


def test_snapshots_keep_the_bucket_layout(spark):
    from hirelens.operators import ingest
    from hirelens.sources import tables
    from hirelens.sources.sinks import read_snapshot, write_snapshot
    out = os.path.join(scratch_dir(), "snap")
    silver, bronze = tables.silver(spark, SF_SMALL), tables.bronze(spark, SF_SMALL)
    write_snapshot(out, silver, bronze, buckets=4)
    s, b = read_snapshot(spark, out)
    assert sorted(map(str, s.collect())) == sorted(map(str, silver.select(*s.columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ingest.recleaned(s, b)
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        executed = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in executed
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_dead_apply_leaves_the_old_version(spark, monkeypatch):
    from hirelens.sources import sinks, tables
    out = os.path.join(scratch_dir(), "snap")
    silver, bronze = tables.silver(spark, SF_SMALL), tables.bronze(spark, SF_SMALL)
    sinks.write_snapshot(out, silver, bronze, buckets=2)
    n = silver.count()

    def dies(*a):
        raise OSError("lost")
    monkeypatch.setattr(sinks, "_put", dies)
    with pytest.raises(OSError):
        sinks.write_snapshot(out, silver.limit(5), bronze.limit(5), buckets=2)
    assert [t.count() for t in sinks.read_snapshot(spark, out)] == [n, bronze.count()]
    monkeypatch.undo()
    sinks.write_snapshot(out, silver.limit(5), bronze.limit(4), buckets=2)
    assert [t.count() for t in sinks.read_snapshot(spark, out)] == [5, 4]


def test_cli_offlist_drops_raw_rows_without_a_silver_row(spark):
    base = scratch_dir()
    silver, bronze, out = (os.path.join(base, n) for n in ("s", "b", "out"))
    schema = "source string, job_key string, city string, salary_avg double"
    spark.createDataFrame([("a", "1", "X", 1.0), ("a", "2", "Y", 2.0)], schema).write.parquet(silver)
    spark.createDataFrame([("a", "1", "X", 1.0), ("a", "2", "Y", 2.0), ("a", "3", "Y", 0.0)], schema).write.parquet(bronze)
    tables = ["--silver", silver, "--bronze", bronze, "--cities", "X"]
    assert cli.main([*tables, "clean-offlist"]) == 0 and not os.path.exists(out)
    assert cli.main([*tables, "clean-offlist", "--apply", "--out", out]) == 0
    from hirelens.sources.sinks import POINTER, read_snapshot
    assert [[r.job_key for r in t.collect()] for t in read_snapshot(spark, out)] == [["1"], ["1"]]
    os.remove(os.path.join(out, POINTER))       # as after a job that died
    with pytest.raises(ValueError):
        cli.main(["--snapshot", out, "health-check"])


def test_cli_needs_bronze_beside_silver(spark):
    with pytest.raises(SystemExit):
        cli.main(["--silver", "s", "health-check"])


def test_versions_are_partitions_and_old_layouts_stay_readable(spark):
    import json
    from hirelens.sources import sinks
    out = os.path.join(scratch_dir(), "snap")
    one, two = (spark.createDataFrame([("a", str(i)) for i in range(n)], "source string, job_key string") for n in (1, 2))
    first, second = sinks.write_snapshot(out, one, two, buckets=2), sinks.write_snapshot(out, two, one, buckets=2)
    assert [t.count() for t in sinks.read_snapshot(spark, out)] == [2, 1]
    plain = spark.read.parquet(os.path.join(out, "silver")).groupBy("version").count()
    assert {r["version"]: r["count"] for r in plain.collect()} == {first: 1, second: 2}
    old = os.path.join(scratch_dir(), "old")
    for name in sinks.SNAPSHOT_TABLES:
        os.renames(os.path.join(out, name, f"version={first}"), os.path.join(old, first, name))
    sinks._put(spark, os.path.join(old, sinks.POINTER), json.dumps({"version": first, "buckets": 2}))
    assert [t.count() for t in sinks.read_snapshot(spark, old)] == [1, 2]
