"""Plans that must not repeat work per row."""

import re

import pytest

from hirelens.operators import inference


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("build", [inference.spearman_exp_salary, inference.spearman_matrix])
def test_ranks_read_the_rows_once_and_test_ranges_on_distinct_values(spark, build):
    rows = [("1-3年", "本科", "a,b", float(i % 7)) if i % 3 else ("5-10年", "大专", "a", float(i % 5)) for i in range(90)]
    silver = spark.createDataFrame(rows, "experience string, education string, tags string, salary_avg double")
    made = build(silver)
    # n_dropped alone reads the rows again; every rank table reads what is stored
    assert len(re.findall(r"LogicalRDD \[experience#\d+L?, education#\d+, tags", plan(made))) <= 1
    assert made.count() in (1, 16)


def test_a_landing_file_per_part_and_no_python_in_the_stream(spark):
    import datetime as dt
    import os
    from hirelens.session import scratch_dir
    from hirelens.streaming import ingest_stream
    base = scratch_dir()
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 9, "view", float(i), None) for i in range(50)]
    spark.createDataFrame(rows, ingest_stream.EVENT_SCHEMA).write.parquet(f"{base}/events.parquet")
    ingest_stream.land_events(spark, base, f"{base}/landing", parts=5)
    assert len([f for f in os.listdir(f"{base}/landing") if f.endswith(".parquet")]) == 5
    cards = ingest_stream.event_cards(spark.createDataFrame(rows, ingest_stream.EVENT_SCHEMA))
    assert "InPandas" not in plan(ingest_stream.first_writes(cards))


def test_references_are_matched_once(spark):
    from pyspark.sql import functions as F
    from hirelens.operators.extract import html_unescape
    texts = ["a&amp;lt;b", "&#38;lt;", "&amp;#38;", "&#x26;amp;&quot;", "&#xD800;&#0;", "&#12345678;&nbsp", "&lt;&#65;&gt;&"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(html_unescape(F.col("t")).alias("u"))
    assert [r.u for r in df.collect()] == ["a&lt;b", "&lt;", "&#38;", '&amp;"', "\ufffd\ufffd", "&#12345678;&nbsp", "<A>&"]
    assert plan(df).count("regexp_extract(") == 1


def test_spans_are_tested_once(spark):
    from pyspark.sql import functions as F
    from hirelens.operators.extract import classify_labels
    df = spark.createDataFrame([(["本科", "硕士 1-3年", " 20-30K ", None],)], "s array<string>")
    out = df.select(classify_labels(F.col("s")).alias("c"))
    assert plan(out).count("RLIKE") + plan(out).count("Contains") <= 3
    assert tuple(out.first().c) == ("本科", "20-30K", "硕士 1-3年")


def test_stored_rows_are_shuffled_once_and_lie_in_one_bucket_a_task(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from hirelens.sources import tables
    assert tables.buckets(spark, [("lineitem", 532 << 20, 0)]) == 128
    monkeypatch.setattr(tables, "_input_files", lambda *_: [])
    raw = spark.range(500).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("job_key"), F.col("id").alias("v"))
    made = []

    def build():
        made.append(raw.groupBy("source", "job_key").agg(F.min(F.struct("v")).alias("v")))
        return made[0]
    got = tables._stored(spark, str(tmp_path), "probe", build)
    files = [f.rsplit("_", 1)[1].split(".")[0] for f in got.inputFiles()]
    assert got.count() == 500 and len(files) == len(set(files)) <= 16       # one file of one task per bucket
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_sends_the_cuts_to_the_rows(spark):
    from hirelens.operators import ml
    rows = [("a" if i % 3 else None, f"k{i}", ["1-3年", "5-10年"][i % 2]) for i in range(200)]
    frame = spark.createDataFrame(rows, "source string, job_key string, experience string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as for tables beyond it
    try:
        split = ml.stratified_split(frame, buckets=16)
        assert "SortMergeJoin" not in executed(split)
        assert sorted((r.experience, r["count"]) for r in split.where("is_test").groupBy("experience").count().collect()) == [
            ("1-3年", 20), ("5-10年", 20)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reclean_joins_each_table_once(spark):
    from hirelens.operators import ingest
    silver = spark.createDataFrame([("a", "1", "x", "y", "t"), ("a", "2", "x", "y", "t"), ("a", None, "x", "y", None)],
                                   "source string, job_key string, experience string, education string, tags string")
    bronze = spark.createDataFrame([("a", "1", "1-3年", None, "Python dev", "old"), ("a", "3", None, None, "Python", "own"),
                                    ("a", None, "1-3年", "本科", "Python", None)],
                                   "source string, job_key string, experience string, education string, title string, tags string")
    s, b = ingest.reclean_apply(silver, bronze)
    assert [len(re.findall(r"\bJoin\b", plan(x))) for x in (s, b)] == [1, 1]
    assert s.columns == silver.columns and b.columns == bronze.columns
    assert {tuple(r) for r in s.collect()} == {
        ("a", "1", "1-3年", "y", "Python"), ("a", "2", "x", "y", "t"), ("a", None, "x", "y", None)}
    assert {(r.job_key, r.title, r.tags) for r in b.collect()} == {
        ("1", "Python dev", "Python"), ("3", "Python", "own"), (None, "Python", None)}


def test_a_batch_is_made_once_and_lies_in_the_buckets(spark):
    import __spark_entry__
    from conftest import SF_SMALL
    rows = __spark_entry__.queries()["insert_rows"](spark, SF_SMALL)
    assert "l_orderkey" not in plan(rows)                               # both halves read the stored batch
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in executed(__spark_entry__.queries()["insert_rows"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
