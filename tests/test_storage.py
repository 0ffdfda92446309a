"""Stored tables follow their input through any file system; filters over the cleaning stay above it."""

import shutil

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hirelens.sources import tables


def test_changed_input_by_uri_is_read_again(spark, tmp_path):
    for name in tables.INPUTS:
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    uri = f"file://{tmp_path}"
    before = tables.silver(spark, uri).count()
    lines = pq.read_table(tmp_path / "lineitem.parquet")
    pq.write_table(lines.filter(pc.equal(lines["l_linenumber"], 1)), tmp_path / "lineitem.parquet")
    assert 0 < tables.silver(spark, uri).count() == tables.bronze(spark, uri).count() < before


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        tables.bronze(spark, f"file://{tmp_path}")


def test_buckets_grow_with_the_input(spark):
    assert tables.buckets(spark, [("lineitem", 1 << 20, 0)]) == 16
    assert tables.buckets(spark, [("lineitem", 100 * 10**12, 0)]) == 1 << 20
    spark.conf.set("spark.hirelens.buckets", "40")
    try:
        assert tables.buckets(spark, []) == 40
    finally:
        spark.conf.unset("spark.hirelens.buckets")


def test_filters_over_parsed_salaries(spark):
    from hirelens.functions.salary import with_salary
    df = spark.createDataFrame([("15-25K",), ("20-30万/年",), ("面议",), (None,)], "salary_text string")
    got = with_salary(df).where((F.col("salary_avg") > 20) | F.col("salary_max").isNull())
    assert sorted(r.salary_text or "" for r in got.collect()) == ["", "20-30万/年", "面议"]
