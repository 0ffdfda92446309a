"""What the card pages shuffle."""

from conftest import SF_SMALL
from hirelens.plans import derived
from hirelens.sources import tables
from pyspark.sql import functions as F


def test_pages_are_made_behind_their_only_shuffle(spark):
    """Failed before: rendered cards were collected, shuffled and spilled, in as many parts as a session has by default."""
    pages = derived.card_pages(spark, SF_SMALL)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange")
    assert "Exchange" not in below and "collect_list" in above and "collect_list" not in below
    assert "sensorsdata" not in below
    assert f", {2 * tables.bucket_count(spark, SF_SMALL)})" in below.splitlines()[0]
    bronze = tables.bronze(spark, SF_SMALL)
    assert pages.count() == bronze.select(derived._order()).distinct().count()
    assert pages.agg(F.sum(F.regexp_count("html", F.lit("sensorsdata=")))).first()[0] == bronze.count()
