"""Stages of the corpus pipeline on documents whose extra columns clash, with nulls, repeated rows and none."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASH = ["score", "offending", "_id", "_text", "_hash", "_mid", "c0", "digest", "copies", "row", "id", "text_", "k0", "th"]


def documents(spark, n=60):
    d = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n)
    return d.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASH])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_column_names(spark, name, stage):
    d = documents(spark)
    odd = d.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    got = stage(spark, d.union(odd), SF)
    if name == "bpe":
        assert got.count() == 62
    else:
        assert got.columns == d.columns
        kept = got.where("doc_id IS NOT NULL").distinct().collect()
        assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in CLASH)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    assert stage(spark, documents(spark).limit(0), SF).collect() == []


@pytest.mark.parametrize("name", ["near_dedup", "mixing"])
def test_one_row_stands_for_equal_ones_and_always_the_same(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    d = spark.createDataFrame([(1, "some words of a text to keep", l, "s", 5) for l in ("de", "en", "fr", None)]
                              + [(2, "quite another one with other words", "en", "t", 6)],
                              "doc_id long, text string, lang string, source string, n_chars long")
    seen = {frozenset(stage(spark, d.repartition(n).orderBy(F.rand(n)), SF).select("doc_id", "lang").distinct().collect())
            for n in (1, 3, 5)}
    assert len(seen) == 1 and len({r.doc_id for r in next(iter(seen))}) == len(next(iter(seen)))
