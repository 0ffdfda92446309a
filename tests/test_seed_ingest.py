"""S4 seed rows through the whole ingest path."""

from pyspark.sql import functions as F

from hirelens.operators import extract, ingest
from hirelens.sources.seed import seed_cards


def test_seed_ingest(spark):
    cards = seed_cards(spark)
    kept = extract.collector_filter(cards)          # drops the intern card (title / lptjob URL)
    assert kept.count() == 8
    keyed = ingest.keyed(kept)
    keys = {r.job_key for r in keyed.collect()}
    assert "5566" not in keys                        # official id is absent -> URL is the key
    assert "https://example.org/job/5566.shtml?ref=list" in keys
    empty_b = ingest.bronze_from_raw(ingest.with_defaults(cards.limit(0)))
    empty_s = ingest.silver_from_raw(cards.limit(0))
    b_new, s_new = ingest.ingest_batch(kept, empty_b, empty_s, order=())
    assert b_new.count() == 7 and s_new.count() == 7    # duplicate key A102 collapses
    s = {r.job_key: r for r in s_new.collect()}
    assert float(s["A100"].salary_avg) == 21.66
    assert s["C1"].source == "unknown" and s["C1"].education == "硕士"
    assert s["C1"].experience == "应届/不限"
    # running the same batch against what it produced adds nothing
    b2, s2 = ingest.ingest_batch(kept, b_new, s_new, order=())
    assert b2.count() == 0 and s2.count() == 0


def test_cleanup_apply_and_commit(spark):
    import os
    from hirelens.operators import quality
    from hirelens.session import scratch_dir
    d = scratch_dir()
    cards = seed_cards(spark)
    b = ingest.bronze_from_raw(ingest.dedupe_first(ingest.keyed(cards), order=()))
    s = ingest.silver_from_bronze(b)
    doomed = quality.doomed_outlier(s, 30.0)
    summary = {r.tbl: (r.deleted, r.kept) for r in
               quality.run_cleanup(s, b, doomed, apply=True, out=d).collect()}
    assert summary["job"] == summary["raw_job"]
    assert spark.read.parquet(os.path.join(d, "silver")).count() == summary["job"][1]
    assert spark.read.parquet(os.path.join(d, "bronze")).count() == summary["raw_job"][1]
    ingest.commit_batch(s, os.path.join(d, "t"), 0)
    ingest.commit_batch(s, os.path.join(d, "t"), 0)      # retry: same partition, no duplicates
    assert spark.read.parquet(os.path.join(d, "t")).count() == s.count()
    assert ingest.resalary_samples(s).count() == 0
