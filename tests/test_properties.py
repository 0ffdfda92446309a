"""Property checks over the small driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from hirelens.operators import extract, ingest, inference, skills, stats
from hirelens.sources import tables


def test_education_shares_sum_to_100(spark):
    s = tables.silver(spark, SF_SMALL)
    for r in stats.education_by_source(s).collect():
        total = sum(r[c] for _, c in stats.EDU_COLUMNS)
        assert abs(total - 100.0) < 1e-4


def test_edge_weight_bounded_by_node_frequency(spark):
    jobs = skills.postings_skills(tables.silver(spark, SF_SMALL))
    freq = {r.skill: r.n for r in skills.skill_counts(jobs).collect()}
    for e in skills.skill_edges(jobs, 25, 1).collect():
        assert e.weight <= min(freq[e.source], freq[e.target])
        assert e.source < e.target


def test_eta_in_unit_interval(spark):
    s = tables.silver(spark, SF_SMALL)
    for col in ("city", "education", "experience"):
        r = inference.anova(s, col, min_n=2).first()
        assert r.eta_sq is None or 0.0 <= r.eta_sq <= 1.0


def test_ingest_twice_adds_nothing(spark):
    raw = tables.postings_raw(spark, SF_SMALL)
    b, s = tables.bronze(spark, SF_SMALL), tables.silver(spark, SF_SMALL)
    r = ingest.insert_if_absent_counts(raw, b, s).first()
    assert r.new_bronze == 0 and r.new_silver == 0 and r.batch_rows == b.count()
    b_new, s_new = ingest.ingest_batch(raw, b, s)
    assert b_new.count() == 0 and s_new.count() == 0


def test_dedupe_first_write_wins(spark):
    rows = [("a", "k1", 2, 1, "late"), ("a", "k1", 1, 9, "early"), ("b", "k1", 5, 5, "only")]
    df = spark.createDataFrame(rows, "source string, job_key string, ord1 long, ord2 long, title string")
    got = {(r.source, r.job_key): r.title for r in ingest.dedupe_first(df).collect()}
    assert got == {("a", "k1"): "early", ("b", "k1"): "only"}


def test_worklist_counts(spark):
    raw = tables.postings_raw(spark, "/root/testdata/sf0.01").select("city", "keyword", "ord1")
    assert extract.worklist_remaining(raw, F.col("ord1") < 5).count() == 104


def test_stratified_split_exact(spark):
    from hirelens.operators import ml
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    split = ml.stratified_split(frame, buckets=16)
    got = {(r.experience, r.is_test): r.n for r in
           split.groupBy("experience", "is_test").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r.experience: r.n for r in frame.groupBy("experience").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for exp, n in sizes.items():
        assert got.get((exp, True), 0) == int(n * 0.2 + 0.5)
    # deterministic
    again = ml.stratified_split(frame, buckets=16).where("is_test").select("source", "job_key")
    assert again.exceptAll(split.where("is_test").select("source", "job_key")).count() == 0


def test_importance_shares(spark):
    from hirelens.operators import ml
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    res, test = ml.train_and_select(frame, ml.ModelSizes(rf_trees=3, rf_depth=3, gbt_iter=3),
                                    k=2, models=["linear", "random_forest"])
    assert res.best in ("linear", "random_forest")
    imp = ml.permutation_importance(res.model, test, repeats=2)
    vals = [r.importance for r in imp.collect()]
    assert all(v >= 0 for v in vals)
    assert abs(sum(vals) - 1.0) < 1e-9 or sum(vals) == 0.0


def test_matrix_has_its_empty_cells(spark):
    s = spark.createDataFrame([("a", "k1", 1.0), ("b", "k2", 2.0)], "source string, keyword string, salary_avg double")
    got = {(r.source, r.keyword): (r.avg_salary, r.n) for r in stats.salary_by_source_keyword(s, ["k1", "k2"]).collect()}
    assert got == {("a", "k1"): (1.0, 1), ("a", "k2"): (None, 0), ("b", "k1"): (None, 0), ("b", "k2"): (2.0, 1)}


def test_first_write_needs_its_order(spark):
    import pytest
    with pytest.raises(ValueError):
        ingest.dedupe_first(spark.createDataFrame([("a", "1", "x")], "source string, job_key string, title string"))
