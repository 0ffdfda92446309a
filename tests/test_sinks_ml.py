"""S11 CSV export, M9/M11 training job persistence."""

import glob
import os

from conftest import SF_SMALL
from hirelens.operators import ml
from hirelens.session import scratch_dir
from hirelens.sources import sinks, tables


def test_export_csv_headers(spark):
    out = os.path.join(scratch_dir(), "export")
    sinks.export_csv(tables.silver(spark, SF_SMALL), out)
    files = glob.glob(os.path.join(out, "part-*.csv"))
    assert files
    with open(files[0], encoding="utf-8") as f:
        header = f.readline().strip().split(",")
    assert header[0] == "来源" and header[-1] == "技能标签" and len(header) == 12


def test_train_job_persists_model_and_report(spark):
    d = scratch_dir()
    assert ml.model_report(spark, os.path.join(d, "none")) == {"trained": False}
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    rep = ml.train(frame, d, [f"NATION_{i}" for i in range(20)],
                   ml.ModelSizes(rf_trees=3, rf_depth=3, gbt_iter=3))
    assert rep["best_model"] in ("linear", "random_forest", "gradient_boosting")
    assert ml.model_report(spark, d)["n_samples"] == rep["n_samples"]
    m = ml.load_model(d)
    assert m.transform(frame.limit(5)).count() == 5


def test_json_text_sinks_and_display_round(spark):
    from pyspark.sql import functions as F
    d = scratch_dir()
    df = spark.createDataFrame([("a", 1.23456, 2.5), ("b", 0.04999, 7.25)], "k string, x double, y double")
    sinks.write_json(df, os.path.join(d, "j"))
    back = {r.k: r.x for r in spark.read.json(os.path.join(d, "j")).collect()}
    assert back == {"a": 1.23456, "b": 0.04999}
    sinks.write_text(df.select(F.concat_ws("|", "k", "x").alias("value")), os.path.join(d, "t"))
    assert sorted(r.value for r in spark.read.text(os.path.join(d, "t")).collect()) == \
        ["a|1.23456", "b|0.04999"]
    shown = {r.k: (r.x, r.y) for r in sinks.display_round(df, {"x": 1, "y": 1}).collect()}
    assert shown == {"a": (1.2, 2.5), "b": (0.0, 7.3)}


def test_experience_tiers_source_filter(spark):
    from hirelens.operators import stats
    s = tables.silver(spark, SF_SMALL)
    all_rows = {r.tier: r.n for r in stats.experience_tiers(s).collect()}
    a = {r.tier: r.n for r in stats.experience_tiers(s, "site_a").collect()}
    b = {r.tier: r.n for r in stats.experience_tiers(s, "site_b").collect()}
    assert {t: a.get(t, 0) + b.get(t, 0) for t in all_rows} == all_rows
    pct = sum(r.pct for r in stats.experience_tiers(s, "site_a").collect())
    assert abs(pct - 100.0) < 1e-4


def test_registered_models_have_full_size():
    from hirelens.plans import catalog
    s = catalog.MODEL_SIZES
    assert (s.rf_trees, s.rf_depth, s.gbt_iter, s.gbt_depth) == (200, 12, 200, 3)
    found = ml.regressors(s, 1000)
    assert found["random_forest"].getSubsamplingRate() == 1.0       # every tree draws as many rows as there are


SMALL = ml.ModelSizes(rf_trees=3, rf_depth=3, gbt_iter=3)


def test_models_are_trained_once_and_published_by_the_report(spark, monkeypatch):
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    d = os.path.join(scratch_dir(), "models")
    res, test = ml.selected(frame, d, SMALL)
    import shutil
    monkeypatch.setattr(ml, "train_and_select", lambda *a, **k: 1 / 0)
    again, same = ml.selected(frame, d, SMALL)          # as another session would find it
    assert (again.scores, again.best, again.n_rows) == (res.scores, res.best, res.n_rows)
    assert same.count() == test.count() and same.columns == frame.columns
    rows = frame.limit(20)
    want = [r.prediction for r in res.model.transform(rows).orderBy("job_key").collect()]
    assert [r.prediction for r in again.model.transform(rows).orderBy("job_key").collect()] == want
    shutil.rmtree(os.path.join(d, "report"))            # a training that died before its report
    import pytest
    with pytest.raises(ZeroDivisionError):
        ml.selected(frame, d, SMALL)


def test_cells_fit_the_same_models_as_rows(spark):
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F
    rows = ml.with_weights(ml.ml_frame(tables.silver(spark, SF_SMALL))).withColumn("city", F.lit("c"))
    few = ml.cells(rows, [])
    assert few.count() < rows.count() / 3 and few.agg(F.sum("n")).first()[0] == rows.count()
    enc = Pipeline(stages=ml.feature_stages()).fit(rows)
    for name in ml.ON_CELLS:
        reg = ml.regressors(ml.ModelSizes(gbt_iter=8))[name]
        a, b = reg.fit(enc.transform(rows)), reg.fit(enc.transform(few))
        both = b.transform(a.transform(enc.transform(rows)).withColumnRenamed("prediction", "p"))
        assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-6, name
    # the sums over cells give the scores of the rows
    pred = a.transform(enc.transform(rows))
    y, p = F.col(ml.LABEL), F.col("prediction")
    plain = pred.agg(F.sum((y - p) ** 2).alias("sse"), F.var_pop(y).alias("v"), F.count("*").alias("n")).first()
    by_cell = ml._r2_by(a.transform(enc.transform(few)).withColumn("k", F.lit(1)), "k")[1]
    assert abs(by_cell - (1 - plain.sse / (plain.v * plain.n))) < 1e-9


def test_forest_sample_is_bounded_and_stable(spark):
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    n = frame.count()
    assert ml.forest_sample(frame, n, ml.ModelSizes()).count() == n
    some = ml.forest_sample(frame, n, ml.ModelSizes(forest_rows=n // 4))
    assert abs(some.count() - n / 4) < n / 16
    keys = {tuple(r) for r in some.select("source", "job_key").collect()}
    assert keys == {tuple(r) for r in ml.forest_sample(frame.repartition(5), n, ml.ModelSizes(forest_rows=n // 4))
                    .select("source", "job_key").collect()}


def test_forest_grows_in_parts_over_all_its_rows(spark):
    import threading
    from pyspark.ml import PipelineModel
    from pyspark.ml.linalg import Vectors
    sizes = ml.ModelSizes(rf_trees=7, rf_depth=3, part_trees=3, part_rows=50, tree_rows=100)
    assert ml.forest_parts(sizes, 400) == [3, 2, 2] and ml.forest_parts(sizes, 99) == [7]
    assert sum(ml.forest_parts(ml.ModelSizes(), 1 << 17)) == 200
    rows = [(Vectors.dense([float(i % 4), float(i % 3)]), float(i % 4), 1.0, i) for i in range(400)]
    df = spark.createDataFrame(rows, ["features", ml.LABEL, "weight", "deal"])
    model = ml.fit_forest(df, sizes, 400, threading.Semaphore(2))
    parts = model.stages[:-1]
    assert [p.getNumTrees for p in parts] == [3, 2, 2]
    out = model.transform(df)
    assert out.columns == [*df.columns, "prediction"]
    row = out.first()
    want = sum(p.predict(row.features) * p.getNumTrees for p in parts) / 7
    assert abs(row.prediction - want) < 1e-9
    d = os.path.join(scratch_dir(), "forest")
    model.write().save(d)
    again = PipelineModel.load(d).transform(df).first()
    assert abs(again.prediction - want) < 1e-9


def test_permuted_copies_are_the_single_permutations(spark):
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    both = ml.permuted_copies(frame, "city", [5, 9])
    for r, seed in enumerate([5, 9]):
        one = ml.permuted(frame, "city", seed)
        got = both.where(both["__rep"] == r).drop("__rep")
        assert got.exceptAll(one).count() == 0 and one.count() == got.count() == frame.count()
    assert both.where("__rep = 0").drop("__rep").exceptAll(both.where("__rep = 1").drop("__rep")).count() > 0


def test_too_few_rows_raise(spark):
    import pytest
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL)).limit(49)
    with pytest.raises(RuntimeError):
        ml.require_rows(frame)
    assert ml.require_rows(frame.union(frame)) == 98
