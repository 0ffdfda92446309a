"""Trees over cells: the models of Spark ML on the same rows, and bootstraps that draw from all of them."""

import os

import numpy as np
import pytest
from conftest import SF_SMALL
from hirelens.operators import ml, trees
from hirelens.session import scratch_dir
from hirelens.sources import tables
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def counted(spark):
    """Rows of all kinds, and what training makes of them."""
    rng = np.random.default_rng(5)
    n = 3000
    pick = lambda values: [values[i] for i in rng.integers(0, len(values), n)]
    rows = [(f"k{i}", c, e, x, k, s, int(sc), float(y)) for i, (c, e, x, k, s, sc, y) in enumerate(zip(
        pick(["c1", "c2", "c3", "c4"]), pick(["e1", "e2"]), pick(["x1", "x2", "x3"]), pick(["k1", "k2"]),
        pick(["a", "b"]), rng.integers(0, 5, n), rng.integers(1, 40, n)))]
    frame = spark.createDataFrame(rows, "job_key string, city string, education string, experience string, keyword string, "
                                        "source string, skill_count int, salary_avg double")
    boost = F.when(F.col("city") == "c1", 9).otherwise(0) + F.col("skill_count") * F.when(F.col("keyword") == "k1", 3).otherwise(-1)
    frame = frame.withColumn(ml.LABEL, F.col(ml.LABEL) + boost)
    data = ml.fold_ids(ml.with_weights(frame), 3)
    enc = Pipeline(stages=ml.feature_stages()).fit(data)
    groups, few = ml._counted(data, enc, 42)
    return data.cache(), enc, groups.cache(), few.cache()


def _sums(groups, lay):
    got = groups.groupBy("cell").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias("y")).collect()
    n, y = np.zeros(lay.cells), np.zeros(lay.cells)
    for r in got:
        n[r.cell], y[r.cell] = r.n, r.y
    return n, y


def test_a_tree_and_boosting_are_those_of_spark(counted):
    data, enc, groups, few = counted
    lay = ml._layout(few)
    n, y = _sums(groups, lay)
    rows = enc.transform(data)
    tree = DecisionTreeRegressor(maxDepth=5, featuresCol="features", labelCol=ml.LABEL, weightCol="weight")
    sizes = ml.ModelSizes(gbt_iter=12)
    for spark_fit, mine in ((tree.fit(rows), trees.grow(lay, n, y, 5)[1]),
                            (ml.regressors(sizes)["gradient_boosting"].fit(rows),
                             trees.boost(lay, n, y, 12, sizes.gbt_depth, ml.GBT_STEP)[1])):
        want = {r.cell: r.prediction for r in spark_fit.transform(few).collect()}
        assert max(abs(mine[c] - p) for c, p in want.items()) < 1e-6


def test_grown_trees_are_spark_models_that_can_be_kept(spark, counted):
    data, enc, groups, few = counted
    lay, d = ml._layout(few), scratch_dir()
    sizes = ml.ModelSizes(rf_trees=7, rf_depth=6, gbt_iter=5)
    regs = ml.regressors(sizes)
    table = trees.fit_all(groups, lay, sizes, ml.GBT_STEP, 3, [-1, 0], ["random_forest", "gradient_boosting"], d)
    for name, count in (("random_forest", 7), ("gradient_boosting", 5)):
        model = trees.spark_model(table, name, regs[name], len(few.first().features), count, ml.GBT_STEP, d)
        want = {r.cell: r.v for r in table.where(f"model = '{name}' AND fit = -1 AND cell IS NOT NULL")
                .groupBy("cell").agg(F.sum("value").alias("v")).collect()}
        PipelineModel(stages=[enc, model]).write().save(os.path.join(d, name))
        again = PipelineModel.load(os.path.join(d, name))
        assert again.stages[-1].getNumTrees == count
        raw = few.select("cell", *ml.FEATURES)
        got = {r.cell: r.prediction for r in again.transform(raw).collect()}
        assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in got) < 1e-9


def test_bootstraps_draw_from_all_rows_whatever_their_order(spark, counted):
    """Failed before: a forest took ``forest_rows`` of the rows, and a tree's bootstrap held ``tree_rows`` of those."""
    data, enc, groups, few = counted
    sizes = ml.ModelSizes(rf_trees=40, rf_depth=2, forest_rows=300, tree_rows=100)
    one, two = (trees.fit_all(g, ml._layout(few), sizes, ml.GBT_STEP, 3, [-1], ["random_forest"], scratch_dir())
                .where("node IS NOT NULL") for g in (groups.checkpoint(), groups.repartition(7).checkpoint()))
    drawn = [r.raw for r in one.where("node = 0").collect()]
    assert len(drawn) == 40 and abs(np.mean(drawn) - 3000) < 5 * (3000 / 40) ** 0.5
    assert len(set(drawn)) > 20                     # every tree its own draws
    key = ["tree", "node", "raw", "left", "right", "feature", "threshold"]
    assert one.select(key).exceptAll(two.select(key)).count() == 0


def test_training_selects_from_all_rows(spark, monkeypatch):
    """Failed before: rows that a query trains on were cut to ``forest_rows`` for its forest."""
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    sizes = ml.ModelSizes(rf_trees=20, rf_depth=2, gbt_iter=2, forest_rows=200, tree_rows=100)
    res, test = ml.train_and_select(frame, sizes, k=2, models=["random_forest"])
    n = res.n_rows - test.count()
    roots = [t._call_java("rootNode").impurityStats().count() for t in res.model.stages[-1].trees]
    n_k = {r.experience: r["count"] for r in frame.groupBy("experience").count().collect()}
    assert frame.count() == res.n_rows
    # a row weighs 1 on average over all rows, so a bootstrap's weight is about the train split's rows
    assert len(n_k) > 1 and abs(np.mean(roots) - n) < n / 10


def test_draws_are_poisson():
    ids = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for mean in (1, 7, 5000):
        got = trees.poisson(trees.uniform(ids, 42, 3), np.full(len(ids), mean))
        assert abs(got.mean() - mean) < 5 * (mean / len(ids)) ** 0.5 and abs(got.var() / mean - 1) < 0.03
    mixed = np.resize([1, 7, 5000], len(ids))
    u = trees.uniform(ids, 42, 3)
    assert (trees.poisson(u, mixed)[1::3] == trees.poisson(u[1::3], mixed[1::3])).all()


def test_importance_is_the_drop_of_r2_over_single_permutations(spark):
    """Also of rows whose features are missing."""
    frame = ml.ml_frame(tables.silver(spark, SF_SMALL))
    res, test = ml.train_and_select(frame, ml.ModelSizes(rf_trees=2, rf_depth=4, gbt_iter=2), k=2, models=["random_forest"])
    test = test.withColumn("city", F.when(F.col("skill_count") >= 0, F.col("city"))).withColumn(
        "keyword", F.when(F.length("job_key") % 3 > 0, F.col("keyword"))).cache()
    y, p = F.col(ml.LABEL), F.col("prediction")

    def r2(rows):
        got = res.model.transform(rows).agg(F.sum((y - p) ** 2).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst")).first()
        return 1 - got.sse / got.sst

    drops = [max(sum(r2(test) - r2(ml.permuted(test, f, 7 + 100 * i + r)) for r in range(2)) / 2, 0.0)
             for i, f in enumerate(ml.FEATURES)]
    for buckets in (4, 1 << 8):
        got = {r.feature: r.importance for r in ml.permutation_importance(res.model, test, 2, 7, buckets=buckets).collect()}
        assert all(abs(got[f] - d / (sum(drops) or 1.0)) < 1e-9 for f, d in zip(ml.FEATURES, drops))
