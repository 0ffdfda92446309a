"""Salary regression with Spark ML.

* class weights and split cuts come from small per-class / per-bucket tables; rows are
  compared with them, never windowed over a whole class, and whether such a table is
  broadcast is left to adaptive execution;
* the split is exact per stratum and deterministic: rows are ordered by a
  seeded key hash inside their stratum, found through hash-bucket counts;
* rows equal in all features are one weighted **cell** (weight, mean and squared deviation of the
  label). Least squares, trees and squared-loss boosting depend on nothing else, so
  they are fitted on cells, whose number is bounded by the combinations of the categories; forests draw
  the bootstrap of each tree from all rows, counted by cell and label. A fitted model predicts every cell once, and
  scores and importances are sums over cells;
* the fits (folds x models, some trees of a forest at a time) are independent jobs over stored tables and run side by side;
* permutation importance rotates a column by one row in a seeded random order of all
  test rows, found side by side in hash ranges.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import partial, reduce
from math import prod

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.tags import skill_count
from hirelens.operators import trees
from hirelens.operators.trees import side_by_side

KEYS = ["source", "job_key"]
LABEL = "salary_avg"
GBT_STEP = 0.1


# M1 ---------------------------------------------------------------------------
def ml_frame(silver: DataFrame) -> DataFrame:
    """Rows with salary and the four categorical fields; source null -> unknown."""
    need = [F.col(c).isNotNull() for c in ("salary_avg", "city", "education", "experience", "keyword")]
    cond = need[0]
    for c in need[1:]:
        cond = cond & c
    return silver.where(cond).select(
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"), "job_key",
        "city", "education", "experience", "keyword",
        skill_count(F.col("tags")).alias("skill_count"),
        F.col("salary_avg").cast("double").alias(LABEL))


# M2 ---------------------------------------------------------------------------
def class_weights(frame: DataFrame, col: str = "experience") -> DataFrame:
    """Per class: n_k and weight N / (K * n_k) (mean weight over rows is 1 by construction)."""
    counts = frame.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()           # over the K class rows only
    w = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select(col, "n", F.round(w, 6).alias("weight"))


def with_weights(frame: DataFrame, col: str = "experience") -> DataFrame:
    counts = frame.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy()
    w = counts.select(col, (F.sum("__n").over(everything)
                            / (F.count(F.lit(1)).over(everything) * F.col("__n"))).alias("weight"))
    return frame.join(w, col, "inner")


# M3 ---------------------------------------------------------------------------
def require_rows(frame: DataFrame, minimum: int = 50) -> int:
    n = frame.count()
    if n < minimum:
        raise RuntimeError(f"too few training rows ({n}); collect more data first")
    return n


# M4 ---------------------------------------------------------------------------
def _hash(seed: int):
    return F.xxhash64(*[F.col(k) for k in KEYS], F.lit(seed))


def stratified_split(frame: DataFrame, strata: str = "experience", test_frac: float = 0.2,
                     seed: int = 42, buckets: int = 1 << 16) -> DataFrame:
    """Add ``is_test``: exactly round(test_frac * n_k) rows of each stratum, chosen by
    the smallest seeded key hashes.

    The last chosen row of each stratum is located from (stratum, hash-bucket) counts
    (a table bounded by strata x buckets); only the rows of that one bucket are ranked.
    Every row then compares itself with the cut of its stratum: no join on the keys. Buckets and
    cuts are a row per stratum, so they are sent to the rows; shuffled by stratum, all rows
    would meet in as many tasks as there are strata.
    """
    rows = frame.withColumn("__h", _hash(seed))
    rows = rows.withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    # order inside a stratum: (bucket, hash, keys) -- bucket first so cuts are bucket ranges
    counts = rows.groupBy(strata, "__b").agg(F.count(F.lit(1)).alias("__c"))
    stratum = Window.partitionBy(strata)
    upto = F.sum("__c").over(stratum.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    cum = counts.select(strata, "__b", (upto - F.col("__c")).alias("__before"), upto.alias("__upto"),
                        F.floor(F.sum("__c").over(stratum) * F.lit(test_frac) + F.lit(0.5)).alias("__k"))
    last = cum.where((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__upto"))).select(
        strata, "__b", (F.col("__k") - F.col("__before")).alias("__take"))
    rank = F.row_number().over(stratum.orderBy("__h", *KEYS))
    place = ["__b", "__h", *KEYS]
    cuts = (rows.join(F.broadcast(last), [strata, "__b"]).withColumn("__r", rank)
            .where(F.col("__r") == F.col("__take"))
            .select(strata, F.struct(*place).alias("__cut")))
    chosen = F.coalesce(F.struct(*place) <= F.col("__cut"), F.lit(False))
    return rows.join(F.broadcast(cuts), strata, "left").select(*frame.columns, chosen.alias("is_test"))


def fold_ids(frame: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled k-fold assignment by seeded key hash (stable across partitionings)."""
    return frame.withColumn("fold", F.pmod(_hash(seed + 1), F.lit(k)).cast("int"))


# M5 / M6 ----------------------------------------------------------------------
FEATURES = dims.CAT_FEATURES + dims.NUM_FEATURES


def feature_stages():
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep")
           for c in dims.CAT_FEATURES]
    ohe = OneHotEncoder(inputCols=[f"{c}_ix" for c in dims.CAT_FEATURES],
                        outputCols=[f"{c}_oh" for c in dims.CAT_FEATURES],
                        dropLast=True, handleInvalid="keep")
    asm = VectorAssembler(inputCols=[f"{c}_oh" for c in dims.CAT_FEATURES] + dims.NUM_FEATURES,
                          outputCol="features")
    return idx + [ohe, asm]


@dataclass
class ModelSizes:
    rf_trees: int = 200
    rf_depth: int = 12
    gbt_iter: int = 200
    gbt_depth: int = 3
    seed: int = 42
    forest_rows: int = 1 << 17      # of forest_sample alone; training takes all rows
    tree_rows: int = 1 << 15        # of fit_forest and of regressors that are told their rows, not of training
    task_rows: int = 1 << 16        # rows per task of a linear fit
    part_trees: int = 50            # of fit_forest alone, as part_rows
    part_rows: int = 1 << 13
    tree_memory_mb: int = 128       # for the node statistics of one pass of a fit by Spark ML
    parallel: int = 6               # linear fits that run side by side at most


def regressors(sizes: ModelSizes, rows: int = 0) -> dict:
    """The three models; ``rows``, if given, makes a forest of Spark ML draw ``tree_rows`` of them per tree."""
    common = dict(featuresCol="features", labelCol=LABEL, weightCol="weight")
    trees = dict(maxMemoryInMB=sizes.tree_memory_mb, seed=sizes.seed)
    return {
        "linear": LinearRegression(**common),
        "random_forest": RandomForestRegressor(numTrees=sizes.rf_trees, maxDepth=sizes.rf_depth,
                                               featureSubsetStrategy="all", cacheNodeIds=True,
                                               subsamplingRate=min(1.0, sizes.tree_rows / max(rows, 1)),
                                               **trees, **common),
        "gradient_boosting": GBTRegressor(maxIter=sizes.gbt_iter, maxDepth=sizes.gbt_depth,
                                          stepSize=GBT_STEP, cacheNodeIds=False, **trees, **common),
    }


def _packed(df: DataFrame, sizes: ModelSizes) -> DataFrame:
    """``df`` stored, in as many partitions as its rows need."""
    df = df.checkpoint(eager=True)
    return df.coalesce(max(1, -(-df.count() // sizes.task_rows)))


#: Models whose fit depends on cells alone.
ON_CELLS = ("linear", "gradient_boosting")


def cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows equal in all features and ``by`` as one: ``n``, the sum of their weights, mean label, squared deviation.

    The weight is a function of a feature, so every row of a cell has the same.
    """
    return rows.groupBy(*FEATURES, *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.avg(LABEL).alias(LABEL),
        (F.var_pop(LABEL) * F.count(F.lit(1))).alias("m2"))


def _r2_by(pred: DataFrame, by: str) -> dict:
    """Unweighted R^2 per value of ``by`` of cells with n, mean label, m2 and prediction."""
    y, p, n = F.col(LABEL), F.col("prediction"), F.col("n")
    whole = Window.partitionBy()                # over the values of ``by`` only
    parts = pred.groupBy(by).agg(F.sum(F.col("m2") + n * (y - p) ** 2).alias("sse"), F.sum("n").alias("n"),
                                 F.sum(n * y).alias("s"))
    spread = pred.join(parts.select(by, (F.col("s") / F.col("n")).alias("__mean")), by).groupBy(by).agg(
        F.sum(F.col("m2") + n * (y - F.col("__mean")) ** 2).alias("sst"))
    rows = parts.join(spread, by).select(by, "sse", "sst", F.count(F.lit(1)).over(whole)).collect()
    return {r[by]: 1.0 - r.sse / r.sst if r.sst else 0.0 for r in rows}


# M7 ---------------------------------------------------------------------------
@dataclass
class TrainResult:
    scores: list = field(default_factory=list)
    best: str | None = None
    model: PipelineModel | None = None
    n_rows: int = 0


def _counted(data: DataFrame, enc: PipelineModel, seed: int) -> tuple[DataFrame, DataFrame]:
    """``data`` (features, weight, label, fold; -1 is the test split) as groups and cells, both stored.

    Cells: the combinations of features, numbered, encoded, with the weight of their rows and whether the train
    split has them. Groups: rows equal in cell, fold and label, counted, with a hash of their own.
    """
    alike = data.groupBy(*FEATURES, "fold", F.col(LABEL).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).checkpoint(eager=True)
    combos = alike.groupBy(*FEATURES).agg(F.max("weight").alias("weight"), F.max(F.col("fold") >= 0).alias("known"))
    number = F.row_number().over(Window.orderBy(*FEATURES)) - 1     # of combinations of categories, not of rows
    few = enc.transform(combos.withColumn("cell", number)).checkpoint(eager=True)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in FEATURES])
    groups = alike.alias("a").join(few.alias("c"), same).select(
        "c.cell", "a.fold", "a.label", "a.n",
        F.xxhash64(*[F.col(f"a.{c}") for c in FEATURES], "a.fold", "a.label", F.lit(seed + 3)).alias("id"))
    return groups.checkpoint(eager=True), few


def _layout(few: DataFrame) -> trees.Layout:
    """The cells' encoded columns on the driver: a few numbers per combination of categories."""
    got = few.select("cell", "weight", "known", *[f"{c}_ix" for c in dims.CAT_FEATURES], *dims.NUM_FEATURES).toArrow()
    col = {name: got.column(name).to_numpy()[got.column("cell").to_numpy().argsort()] for name in got.column_names}
    # a category takes a slot, and one more is kept for those that training has not seen
    sizes = [few.schema[f"{c}_oh"].metadata["ml_attr"]["num_attrs"] for c in dims.CAT_FEATURES]
    return trees.layout([col[f"{c}_ix"].astype(int) for c in dims.CAT_FEATURES], sizes,
                        [col[c].astype(float) for c in dims.NUM_FEATURES], col["known"], col["weight"])


def _linear_input(groups: DataFrame, few: DataFrame) -> DataFrame:
    """Encoded cells of the train split per fold: rows, their mean label and the sum of their weights."""
    per = groups.groupBy("cell", "fold").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias(LABEL))
    return per.join(few, "cell").select("features", LABEL, "fold", (F.col("n") * F.col("weight")).alias("weight"))


def _fits(groups: DataFrame, few: DataFrame, sizes: ModelSizes, k: int, fits: list[int],
          wanted: dict, folder: str) -> tuple[DataFrame, dict]:
    """Predictions (model, fit, cell, value) of every fit of the ``wanted`` models, and per model what makes its fit -1."""
    spark = groups.sparkSession
    train = groups.where(F.col("fold") >= 0)
    lay = _layout(few)

    def grown():
        names = [name for name in wanted if name != "linear"]
        return trees.fit_all(train, lay, sizes, GBT_STEP, k, fits, names, folder) if names else None

    def lines():
        if "linear" not in wanted:
            return []
        source = _packed(_linear_input(train, few), sizes)
        return side_by_side(spark, [partial(wanted["linear"].copy().fit, source.where(F.col("fold") != f)) for f in fits],
                            sizes.parallel)

    table, linear = side_by_side(spark, [grown, lines], 2)
    size = len(few.select("features").first()[0])
    made, parts = {}, []
    if table is not None:
        parts.append(table.where(F.col("cell").isNotNull()).groupBy("model", "fit", "cell").agg(F.sum("value").alias("value")))
        for name, count in (("random_forest", sizes.rf_trees), ("gradient_boosting", sizes.gbt_iter)):
            if name in wanted:
                made[name] = partial(trees.spark_model, table, name, wanted[name], size, count, GBT_STEP, folder)
    for f, model in zip(fits, linear):
        parts.append(model.transform(few).select(F.lit("linear").alias("model"), F.lit(f).alias("fit"), "cell",
                                                 F.col("prediction").alias("value")))
        if f < 0:
            made["linear"] = partial(lambda m: m, model)
    return reduce(DataFrame.union, parts), made


def train_and_select(frame: DataFrame, sizes: ModelSizes | None = None, k: int = 5,
                     seed: int = 42, models: list[str] | None = None) -> tuple[TrainResult, DataFrame]:
    """Weighted fit, unweighted R^2: k-fold CV on the train split, test R^2/MAE.

    Every model learns from all rows of the train split (but for the fold left out), counted by features, fold and
    label. The categorical encoders are fitted once on the train split; the forests' trees, the boosted
    series and the linear fits are made side by side.
    Returns the result (best = highest mean CV R^2, first wins ties; its model is a
    PipelineModel over raw columns) and the raw test split.
    """
    from hirelens.session import work_path
    folder = work_path(frame.sparkSession, "models", "parts")     # reliable checkpoints go to the shared folder, too
    sizes = sizes or ModelSizes(seed=seed)
    data = fold_ids(stratified_split(with_weights(frame), seed=seed), k, seed)
    data = data.checkpoint(eager=True)       # cut lineage: encoders, groups and the test split read this frame
    enc = Pipeline(stages=feature_stages()).fit(data.where(~F.col("is_test")))
    placed = data.withColumn("fold", F.when(F.col("is_test"), -1).otherwise(F.col("fold")))
    groups, few = _counted(placed, enc, seed)
    wanted = {name: reg for name, reg in regressors(sizes).items() if not models or name in models}
    predicted, made = _fits(groups, few, sizes, k, [-1, *range(k)], wanted, folder)

    # a fit is judged on the rows that it has not seen: fit -1 on the test split, which is "fold" -1
    judged = groups.join(predicted.withColumnRenamed("fit", "fold"), ["cell", "fold"]).select(
        F.concat_ws(":", "model", "fold").alias("by"), "n", F.col("label").alias(LABEL), F.lit(0.0).alias("m2"),
        F.col("value").alias("prediction")).checkpoint(eager=True)
    r2 = _r2_by(judged, "by")
    off = F.sum(F.col("n") * F.abs(F.col(LABEL) - F.col("prediction"))) / F.sum("n")
    mae = {r["by"]: r["mae"] for r in judged.where(F.col("by").endswith(":-1")).groupBy("by").agg(off.alias("mae")).collect()}
    res = TrainResult(n_rows=groups.agg(F.sum("n")).first()[0])
    best_r2 = float("-inf")
    for name in wanted:
        cv_mean = sum(r2.get(f"{name}:{f}", 0.0) for f in range(k)) / k
        res.scores.append({"model": name, "cv_r2": cv_mean, "test_r2": r2.get(f"{name}:-1", 0.0),
                           "test_mae": float(mae.get(f"{name}:-1") or 0.0)})
        if cv_mean > best_r2:
            best_r2, res.best = cv_mean, name
    res.model = PipelineModel(stages=[enc, made[res.best]()])
    return res, data.where(F.col("is_test"))


def refit_best(frame: DataFrame, best: str, sizes: ModelSizes | None = None,
               seed: int = 42) -> PipelineModel:
    """M9: refit the chosen model on all rows (weighted)."""
    from hirelens.session import work_path
    folder = work_path(frame.sparkSession, "models", "parts")
    sizes = sizes or ModelSizes(seed=seed)
    rows = with_weights(frame).withColumn("fold", F.lit(0))
    enc = Pipeline(stages=feature_stages()).fit(rows)
    groups, few = _counted(rows, enc, seed)
    _, made = _fits(groups, few, sizes, 1, [-1], {best: regressors(sizes)[best]}, folder)
    return PipelineModel(stages=[enc, made[best]()])


# M8 ---------------------------------------------------------------------------
def permuted(test: DataFrame, col: str, seed: int, buckets: int = 1 << 12) -> DataFrame:
    """``test`` with ``col`` rotated by one row in a seeded random order of all rows.

    The order is that of an unsigned 64-bit key hash. Its leading bits deal the rows
    into ``buckets`` (a power of two) that are ordered side by side; the first row of a
    bucket takes the last value of the bucket before, from a table of one row per
    bucket. The permutation is the same for every number of buckets and rows per task.
    """
    return permuted_copies(test, col, [seed], buckets).drop("__rep")


def permuted_copies(test: DataFrame, col: str, seeds: list[int], buckets: int = 1 << 12) -> DataFrame:
    """``permuted`` for each of the ``seeds`` in one pass; ``__rep`` is the seed's place in the list."""
    drawn = F.array(*[F.struct(F.lit(r).alias("rep"), F.lit(s * 7919 + 1).alias("salt")) for r, s in enumerate(seeds)])
    base = test.select("*", F.explode(drawn).alias("__d")).withColumn("__rep", F.col("__d.rep"))
    base = base.withColumn("__o", F.xxhash64(*[F.col(c) for c in KEYS], F.col("__d.salt"))).drop("__d")
    return rotated(base, col, KEYS, buckets).withColumn(col, F.col("__turned")).select(*test.columns, "__rep")


def rotated(base: DataFrame, value: str, ties: list[str], buckets: int) -> DataFrame:
    """Per ``__rep`` the ``value`` of the row before, as ``__turned``, in the order of the unsigned ``__o`` and ``ties``."""
    bits = buckets.bit_length() - 1
    base = base.withColumn("__blk", F.shiftrightunsigned("__o", 64 - bits))
    place = ["__rep", "__blk"]
    w = Window.partitionBy(*place).orderBy("__o", *ties)
    ends = base.groupBy(*place).agg(F.max_by(value, F.struct("__o", *ties)).alias("__end"))
    chain = Window.partitionBy("__rep").orderBy("__blk")        # at most ``buckets`` rows a copy
    before = F.when(F.row_number().over(chain) == 1,
                    F.max_by("__end", "__blk").over(Window.partitionBy("__rep")))
    ends = ends.select(*place, before.otherwise(F.lag("__end").over(chain)).alias("__prev"))
    turned = (base.withColumn("__lag", F.lag(value, 1).over(w))
              .withColumn("__first", F.row_number().over(w) == 1).join(ends, place))
    return turned.withColumn("__turned", F.when(F.col("__first"), F.col("__prev")).otherwise(F.col("__lag")))


def permutation_importance(model: PipelineModel, test: DataFrame, repeats: int = 10,
                           seed: int = 42, buckets: int = 1 << 8) -> DataFrame:
    """Mean R^2 drop per raw feature, clipped at 0 and normalised to shares.

    A row's features are one number, with a digit per feature. The permuted copies for all features are made in one
    pass, in which a row is that number, its label and a digit; they are summed up to cells, and the model predicts
    each distinct feature combination of them once.
    """
    spark = test.sparkSession
    # the categories, on the driver as the options of the model report are; 0 stands for a missing one
    seen = test.agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in FEATURES]).first().asDict()
    lists = {f: F.array(*[F.lit(v) for v in seen[f]]).cast(f"array<{test.schema[f].dataType.simpleString()}>") for f in FEATURES}
    sizes = [len(seen[f]) + 1 for f in FEATURES]
    unit = [prod(sizes[i + 1:]) for i in range(len(FEATURES))]

    def digit(i: int):
        return F.expr(f"(__cell div {unit[i]}) % {sizes[i]}")

    number = reduce(lambda a, b: a + b, [F.coalesce(F.array_position(lists[f], F.col(f)), F.lit(0)) * F.lit(unit[i])
                                         for i, f in enumerate(FEATURES)])
    rows = test.select(*KEYS, number.alias("__cell"), LABEL)
    digits = F.array(*[digit(i) for i in range(len(FEATURES))])
    copies = [(i * repeats + r, i, (seed + 100 * i + r) * 7919 + 1) for i in range(len(FEATURES)) for r in range(repeats)]
    drawn = F.array(*[F.struct(F.lit(c).alias("rep"), F.lit(i).alias("i"), F.lit(salt).alias("salt")) for c, i, salt in copies])
    base = rows.select("*", F.explode(drawn).alias("__d")).select(
        F.col("__d.rep").alias("__rep"), F.col("__d.i").alias("__i"), "__cell", LABEL,
        F.xxhash64(*[F.col(c) for c in KEYS], F.col("__d.salt")).alias("__o"), digits[F.col("__d.i")].alias("__digit"))
    # rows equal in hash, cell and label may change places
    moved = rotated(base, "__digit", ["__cell", LABEL], buckets)
    units = F.array(*[F.lit(u).cast("long") for u in unit])
    moved = moved.select("__rep", (F.col("__cell") + (F.col("__turned") - F.col("__digit")) * units[F.col("__i")]).alias("__cell"), LABEL)
    per = moved.unionByName(rows.select(F.lit(-1).alias("__rep"), "__cell", LABEL)).groupBy("__rep", "__cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias(LABEL), (F.var_pop(LABEL) * F.count(F.lit(1))).alias("m2"))
    per = per.checkpoint(eager=True)
    combos = per.select("__cell").distinct().select(
        "__cell", *[F.when(digit(i) > 0, F.get(lists[f], (digit(i) - 1).cast("int"))).alias(f)
                    for i, f in enumerate(FEATURES)])
    known = model.transform(combos).select("__cell", "prediction")
    r2 = _r2_by(per.join(known, "__cell"), "__rep")
    drops = [max(sum(r2[-1] - r2[i * repeats + r] for r in range(repeats)) / repeats, 0.0) if r2 else 0.0
             for i in range(len(FEATURES))]
    total = sum(drops) or 1.0
    out = [(f, dims.FEATURE_LABELS[f], v / total) for f, v in zip(FEATURES, drops)]
    return spark.createDataFrame(out, "feature string, label string, importance double")


# M10 --------------------------------------------------------------------------
def validate_requests(requests: DataFrame, options: DataFrame) -> DataFrame:
    """The four categorical inputs must be non-blank and seen in training.

    ``options`` is the (feature, value) table of A19; ``reason`` is null for valid rows.
    """
    req = requests
    for c in ("source",):
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast("string"))
    if "skill_count" not in req.columns:
        req = req.withColumn("skill_count", F.lit(None).cast("int"))
    reason = F.lit(None).cast("string")
    for c in ("city", "education", "experience", "keyword"):
        opt = options.where(F.col("feature") == c).select(F.col("value").alias(c),
                                                          F.lit(True).alias(f"__ok_{c}"))
        req = req.join(opt, c, "left")          # option lists are data-driven: AQE decides
        blank = F.col(c).isNull() | (F.trim(F.col(c)) == "")
        reason = (F.when(reason.isNotNull(), reason)
                  .when(blank, F.lit(f"{c} is blank"))
                  .when(F.col(f"__ok_{c}").isNull(), F.lit(f"{c} not in options")))
    return req.withColumn("reason", reason).drop(*[f"__ok_{c}" for c in
                                                   ("city", "education", "experience", "keyword")])


def with_defaults(requests: DataFrame, default_source: str, default_skills: int = 2) -> DataFrame:
    """Requests with the source and the skill count that they leave open."""
    return (requests.withColumn("source", F.coalesce(F.col("source"), F.lit(default_source)))
            .withColumn("skill_count", F.coalesce(F.col("skill_count"), F.lit(default_skills))))


def score_batch(model: PipelineModel, requests: DataFrame, options: DataFrame,
                default_source: str, default_skills: int = 2) -> DataFrame:
    """Validate, fill defaults, predict, clip at 0, round to 1 dp."""
    v = with_defaults(validate_requests(requests, options), default_source, default_skills)
    ok = v.where(F.col("reason").isNull()).withColumn(LABEL, F.lit(0.0))
    pred = model.transform(ok).select(
        *[c for c in v.columns if c != "reason"],
        F.round(F.greatest(F.col("prediction"), F.lit(0.0)), 1).alias("predicted_salary"))
    bad = v.where(F.col("reason").isNotNull())
    return pred.unionByName(bad.withColumn("predicted_salary", F.lit(None).cast("double")),
                            allowMissingColumns=True)


# M9 / M11 -----------------------------------------------------------------------
def train(frame: DataFrame, model_dir: str, cities: list[str], sizes: ModelSizes | None = None,
          seed: int = 42) -> dict:
    """Full training job: guard, select by CV, importance on the held-out split
    (before the refit), options, refit on all rows, save model + report (S14)."""
    from hirelens.operators.stats import feature_options
    from hirelens.sources.sinks import write_report
    spark = frame.sparkSession
    n = require_rows(frame)
    res, test = train_and_select(frame, sizes, seed=seed)
    imp = permutation_importance(res.model, test, seed=seed)
    importance = sorted(([r.label, round(r.importance, 4)] for r in imp.collect()),
                        key=lambda x: -x[1])
    opts = feature_options(frame, cities).orderBy("feature", "city_ord", "value")
    options: dict[str, list] = {}
    for r in opts.collect():                 # bounded: distinct values of 5 categoricals
        options.setdefault(r.feature, []).append(r.value)
    final = refit_best(frame, res.best, sizes, seed)
    final.write().overwrite().save(f"{model_dir}/model")
    report = {"n_samples": n, "best_model": res.best,
              "scores": [{k: (round(v, 4) if isinstance(v, float) else v) for k, v in s.items()}
                         for s in res.scores],
              "feature_options": options, "feature_importance": importance}
    write_report(spark, report, f"{model_dir}/report")
    return report


def load_model(model_dir: str) -> PipelineModel:
    return PipelineModel.load(f"{model_dir}/model")


def model_report(spark, model_dir: str) -> dict:
    """The saved report, or ``{"trained": False}`` when nothing was trained."""
    from hirelens.sources.sinks import read_report
    r = read_report(spark, f"{model_dir}/report")
    return r if r is not None else {"trained": False}


_TRAINING = threading.RLock()       # one training per folder even if queries run in parallel threads


def selected(frame: DataFrame, folder: str, sizes: ModelSizes | None = None,
             seed: int = 42) -> tuple[TrainResult, DataFrame]:
    """What ``train_and_select`` gives for ``frame``, trained once and kept in ``folder``.

    The selected model and the test split are written first and the report last: it is the mark
    that readers, of any session, look for. A folder without it is written again.
    """
    from hirelens.session import path_exists
    from hirelens.sources.sinks import read_report, write_report
    spark = frame.sparkSession
    with _TRAINING:
        report = read_report(spark, f"{folder}/report") if path_exists(spark, f"{folder}/report/_SUCCESS") else None
        if report is None:
            require_rows(frame)
            res, test = train_and_select(frame, sizes, seed=seed)
            res.model.write().overwrite().save(f"{folder}/model")
            test.select(*frame.columns).write.mode("overwrite").parquet(f"{folder}/test")
            report = {"scores": res.scores, "best": res.best, "n_rows": res.n_rows}
            write_report(spark, report, f"{folder}/report")
    res = TrainResult(report["scores"], report["best"], load_model(folder), report["n_rows"])
    return res, spark.read.parquet(f"{folder}/test")


# Forests of Spark ML over a part of the rows ----------------------------------------
# No query and no training uses these three: there every tree draws from all rows (``trees``). They stay for callers of their own,
# as ``forest_rows``, ``tree_rows``, ``part_trees`` and ``part_rows`` of ModelSizes do.
def forest_sample(frame: DataFrame, n: int, sizes: ModelSizes) -> DataFrame:
    """About ``forest_rows`` of the ``n`` rows, by seeded key hash; all of them if there are no more."""
    if n <= sizes.forest_rows:
        return frame
    share = int(sizes.forest_rows / n * (1 << 40))
    return frame.where(F.pmod(_hash(sizes.seed + 2), F.lit(1 << 40)) < share)


def forest_parts(sizes: ModelSizes, rows: int) -> list[int]:
    """Trees of the parts in which a forest over ``rows`` rows is fitted."""
    n = max(1, min(-(-sizes.rf_trees // sizes.part_trees), rows // sizes.part_rows))
    return [sizes.rf_trees // n + (i < sizes.rf_trees % n) for i in range(n)]


def fit_forest(source: DataFrame, sizes: ModelSizes, rows: int, room: threading.Semaphore) -> PipelineModel:
    """The forest over ``source``, grown in parts side by side as far as ``room`` lets them.

    The cost of a tree goes with the rows that its bootstrap draws from, also those it leaves out. Where the
    bootstraps are a fraction of the rows, the rows are dealt out by the column ``deal``, so that a part
    draws as many of its own ones and the parts take all. The forest's prediction is the mean of its trees'.
    """
    trees = forest_parts(sizes, rows)
    deals = max(1, min(len(trees), rows // sizes.tree_rows))
    base = regressors(sizes, rows // deals)["random_forest"]

    def grow(i: int):
        own = source if deals == 1 else source.where(F.pmod("deal", F.lit(deals)) == i % deals)
        part = base.copy({base.numTrees: trees[i], base.seed: sizes.seed + i,
                          base.maxMemoryInMB: max(32, sizes.tree_memory_mb // len(trees))})
        with room:
            return part.fit(own.coalesce(1) if len(trees) > 1 else own).setPredictionCol(f"__p{i}")

    grown = side_by_side(source.sparkSession, [partial(grow, i) for i in range(len(trees))], len(trees))
    names = [f"__p{i}" for i in range(len(trees))]
    mean = " + ".join(f"{p} * {n}" for p, n in zip(names, trees))
    return PipelineModel(stages=[*grown, SQLTransformer(
        statement=f"SELECT * EXCEPT ({', '.join(names)}), ({mean}) / {sizes.rf_trees} AS prediction FROM __THIS__")])
