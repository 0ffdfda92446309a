"""Regression trees over cells, for M7 and M9.

Rows equal in all features are one **cell**, and a split never parts them: a tree depends on each cell's weight and
mean label alone. So a tree is grown whole inside a task, from histograms over the categories (one bin per
category and not one per row), which makes a level of a tree a few array operations over the cells.

* **bootstrap**: a tree draws from *all* rows. Rows equal in features, fold and label are one counted group; the
  sum of ``n`` draws of Poisson(1) is one draw of Poisson(n), so groups are drawn, each by a hash of its
  own and the tree's number. The draws do not depend on partitions, batches or tasks;
* a **task** grows some trees of the forest, for the whole train split and for each fold left out, or one boosted
  series. It streams the groups once and holds sums per cell, fold and tree;
* grown trees become Spark's own models, by way of the files in which Spark keeps them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

#: Sums that a task holds for the trees it grows; with more cells it grows fewer trees.
TASK_MB = 64
#: Groups that are drawn at once.
DRAW_ROWS = 1 << 16
#: A gain below this share of a node's sum of squares is rounding.
NO_GAIN = 1e-13

OUT = ("model string, fit int, cell int, value double, tree int, node int, weight double, square double, raw long, "
       "gain double, left int, right int, feature int, threshold double")
_ARROW = pa.schema([("model", pa.string()), ("fit", pa.int32()), ("cell", pa.int32()), ("value", pa.float64()),
                    ("tree", pa.int32()), ("node", pa.int32()), ("weight", pa.float64()), ("square", pa.float64()),
                    ("raw", pa.int64()), ("gain", pa.float64()), ("left", pa.int32()), ("right", pa.int32()),
                    ("feature", pa.int32()), ("threshold", pa.float64())])


@dataclass
class Layout:
    """The cells as a tree sees them.

    A category column has a bin per encoded slot and may split one category from the others, as the slot's 0 or 1
    does; a numeric one has a bin between any two neighbouring thresholds.
    """
    bins: np.ndarray            # column x cell -> bin, numbered through all columns
    first: np.ndarray           # first bin per column
    of: np.ndarray              # bin -> column
    numeric: np.ndarray         # column -> is it a numeric one
    feature: np.ndarray         # bin -> place in the feature vector
    threshold: np.ndarray       # bin -> at most this goes left
    weight: np.ndarray          # cell -> weight of each of its rows

    @property
    def cells(self) -> int:
        return self.bins.shape[1]


def layout(slots: np.ndarray, sizes: list[int], values: np.ndarray, known: np.ndarray, weight: np.ndarray) -> Layout:
    """``slots``: category column x cell, of ``sizes`` slots; ``values``: numeric column x cell; thresholds lie
    between the values of the ``known`` cells."""
    bins, of, feature, threshold, first = [], [], [], [], []
    for c, size in enumerate(sizes):
        first.append(len(of))
        bins.append(slots[c] + len(of))
        feature += range(len(of), len(of) + size)
        of += [c] * size
        threshold += [0.5] * size
    at = len(of)
    for i, v in enumerate(values):
        seen = np.unique(v[known])
        cuts = (seen[:-1] + seen[1:]) / 2
        first.append(len(of))
        bins.append(np.searchsorted(cuts, v, side="left") + len(of))
        feature += [at + i] * (len(cuts) + 1)
        of += [len(sizes) + i] * (len(cuts) + 1)
        threshold += [*cuts, 0.0]
    return Layout(np.array(bins, np.int64), np.array(first), np.array(of), np.arange(len(first)) >= len(sizes),
                  np.array(feature), np.array(threshold, float), weight)


@dataclass
class Tree:
    """Nodes level by level; ``left`` is -1 at a leaf."""
    value: np.ndarray
    weight: np.ndarray
    square: np.ndarray
    raw: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray


def grow(lay: Layout, n: np.ndarray, y: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """The tree over cells of ``n`` rows and mean label ``y``, and its prediction for every cell.

    Each node takes the split of least squared error, the first of equal ones. Cells without rows run along.
    """
    w = lay.weight * n
    wy, bins = w * y, lay.bins
    columns, total = bins.shape[0], len(lay.of)
    live, node, nodes, first = np.arange(lay.cells), np.zeros(lay.cells, np.int64), 1, 0
    predicted, levels = np.empty(lay.cells), []
    for level in range(depth + 1):
        lw, ly = w[live], wy[live]
        sw, sy = np.bincount(node, lw, nodes), np.bincount(node, ly, nodes)
        syy, raw = np.bincount(node, ly * y[live], nodes), np.bincount(node, n[live], nodes)
        predicted[live] = (sy / sw)[node]
        split = np.zeros(nodes, bool)
        best, gain = np.zeros(nodes, np.int64), np.full(nodes, -1.0)
        if level < depth:
            key = (node * total + bins[:, live]).ravel()
            hw = np.bincount(key, np.tile(lw, columns), nodes * total).reshape(nodes, total)
            hy = np.bincount(key, np.tile(ly, columns), nodes * total).reshape(nodes, total)
            some = hw > 0
            can = np.zeros((nodes, total), bool)
            for c, start in enumerate(lay.first):
                end = start + np.count_nonzero(lay.of == c)
                here = some[:, start:end]
                if lay.numeric[c]:              # sums up to a threshold, and something on both sides of it
                    below = np.cumsum(here, 1)
                    can[:, start:end] = (below > 0) & (below < below[:, -1:])
                    hw[:, start:end], hy[:, start:end] = np.cumsum(hw[:, start:end], 1), np.cumsum(hy[:, start:end], 1)
                else:                           # one category, and others beside it
                    can[:, start:end] = here & (np.count_nonzero(here, 1) > 1)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = hy * hy / hw + (sy[:, None] - hy) ** 2 / (sw[:, None] - hw)
            score[~can] = -np.inf
            best = np.argmax(score, 1)
            won = score[np.arange(nodes), best] - sy * sy / sw
            split = won > NO_GAIN * syy
            gain = np.where(split, won / sw, -1.0)
        rank = np.cumsum(split) - 1
        child = np.where(split, first + nodes + 2 * rank, -1)
        levels.append(Tree(sy / sw, sw, syy, raw, gain, child, np.where(split, child + 1, -1),
                           np.where(split, lay.feature[best], -1), lay.threshold[best]))
        if not split.any():
            break
        on = split[node]
        live, node = live[on], node[on]
        at = best[node]
        column = lay.of[at]
        bin_ = bins[column, live]
        right = np.where(lay.numeric[column], bin_ > at, bin_ == at)
        node, first, nodes = 2 * rank[node] + right, first + nodes, 2 * int(np.count_nonzero(split))
    return Tree(*(np.concatenate([getattr(t, f) for t in levels]) for f in Tree.__dataclass_fields__)), predicted


def boost(lay: Layout, n: np.ndarray, y: np.ndarray, rounds: int, depth: int, step: float) -> tuple[list[Tree], np.ndarray]:
    """Squared-loss boosting: the first tree learns the label, each other the negative gradient 2 (y - prediction)."""
    tree, predicted = grow(lay, n, y, depth)
    trees = [tree]
    for _ in range(rounds - 1):
        tree, more = grow(lay, n, np.where(n > 0, 2 * (y - predicted), 0.0), depth)
        trees.append(tree)
        predicted = predicted + step * more
    return trees, predicted


# Bootstrap ---------------------------------------------------------------------
def uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) per 64-bit id and tree (the finalizer of splitmix64)."""
    mask = (1 << 64) - 1
    salt = ((seed << 32) + tree + 1) * 0x9E3779B97F4A7C15 & mask
    z = ids + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


@lru_cache(maxsize=4096)
def _poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """Smallest value and the distribution function from there on; what is left out is below 2^-53."""
    wide = int(12 * mean ** 0.5) + 40
    low = max(0, mean - wide)
    k = np.arange(low + 1, mean + wide + 1)
    # p(k) / p(k - 1) = mean / k
    steps = np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    p = np.exp(steps - steps.max())
    return low, np.cumsum(p) / p.sum()


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Draws of Poisson(mean), whole means of 1 or more, by inversion of ``u``."""
    out = np.empty(len(u), np.int64)
    order = np.argsort(mean, kind="stable")
    ends = np.flatnonzero(np.diff(mean[order], append=-1)) + 1
    for start, end in zip([0, *ends], ends):
        at = order[start:end]
        low, upto = _poisson_table(int(mean[at[0]]))
        out[at] = low + np.minimum(np.searchsorted(upto, u[at], side="right"), len(upto) - 1)
    return out


# Tasks ---------------------------------------------------------------------------
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Cell, fold, label, count and id of the train rows' groups, some ``DRAW_ROWS`` at a time."""
    def arrays(held):
        return [pa.Table.from_batches(held).column(c).to_numpy() for c in ("cell", "fold", "label", "n", "id")]

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= DRAW_ROWS:
            yield arrays(held)
            held, rows = [], 0
    if rows:
        yield arrays(held)


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(total, n, out=np.zeros_like(total), where=n > 0)


def _without(sums: np.ndarray, fit: int) -> np.ndarray:
    """Sums over the folds (last axis but one) without the fold ``fit``; -1 leaves none out."""
    return sums.sum(-2) if fit < 0 else sums[..., [f for f in range(sums.shape[-2]) if f != fit], :].sum(-2)


def _rows(**columns) -> pa.RecordBatch:
    size = max(len(v) for v in columns.values() if isinstance(v, np.ndarray))
    full = []
    for f in _ARROW:
        v = columns.get(f.name)
        full.append(pa.nulls(size, f.type) if v is None else
                    pa.array(v if isinstance(v, np.ndarray) else [v] * size, f.type))
    return pa.RecordBatch.from_arrays(full, schema=_ARROW)


def _tree_rows(model: str, number: int, t: Tree) -> pa.RecordBatch:
    return _rows(model=model, tree=number, node=np.arange(len(t.value), dtype=np.int32), value=t.value, weight=t.weight,
                 square=t.square, raw=np.rint(t.raw).astype(np.int64), gain=t.gain, left=t.left.astype(np.int32),
                 right=t.right.astype(np.int32), feature=t.feature.astype(np.int32), threshold=t.threshold)


def _predictions(model: str, fit: int, value: np.ndarray) -> pa.RecordBatch:
    return _rows(model=model, fit=fit, cell=np.arange(len(value), dtype=np.int32), value=value)


def _forest_task(batches, lay, model: str, trees: range, folds: int, fits: list[int], depth: int, seed: int, share: float):
    """Trees ``trees`` of the forest of every fit: their predictions, summed up, and the nodes of fit -1."""
    lay = lay.value
    n, total = (np.zeros((len(trees), folds * lay.cells)) for _ in range(2))
    for cell, fold, label, count, ids in _groups(batches):
        at, ids = fold.astype(np.int64) * lay.cells + cell, ids.view(np.uint64)
        for i, t in enumerate(trees):
            drawn = poisson(uniform(ids, seed, t), count)
            n[i] += np.bincount(at, drawn, n.shape[1])
            total[i] += np.bincount(at, drawn * label, n.shape[1])
    n, total = (a.reshape(len(trees), folds, lay.cells) for a in (n, total))
    for fit in fits:
        value = np.zeros(lay.cells)
        for i, t in enumerate(trees):
            rows = _without(n[i], fit)
            if not rows.any():
                raise RuntimeError(f"fit {fit}: no training rows")
            tree, predicted = grow(lay, rows, _mean(_without(total[i], fit), rows), depth)
            value += share * predicted
            if fit < 0:
                yield _tree_rows(model, t, tree)
        yield _predictions(model, fit, value)


def _boost_task(batches, lay, model: str, folds: int, fit: int, rounds: int, depth: int, step: float):
    lay = lay.value
    n, total = (np.zeros(folds * lay.cells) for _ in range(2))
    for cell, fold, label, count, _ in _groups(batches):
        at = fold.astype(np.int64) * lay.cells + cell
        n += np.bincount(at, count, len(n))
        total += np.bincount(at, count * label, len(n))
    rows, total = (_without(a.reshape(folds, lay.cells), fit) for a in (n, total))
    if not rows.any():
        raise RuntimeError(f"fit {fit}: no training rows")
    trees, predicted = boost(lay, rows, _mean(total, rows), rounds, depth, step)
    if fit < 0:
        for i, t in enumerate(trees):
            yield _tree_rows(model, i, t)
    yield _predictions(model, fit, predicted)


def side_by_side(spark, jobs: list, parallel: int) -> list:
    """Results of the callables in their order, at most ``parallel`` running at a time."""
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def fit_all(groups: DataFrame, lay: Layout, sizes, step: float, folds: int, fits: list[int], models: list[str],
            folder: str) -> DataFrame:
    """Trees and predictions of the ``models``, stored below ``folder``.

    ``groups``: cell, fold, label, n and id of the train rows, stored. A fit leaves out the fold of its number, -1 none.
    Rows with a ``cell`` hold a prediction, to be summed over tasks, those with a ``node`` a node of fit -1.
    Every task is a job: as one union, tasks of a partition each would be run one after another in a single one.
    """
    spark = groups.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sent = spark.sparkContext.broadcast(lay)    # as many cells as the categories have combinations in the data
    one = groups.select("cell", "fold", "label", "n", "id").coalesce(1)
    tasks = []
    if "gradient_boosting" in models:
        tasks += [partial(_boost_task, lay=sent, model="gradient_boosting", folds=folds, fit=fit, rounds=sizes.gbt_iter,
                          depth=sizes.gbt_depth, step=step) for fit in fits]
    if "random_forest" in models:
        held = max(1, (TASK_MB << 20) // (16 * folds * lay.cells))
        each = min(held, -(-sizes.rf_trees // (3 * cores)))
        tasks += [partial(_forest_task, lay=sent, model="random_forest", trees=range(i, min(i + each, sizes.rf_trees)),
                          folds=folds, fits=fits, depth=sizes.rf_depth, seed=sizes.seed, share=1 / sizes.rf_trees)
                  for i in range(0, sizes.rf_trees, each)]
    path = f"{folder}/grown-{uuid.uuid4().hex}"
    side_by_side(spark, [partial(one.mapInArrow(task, OUT).write.parquet, f"{path}/task={i}")
                         for i, task in enumerate(tasks)], cores)
    return spark.read.schema(f"{OUT}, task int").parquet(path)


# Spark's models --------------------------------------------------------------------
def spark_model(grown: DataFrame, name: str, regressor, features: int, trees: int, step: float, folder: str):
    """The nodes of model ``name`` as Spark's model of ``regressor``, by way of its files below ``folder``.

    ``impurity`` of a node is the variance between cells; that inside of them does not tell splits apart.
    """
    spark, boosted = grown.sparkSession, name == "gradient_boosting"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    params = {p.name: v for p, v in regressor.extractParamMap().items()}

    def meta(cls: str, uid: str, keep: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{cls}", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": uid, "paramMap": keep, "defaultParamMap": {}, **more})

    cls = GBTRegressionModel if boosted else RandomForestRegressionModel
    spark.createDataFrame([(meta(cls.__name__, regressor.uid, params, numFeatures=features, numTrees=trees),)],
                          "value string").coalesce(1).write.text(f"{path}/metadata")
    single = {k: params[k] for k in ("maxDepth", "featuresCol", "labelCol", "weightCol")}
    spark.createDataFrame(
        [(i, meta("DecisionTreeRegressionModel", f"dtr_{i}", single), step if boosted and i else 1.0) for i in range(trees)],
        "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    w, s, leaf = F.col("weight"), F.col("value") * F.col("weight"), F.col("left") < 0
    none = F.array().cast("array<double>")
    grown.where((F.col("model") == name) & F.col("node").isNotNull()).select(
        F.col("tree").alias("treeID"), F.struct(
            F.col("node").alias("id"), F.col("value").alias("prediction"),
            F.greatest(F.col("square") / w - F.col("value") ** 2, F.lit(0.0)).alias("impurity"),
            F.array(w, s, "square").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
            F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
            F.struct(F.col("feature").alias("featureIndex"),
                     F.when(leaf, none).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")
    ).coalesce(1 if boosted else 8).write.parquet(f"{path}/data")
    return cls.load(path)
