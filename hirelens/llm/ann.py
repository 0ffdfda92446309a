"""Approximate nearest neighbours over balanced posting lists.

Vectors equal in every component are one entry that remembers its smallest ids, so copies
(of rows or of queries) cost nothing more. Centroids are fitted on a bounded sample and
searched in memory along a neighbour graph by best-first steps, all vectors of a
batch side by side. A vector goes to the list of its nearest centroid and, near a
boundary, to further ones: those at most ``1 + REPLICATE`` times as far, unless they lie
closer to a centroid already chosen than to the vector, at most MAX_COPIES; for this it is
compared with every centroid. A list
longer than LIST_ROWS is split evenly by hash into parts that are always searched
together, so all parts stay balanced whatever the data. A query searches the lists whose
centroid is at most ``1 + PROBE`` times as far as its nearest one, however many: its beam of
BEAM centroids doubles until the last one lies farther.

Lists and the queries that want them meet where the list lies: the list's vectors come
first, then the queries in batches, and every batch leaves its best matches only.

Defined cases: vectors that are null, empty or zero or hold a null or non-finite
component, and those of another length than most, take no part; null ids neither; a
repeated id is one row for each of its vectors; components may be as large or small as doubles are; ties go to the smaller id; with no
vectors there are no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import drop_staged, map_arrow, staged

SAMPLE_ROWS = 20_000        # vectors the centroids are fitted on
LIST_TARGET = 256           # vectors per centroid aimed at
MAX_CENTROIDS = 4096        # so the broadcast centroids stay small
MAX_COPIES = 4
REPLICATE = 0.10
PROBE = 0.22
LIST_ROWS = 2048            # vectors in a part of a list
GRAPH_DEGREE = 24
BEAM = 192                  # centroids a query's search begins with


@dataclass
class Centroids:
    points: np.ndarray          # unit vectors
    graph: np.ndarray           # neighbours of every centroid
    entries: np.ndarray         # where searches start

    @classmethod
    def fit(cls, x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> Centroids:
        """Spherical k-means; a cluster left empty takes the point worst served."""
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            best = np.empty(len(x), np.int64)
            sim = np.empty(len(x))
            for i in range(0, len(x), 4096):
                s = x[i:i + 4096] @ c.T
                best[i:i + 4096] = s.argmax(axis=1)
                sim[i:i + 4096] = s.max(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, best, x)
            empty = np.flatnonzero(np.bincount(best, minlength=k) == 0)
            sums[empty] = x[np.argsort(sim)[:len(empty)]]
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        degree = min(GRAPH_DEGREE, k - 1)
        graph = np.empty((k, max(1, degree)), np.int64)
        for i in range(0, k, 1024):
            s = c[i:i + 1024] @ c.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            near = np.argpartition(-s, max(0, degree - 1), axis=1)[:, :max(1, degree)] if k > 1 else np.zeros((len(s), 1), int)
            graph[i:i + 1024] = near
        entries = list(rng.choice(k, min(k, 32), replace=False))
        seen = np.zeros(k, bool)
        new = np.array(entries)
        while True:                                     # a part of the graph no entry leads to gets its own
            while len(new):
                seen[new] = True
                new = np.unique(graph[new])
                new = new[~seen[new]]
            if seen.all():
                break
            new = np.flatnonzero(~seen)[:1]
            entries.append(new[0])
        return cls(c, graph, np.array(entries))

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest centroids of every row and their similarity, best first."""
        n, k = len(x), len(self.points)
        most = min(most, k)
        if k <= most:                                   # every centroid is wanted anyway
            s = x @ self.points.T
            order = np.argsort(-s, axis=1, kind="stable")
            return order, np.take_along_axis(s, order, axis=1)
        score = np.full((n, k), -np.inf, np.float32)    # of the centroids met so far
        opened = np.zeros((n, k), bool)
        rows = np.arange(n)[:, None]
        score[:, self.entries] = x @ self.points[self.entries].T
        width = 8
        for _ in range(k):
            held = np.argpartition(-score, most - 1, axis=1)[:, :most]
            pending = np.where(opened[rows, held] | np.isneginf(score[rows, held]), -np.inf, score[rows, held])
            pick = np.argpartition(-pending, min(width, most) - 1, axis=1)[:, :width]
            at = held[rows, pick]
            fresh = ~np.isneginf(pending[rows, pick])
            if not fresh.any():
                break
            opened[np.nonzero(fresh)[0], at[fresh]] = True
            met = self.graph[at].reshape(n, -1)
            new = np.isneginf(score[rows, met]) & np.repeat(fresh, self.graph.shape[1], axis=1)
            r, c = np.nonzero(new)
            m = met[r, c]
            score[r, m] = np.einsum("ij,ij->i", x[r], self.points[m])
        held = np.argpartition(-score, most - 1, axis=1)[:, :most]
        s = score[rows, held]
        order = np.argsort(-s, axis=1, kind="stable")
        return held[rows, order], s[rows, order]

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of every centroid at most ``1 + ratio`` times as far as the row's nearest."""
        found, rows, beam = [], np.arange(len(x)), BEAM
        while len(rows):
            at, sim = self.search(x[rows], beam)
            ok = _near(sim, ratio)
            done = ~ok[:, -1] & ~np.isneginf(sim[:, -1]) | (at.shape[1] == len(self.points))
            r, c = np.nonzero(ok & done[:, None])
            found.append((rows[r], at[r, c]))
            rows, beam = rows[~done], beam * 2
        row, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], at[order]

    def homes(self, x: np.ndarray, ratio: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of the lists that hold each row: its nearest and those near a boundary."""
        s = x @ self.points.T
        best = s.max(axis=1, keepdims=True)
        most = int(_near(s, ratio, best).sum(axis=1).max())
        at = np.argpartition(-s, most - 1, axis=1)[:, :most]
        sim = np.take_along_axis(s, at, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        at, sim = np.take_along_axis(at, order, axis=1), np.take_along_axis(sim, order, axis=1)
        d, ok = _distance(sim), _near(sim, ratio)
        chosen = np.full((len(x), copies), -1)
        chosen[:, 0] = at[:, 0]
        n = np.ones(len(x), np.int64)
        for j in range(1, most):                        # skip a list that a nearer chosen one stands for
            r = np.flatnonzero(ok[:, j] & (n < copies))
            between = _distance(np.einsum("ikd,id->ik", self.points[chosen[r]], self.points[at[r, j]]))
            r = r[~((between < d[r, j, None]) & (chosen[r] >= 0)).any(axis=1)]
            chosen[r, n[r]] = at[r, j]
            n[r] += 1
        row, col = np.nonzero(chosen >= 0)
        return row, chosen[row, col]


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # by a power of two, so nothing is rounded: squares of the largest components stay within doubles
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * sim))


def _near(sim: np.ndarray, ratio: float, best: np.ndarray | None = None) -> np.ndarray:
    """Which are at most ``1 + ratio`` times as far as the best, by default the first."""
    return _distance(sim) <= (1 + ratio) * _distance(sim[:, :1] if best is None else best) + 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector can take part: finite throughout and not zero."""
    # a null, NaN or infinite component makes the product with zero differ from zero
    finite = F.forall(vector, lambda x: F.coalesce(x.cast("double") * 0.0 == 0.0, F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def entries(rows: DataFrame, id_col: str, vector_col: str, ids_kept: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k1, k2) and distinct vectors (k1, k2, vector, ids), ids being the smallest few.

    (k1, k2) is a 128-bit hash of the components.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0)      # -0.0 is 0.0
    good = (rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")))
    length = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    good = good.where(F.size("vector") == (length["n"] if length else -1))
    good = staged(good.select("id", "vector", F.xxhash64("vector").alias("k1"),
                              F.xxhash64(F.lit("second"), "vector").alias("k2")).distinct(), "vectors")
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    few = good.select("k1", "k2", "id").withColumn("r", rank).where(F.col("r") <= ids_kept)
    ids = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    firsts = ids.select("k1", "k2", "ids", F.element_at("ids", 1).alias("id"))
    distinct = staged(good.join(firsts, ["k1", "k2", "id"]).select("k1", "k2", "vector", "ids"), "entries")
    return good.select("id", "k1", "k2"), distinct


def fit(distinct: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Centroids:
    """Centroids of a sample of at most ``sample_rows`` vectors, in order of their hash."""
    n = distinct.count()
    sample = distinct.orderBy("k1", "k2").select("vector").limit(sample_rows).toArrow()
    x = _unit(sample.column("vector").combine_chunks())
    k = max(1, min(MAX_CENTROIDS, -(-n // LIST_TARGET), -(-len(x) // 4)))
    return Centroids.fit(x, k)


def _lists(vectors: DataFrame, model, ratio: float, copies: int | None = None) -> DataFrame:
    """(list, k1, k2, vector) of the lists (up to ``copies``) a vector belongs to or, as a query, searches."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("k1", T.LongType()),
                           T.StructField("k2", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(it):
        m: Centroids = model.value
        for big in it:
            for i in range(0, big.num_rows, 256):
                batch = big.slice(i, 256)
                x = _unit(batch.column(2))
                row, at = m.within(x, ratio) if copies is None else m.homes(x, ratio, copies)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *taken.columns],
                                                 names=schema.names)

    return map_arrow(vectors.select("k1", "k2", "vector"), run, schema)


def _match(keep: int):
    """Best matches of queries (side 1) among a part's vectors (side 0), in rows sorted by part and side."""
    names = ["q1", "q2", "k1", "k2", "score"]

    def run(it):
        part, base, keys = None, None, None
        for big in it:
            lists = big.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = big.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            side = big.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(lists)]):
                if a == b:
                    continue
                here = (lists[a], parts[a])
                batch = big.slice(a, b - a)
                x = _unit(batch.column(5))
                k = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1)
                if side[a] == 0:
                    if here != part:
                        part, base, keys = here, [], []
                    base.append(x)
                    keys.append(k)
                    continue
                if here != part or not base:
                    continue
                if len(base) > 1:
                    base, keys = [np.concatenate(base)], [np.concatenate(keys)]
                for i in range(0, len(x), 256):
                    s = x[i:i + 256] @ base[0].T
                    n = min(keep, s.shape[1])
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    q = np.repeat(np.arange(i, i + len(s)), n)
                    t = top.ravel()
                    exact = np.einsum("ij,ij->i", x[q], base[0][t])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[q, 0]), pa.array(k[q, 1]), pa.array(keys[0][t, 0]), pa.array(keys[0][t, 1]),
                         pa.array(exact)], names=names)

    return run


def neighbours(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding",
               top: int = 5, probe: float = PROBE, replicate: float = REPLICATE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest other rows found for each query row.

    ``queries`` says which rows are queries; score is the cosine.
    """
    members, distinct = entries(rows, id_col, vector_col, ids_kept=top + 1)
    wanted = members.where(queries)
    asked = distinct.join(wanted.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark = rows.sparkSession
    if not distinct.limit(1).count():
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fit(distinct))
    stored = staged(_lists(distinct, model, replicate, MAX_COPIES), "postings")
    sizes = staged(stored.groupBy("list").agg(F.count("*").alias("n"))
                   .select("list", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("parts")), "list-sizes")
    side = lambda df, n, part: df.join(sizes, "list").select(
        "list", part.alias("part"), F.lit(n).alias("side"), "k1", "k2", "vector")
    base = side(stored, 0, F.pmod(F.xxhash64("k1", "k2"), F.col("parts")).cast("int"))
    asks = side(_lists(asked, model, probe), 1, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = (base.union(asks).repartition("list", "part")
             .sortWithinPartitions("list", "part", "side"))
    found = T.StructType([T.StructField(c, T.LongType()) for c in ("q1", "q2", "k1", "k2")]
                         + [T.StructField("score", T.DoubleType())])
    near = map_arrow(dealt, _match(top + 1), found)
    near = staged(near.groupBy("q1", "q2", "k1", "k2").agg(F.max("score").alias("score")), "near")
    for t in (stored, sizes):
        drop_staged(t)
    # every distinct vector counts with its ids; ties are told apart by id below
    some = near.withColumn("r", F.rank().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score")))).where(
        F.col("r") <= top + 1)
    per = (some.join(distinct.select("k1", "k2", "ids"), ["k1", "k2"])
           .select("q1", "q2", "score", F.explode("ids").alias("vec_id")))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    per = per.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    answers = staged(per.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "answers")
    for t in (near, distinct):
        drop_staged(t)
    own = wanted.join(answers, ["k1", "k2"]).select("id", F.slice(F.filter(
        "found", lambda x: x["vec_id"] != F.col("id")), 1, top).alias("found"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
