"""MinHash near-duplicate groups with sequential Bayesian verification.

A document is the set of its distinct word shingles, held as 64-bit hashes; equal sets are one
node. A node has BANDS * ROWS minima of random linear maps of those hashes. Nodes that
agree in all rows of a band are candidates. Of the minima one byte each goes along to where
candidates meet; with similarity J two such bytes agree with probability J + (1 - J) / 256.
Batch after batch of bytes is compared, and a pair goes as soon as the posterior probability
(flat prior on J) that its similarity reaches the threshold is below MISS. What
survives all batches links nodes to candidate groups; the sets of a group's nodes are then
fetched, and survivors are verified on them exactly.

A band's key with more than BLOCK nodes is compared block by block, every two blocks in one place;
out of it comes a spanning forest of the surviving links, never all pairs. Candidate groups are
verified likewise, in blocks of about BLOCK_SHINGLES hashes, by a forest of verified
links: a pair is left out only if its two nodes are linked already, so the groups are
those of all verified pairs.

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing;
fewer words than a shingle make one shingle; repeated rows and null ids are rows of their own, each
with its result row; a group whose rows have no id has a null ``component_id``, and a row without an id counts as
kept only there; texts may be of any length; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, drop_staged, map_arrow, staged
from hirelens.llm.components import components

PERCENT = 85                # of the union that linked sets share at least
BANDS, ROWS = 24, 5         # a pair at the threshold shares no band once in 10^6
MISS = 1e-6                 # posterior probability below which a pair goes
BATCH = 24                  # signature bytes compared at once
BLOCK = 2048                # nodes of a band's key that are compared with each other at once
BLOCK_SHINGLES = 1 << 18    # hashes of a candidate group's sets that are held at once
SEED = 42


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()    # bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[:n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(line[a:b], SEED) for a, b in zip(first, ends[shingle - 1:].tolist())}), np.uint64)


@lru_cache(maxsize=4)
def _maps(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One row of ``n`` minima per set; no set may be empty."""
    a, b = _maps(n)
    out = np.empty((len(sets), n), np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(n):
        out[:, k] = np.minimum.reduceat(flat * a[k] + b[k], starts)
    return out


def signatures(mins: np.ndarray) -> np.ndarray:
    """A byte of every minimum; not of its top bits, which are mostly zero."""
    return ((mins * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, of all bits of its minima."""
    n, bands = len(mins), mins.shape[1] // rows
    flat = np.ascontiguousarray(mins).view(np.uint8).reshape(n * bands, rows * 8)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in flat]
    return np.array(keys, np.uint64).reshape(n, bands)


def _tail(x: float, hits: int, n: int) -> float:
    """P(p >= x) for p with a flat prior after ``hits`` of ``n`` agreed: a binomial sum."""
    return math.fsum(math.comb(n + 1, i) * x ** i * (1 - x) ** (n + 1 - i) for i in range(hits + 1))


@lru_cache(maxsize=16)
def fewest_hits(n: int, percent: int = PERCENT, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(bytes compared, agreeing bytes a pair needs to stay) for every batch of ``n`` bytes."""
    floor = 1 / 256
    at = percent / 100 * (1 - floor) + floor
    out = []
    for seen in [*range(BATCH, n, BATCH), n]:
        hits = 0
        while hits < seen and _tail(at, hits, seen) < miss * _tail(floor, hits, seen):
            hits += 1
        out.append((seen, hits))
    return tuple(out)


def survivors(sigs: np.ndarray, sig: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Indices of the signatures that no batch tells apart from ``sig``."""
    left, hits, done = np.arange(len(sigs)), np.zeros(len(sigs), np.int64), 0
    for seen, need in fewest_hits(sigs.shape[1], percent, miss):
        hits = hits + (sigs[left, done:seen] == sig[done:seen]).sum(axis=1)
        ok = hits >= need
        left, hits, done = left[ok], hits[ok], seen
    return left


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, th, n, d1, d2, sig, keys): every row with its set's size, digest, signature and band keys."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
        T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(it):
        for batch in batches(it, "_text"):
            found = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            some = [s for s in found if len(s)]
            sig, keys = iter(()), iter(())
            if some:
                mins = minima(some, BANDS * ROWS)
                sig = iter([r.tobytes() for r in signatures(mins)])
                keys = iter(band_keys(mins, ROWS).view(np.int64).tolist())
            ids = [xxhash.xxh128_digest(s.tobytes()) for s in found]
            halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([len(s) for s in found], pa.int64()),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array([next(sig) if len(s) else None for s in found], pa.binary()),
                 pa.array([next(keys) if len(s) else None for s in found], pa.list_(pa.int64()))], names=schema.names)

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    return map_arrow(rows, run, schema)


def _forest(size: int, near, sides: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest; ``near(at, others)`` says which of the others link with ``at``.

    Sides 0 and 1 are compared with the other side only, side 2 with itself.
    """
    split = int(np.searchsorted(sides, 1)) if sides[0] == 0 and sides[-1] == 1 else 0
    if not split and sides[0] != 2:
        return []                                   # one block of two came without the other
    rest = [np.arange(split), np.arange(split, size)] if split else [np.arange(size)]
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while queue or len(rest[0]):
        if not queue:
            queue, rest[0] = [int(rest[0][0])], rest[0][1:]
        at = queue.pop()
        other = (0 if at >= split else 1) if split else 0
        if not len(rest[other]):
            continue
        found = near(at, rest[other])
        if len(found):
            links += [(at, int(f)) for f in rest[other][found]]
            queue += rest[other][found].tolist()
            rest[other] = np.delete(rest[other], found)
    return links


def _in_runs(it, by: int, handle):
    """Call ``handle(columns of a run)`` for every run of rows equal in their first ``by`` columns; yields links."""
    held: list[pa.RecordBatch] = []

    def out(links):
        a = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    def whole():
        table = pa.Table.from_batches(held)
        return table.combine_chunks().to_batches()[0]

    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        heads = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(by)]
        new = np.zeros(batch.num_rows, bool)
        for h in heads:
            new[1:] |= h[1:] != h[:-1]
        first = tuple(h[0] for h in heads)
        cuts = np.flatnonzero(new).tolist()
        links: list = []
        if last is not None and first != last:
            links += handle(whole())
            held = []
        for a, b in zip([0, *cuts], [*cuts, None]):
            if b is None:
                held.append(batch.slice(a))
            else:
                held.append(batch.slice(a, b - a))
                run = held[0] if len(held) == 1 else whole()
                links += handle(run) if run.num_rows > 1 else []
                held = []
        last = tuple(h[-1] for h in heads)
        if links:
            yield out(links)
    if held:
        links = handle(whole())
        if links:
            yield out(links)


def _paired(blocks, mine):
    """Block pairs that a row of block ``mine`` takes part in, with its side there."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        (F.least(o, mine) * blocks + F.greatest(o, mine)).alias("pair"),
        F.when(o == mine, 2).when(mine < o, 0).otherwise(1).cast("int").alias("side")))


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def candidates(nodes: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(a, b): surviving links that connect all nodes (node, sig, keys) whose comparison survives."""
    keys = staged(nodes.select("node", F.posexplode("keys").alias("slot", "key")), "minhash-keys")
    shared = staged(keys.groupBy("slot", "key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-shared")
    members = keys.join(shared, ["slot", "key"])
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (members.join(nodes.select("node", "sig"), "node")
             .withColumn("o", F.explode(_paired(blocks, mine)))
             .select("slot", "key", "o.pair", "o.side", "node", "sig")
             .repartition("slot", "key", "pair").sortWithinPartitions("slot", "key", "pair", "side", "node"))

    def handle(run):
        sigs = np.frombuffer(b"".join(run.column(5).to_pylist()), np.uint8).reshape(run.num_rows, -1)
        nodes = run.column(4).to_numpy(zero_copy_only=False)
        sides = run.column(3).to_numpy(zero_copy_only=False)
        links = _forest(run.num_rows, lambda at, rest: survivors(sigs[rest], sigs[at], percent, miss), sides)
        return [(int(nodes[a]), int(nodes[b])) for a, b in links]

    out = staged(map_arrow(dealt, lambda it: _in_runs(it, 3, handle), LINKS), "minhash-near")
    for t in (keys, shared):
        drop_staged(t)
    return out


def _same(held: list[np.ndarray], mine: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the sets that share at least ``percent`` of the union with ``mine``."""
    sizes = np.array([len(s) for s in held])
    fits = np.flatnonzero(100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine)))
    if not len(fits):
        return fits
    flat = np.concatenate([held[i] for i in fits])
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    starts = np.concatenate([[0], np.cumsum(sizes[fits])[:-1]])
    both = np.add.reduceat((mine[at] == flat).astype(np.int64), starts)
    return fits[100 * both >= percent * (sizes[fits] + len(mine) - both)]


def verified(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int,
             percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(a, b): links, verified on whole sets, that connect what is linked within a candidate group.

    ``groups`` has node, root, n, d1, d2, sig and one row (id, th) that holds the node's set.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def run(it):
        for batch in batches(it, "_text"):
            found = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())],
                                             names=schema.names)

    texts = docs.select(F.col(id_col).cast(id_type).alias("_id"), F.col(text_col).alias("_text"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    # a merge join at every size: adaptive skew handling splits a text with very many rows
    wanted = groups.select("node", "id", "th").hint("merge")
    same = (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("id"))
    whole = map_arrow(texts.join(wanted, same).select("node", "_text"), run, schema)
    whole = whole.groupBy("node").agg(F.first("hashes").alias("hashes"))    # of rows equal in id and text
    totals = groups.groupBy("root").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (groups.join(totals, "root").select("root", "node", "sig", "total").join(whole, "node")
             .withColumn("o", F.explode(_paired(blocks, mine)))
             .select("root", "o.pair", "o.side", "node", "sig", "hashes")
             .repartition("root", "pair").sortWithinPartitions("root", "pair", "side", "node"))

    def handle(run):
        held = [np.frombuffer(b, np.uint64) for b in run.column(5).to_pylist()]
        sigs = np.frombuffer(b"".join(run.column(4).to_pylist()), np.uint8).reshape(run.num_rows, -1)
        nodes = run.column(3).to_numpy(zero_copy_only=False)

        def near(at, rest):
            left = survivors(sigs[rest], sigs[at], percent, miss)
            return left[_same([held[i] for i in rest[left]], held[at], percent)] if len(left) else left

        links = _forest(run.num_rows, near, run.column(2).to_numpy(zero_copy_only=False))
        return [(int(nodes[a]), int(nodes[b])) for a, b in links]

    return map_arrow(dealt, lambda it: _in_runs(it, 2, handle), LINKS)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest id among the rows reachable over links; a row is kept if that is its own.
    """
    rows = staged(sets(docs, id_col, text_col, shingle), "minhash-rows")
    some = rows.where("n > 0")
    nodes = staged(some.groupBy("d1", "d2").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("row"), F.first("n").alias("n"),
        F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    near = candidates(nodes, percent, miss)
    rough = components(near)
    groups = staged(nodes.join(rough, "node").select("node", "root", "n", "sig", "row.id", "row.th"), "minhash-groups")
    links = staged(verified(groups, docs, id_col, text_col, shingle, percent, miss), "minhash-links")
    member = staged(nodes.select("node", "d1", "d2", "least").join(components(links), "node", "left").select(
        "d1", "d2", "least", F.coalesce("root", "node").alias("root")), "minhash-member")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = staged(member.join(least, "root").select("d1", "d2", "component_id"), "minhash-by-set")
    for t in (nodes, near, groups, links, member):
        drop_staged(t)
    out = rows.join(by_set, ["d1", "d2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


#: Groups by exact similarity of all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s
  FROM cut),
sets AS (SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sh WHERE len(s) > 0 GROUP BY ALL),
one AS (SELECT node, n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM one a JOIN one b
    ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
linked AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT node, node FROM sets UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
root AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id,
       coalesce(r.component_id, d.doc_id) = d.doc_id AS kept
FROM sh d LEFT JOIN sets ON len(d.s) > 0 AND list_sort(d.s) = sets.s LEFT JOIN root r ON r.node = sets.node
"""
