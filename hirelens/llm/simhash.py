"""SimHash near-duplicate groups, with pigeonring filtering of the candidates.

A fingerprint has 64 bits in a ring of eight 8-bit segments. If two fingerprints
differ in at most t bits, then there is a segment from which on every chain of l
consecutive segments differs in at most floor(l * t / 8) bits (pigeonring). For
t = 3 the budgets are 0 0 1 1 1 2 2 3: two equal segments, then at most one bit in
the three after them, so two of those three are equal as well. That gives
8 * 3 keys of four exact segments (32 bits). Fingerprints that share a key are
candidates; the chain budgets from that key's segment are checked one after the
other, and the last budget is the full Hamming distance.

Keys are dealt over the cluster, and each is compared where its members lie; a key
with more than ``BLOCK`` members is compared block by block (every two blocks of it
meet in one place), so no task holds more than two blocks and no pair is left out.
Out of a key come only the links of a spanning forest, never all pairs. Copies of
a fingerprint are one node from the start.

Defined cases: a null or wordless text has fingerprint zero and is linked like any
other; repeated rows and null ids are rows of their own with their own result row
(a null id is never the smallest of a group that has another id); only the id and
text columns are read, besides those named in ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, coded, decoded, map_arrow, one_of_each, staged
from hirelens.llm.components import components

SEGMENTS = 8
SEGMENT_BITS = 8
SEED = 42
BLOCK = 2048                # members of one key that are compared with each other at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles: a bit is set if over half the hashes set it."""
    words = (text or "").encode("utf-8", "replace").lower().split()    # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    first = (ends - lengths + 1)[:n].tolist()
    last = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], ">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns as k0, k1, ... and ``fp``, the fingerprint as a signed long."""
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("fp", T.LongType())])

    def run(it):
        for batch in batches(it, "_text"):
            fps = [fingerprint(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=schema.names)

    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    return map_arrow(docs.select(F.col(text_col).alias("_text"), *cols), run, schema)


def budgets(max_bits: int) -> list[int]:
    return [length * max_bits // SEGMENTS for length in range(1, SEGMENTS + 1)]


def key_segments(max_bits: int) -> list[tuple[int, ...]]:
    """Offsets (from the first segment) that a key holds exact, one tuple per key.

    The zero-budget segments, and all but one of those that follow with budget one.
    """
    b = budgets(max_bits)
    zero = [i for i, x in enumerate(b) if x == 0]
    one = [i for i, x in enumerate(b) if x == 1]
    if not zero:
        raise ValueError(f"max_bits must be below {SEGMENTS}, so that a chain starts with an equal segment")
    if len(one) < 2:
        return [tuple(zero)]
    return [tuple(zero + [i for i in one if i != skip]) for skip in one]


def _keys(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(slot, key, fp): every fingerprint under each of its pigeonring keys."""
    rows = []
    for first in range(SEGMENTS):
        for k, offsets in enumerate(key_segments(max_bits)):
            mask = sum(0xFF << (SEGMENT_BITS * ((first + o) % SEGMENTS)) for o in offsets)
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            rows.append(F.struct(F.lit(first * 16 + k).cast("int").alias("slot"),
                                 F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return nodes.select("fp", F.explode(F.array(*rows)).alias("s")).select("s.slot", "s.key", "fp")


def _within(x: np.ndarray, first: np.ndarray | int, max_bits: int) -> np.ndarray:
    """Indices of those differences whose chains from segment ``first`` stay in budget."""
    left = np.arange(len(x))
    turn = np.asarray(first, np.uint64) * np.uint64(SEGMENT_BITS)
    rolled = (x >> turn) | (x << ((np.uint64(64) - turn) % np.uint64(64)))
    for length, most in enumerate(budgets(max_bits), 1):
        mask = np.uint64((1 << (SEGMENT_BITS * length)) - 1)
        ok = np.bitwise_count(rolled & mask) <= most
        left, rolled = left[ok], rolled[ok]
    return left


def _forest(fps: np.ndarray, first: int, max_bits: int, split: int = 0) -> list[tuple[int, int]]:
    """Links of a spanning forest among the members of one key.

    With ``split`` only pairs between the first ``split`` members and the others count.
    """
    links: list[tuple[int, int]] = []
    sides = [np.arange(len(fps))] if not split else [np.arange(split), np.arange(split, len(fps))]
    side_of = np.zeros(len(fps), np.int8)
    if split:
        side_of[split:] = 1
    rest = [s for s in sides]
    queue: list[int] = []
    while queue or len(rest[0]):
        if not queue:
            queue, rest[0] = [int(rest[0][0])], rest[0][1:]
        at = queue.pop()
        other = 1 - side_of[at] if split else 0
        near = _within(fps[rest[other]] ^ fps[at], first, max_bits)
        if len(near):
            found = rest[other][near]
            links += [(int(fps[at]), int(fps[f])) for f in found]
            rest[other] = np.delete(rest[other], near)
            queue += found.tolist()
    return links


def _compare(max_bits: int):
    """Links within runs of equal (slot, key, pair) in rows sorted by that and by side."""
    def flush(slot, fps, sides):
        split = int(np.searchsorted(sides, 1)) if sides[-1] == 1 and sides[0] == 0 else 0
        if sides[0] != sides[-1] or sides[0] == 2:      # two blocks, or a key or block by itself
            return _forest(fps, int(slot) // 16, max_bits, split)
        return []

    def out(links):
        a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    def run(it):
        held = None                                     # rows of the last, perhaps unfinished, run
        for batch in it:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            slot, key, pair, side, fp = cols
            n = len(slot)
            if not n:
                continue
            new = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            edges = np.concatenate([[0], new])
            held = [c[edges[-1]:] for c in cols]
            links = _runs(slot, side, fp, np.concatenate([edges[:-1], edges[-1:]]), flush)
            if links:
                yield out(links)
        if held is not None and len(held[0]):
            links = _runs(*[held[i] for i in (0, 3, 4)], np.array([0, len(held[0])]), flush)
            if links:
                yield out(links)

    def _runs(slot, side, fp, edges, flush):
        """Links of all runs between consecutive edges; runs of two are compared together."""
        links: list[tuple[int, int]] = []
        fp = fp.view(np.uint64)
        size = np.diff(edges)
        first = edges[:-1]
        two = first[(size == 2)]
        two = two[(side[two] == 2) | (side[two] != side[two + 1])]
        near = two[_within(fp[two] ^ fp[two + 1], slot[two] // 16, max_bits)]
        links += zip(fp[near].tolist(), fp[near + 1].tolist())
        for i in np.flatnonzero(size > 2).tolist():
            s = slice(first[i], first[i] + size[i])
            links += flush(slot[first[i]], fp[s], side[s])
        return links

    return run


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``max_bits`` bits."""
    keys = staged(_keys(nodes, max_bits), "keys")
    sizes = keys.groupBy("slot", "key").agg(F.count("*").alias("n"))
    shared = staged(sizes.where("n > 1"), "shared")
    members = keys.join(shared, ["slot", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # side 2: compared with each other; sides 0 and 1: with the other side only
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        (F.least(o, mine) * blocks + F.greatest(o, mine)).alias("pair"),
        F.when(o == mine, 2).when(mine < o, 0).otherwise(1).cast("int").alias("side")))
    dealt = (members.withColumn("o", F.explode(others)).select("slot", "key", "o.pair", "o.side", "fp")
             .repartition("slot", "key", "pair").sortWithinPartitions("slot", "key", "pair", "side", "fp"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return map_arrow(dealt, _compare(max_bits), schema)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, ``fp``, ``component_id`` and ``n_in_group``.

    ``component_id`` is the smallest id among the rows whose fingerprints are
    reachable over links of at most ``max_bits`` differing bits.
    """
    names = (id_col, *keep)
    fps = staged(fingerprints(docs, text_col, shingle, names), "fps")
    nodes = staged(fps.groupBy("fp").agg(F.min("k0").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    member = staged(joined, "member")
    groups = staged(member.groupBy("root").agg(F.min("least").alias("component_id"),
                                               F.sum("n").alias("n_in_group")), "groups")
    by_fp = staged(member.select("fp", "root").join(groups, "root").select("fp", "component_id", "n_in_group"),
                   "by_fp")
    cols = [F.col(f"k{i}").alias(c) for i, c in enumerate(names)]
    return fps.join(by_fp, "fp").select(*cols, "fp", "component_id", "n_in_group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest id.

    Rows that share that id stand in order of their text's hash, and of rows equal in
    both the one whose other columns hash lowest stays; a group without any id keeps the first by hash.
    Columns may have any names.
    """
    rows, codes = coded(docs)
    id_code, text = codes[id_col], codes[text_col]
    marked = rows.withColumn("digest", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    groups = near_groups(marked, id_code, text, shingle, max_bits, keep=("digest",))
    first = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("g")).agg(
        F.min("digest").alias("any_hash"),
        F.min(F.when(F.col(id_code) == F.col("component_id"), F.col("digest"))).alias("own_hash"))
    keepers = staged(first.select(F.col("component_id").alias("_id"),
                                  F.coalesce("own_hash", "any_hash").alias("_hash")).distinct(), "keepers")
    same = F.col(id_code).eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_hash"))
    kept = marked.join(keepers, same, "left_semi")
    return decoded(one_of_each(kept, [id_code, "digest"], codes, [id_code, text]), codes)
