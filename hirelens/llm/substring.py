"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text (its window is 16 bytes: the hash of a
position is the sum of the gear values of the last bytes, each shifted once more,
built by doubling). A word is a chunk's first if the hash at its end is the largest
among the words within ``REACH`` on either side, so a boundary depends on nearby
bytes only: after an insertion the chunks are the same again from the next boundary
on. Chunks have more than REACH words; without a boundary one ends after MAX_WORDS.

A chunk's 64-bit digest is looked up among all chunks; every occurrence but the
first (in order of id, text hash and place) is a repeat. Runs of adjacent repeated
chunks of at least ``min_words`` words are cut from the text. Digests are counted
with a combiner and joined back from stored tables, so a passage that a third of the
rows hold does not gather in one task.

Defined cases: null and empty texts have no chunk, and a null text stays null; rows
equal in id and text are one document (both come out alike; neither is a repeat of
the other); null ids come first; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, map_arrow, staged

WINDOW = 16
REACH = 4
MAX_WORDS = 64
MIN_WORDS = 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 0x6EA2) for b in range(256)], np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), 0x20]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last WINDOW bytes at every position."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    return h


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every chunk (the text's end last) and the number of words of each."""
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    solid = ~blank
    ends = np.flatnonzero(solid & np.append(blank[1:], True))
    if not len(ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(solid & np.append(True, blank[:-1]))
    h = gear_hashes(raw)[ends]
    n = len(h)
    top = np.ones(n, bool)
    for d in range(1, min(REACH, n - 1) + 1):
        top[d:] &= h[d:] > h[:-d]
        top[:-d] &= h[:-d] >= h[d:]
    top[0] = True
    first = np.flatnonzero(top)
    gaps = np.diff(np.append(first, n))
    if gaps.max() > MAX_WORDS:
        first = np.concatenate([np.arange(a, a + g, MAX_WORDS) for a, g in zip(first, gaps)])
    return np.append(starts[first], len(raw)), np.diff(np.append(first, n))


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, start, words, digest): every chunk, with its first byte in the text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()),
                           T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
                           T.StructField("words", T.ShortType()), T.StructField("digest", T.LongType())])
    digest = xxhash.xxh3_64_intdigest

    def run(it):
        for batch in batches(it, "_text"):
            rows, starts, stops, words, digests = [], [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                data = text.as_py() or b""
                cuts, counts = chunks(data)
                if not len(counts):
                    continue
                edges = cuts.tolist()
                digests += [digest(data[a:b].rstrip()) for a, b in zip(edges, edges[1:])]
                rows.append(np.full(len(counts), i))
                starts.append(cuts[:-1])
                stops.append(cuts[1:])
                words.append(counts)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(np.concatenate(starts).astype(np.int32)),
                     pa.array(np.concatenate(stops).astype(np.int32)),
                     pa.array(np.concatenate(words).astype(np.int16)),
                     pa.array(np.array(digests, np.uint64).view(np.int64))], names=schema.names)

    return map_arrow(_keyed(docs, id_col, text_col), run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"),
                       text.alias("_text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])


def repeats(table: DataFrame) -> DataFrame:
    """The rows of a stored chunk table that are not the first occurrence of their digest."""
    place = F.struct("id", "th", "start")
    firsts = table.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = staged(firsts.where(F.col("first") != F.col("last")).select("digest", "first"), "shared")
    return table.join(shared, "digest").where(~place.eqNullSafe(F.col("first"))).drop("first")


def runs(spans: list[tuple[int, int, int]], min_words: int) -> list[tuple[int, int, int]]:
    """Adjacent (start, stop, words) spans joined; those of at least ``min_words`` words."""
    out: list[list[int]] = []
    for a, b, w in sorted(spans):
        if out and out[-1][1] == a:
            out[-1][1], out[-1][2] = b, out[-1][2] + w
        else:
            out.append([a, b, w])
    return [tuple(r) for r in out if r[2] >= min_words]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          min_words: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` without its repeats: id, text, removed_spans, removed_words.

    ``removed_spans`` are byte spans [start, stop) of the UTF-8 text with their words.
    The columns named in ``keep`` follow as k0, k1, ...
    """
    table = staged(chunk_table(docs, id_col, text_col), "chunks")
    cuts = repeats(table).groupBy(F.col("id").alias("_rid"), F.col("th").alias("_rth")).agg(
        F.collect_set(F.struct("start", "stop", "words")).alias("_spans"))
    cuts = staged(cuts.where(F.aggregate("_spans", F.lit(0), lambda s, x: s + x["words"]) >= min_words), "cuts")
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth"))
    joined = _keyed(docs, id_col, text_col, keep).join(cuts, same, "left").drop("_th", "_rid", "_rth")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
                         T.StructField("words", T.LongType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()),
                           T.StructField("removed_spans", T.ArrayType(span)), T.StructField("removed_words", T.LongType()),
                           *[T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]])

    def run(it):
        for batch in batches(it, "_text"):
            out = batch.column(1).to_pylist()
            spans = batch.column(batch.num_columns - 1).to_pylist()
            found: list[list[dict]] = [[] for _ in out]
            for i, s in enumerate(spans):
                hits = runs([(x["start"], x["stop"], x["words"]) for x in s], min_words) if s else []
                if hits:
                    data, at, parts = out[i].encode("utf-8"), 0, []
                    for a, b, _ in hits:
                        parts.append(data[at:a])
                        at = b
                    out[i] = b"".join([*parts, data[at:]]).decode("utf-8")
                    found[i] = [{"start": a, "stop": b, "words": w} for a, b, w in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(found, arrow_span),
                 pa.array([sum(x["words"] for x in f) for f in found], pa.int64()), *batch.columns[2:-1]],
                names=schema.names)

    return map_arrow(joined, run, schema)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
        min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with the shortened texts and, where there is one, their new length."""
    own = tuple(c for c in docs.columns if c not in (id_col, text_col))
    got = dedup(docs, id_col, text_col, min_words, own)
    back = {c: F.col(f"k{i}") for i, c in enumerate(own)} | {id_col: F.col("id"), text_col: F.col("text")}
    if chars_col in own:
        n = F.length("text").cast(docs.schema[chars_col].dataType)
        back[chars_col] = F.when(F.size("removed_spans") > 0, n).otherwise(back[chars_col])
    return got.select(*[back[c].alias(c) for c in docs.columns])
