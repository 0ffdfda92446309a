"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Code points become classes by
one array lookup (plus a comparison with the next characters), and a class is a
transition function on the eight states of a small automaton. Such functions
compose associatively, so the state before every character comes from a scan: all
blocks of a text compose their functions side by side, a doubling scan joins the
blocks, and a last pass replays each block from its known first state. A pair
(state, class) says whether a token starts there.

The slices between starts are merged pair by pair, lowest rank first, behind a
cache; each id's byte offset is kept, and decoding is one gather by those offsets.

Defined cases: a null text is an empty text, with no ids; repeated rows give
repeated results; only the id and the text column are read, so other columns,
whatever their names, neither matter nor are returned.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, map_arrow

# character classes
LETTER, DIGIT, OTHER, SPACE_LAST, BLANK_LAST, BLANK, APO1, APO2, RESET = range(9)
# states: what the token so far is, or (FRESH) that a token starts now
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, LEAD_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
N_STATES = 8

# The White_Space code points, and the endings after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")

CACHE_ENTRIES = 200_000     # distinct slices kept per Python worker; then the cache starts anew
CACHED_CHARS = 64           # longer slices are merged without being cached
DECODED_IDS = 1 << 16       # ids decoded by one gather, whatever the length of the text


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", both flat, at class * N_STATES + state."""
    nxt = np.zeros((9, N_STATES), np.intp)
    start = np.ones((9, N_STATES), bool)
    runs = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER, BLANK: IN_BLANKS}
    for cls, run in runs.items():
        nxt[cls] = run
        start[cls, run] = False
        if cls != BLANK:                        # one space joins the run after it
            start[cls, LEAD_SPACE] = False
    nxt[LETTER, ONE_MORE], nxt[LETTER, TWO_MORE] = FRESH, ONE_MORE
    start[LETTER, [ONE_MORE, TWO_MORE]] = False
    nxt[SPACE_LAST], nxt[BLANK_LAST], nxt[RESET] = LEAD_SPACE, FRESH, FRESH
    for cls, rest in ((APO1, ONE_MORE), (APO2, TWO_MORE)):
        nxt[cls] = rest
        nxt[cls, [IN_OTHER, LEAD_SPACE]] = IN_OTHER     # there it is one more symbol of a run
        start[cls, [IN_OTHER, LEAD_SPACE]] = False
    return nxt.ravel(), start.ravel()


@functools.cache
def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                        np.uint8, 0x110000)
    table[WHITE_SPACE] = BLANK
    return table


def classes(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Class of every code point; ``resets`` are the positions between texts."""
    cls = _class_table()[points]
    cls[resets] = RESET
    follow = np.full(len(cls), RESET, np.uint8)
    follow[:-1] = cls[1:]
    last = (cls == BLANK) & (follow != BLANK) & (follow != RESET)
    cls[last] = np.where(points[last] == 0x20, SPACE_LAST, BLANK_LAST)
    apo = np.flatnonzero(points == 0x27)
    if len(apo):
        p = np.concatenate([points, np.zeros(2, points.dtype)])
        gap = np.concatenate([cls, [RESET, RESET]]) == RESET
        one = np.isin(p[apo + 1], [ord(c) for c in ENDINGS_1]) & ~gap[apo + 1]
        two = np.zeros(len(apo), bool)
        for a, b in ENDINGS_2:
            two |= (p[apo + 1] == ord(a)) & (p[apo + 2] == ord(b))
        two &= ~gap[apo + 1] & ~gap[apo + 2]
        cls[apo[one]] = APO1
        cls[apo[two]] = APO2
    return cls


def token_starts(cls: np.ndarray, block: int = 64) -> np.ndarray:
    """Positions where a token starts, by a scan over the classes' transition functions."""
    nxt, start = _automaton()
    n = len(cls)
    n_blocks = -(-n // block)
    padded = np.full(n_blocks * block, RESET, np.uint8)
    padded[:n] = cls
    rows = np.ascontiguousarray(padded.reshape(n_blocks, block).T) * N_STATES
    fns = np.tile(np.arange(N_STATES), (n_blocks, 1))
    for row in rows:                                    # each block's composed function
        fns = nxt[row[:, None] + fns]
    step = 1
    while step < n_blocks:                              # inclusive scan over the blocks
        joined = fns.copy()
        joined[step:] = np.take_along_axis(fns[step:], fns[:-step], axis=1)
        fns, step = joined, step * 2
    state = np.full(n_blocks, FRESH, np.intp)
    state[1:] = fns[:-1, FRESH]
    starts = np.empty((block, n_blocks), bool)
    for k, row in enumerate(rows):
        at = row + state
        starts[k] = start[at]
        state = nxt[at]
    return np.flatnonzero(starts.T.ravel()[:n])


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Per text its slices, each of which is merged separately."""
    if not texts:
        return
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = token_starts(classes(points, ends))
    cuts = np.searchsorted(starts, ends)                # a separator always starts a token
    starts = starts.tolist()
    first = 0
    for cut in cuts.tolist():
        edges = starts[first:cut + 1]
        yield [joined[a:b] for a, b in zip(edges, edges[1:])]
        first = cut + 1


class Vocabulary:
    """Ranks of byte strings; a rank is the id."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.places = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        held = np.zeros(int(lengths.sum()), np.uint8)
        for token, rank in self.ranks.items():
            held[self.places[rank]:self.places[rank] + len(token)] = np.frombuffer(token, np.uint8)
        self.held = held
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i:i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long slices: a heap of pairs and links between the parts, n log n."""
        import heapq
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))                     # part starting at i ends here; 0: gone
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1)
                if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] == n or not end[end[i]] or end[end[i]] != stop:
                continue                                # one of the two has changed since
            end[end[i]], end[i] = 0, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i]:stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        cache, merge = self.cache, self.merge
        for pieces in slices(texts):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            ids = list(map(cache.get, pieces))
            for i, got in enumerate(ids):
                if got is None:
                    p = pieces[i]
                    ids[i] = got = array("I", merge(p.encode("utf-8", "replace"))).tobytes()
                    if len(p) <= CACHED_CHARS:
                        cache[p] = got
            yield np.frombuffer(b"".join(ids), np.uint32)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First byte of every id's token in the text."""
        ends = np.cumsum(self.lengths[ids])
        return np.concatenate([[0], ends[:-1]])[:len(ids)].astype("<u8")

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the ids, each put at its offset: one gather per DECODED_IDS ids."""
        out = []
        for i in range(0, len(ids), DECODED_IDS):
            some = ids[i:i + DECODED_IDS]
            at = offsets[i:i + DECODED_IDS].astype(np.int64)
            where = np.repeat(self.places[some] - (at - at[0]), self.lengths[some])
            where += np.arange(len(where))
            out.append(self.held[where].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids, offsets) of every row: little-endian 32-bit ids and 64-bit byte offsets."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.BinaryType()),
                           T.StructField("offsets", T.BinaryType())])

    def run(it):
        voc = vocabulary(ranks_path)
        for batch in batches(it, "_text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = list(voc.encode(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g.astype("<u4").tobytes() for g in got], pa.binary()),
                 pa.array([voc.offsets(g).tobytes() for g in got], pa.binary())],
                names=[id_col, "ids", "offsets"])

    return map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded) of rows as ``encode`` returns them; ``decoded`` is binary."""
    id_type = encoded.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.BinaryType()),
                           T.StructField("decoded", T.BinaryType())])

    def run(it):
        voc = vocabulary(ranks_path)
        for batch in batches(it, "_ids"):
            out = []
            for ids, offsets in zip(batch.column(1), batch.column(2)):
                out.append(voc.decode(np.frombuffer(ids.as_buffer() or b"", "<u4"),
                                      np.frombuffer(offsets.as_buffer() or b"", "<u8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             names=[id_col, "ids", "decoded"])

    return map_arrow(encoded.select(F.col(id_col).alias("_id"), F.col("ids").alias("_ids"),
                                    F.col("offsets").alias("_offsets")), run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Both directions run in one pass, so a task needs one Python worker and neither the ids
    nor the decoded bytes leave it.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def run(it):
        voc = vocabulary(ranks_path)
        for batch in batches(it, "_text"):
            counts, ids_sha, decoded_sha = [], [], []
            for ids in voc.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(voc.decode(ids, voc.offsets(ids))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema)
