"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of
its hashed words and word beginnings; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are known, so the gradient of the document's
log-likelihood goes back through the noisy-or to the sentences, which teaches the
model which sentences carry the label. The same sentence scores then locate them.

The model is fitted on a bounded sample (``sample_size`` labelled rows, half of them
at most positive, in order of a hash of the id; the loss weighs the classes back to
their share). Scoring covers every row.

Defined cases: a null or empty text has no sentence and scores 0; a document with
several labels counts as toxic if one says so; null labels and labels of a null id
teach nothing; repeated rows score alike; with no labelled document of one of the
two kinds all scores are the share of the other (0 without any label). Only the id
and text columns are read, and others returned if they are to be kept.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, map_arrow, staged

BITS = 18
SAMPLE_SIZE = 12_000
MIN_DOCS = 4                    # a feature seen in fewer sample documents has weight 0
SCREEN = 3.0                    # standard errors by which a feature's shares must differ
BEGINNINGS = (4, 5, 6)          # lengths of the word beginnings that are features
CACHE_ENTRIES = 100_000         # word scores kept per Python worker
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    parts = [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    constant: float | None = None       # score of every text, if there was nothing to learn
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "constant": self.constant, "cache": {}}

    def word(self, w: str) -> float:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            got = self.cache[w] = float(self.weights[word_features(w)].sum())
        return got

    def sentences(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Probability and span (code points) of every sentence with a word."""
        spans, sums, score = [], [], self.word
        for m in SENTENCE.finditer(text):
            words = WORD.findall(m[0].lower())
            if words:
                spans.append(m.span())
                sums.append(sum(map(score, words)))
        z = np.clip(np.array(sums) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z)), spans

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or score of a text and its offending sentences (probability 0.5 or more)."""
        if self.constant is not None:
            return self.constant, []
        p, spans = self.sentences(text)
        if not len(p):
            return 0.0, []
        doc = -np.expm1(np.log1p(-p).sum())
        return float(min(1.0, max(0.0, doc))), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def fit(labels: np.ndarray, weights: np.ndarray, sentences: np.ndarray, lengths: np.ndarray,
        features: np.ndarray, epochs: int = 150, rate: float = 0.15, ridge: float = 2e-5) -> Model:
    """Noisy-or model by full-batch Adam.

    Document i has ``sentences[i]`` sentences and the loss weight ``weights[i]``; sentence j
    has ``lengths[j]`` of the ``features``, in order.
    """
    y = labels.astype(bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    used, cols = np.unique(features, return_inverse=True)
    n_docs, n_sent = len(y), len(lengths)
    doc_of = np.repeat(np.arange(n_docs), sentences)
    rows = np.repeat(np.arange(n_sent), lengths)
    w, b = np.zeros(len(used)), -6.0
    mom, var = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    weights = weights / weights.sum()
    for step in range(1, epochs + 1):
        z = np.clip(np.bincount(rows, w[cols], n_sent) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc_of, np.log1p(-p), n_docs)            # log P(no sentence is toxic)
        doc = np.clip(-np.expm1(none), 1e-12, 1)
        g = np.where(y[doc_of], -p * np.exp(none)[doc_of] / doc[doc_of], p) * weights[doc_of]
        grad = np.append(np.bincount(cols, g[rows], len(used)) + ridge * w, g.sum())
        mom = 0.9 * mom + 0.1 * grad
        var = 0.99 * var + 0.01 * grad * grad
        move = rate * (mom / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.99 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return Model(full, float(b))


def _sentence_features(text: str) -> list[np.ndarray]:
    """Features of every sentence that has a word."""
    found = (WORD.findall(m[0].lower()) for m in SENTENCE.finditer(text))
    return [np.array([f for w in words for f in word_features(w)], np.int32) for words in found if words]


def _document_counts(it):
    """(y, feature, docs) of the documents of each batch."""
    for batch in batches(it, "_text"):
        seen = np.zeros((2, 1 << BITS), np.int32)
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = _sentence_features(text or "")
            if rows:
                seen[y, np.unique(np.concatenate(rows))] += 1
        y, f = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(f.astype(np.int32)),
                                          pa.array(seen[y, f].astype(np.int64))], names=["y", "feature", "docs"])


def _selected(wanted):
    """(id, y, lengths, features) of every document, with the ``wanted`` features only."""
    def run(it):
        keep = wanted.value
        for batch in batches(it, "_text"):
            lengths, feats = [], []
            for text in batch.column(1).to_pylist():
                rows = [r[keep[r]] for r in _sentence_features(text or "")]
                lengths.append(np.array([len(r) for r in rows], "<i4").tobytes())
                feats.append(b"".join(r.astype("<i4").tobytes() for r in rows))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(lengths, pa.binary()),
                                              pa.array(feats, pa.binary())], names=["id", "y", "lengths", "features"])
    return run


def screen(docs_with: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Features whose share of documents differs clearly (SCREEN standard errors) between the kinds."""
    share = docs_with / np.maximum(1, kinds)[:, None]
    pooled = docs_with.sum(axis=0) / max(1, kinds.sum())
    error = np.sqrt(pooled * (1 - pooled) * (1 / np.maximum(1, kinds)).sum()) + 1e-12
    return (docs_with.sum(axis=0) >= MIN_DOCS) & (np.abs(share[1] - share[0]) >= SCREEN * error)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", sample_size: int = SAMPLE_SIZE) -> Model:
    """Model from at most ``sample_size`` rows that have a label and fulfil ``usable`` (over the id).

    The features of the sample are found on the executors; the driver receives document
    counts of the hashed features and, per document, the screened features only.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .where(F.lit(True) if usable is None else usable)
             .groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col)) > 0).cast("int").alias("_y")))
    order = [F.xxhash64("_id"), "_id"]
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    sides = [known.where(F.col("_y") == y).orderBy(*order).limit(sample_size // 2) for y in (0, 1)]
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = staged(picked.join(sides[0].union(sides[1]), "_id").groupBy("_id", "_y").agg(
        F.min("_text").alias("_text")).select("_y", "_text", "_id"), "labelled")
    counts = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("feature", T.IntegerType()),
                           T.StructField("docs", T.LongType())])
    table = (map_arrow(sample, _document_counts, counts).groupBy("y", "feature").agg(F.sum("docs").alias("docs"))
             .toArrow())
    docs_with = np.zeros((2, 1 << BITS))
    docs_with[table["y"].to_numpy(), table["feature"].to_numpy()] = table["docs"].to_numpy()
    kinds = np.zeros(2)
    for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect():
        kinds[r["_y"]] = r["n"]
    wanted = docs.sparkSession.sparkContext.broadcast(screen(docs_with, kinds))
    fields = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()),
                           T.StructField("lengths", T.BinaryType()), T.StructField("features", T.BinaryType())])
    rows = map_arrow(sample, _selected(wanted), fields).orderBy("id").select("y", "lengths", "features").toArrow()
    y = rows["y"].to_numpy().astype(int)
    lengths = [np.frombuffer(x or b"", "<i4") for x in rows["lengths"].to_pylist()]
    flat = np.frombuffer(b"".join(rows["features"].to_pylist()), "<i4")
    share = np.array([n.get(k, 0) for k in (0, 1)]) / np.maximum(1, kinds)
    return fit(y, share[y] if len(y) else np.ones(0), np.array([len(x) for x in lengths], np.int64),
               np.concatenate([np.zeros(0, np.int32), *lengths]).astype(np.int64), flat)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """(id, score, offending): ``offending`` are the spans (code points) of toxic sentences.

    With ``keep``, also the row's text and those columns.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("offending", T.ArrayType(span))])
    kept = [] if keep is None else [text_col, *keep]
    for c in kept:
        schema.add(T.StructField(c, docs.schema[c].dataType))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(it):
        m = shared.value
        for batch in batches(it, "_text"):
            got = [m.score(t or "") for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(spans, arrow_span),
                 *(batch.columns[1:] if kept else [])],
                names=schema.names)

    others = [F.col(c) for c in kept[1:]]
    return map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *others), run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text is divisible by five (so is a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
