"""Quality rules whose cutoffs are chosen with a risk guarantee.

Counts of every text give a few rule values (symbols a word, share of repeated lines,
share of repeated words, mean word length from above and below). A rule rejects a
text whose value lies above its cutoff; each stratum has a cutoff of its own, chosen on
labelled good documents of that stratum, none of which was used for anything else.

For a cutoff that rejects k of n good documents, the exact binomial test of "it
rejects more than alpha of them" has the p-value P(Bin(n, alpha) <= k). A rule's cutoffs are
tested from the loosest to the strictest and the testing stops at the first that fails
(fixed sequence), at level delta / (strata * rules) (Bonferroni), with
alpha = risk / rules. So with probability 1 - delta, in every stratum at once, all rules
together falsely reject at most ``risk`` of the good documents that pass the base rules. A
rule without an accepted cutoff rejects nothing.

Defined cases: a null text has no words; a null stratum value is a stratum of its own;
without good labels nothing but the base rules rejects; a document with several labels is
good if none says otherwise; repeated rows get equal rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, map_arrow, staged

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RISK = 0.05
DELTA = 0.05
STEPS = 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rule, its value, its loosest and its strictest cutoff.
RULES = (
    ("symbols", "try_divide(n_symbols, n_words)", 1.0, 0.02),
    ("dup_lines", "try_divide(n_dup_lines, n_lines)", 0.6, 0.02),
    ("repeats", "try_divide(n_repeat_words, n_words)", 0.2, 0.01),
    ("long_words", "try_divide(word_chars, n_words)", 16.0, 6.5),
    ("short_words", "-try_divide(word_chars, n_words)", -1.5, -4.5),
)


def cutoffs(loose: float, strict: float) -> list[float]:
    return [loose + (strict - loose) * i / (STEPS - 1) for i in range(STEPS)]


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    size = len(ids)
    key, span = w[:n].copy(), size
    for k in range(1, width):
        if span * size >= 1 << 62:                      # number the keys anew, so that none overflows
            _, key = np.unique(key, return_inverse=True)
            span = int(key.max()) + 1
        key = key * size + w[k:n + k]
        span *= size
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; ``n_lines`` are the lines with a word."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), len(joined.decode("utf-8")), len(data) - len(data.translate(None, SYMBOLS)),
            dup, repeat_words(words), lines)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, COUNTS, base_failed) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("stratum", docs.schema[stratum_col].dataType),
                           *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(it):
        for batch in batches(it, "_text"):
            rows = np.array([counts(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                              *[pa.array(rows[:, i]) for i in range(len(COUNTS))]],
                                             names=schema.names)

    got = map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("_stratum"),
                                F.col(text_col).alias("_text")), run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed down from its largest term."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    at = min(k, int(n * p))
    log = (math.lgamma(n + 1) - math.lgamma(at + 1) - math.lgamma(n - at + 1)
           + at * math.log(p) + (n - at) * math.log1p(-p))
    top = math.exp(log)
    total, term = top, top
    for i in range(at, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    term = top
    for i in range(at + 1, k + 1):
        term *= (n - i + 1) / i * p / (1 - p)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)



def certify(measured: DataFrame, good_ids: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, trials, needed, cut): the cutoff certified for a rule in a stratum, null if none is.

    A good document is one trial of its stratum, whatever the number of its rows; it counts as
    rejected if one of them is. ``needed`` trials without a rejection would certify the loosest cutoff.
    """
    good = measured.join(good_ids, measured["id"] == good_ids["gid"], "left_semi").where("NOT base_failed")
    over = []
    for name, value, loose, strict in RULES:
        v = F.expr(f"double({value})")
        # how many cutoffs, from the strictest one, reject the document
        over.append(F.max(sum((v > F.lit(c)).cast("int") for c in cutoffs(loose, strict))).alias(name))
    trials = good.groupBy("stratum", "id").agg(*over)
    steps = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("over")) for name, *_ in RULES]
    per = (trials.select("stratum", F.explode(F.array(*steps)).alias("s"))
           .groupBy("stratum", "s.rule", "s.over").agg(F.count("*").alias("docs")))
    per = staged(per, "risk-counts")
    whole = Window.partitionBy("stratum", "rule")
    # step i (0: loosest) rejects the documents that at least STEPS - i cutoffs reject
    at_least = F.sum("docs").over(whole.orderBy(F.desc("over")))
    sums = per.select("stratum", "rule", "over", at_least.alias("hit"), F.sum("docs").over(whole).alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))
    grid = sums.select("stratum", "rule", "n").distinct().withColumn("step", step).alias("g").join(
        sums.alias("h"), F.col("g.stratum").eqNullSafe(F.col("h.stratum")) & (F.col("g.rule") == F.col("h.rule"))
        & (F.col("h.over") >= STEPS - F.col("g.step")), "left").groupBy("g.stratum", "g.rule", "g.step", "g.n").agg(
        F.coalesce(F.max("h.hit"), F.lit(0)).alias("k"))
    strata = per.select("stratum").distinct().count()
    level = delta / max(1, strata * len(RULES))
    alpha = risk / len(RULES)

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), alpha) for a, b in zip(k, n)], dtype="float64")

    tested = grid.withColumn("ok", p_value("k", "n") <= level)
    first_bad = tested.groupBy("stratum", "rule").agg(
        F.max("n").alias("trials"), F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(STEPS)).alias("bad"))
    cuts = F.create_map(*[x for name, _, loose, strict in RULES
                          for x in (F.lit(name), F.array(*map(F.lit, cutoffs(loose, strict))))])
    cut = F.when(F.col("bad") > 0, F.element_at(F.element_at(cuts, F.col("rule")), F.col("bad")))
    needed = math.ceil(math.log(level) / math.log1p(-alpha))
    return staged(first_bad.select("stratum", "rule", "trials", F.lit(needed).cast("long").alias("needed"),
                                   cut.alias("cut")), "cutoffs")


def choose(measured: DataFrame, good_ids: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff column per rule; null: the rule is off there)."""
    return certify(measured, good_ids, risk, delta).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == name, F.col("cut"))).alias(f"cut_{name}") for name, *_ in RULES])


def good_documents(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(gid): documents all of whose labels say that they are good."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("gid")).agg(F.min(label_col).alias("q")).where("q > 0").select("gid"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK,
          delta: float = DELTA) -> DataFrame:
    """(id, COUNTS, base_failed, kept, broken): ``broken`` names the rules that rejected a text."""
    measured = staged(measure(docs, id_col, text_col, stratum_col), "measured")
    good = good_documents(labels, id_col, label_col)
    cuts = choose(measured, good, risk, delta).withColumnRenamed("stratum", "_s")
    values = [F.expr(f"double({value})") for _, value, _, _ in RULES]
    over = F.array(*[F.when(v > F.col(f"cut_{name}"), F.lit(name)) for (name, *_), v in zip(RULES, values)])
    out = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("_s")), "left").withColumn(
        "broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(over)))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed",
                      (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")
