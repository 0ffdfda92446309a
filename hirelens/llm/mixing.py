"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of all words by its weight, at most ``max_repeat`` times its
own size; what a source cannot take is shared again by weight among the others. That
fixed point is found in closed form: with the sources in order of size / weight, the
full ones come first, and the level of the first that is not full holds for the rest
(after it the running level only falls).

A source whose target is r times its size takes floor(r) whole copies of every
document for certain. The rest, f = r - floor(r), is a Pareto order sample: with u
uniform (from a hash of the document), the documents are ranked by
(u / (1 - u)) / (f / (1 - f) * a), random odds over inclusion odds, and those ranked
first are taken until their words meet the rest of the target. ``a`` makes
the inclusion unequal; by default it is words / (words + 100), so that scraps of text
are rarer in the mix than full texts. The sample's size is fixed in words: the order
is cut where the sum is nearest to the target.

The order is never sorted as a whole. Rank values are counted in 1024 bins per
source; only the bin that holds the cut is opened, again in 1024 bins, and what is
left there is ranked. A source with a third of all rows is summed before any shuffle.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source
of its own, after all others; rows equal in id and text rank together and are taken
in some order; a source without words has target 0; an empty table gives no rows.
Only DataFrame functions run here. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import coded, decoded, one_of_each, staged

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BINS = 1024
LEVELS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, source_size, target, whole, part) of a (src, source_size) table, one row per source."""
    by_code_point = Window.orderBy(F.col("src").asc_nulls_last())
    n = F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).cast("double")
    filling = Window.orderBy("full", F.col("src").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = (max_repeat * F.col("source_size")).cast("double")
    t = (sizes.withColumn("w", w).withColumn("cap", cap).withColumn("full", F.col("cap") / F.col("w"))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(after))
         .withColumn("open", F.when(F.col("full") > F.col("level"), F.col("level"))))
    settled = F.max("open").over(Window.partitionBy(F.lit(0)))
    t = t.withColumn("settled", settled).withColumn("target", F.when(F.col("open").isNull(), F.col("cap"))
                                                    .otherwise(F.col("w") * F.col("settled")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return t.select("src", "source_size", "target", F.floor(ratio).alias("whole"),
                    (ratio - F.floor(ratio)).alias("part"))


def _prefix(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the bin of each level that holds the cut, and what remains to take inside it.

    ``ranked`` has (src, size, t) with t in [0, 1); ``plan`` has (src, rest).
    """
    cut = plan.select("src", F.lit(0).cast("long").alias("bin"), F.col("rest"))
    for level in range(1, LEVELS + 1):
        fine = F.floor(F.col("t") * float(BINS ** level)).cast("long")
        inside = (ranked.withColumn("fine", fine)
                  .join(cut, ranked["src"].eqNullSafe(cut["src"])
                        & (F.floor(F.col("fine") / BINS) == F.col("bin")))
                  .select(ranked["src"], "fine", "size"))
        sums = inside.groupBy("src", "fine").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("src").orderBy("fine"))
        found = (sums.withColumn("upto", upto).alias("s")
                 .join(cut.alias("c"), F.col("s.src").eqNullSafe(F.col("c.src")))
                 .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
                 .select("s.src", F.col("s.fine").alias("bin"),
                         (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest")))
        # every document fits: the cut lies behind the last bin
        last = F.lit(BINS ** level).cast("long")
        cut = staged(cut.alias("c").join(found.alias("f"), F.col("c.src").eqNullSafe(F.col("f.src")), "left")
                     .select(F.col("c.src").alias("src"), F.coalesce("f.bin", last).alias("bin"),
                             F.coalesce("f.rest", F.lit(-1.0)).alias("rest")), "cut")
    return cut


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
        inclusion: Column | None = None) -> DataFrame:
    """(id, th, src, size, source_size, target, copies, taken) for every row of ``docs``.

    ``copies`` is how often the mix holds the document, ``taken`` its words there.
    ``inclusion`` is a positive weight of a document's odds over its ``size``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("src"),
                       word_count(F.col(text_col)).alias("size"), F.md5(text).alias("th"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), "th"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    base = staged(base.withColumn("u", u), "sizes")
    plan = staged(targets(base.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_repeat)
                  .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    a = F.col("size") / (F.col("size") + 100.0) if inclusion is None else inclusion
    known = (base.join(plan, base["src"].eqNullSafe(plan["src"]))
             .select("_id", "th", base["src"], "size", "u", "source_size", "target", "whole", "part", "rest"))
    odds = F.col("part") / (1.0 - F.col("part")) * a
    q = (F.col("u") / (1.0 - F.col("u"))) / odds
    sampled = (F.col("size") > 0) & (F.col("part") > 0)
    known = staged(known.withColumn("t", F.when(sampled, q / (1.0 + q)))
                   .withColumn("t", F.when(F.col("t") >= 1.0, 1.0 - 2.0 ** -53).otherwise(F.col("t"))), "ranked")
    ranked = known.where("t IS NOT NULL").select("src", "size", "t")
    cut = _prefix(ranked, plan.where("rest > 0").select("src", "rest"))
    fine = F.floor(F.col("t") * float(BINS ** LEVELS)).cast("long")
    marked = (known.alias("k").join(cut.select(F.col("src").alias("csrc"), F.col("bin"), F.col("rest").alias("left")),
                                    F.col("k.src").eqNullSafe(F.col("csrc")) & F.col("k.t").isNotNull(), "left")
              .withColumn("fine", fine))
    order = ["t", F.col("_id").asc_nulls_first(), "th"]
    upto = F.sum("size").over(Window.partitionBy("src").orderBy(*order)
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cols = ["_id", "th", "src", "size", "source_size", "target", "whole"]
    edge = (marked.where("fine = bin").withColumn("upto", upto)
            .select(*cols, (2 * F.col("upto") - F.col("size") <= 2 * F.col("left")).alias("more")))
    rest = marked.where("fine IS NULL OR bin IS NULL OR fine <> bin").select(
        *cols, F.coalesce(F.col("fine") < F.col("bin"), F.lit(False)).alias("more"))
    copies = (F.col("whole") + F.col("more").cast("long")).cast("long")
    return rest.union(edge).select(
        F.col("_id").alias(id_col), "th", "src", "size", "source_size", "target",
        F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"),
        (F.when(F.col("size") > 0, copies).otherwise(0) * F.col("size")).cast("long").alias("taken"))


def expand(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           **params) -> DataFrame:
    """The mixed rows of ``docs`` themselves, each as often as the mix takes it.

    Of rows equal in id, source and text the one whose other columns hash lowest stands for
    all, as often as all are taken. Columns may have any names.
    """
    rows, codes = coded(docs)
    id_code, text, source = codes[id_col], codes[text_col], codes[source_col]
    got = mix(rows, id_code, text, source, **params).where("copies > 0")
    got = got.groupBy(F.col(id_code).alias("_mid"), F.col("src").alias("_msrc"), F.col("th").alias("_mth")).agg(
        F.sum("copies").alias("copies"))
    keyed = rows.withColumn("digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    keyed = one_of_each(keyed, [id_code, source, "digest"], codes, [id_code, source, text])
    same = (F.col(id_code).eqNullSafe(F.col("_mid")) & F.col(source).eqNullSafe(F.col("_msrc"))
            & (F.col("digest") == F.col("_mth")))
    repeated = keyed.join(got, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return decoded(repeated, codes)


#: The same rules in DuckDB: the order is sorted as a whole there.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS src, coalesce(text, '') AS txt,
         len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::BIGINT AS size,
         md5(coalesce(text, '')) AS th
  FROM documents),
u AS (
  SELECT *, (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || th), 1, 13))::BIGINT + 0.5::DOUBLE)
            / 4503599627370496::DOUBLE AS u FROM d),
s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY src),
l AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / w AS f,
         ((sum(source_size) OVER ())::DOUBLE
          - coalesce(sum((3 * source_size)::DOUBLE) OVER (ORDER BY (3 * source_size)::DOUBLE / w, src NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, src NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM s),
o AS (SELECT *, CASE WHEN f > lvl THEN lvl END AS op FROM l),
t AS (
  SELECT src, source_size, CASE WHEN op IS NULL THEN cap ELSE w * max(op) OVER () END AS target FROM o),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM t),
k AS (
  SELECT u.*, r.source_size, r.target, floor(r.ratio) AS whole, r.ratio - floor(r.ratio) AS part
  FROM u JOIN r ON u.src IS NOT DISTINCT FROM r.src),
q AS (
  SELECT *, (u / (1.0::DOUBLE - u)) / (part / (1.0::DOUBLE - part) * (size / (size + 100.0::DOUBLE))) AS q
  FROM k WHERE size > 0 AND part > 0),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY src ORDER BY q / (1.0::DOUBLE + q), doc_id NULLS FIRST, th
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
UNION ALL
SELECT doc_id, size, source_size, target, (size * whole)::BIGINT FROM k WHERE NOT (size > 0 AND part > 0)
"""
