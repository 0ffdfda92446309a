"""C5/C6 with dictionaries of any size: aliases are joined with the texts, not tested one by one.

An alias of ASCII letters alone must equal a whole run of letters, so such aliases equijoin the distinct
letter runs of the texts. Any other alias is a substring; it is filed under one of its grams (GRAM
characters, or all of a shorter alias), the one that the fewest texts hold, and joins the distinct
grams of the texts. The pairs found so are tested on the whole text. Work follows
the texts and the pairs that share a rare gram, not texts x aliases.

Texts equal after lower-casing are one text throughout. A null or empty text has no hits,
an empty alias hits nothing; rows with the same id share their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.tags import letter_runs
from hirelens.session import work_root

GRAM = 3


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct runs of ``n`` characters; shorter texts have none."""
    # a look ahead at n characters, then one character on: a single pass, and the runs overlap
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def _pieces(text: Column, sizes: list[int]) -> Column:
    """All grams of the given sizes, those that aliases are filed under."""
    return F.flatten(F.array(*[grams(text, n) for n in sizes]))


def hits(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical), distinct: the dictionary entries that a row's text hits.

    ``aliases`` has columns canonical and alias (lower case).
    """
    work_root(texts.sparkSession)
    known = aliases.where(F.length("alias") > 0).select("canonical", "alias").distinct()
    blob = F.lower(F.col(text_col))
    rows = texts.where(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.xxhash64(blob).alias("h1"), F.md5(blob).alias("h2"), blob.alias("blob"))
    owners = rows.select("id", "h1", "h2").distinct()
    whole = rows.groupBy("h1", "h2").agg(F.first("blob").alias("blob")).checkpoint()
    is_word = F.col("alias").rlike(r"\A[a-z]+\z")

    runs = whole.select("h1", "h2", F.explode(F.array_distinct(letter_runs(F.col("blob")))).alias("alias"))
    words = runs.join(known.where(is_word), "alias").select("h1", "h2", "canonical")

    # the grams that aliases hold, by how many texts hold them
    parts = known.where(~is_word).select("alias").distinct().checkpoint()
    size = F.least(F.length("alias"), F.lit(GRAM))
    sized = {n: F.when(size == n, grams(F.col("alias"), n)) for n in range(1, GRAM + 1)}
    filed = parts.select("alias", F.explode(F.coalesce(*sized.values())).alias("gram"))
    wanted = filed.select("gram").distinct()
    sizes = sorted(r[0] for r in parts.select(size).distinct().collect()) or [GRAM]    # GRAM numbers at most
    seen = (whole.select("h1", "h2", F.explode(_pieces(F.col("blob"), sizes)).alias("gram"))
            .join(wanted, "gram", "left_semi").checkpoint())
    texts_with = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (filed.join(texts_with, "gram", "left").groupBy("alias")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    pairs = seen.join(rarest, "gram").select("h1", "h2", "alias")
    found = (pairs.join(whole, ["h1", "h2"]).where(F.instr(F.col("blob"), F.col("alias")) > 0)
             .select("h1", "h2", "alias").join(known, "alias").select("h1", "h2", "canonical"))
    per_text = words.union(found).distinct()
    return owners.join(per_text, ["h1", "h2"]).select(F.col("id").alias(id_col), "canonical").distinct()
