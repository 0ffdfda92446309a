"""Connected components of a link table that never leaves the executors.

Alternating star rounds: in a large-star round every node links its larger
neighbours to the smallest neighbour; in a small-star round it links its smaller
neighbours and itself to the smallest one. Both keep components as they are and
end in one star per component, around its smallest node, after about log(n) rounds.

A round is one combined aggregation (smallest neighbour) and one join of two stored
tables, so a node with very many links is summed before the shuffle and its join
partition can be split. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import drop_staged, staged


def _lowest(links: DataFrame) -> DataFrame:
    return staged(links.groupBy("a").agg(F.min("b").alias("m")), "lowest")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; ``root`` is the component's smallest node.

    ``links`` has long columns a and b; direction, repeats and self links do not
    matter, rows with a null are ignored. No links give no rows.
    """
    stars = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star over both directions
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both)
        large = staged(both.join(low, "a").where("b > a")
                       .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large")
        # small star: every row of ``large`` points down already
        low2 = _lowest(large)
        new = large.join(low2, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        old, stars = stars, staged(new, "links")
        for t in (low, large, low2, old):
            drop_staged(t)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
