"""Connected components of a link table by large-star and small-star steps.

Every step is a minimum by node and a join with the links, so a node of very many links is
summed before the exchange, and joined by broadcast. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

MOST_ROUNDS = 60


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links(a, b) -> (id, component): each linked node with the smallest node it can reach."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    now = written(links.select(b.alias("u"), a.alias("v")).where("u <> v").distinct(), label)
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour of a node gets the least of the node's surroundings
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), label)
        large = join_counted(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself get the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small.select("u", F.col("m").alias("v"))).distinct(), label)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.bit_xor(F.xxhash64("v", "u"))).head()
        if state == before:
            ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"no fixpoint of the components within {MOST_ROUNDS} rounds")
