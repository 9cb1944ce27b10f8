"""Connected components by large-star and small-star steps: rounds grow with the logarithm of a component's
size, not with its diameter, and a node of very many edges is summed before each exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.store import Store

MOST_ROUNDS = 100


def least_in_component(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): each node with the least node that it is connected to. Any type with an order will do."""
    store = Store(edges.sparkSession, "stars")
    e = store.written(edges.toDF("a", "b").where("a is not null and b is not null"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    links = store.written(e.where("a <> b").select(F.greatest("a", "b").alias("far"), F.least("a", "b").alias("near")).distinct())
    kept, before = store.passing.pop(0), None
    for _ in range(MOST_ROUNDS):
        ends = links.unionAll(links.select(F.col("near").alias("far"), F.col("far").alias("near")))
        least = ends.groupBy("far").agg(F.min("near").alias("near")).select(F.col("far").alias("hub"), F.least("far", "near").alias("least"))
        spread = ends.join(least, F.col("far") == F.col("hub")).where("near > far").select(F.col("near").alias("far"), F.col("least").alias("near")).distinct()
        lows = spread.groupBy("far").agg(F.min("near").alias("least")).withColumnRenamed("far", "hub")
        drawn = spread.join(lows, F.col("far") == F.col("hub")).where("near <> least").select(F.col("near").alias("far"), F.col("least").alias("near"))
        old = list(store.passing)
        links = store.written(drawn.unionAll(lows.select(F.col("hub").alias("far"), F.col("least").alias("near"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("far", "near"))).head()
        store.drop(*old)
        store.passing = store.passing[-1:]
        if state == before:
            store.passing.append(kept)
            return nodes.join(links, F.col("node") == F.col("far"), "left").select("node", F.coalesce("near", "node").alias("component"))
        before = state
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
