"""Mining programs: k-means, frequent itemsets, decision trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lattica.store import Store

#: Itemsets: rows of baskets in a task; sets and items of at most so many rows, by count, are broadcast.
BASKET_ROWS, FEW_ROWS = 500_000, 50_000


def kmeans(points: DataFrame, centers: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Lloyd's rounds over points(id, vector) from centers(center, vector): (centers, assignment).

    The centers are a bounded set; they go to all tasks as a literal."""
    def assigned(rows: list) -> DataFrame:
        options = [F.struct(F.aggregate(F.zip_with("vector", F.lit(list(map(float, r.vector))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("distance"), F.lit(r.center).alias("center")) for r in rows]
        return pts.select("id", "vector", (F.least(*options) if len(options) > 1 else options[0])["center"].alias("center"))

    store = Store(points.sparkSession, "kmeans")
    pts = store.written(points.toDF("id", "vector").select("id", F.col("vector").cast("array<double>").alias("vector")))
    rows = sorted(centers.toDF("center", "vector").collect(), key=lambda r: r.center)
    size = len(rows[0].vector)
    for _ in range(rounds):
        means = assigned(rows).groupBy("center").agg(*(F.avg(F.col("vector")[i]).alias(f"m{i}") for i in range(size))).collect()
        new = {r.center: [r[f"m{i}"] for i in range(size)] for r in means}
        after = [Row(center=r.center, vector=new.get(r.center, list(r.vector))) for r in rows]
        done = all(list(map(float, a.vector)) == list(map(float, b.vector)) for a, b in zip(after, rows))
        rows = after
        if done:
            break
    final = points.sparkSession.createDataFrame([(r.center, list(map(float, r.vector))) for r in rows], "center long, vector array<double>")
    return final, assigned(rows).select("id", "center")


def frequent_itemsets(baskets: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """(items, size, support) of every set of items that `support` baskets hold; baskets(basket, item).

    Level by level: candidates join two frequent sets that differ in their last item and are kept only
    if all their subsets are frequent; baskets are reduced to frequent items first. A basket's rows are brought together in
    tasks of about BASKET_ROWS; from then on a set that a basket holds carries the basket's later items, so that longer
    sets are made without another exchange. Sets of a basket are counted as they are made, each level anew
    through the frequent sets below it, and only baskets and frequent sets are written, so a long basket costs time, not room."""
    store = Store(baskets.sparkSession, "itemsets")

    def kept(df: DataFrame) -> tuple[DataFrame, int]:
        df = store.written(df)
        return df, store.count(store.passing[-1])

    def among(df: DataFrame, known: DataFrame, rows: int, on: str) -> DataFrame:
        return df.join(F.broadcast(known) if rows <= FEW_ROWS else known.hint("shuffle_hash"), on, "left_semi")

    def together(df: DataFrame, rows: int) -> DataFrame:
        return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // BASKET_ROWS)), "basket")

    b = baskets.toDF("basket", "item")
    b, rows = kept(together(b, b.count()).distinct())
    level, found = kept(b.groupBy("item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support).select(F.array("item").alias("items"), "support"))
    frequent = among(b.where("basket is not null"), level.select(F.col("items")[0].alias("item")), found, "item")
    whole = store.written(together(frequent, rows).groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("rest")))
    holders = whole.select(F.array().cast(level.schema["items"].dataType).alias("items"), "rest")
    out, size = level, 1

    def longer(df: DataFrame) -> DataFrame:
        more = df.select("items", "rest", F.posexplode("rest").alias("at", "more"))
        return more.select(F.concat("items", F.array("more")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))

    holders = longer(holders).where(F.size("rest") > 0)
    while found and (most is None or size < most):
        x = level.select("items").toDF("x")
        y = level.select("items").toDF("y")
        head = lambda c: F.slice(c, 1, size - 1)
        made = held = longer(holders)
        if size > 1:
            pairs = x.join(y, (head("x") == head("y")) & (F.element_at("x", -1) < F.element_at("y", -1)))
            candidates = pairs.select(F.concat("x", F.slice("y", size, 1)).alias("items"))
            for drop in range(size - 1):
                rest = F.concat(F.slice("items", 1, drop), F.slice("items", drop + 2, size - drop)) if drop else F.slice("items", 2, size)
                candidates = candidates.join(level.select(F.col("items").alias("known")), rest == F.col("known"), "left_semi")
            held = among(held, *kept(candidates), "items")
        size += 1
        level, found = kept(held.groupBy("items").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support))
        holders = among(made.where(F.size("rest") > 0), level.select("items"), found, "items")
        out = out.unionByName(level)
    return out.select("items", F.size("items").alias("size"), "support")


def association_rules(itemsets: DataFrame, confidence: float) -> DataFrame:
    """(body, head, support, confidence) of rules with one item on the right."""
    whole = itemsets.where("size > 1").select("items", "support", F.explode("items").alias("head"))
    whole = whole.select(F.filter("items", lambda x: x != F.col("head")).alias("body"), "head", "support")
    parts = itemsets.select(F.col("items").alias("body"), F.col("support").alias("base"))
    return whole.join(parts, "body").select("body", "head", "support", (F.col("support") / F.col("base")).alias("confidence")).where(F.col("confidence") >= confidence)


def decision_tree(train: DataFrame, label: str, features: list[str], depth: int = 3) -> list[dict]:
    """A tree over categorical features by least Gini impurity (of equals the first feature by name), grown level by
    level. Rows carry the key of their open node; counts by value stay distributed, and only a row for each open
    node and feature reaches the driver. Returns the tree's nodes:
    {path: ((feature, value), ...), feature or None, label, rows}."""
    store = Store(train.sparkSession, "tree")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = store.written(train.select(F.lit("").alias("node"), text(label).alias("y"), F.array(*(F.struct(F.lit(f).alias("f"), text(f).alias("v")) for f in sorted(features))).alias("fv")))
    nodes, paths = [], {"": ()}
    for level in range(depth + 1):
        classes = rows.groupBy("node", "y").count().groupBy("node").agg(F.min_by("y", F.struct(-F.col("count"), "y")).alias("label"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("kinds"))
        values = rows.select("node", "y", F.explode("fv").alias("x")).groupBy("node", "x.f", "x.v", "y").count().groupBy("node", "f", "v").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("squares"))
        impurity: dict[str, list] = {}
        for r in values.groupBy("node", "f").agg((F.sum(F.col("n") - F.col("squares") / F.col("n")) / F.sum("n")).alias("g")).collect():
            impurity.setdefault(r.node, []).append((round(r.g, 12), r.f))
        splits = []
        for r in classes.orderBy("node").collect():
            used = {f for f, _ in paths[r.node]}
            best = min((x for x in impurity[r.node] if x[1] not in used), default=None)
            split = best[1] if best and level < depth and r.kinds > 1 else None
            nodes.append({"path": paths[r.node], "feature": split, "label": r.label, "rows": r.n})
            if split:
                splits.append((r.node, split))
        if not splits:
            break
        chosen = F.broadcast(train.sparkSession.createDataFrame(splits, "at string, split string"))
        value = F.filter("fv", lambda x: x["f"] == F.col("split"))[0]["v"]
        moved = rows.join(chosen, F.col("node") == F.col("at")).select("at", "split", value.alias("value"), "y", "fv")
        rows = store.written(moved.select(F.concat_ws("\u0001", "at", "split", "value").alias("node"), "y", "fv", "at", "split", "value"))
        paths = {r.node: (*paths[r["at"]], (r.split, r.value)) for r in rows.select("node", "at", "split", "value").distinct().collect()}
        rows = rows.select("node", "y", "fv")
    return nodes


def predict(nodes: list[dict], df: DataFrame, name: str = "predicted") -> DataFrame:
    """df with the label of the deepest node that fits each row."""
    out = F.lit(None).cast("string")
    for node in sorted(nodes, key=lambda n: len(n["path"])):
        here = F.lit(True)
        for f, v in node["path"]:
            here &= F.coalesce(F.col(f).cast("string"), F.lit("")) == F.lit(str(v))
        out = F.when(here, node["label"]).otherwise(out)
    return df.withColumn(name, out)
