"""Graph programs over edges(src, dst[, weight]). Every one is a fixpoint or a few joins."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import least_in_component
from lattica.operators.fixpoint import MAX_ITERATIONS, NoFixpoint, best_fixpoint, set_fixpoint, sum_fixpoint
from lattica.store import Store

#: Triangles: groups of nodes, at least; edges that a cell of two groups looks up; edges in a task that makes lists.
GROUPS, CELL_EDGES, LIST_ROWS = 8, 1_000_000, 500_000


def _edges(edges: DataFrame, weighted: bool = False, key: str = "src") -> DataFrame:
    """The different edges under fixed names, written once by the end on which rounds join them."""
    a, b, *rest = edges.columns
    cols = [F.col(a).alias("src"), F.col(b).alias("dst")]
    if weighted:
        cols.append(F.col(rest[0]).alias("w"))
    return Store(edges.sparkSession, "edges").base(edges.select(*cols).distinct(), key)


def transitive_closure(edges: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(src, dst) for every path of one edge or more."""
    e = _edges(edges)
    nxt = e.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return set_fixpoint(e, lambda d: d.join(nxt, d.dst == nxt.mid).select("src", F.col("end").alias("dst")), max_iterations)


def transitive_closure_doubling(edges: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """The closure by joining it with itself: a path of n edges takes log2(n) rounds, not n."""
    from lattica.operators.fixpoint import Clique, Predicate, Rule

    e = _edges(edges)

    def twice(d: list[DataFrame]) -> DataFrame:
        a, b = d[0].toDF("src", "mid"), d[1].toDF("mid2", "dst")
        return a.join(b, a.mid == b.mid2).select("src", "dst")

    rules = [Rule("tc", [], lambda _: e), Rule("tc", ["tc", "tc"], twice)]
    return Clique(e.sparkSession, [Predicate("tc", ["src", "dst"])], rules, max_iterations).solve()["tc"]


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that the starts reach, themselves included."""
    e = _edges(edges)
    return set_fixpoint(starts.toDF("node").distinct(), lambda d: d.join(e, d.node == e.src).select(F.col("dst").alias("node")))


def same_generation(edges: DataFrame) -> DataFrame:
    """(x, y): different nodes as far below a common ancestor; edges go from parent to child."""
    e = _edges(edges)
    a, b = e.toDF("pa", "x"), e.toDF("pb", "y")
    start = a.join(b, a.pa == b.pb).where("x <> y").select("x", "y")
    return set_fixpoint(start, lambda d: d.toDF("px", "py").join(a, F.col("px") == a.pa).join(b, F.col("py") == b.pb).select("x", "y"))


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, cost): the least cost from any start; weights are not negative."""
    e = _edges(edges, True)
    first = starts.toDF("node").select("node", F.lit(0).cast(dict(e.dtypes)["w"]).alias("cost"))
    return best_fixpoint(first, lambda d: d.join(e, d.node == e.src).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost")), "min", "cost")


def shortest_path_tree(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, cost, via): shortest_paths with the node before on the path that won, the least of several."""
    e = _edges(edges, True)
    kind = dict(e.dtypes)
    first = starts.toDF("node").select("node", F.lit(0).cast(kind["w"]).alias("cost"), F.lit(None).cast(kind["src"]).alias("via"))
    return best_fixpoint(first, lambda d: d.select("node", "cost").join(e, F.col("node") == e.src).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("via")), "min", "cost", witness=("via",))


def all_shortest_paths(edges: DataFrame) -> DataFrame:
    """(src, dst, cost) for every connected pair."""
    e = _edges(edges, True)
    nxt = e.toDF("mid", "end", "more")
    return best_fixpoint(e.toDF("src", "dst", "cost"), lambda d: d.join(nxt, d.dst == nxt.mid).select("src", F.col("end").alias("dst"), (F.col("cost") + F.col("more")).alias("cost")), "min", "cost")


def landmark_distances(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(node, landmark, hops): hops from a node to each landmark along the edges."""
    e = _edges(edges, key="dst")
    first = landmarks.toDF("node").select("node", F.col("node").alias("landmark"), F.lit(0).alias("hops"))
    return best_fixpoint(first, lambda d: d.join(e, d.node == e.dst).select(F.col("src").alias("node"), "landmark", (F.col("hops") + 1).alias("hops")), "min", "hops")


def label_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least label that reaches a node along the edges' direction."""
    e = _edges(edges)
    first = e.select(F.col("src").alias("node"), F.col("src").alias("component"))
    return best_fixpoint(first, lambda d: d.join(e, d.node == e.src).select(F.col("dst").alias("node"), "component"), "min", "component")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of its component, edges taken both ways."""
    a, b, *_ = edges.columns
    return least_in_component(edges.select(a, b))


def strongly_connected_components(edges: DataFrame, max_rounds: int = MAX_ITERATIONS) -> DataFrame:
    """(node, component): the least node that a node reaches and is reached by; alone, itself.

    Rounds over what is left: nodes without edges in or out are alone; every other node takes the least node
    that reaches it as its colour, and the nodes of a colour that reach the node it is named after, within the colour, are that
    node's component. No more than the nodes and edges is held, never the closure."""
    e = _edges(edges)
    store = Store(e.sparkSession, "scc")
    nodes = store.written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    left, done = store.written(e.where("src <> dst")), []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        before, now = None, store.count(store.passing[-1])
        while before != now:  # edges at nodes without a way in or out lie on no cycle
            before = now
            left = store.written(left.join(left.select(F.col("dst").alias("s")).distinct(), F.col("src") == F.col("s"), "left_semi").join(left.select(F.col("src").alias("d")).distinct(), F.col("dst") == F.col("d"), "left_semi"))
            now = store.count(store.passing[-1])
        if not now:
            break
        start = left.select(F.col("src").alias("node"), F.col("src").alias("colour")).union(left.select("dst", "dst")).distinct()
        colours = store.written(best_fixpoint(start, lambda d, left=left: d.join(left, d.node == left.src).select(F.col("dst").alias("node"), "colour"), "min", "colour"))
        of = colours.toDF("n", "c")
        inner = left.join(of, left.src == of.n).select("src", "dst", F.col("c").alias("cs")).join(of, F.col("dst") == of.n).where("c = cs").select("src", "dst")
        inner = store.written(inner)
        found = store.written(set_fixpoint(colours.where("node = colour"), lambda d, inner=inner: d.join(inner, d.node == inner.dst).select(F.col("src").alias("node"), "colour")))
        done.append(found)
        gone = found.select(F.col("node").alias("g"))
        left = store.written(left.join(gone, left.src == gone.g, "left_anti").join(gone, left.dst == gone.g, "left_anti"))
    else:
        raise NoFixpoint(f"strong components: edges are left after {max_rounds} rounds")
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    found = reduce(DataFrame.unionByName, done).toDF("n", "component")
    return nodes.join(found, nodes.node == found.n, "left").select("node", F.coalesce("component", "node").alias("component"))


def count_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, paths): paths from the starts; the edges have no cycle."""
    e = _edges(edges)
    first = starts.toDF("node").select("node", F.lit(1).cast("long").alias("paths"))
    return sum_fixpoint(first, lambda d: d.join(e, d.node == e.src).select(F.col("dst").alias("node"), "paths", F.col("src")), "paths")


def count_all_paths(edges: DataFrame) -> DataFrame:
    """(src, dst, paths) for every connected pair; the edges have no cycle."""
    e = _edges(edges)
    nxt = e.toDF("mid", "end")
    return sum_fixpoint(e.select("src", "dst", F.lit(1).cast("long").alias("paths")), lambda d: d.join(nxt, d.dst == nxt.mid).select("src", F.col("end").alias("dst"), "paths", F.col("mid")), "paths")


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) for every node; edges without direction, loops and repeats left out.

    Edges go from the node of lower degree to the other, so that no node of very many edges
    has more than the square root of all edges going out, and wedges stay few. Wedges are never moved: nodes fall into
    groups by hash, and a node's neighbours are sent, as lists of two groups, to the cell of these groups, where the edges
    between the groups are. A neighbour is sent once for each group, and a cell has CELL_EDGES edges to look up."""
    e = _edges(edges)
    plain = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = plain.select(F.col("a").alias("v")).unionAll(plain.select("b"))
    degree = ends.groupBy("v").count()
    d1, d2 = degree.toDF("a", "da"), degree.toDF("b", "db")
    ranked = plain.join(d1, "a").join(d2, "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    store = Store(e.sparkSession, "triangles")
    out = store.written(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t")))
    rows = store.count(store.passing[-1])
    ends = out.select(F.col("t").alias("s")).distinct()  # an edge that closes a wedge starts at the end of another
    closing = store.written(out.join(ends, "s", "left_semi").select(F.least("s", "t").alias("m"), F.greatest("s", "t").alias("n")))
    groups = max(GROUPS, math.isqrt(2 * store.count(store.passing[-1]) // CELL_EDGES) + 1)
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    dealt = out.repartition(max(e.sparkSession.sparkContext.defaultParallelism, -(-rows // LIST_ROWS)), "s").groupBy("s", group("t").alias("g")).agg(F.collect_list("t").alias("of"))
    lists = dealt.groupBy("s").agg(F.collect_list(F.struct("g", "of")).alias("by"))
    pairs = lists.select("s", "by", F.explode("by").alias("x")).select("s", "x", F.explode("by").alias("y")).where("x.g < y.g or x.g = y.g and size(x.of) > 1")
    legs = pairs.select("s", (F.col("x.g") * groups + F.col("y.g")).alias("cell"), F.col("x.of").alias("one"), F.when(F.col("x.g") < F.col("y.g"), F.col("y.of")).alias("other")).repartitionById(groups * groups, F.col("cell"))
    wedges = legs.select("s", "cell", "one", "other", F.explode("one").alias("u")).select("s", "cell", "u", "other", F.explode(F.coalesce("other", "one")).alias("v")).where("other is not null or u < v")
    wedges = wedges.select("s", "cell", F.least("u", "v").alias("m"), F.greatest("u", "v").alias("n"))
    looked = closing.select((F.least(group("m"), group("n")) * groups + F.greatest(group("m"), group("n"))).alias("cell"), "m", "n").repartitionById(groups * groups, F.col("cell"))
    closed = wedges.join(looked.hint("shuffle_hash"), ["cell", "m", "n"])
    counted = closed.select(F.explode(F.array("s", "m", "n")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return nodes.join(counted, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def out_degree_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): each edge with its source's out-degree."""
    e = _edges(edges)
    return e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("weight")), "src").select("src", "dst", "weight")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after some rounds from equal ranks; ranks of nodes without edges out are spread over all."""
    e = _edges(edges)
    store = Store(e.sparkSession, "pagerank")
    nodes = store.written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    links = store.written(e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        given = ranks.join(links, ranks.node == links.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        kept = ranks.join(links.select("src").distinct(), ranks.node == F.col("src"), "left_anti").agg(F.sum("rank")).head()[0] or 0.0
        base = (1 - damping) / n + damping * kept / n
        ranks = store.written(nodes.join(given, "node", "left").select("node", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): each round every node takes its neighbours' most frequent label, of equals the least."""
    e = _edges(edges)
    store = Store(e.sparkSession, "labels")
    both = store.written(e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        seen = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node"), "label").agg(F.count(F.lit(1)).alias("n"))
        labels = store.written(seen.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")))
    return labels


def pregel(vertices: DataFrame, edges: DataFrame, message: Callable[[Column, Column, Column], Column], merge: Callable[[str], Column], update: Callable[[Column, Column], Column], max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """vertices(id, value): each round the nodes whose value changed send message(value, src, dst) along
    their edges, messages to a node are merged by an aggregate, and update(old, merged) gives its new value.
    Values that still change after max_iterations rounds raise NoFixpoint."""
    store, e = Store(vertices.sparkSession, "pregel"), _edges(edges)
    state = store.written(vertices.toDF("id", "value").withColumn("changed", F.lit(True)))
    for _ in range(max_iterations):
        active = state.where("changed")
        if active.isEmpty():
            break
        sent = active.join(e, active["id"] == e.src).select(F.col("dst").alias("to"), message(F.col("value"), F.col("src"), F.col("dst")).alias("m"))
        got = sent.where("m is not null").groupBy("to").agg(merge("m").alias("m"))
        new = F.when(F.col("m").isNotNull(), update(F.col("value"), F.col("m"))).otherwise(F.col("value"))
        state = store.written(state.join(got, state["id"] == got["to"], "left").select("id", new.alias("new"), "value").select("id", F.col("new").alias("value"), (~F.col("new").eqNullSafe(F.col("value"))).alias("changed")))
    else:
        if not state.where("changed").isEmpty():
            raise NoFixpoint(f"values still change after {max_iterations} rounds")
    return state.select("id", "value")


def coalesce_intervals(intervals: DataFrame) -> DataFrame:
    """(start, end) of the unions of overlapping or touching intervals: a running maximum, not a range join.

    The running maximum goes over ranges of starts: within each, and over the ranges' maxima."""
    i = intervals.toDF("s", "e").where("s <= e")
    parts = max(2, i.sparkSession.sparkContext.defaultParallelism)
    store = Store(i.sparkSession, "intervals")
    dealt = store.written(i.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()))
    tops = dealt.groupBy("part").agg(F.max("e").alias("top"))
    before = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = F.max("e").over(Window.partitionBy("part").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt.withColumn("within", within).join(F.broadcast(before), "part").withColumn("seen", F.greatest("within", "before"))
    opened = store.written(marked.withColumn("opens", (F.col("seen").isNull() | (F.col("seen") < F.col("s"))).cast("long")))
    counts = opened.groupBy("part").agg(F.sum("opens").alias("opened"))
    offset = counts.select("part", F.coalesce(F.sum("opened").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    number = F.sum("opens").over(Window.partitionBy("part").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")
    grouped = opened.join(F.broadcast(offset), "part").withColumn("island", number)
    return grouped.groupBy("island").agg(F.min("s").alias("start"), F.max("e").alias("end")).select("start", "end")
