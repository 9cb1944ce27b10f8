"""Graph and mining programs, sources and functions on small inputs, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import compat
from lattica.library import graph, mining
from lattica.operators import fixpoint
from lattica.sources import relations

EDGES = [(random.Random(i).randrange(12), random.Random(i + 99).randrange(12)) for i in range(24)]


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def reach(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_closures(edges):
    want = sorted(reach(EDGES), key=str)
    assert table(graph.transitive_closure(edges)) == want == table(graph.transitive_closure_doubling(edges))


@pytest.mark.parametrize("few", [True, False])
def test_compaction_and_wide_paths_agree(spark, edges, monkeypatch, few):
    monkeypatch.setattr(fixpoint, "COMPACT", 1)
    monkeypatch.setattr(fixpoint, "SMALL_ROWS", 0)
    monkeypatch.setattr(fixpoint, "FEW_ROWS", 0 if few else 50_000)
    assert table(graph.transitive_closure(edges)) == sorted(reach(EDGES), key=str)
    w = spark.createDataFrame([(a, b, (a * b) % 5 + 1) for a, b in EDGES], "a long, b long, w long")
    best = {}
    for a, b, c in [(a, b, (a * b) % 5 + 1) for a, b in EDGES]:
        best[a, b] = min(c, best.get((a, b), c))
    nodes = {x for e in EDGES for x in e}
    for k, i, j in itertools.product(nodes, nodes, nodes):
        if (i, k) in best and (k, j) in best:
            best[i, j] = min(best.get((i, j), 1e9), best[i, k] + best[k, j])
    for k, i, j in itertools.product(nodes, nodes, nodes):
        if (i, k) in best and (k, j) in best:
            best[i, j] = min(best.get((i, j), 1e9), best[i, k] + best[k, j])
    assert table(graph.all_shortest_paths(w)) == sorted(((a, b, c) for (a, b), c in best.items()), key=str)
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "a long, b long")
    assert table(graph.count_paths(dag, spark.range(1, 2))) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]


def test_components(edges):
    pairs = reach(EDGES)
    nodes = {x for e in EDGES for x in e}
    both = reach(EDGES + [(b, a) for a, b in EDGES])
    assert table(graph.connected_components(edges)) == sorted(((n, min([n] + [b for a, b in both if a == n])) for n in nodes), key=str)
    assert table(graph.strongly_connected_components(edges)) == sorted(((n, min([n] + [b for a, b in pairs if a == n and (b, a) in pairs])) for n in nodes), key=str)


def test_a_long_chain_and_cycles(spark):
    """Components in few rounds whatever the diameter; strong components of rings that hang together."""
    n = 5000
    order = random.Random(3).sample(range(n), n)
    chain = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {tuple(r) for r in graph.connected_components(chain).groupBy("component").count().collect()} == {(0, n)}
    rings = [(10 * r + i, 10 * r + (i + 1) % 10) for r in range(8) for i in range(10)] + [(10 * r + 3, 10 * r + 17) for r in range(7)] + [(5, 5), (100, 101), (101, 3), (79, 200)]
    got = dict(table(graph.strongly_connected_components(spark.createDataFrame(rings, "a long, b long"))))
    assert got == {n: n // 10 * 10 for n in range(80)} | {100: 100, 101: 101, 200: 200}


def test_pregel_raises_at_its_limit(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    nodes = spark.range(7).select("id", F.col("id").alias("v"))
    least = (lambda v, a, b: v), (lambda m: F.min(m)), (lambda old, new: F.least(old, new))
    assert {r.value for r in graph.pregel(nodes, path, *least).collect()} == {0}
    with pytest.raises(fixpoint.NoFixpoint):
        graph.pregel(nodes, path, *least, max_iterations=3)


def test_places_in_an_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("x"))
    assert [r["at"] for r in compat.with_index(df, "x").orderBy("x").collect()] == list(range(100))
    assert compat.with_index(df.limit(0), "x").count() == 0


def test_triangles_and_ranks(spark, edges):
    plain = {frozenset(e) for e in EDGES if e[0] != e[1]}
    nodes = {x for e in EDGES for x in e}
    count = dict.fromkeys(nodes, 0)
    for t in itertools.combinations(sorted(nodes), 3):
        if all(frozenset(p) in plain for p in itertools.combinations(t, 2)):
            for n in t:
                count[n] += 1
    assert table(graph.triangles(edges)) == sorted(count.items(), key=str)
    ranks = dict(table(graph.pagerank(edges, 5)))
    assert sum(ranks.values()) == pytest.approx(1.0) and set(ranks) == nodes
    assert graph.pagerank(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wedges_are_made_where_they_are_looked_up(spark, monkeypatch):
    """Lists of neighbours are exchanged, not wedges; many cells give the same counts as one."""
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]
    plain = {frozenset(e) for e in rows if e[0] != e[1]}
    count = {n: 0 for e in rows for n in e}
    for t in itertools.combinations(sorted(count), 3):
        if all(frozenset(p) in plain for p in itertools.combinations(t, 2)):
            for n in t:
                count[n] += 1
    df = spark.createDataFrame(rows, "a long, b long")
    for groups, edges in ((1, 1 << 30), (3, 1 << 30), (1, 30)):
        monkeypatch.setattr(graph, "GROUPS", groups)
        monkeypatch.setattr(graph, "CELL_EDGES", edges)
        found = graph.triangles(df)
        assert table(found) == sorted(count.items(), key=str)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "ShuffledHashJoin [cell" in x)
    side = lines[at + 1 : at + 1 + next(i for i, x in enumerate(lines[at + 1 :]) if "Exchange" in x)]
    assert sum("Generate explode" in x for x in side) == 2


def test_intervals(spark):
    rng = random.Random(4)
    rows = [(s, s + rng.randrange(6)) for s in (rng.randrange(200) for _ in range(60))]
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    assert table(graph.coalesce_intervals(spark.createDataFrame(rows, "s long, e long"))) == sorted(map(tuple, out), key=str)


def test_itemsets_and_rules(spark):
    rng = random.Random(8)
    baskets = [sorted(rng.sample("abcdef", rng.randint(1, 5))) for _ in range(30)]
    want = {}
    for n in range(1, 7):
        for items in itertools.combinations("abcdef", n):
            k = sum(set(items) <= set(b) for b in baskets)
            if k >= 6:
                want[items] = k
    df = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "basket long, item string")
    found = mining.frequent_itemsets(df, 6)
    assert {tuple(r["items"]): r.support for r in found.collect()} == want
    for r in mining.association_rules(found, 0.5).collect():
        assert r.confidence == pytest.approx(want[tuple(sorted([*r.body, r.head]))] / want[tuple(r.body)])


def test_itemsets_keep_tasks_small(spark, monkeypatch):
    """Baskets are brought together in tasks of so many rows; sets beyond the broadcast and nulls give the same."""
    from lattica.store import Store

    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.choice("abcdefg")) for _ in range(400)] + [(i, None) for i in range(20)] + [(None, "a"), (None, "b")] + [(100 + i, "abc"[i % 3]) for i in range(9)]
    baskets = {}
    for k, x in rows:
        baskets.setdefault(k, set()).add(x)
    want = {(None,): sum(None in b for b in baskets.values())}
    for n in range(1, 8):
        for items in itertools.combinations("abcdefg", n):
            s = sum(set(items) <= b for k, b in baskets.items() if n == 1 or k is not None)
            if s >= 12:
                want[items] = s
    parts, put = [], Store.put

    def counted(self, df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        parts.append("Join" in plan and "basket" in plan.split("Join")[1].splitlines()[0])
        return put(self, df)

    monkeypatch.setattr(Store, "put", counted)
    monkeypatch.setattr(mining, "BASKET_ROWS", 50)
    for few in (50_000, 0):
        monkeypatch.setattr(mining, "FEW_ROWS", few)
        found = mining.frequent_itemsets(spark.createDataFrame(rows, "basket long, item string"), 12).collect()
        assert {tuple(r["items"]): r.support for r in found} == want and len(found) == len(want)
    assert parts and not any(parts)


def test_kmeans_and_tree(spark):
    points = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 1.0]) for i in range(20)], "id long, v array<double>")
    start = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "c long, v array<double>")
    centers, where = mining.kmeans(points, start)
    assert {r.id % 2 == r.center for r in where.collect()} == {True}
    assert [round(r.vector[0], 2) for r in centers.orderBy("center").collect()] == [0.09, 10.1]
    rows = spark.createDataFrame([("y" if a == "s" and b == "h" else "n", a, b) for a in "sr" for b in "hl" for _ in range(3)], "label string, a string, b string")
    nodes = mining.decision_tree(rows, "label", ["a", "b"], 2)
    assert mining.predict(nodes, rows).where("predicted <> label").count() == 0


def test_relation_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,2\n3,4,9\n")
    assert table(relations.read_relation(spark, str(tmp_path / "r.csv"), "a int, b int, w int")) == [(1, 2, 1), (3, 4, 9)]
    (tmp_path / "f.fac").write_text('all arc\na, b, 1\nc, "d", 2\n\nall node\n7\n')
    found = relations.read_facts(spark, str(tmp_path / "f.fac"), {"arc": "x string, y string, n int", "node": "n int"})
    assert table(found["arc"]) == [("a", "b", 1), ("c", "d", 2)] and table(found["node"]) == [(7,)]
    relations.write_tsv(found["arc"], str(tmp_path / "out.tsv"))
    assert table(relations.read_relation(spark, str(tmp_path / "out.tsv"), "x string, y string, n int")) == [("a", "b", 1), ("c", "d", 2)]


def test_dialect_functions(spark):
    df = spark.createDataFrame([("b", [3, 1, 3]), (None, [])], "x string, p array<int>")
    got = df.select(compat.field(F.col("x"), "a", "b"), compat.bitmap_of(F.col("p")), compat.bitmap_empty(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(2, [1, 3], False), (0, [], True)]
    text = spark.createDataFrame([("the cat sat. the cat ran.",)], "t string")
    assert [(list(r.ngram), r.estfrequency) for r in compat.word_ngrams(text, "t", 2, 1).collect()] == [(["the", "cat"], 2.0)]
    assert {tuple(r.ngram) for r in compat.context_ngrams(text, "t", ["cat", None], 5).collect()} == {("sat",), ("ran",)}


def test_a_shared_key_is_summed_before_the_join(spark, tmp_path):
    """Rows of a key that most of a table shares aren't moved or sorted one by one."""
    from lattica.queries import relational

    spark.createDataFrame([(k, k % 3) for k in range(40)] + [(1, 2)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    items = [(i, i % 50, float(i % 7) if i % 11 else None) for i in range(2000)]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = relational.QUERIES["join_skewed"](spark, str(tmp_path))
    want = {}
    for order, supplier, quantity in items:
        k = supplier if order % 10 == 0 else 1
        for nation in [k % 3] * (k < 40) + [2] * (k == 1):
            n, q = want.get(nation, (0, 0.0))
            want[nation] = (n + 1, q + (quantity or 0.0))
    assert {r.s_nationkey: (r.n, r.quantity) for r in found.collect()} == want
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in plan and "HashAggregate(keys=[k#" in plan
