"""Recursive programs over relations derived from the driver's tables.

Relations: who brought in whom among customers and which supplier feeds which (trees, k div 2 -> k), which part is
used in which and lanes between suppliers (DAGs, k -> 2k, 3k), tolls and amounts from sizes and balances, lanes with
ways back, who trades with whom, spans, baskets, vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.library import graph, mining
from lattica.plans.engine import LogicEngine
from lattica.plans.recsql import RecursiveSql

from .common import read


def customer_tree(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where("c_custkey > 1").select(F.expr("c_custkey div 2").alias("a"), F.col("c_custkey").alias("b"))


def supplier_tree(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").where("s_suppkey > 1").select(F.expr("s_suppkey div 2").alias("a"), F.col("s_suppkey").alias("b"))


def dag(spark: SparkSession, d: str, table: str, key: str, weight: str) -> DataFrame:
    """k -> 2k and k -> 3k where these exist; w from the end's row."""
    t = read(spark, d, table).where(f"{key} > 0").select(F.col(key).alias("k"), F.expr(weight).cast("long").alias("w"))
    ends = [t.where(f"k % {m} = 0").select(F.expr(f"k div {m}").alias("a"), F.col("k").alias("b"), "w") for m in (2, 3)]
    return ends[0].unionAll(ends[1])


def part_dag(spark: SparkSession, d: str) -> DataFrame:
    return dag(spark, d, "part", "p_partkey", "p_size")


def supplier_dag(spark: SparkSession, d: str) -> DataFrame:
    return dag(spark, d, "supplier", "s_suppkey", "abs(s_acctbal) + 1")


def supplier_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The supplier DAG with ways back from the suppliers of some nations: a graph with cycles."""
    t = supplier_dag(spark, d)
    back = read(spark, d, "supplier").where("s_nationkey % 4 = 0").select(F.col("s_suppkey").alias("b"))
    return t.unionAll(t.join(back, "b", "left_semi").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Customers and the suppliers of what they ordered, by their numbers, as one graph."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return read(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()


#: Fixed texts for the second engine: the same relations.
TREE_C = "arc AS (SELECT c_custkey // 2 AS a, c_custkey AS b FROM customer WHERE c_custkey > 1)"
TREE_S = "arc AS (SELECT s_suppkey // 2 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 1)"
DAG_P = "arc AS (SELECT p_partkey // 2 AS a, p_partkey AS b, CAST(p_size AS BIGINT) AS w FROM part WHERE p_partkey > 0 AND p_partkey % 2 = 0 UNION SELECT p_partkey // 3, p_partkey, CAST(p_size AS BIGINT) FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0)"
DAG_S = "arc AS (SELECT s_suppkey // 2 AS a, s_suppkey AS b, CAST(trunc(abs(s_acctbal) + 1) AS BIGINT) AS w FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 2 = 0 UNION SELECT s_suppkey // 3, s_suppkey, CAST(trunc(abs(s_acctbal) + 1) AS BIGINT) FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 3 = 0)"


BACK = DAG_S.replace("arc AS (", "dag AS (", 1) + ", arc AS (SELECT a, b, w FROM dag UNION SELECT b, a, w FROM dag WHERE b IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 4 = 0))"
TRADES = "arc AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def script(text: str, **relations):
    """A query that runs a script over relations, each given by a function of (spark, sf_dir)."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = {name: f(spark, d) for name, f in relations.items()}
        return RecursiveSql(spark).script(text, tables)

    return run


def logic(text: str, query: str, columns: list[str], limit: int | None = None, **relations):
    """A query that evaluates a logic program."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = LogicEngine(spark, {name: f(spark, d) for name, f in relations.items()}, **({"max_iterations": limit, "stop_at_limit": True} if limit else {}))
        return engine.load(text).query(query).toDF(*columns)

    return run


PROGRAMS: dict[str, tuple] = {}


def add(name: str, query, oracle: str | None) -> None:
    PROGRAMS[name] = (query, oracle)


#: The relations of the scripts. Parts: whole, piece, amount. Lanes: origin, target, toll.
BROUGHT = "create table brought(giver long, taker long); "
FEEDS = "create table feeds(hub long, outlet long); "
USES = "create table uses(whole long, piece long, amount long); "
LANES = "create table lanes(origin long, target long, toll long); "


def rounds(start: str, step: str, n: int, answer: str, relations: str) -> str:
    """SQL that takes a fixed number of rounds: step's {r} is the last round's relation. The graphs here are
    acyclic and n rounds reach their depth up to a million nodes."""
    parts = [relations, f"r0 AS MATERIALIZED ({start})", *(f"r{i + 1} AS MATERIALIZED ({step.format(r=f'r{i}')})" for i in range(n))]
    return "WITH " + ", ".join(parts) + " " + answer.format(r=f"r{n}")


# closures and paths
add("tc_customer_tree", script(BROUGHT + "WITH recursive line (elder, member) AS (SELECT giver, taker FROM brought) UNION (SELECT brought.giver, line.member FROM line, brought WHERE line.elder = brought.taker) SELECT elder AS a, member AS b FROM line", brought=customer_tree),
    f"WITH RECURSIVE {TREE_C}, tc(a, b) AS (SELECT a, b FROM arc UNION SELECT tc.a, arc.b FROM tc JOIN arc ON tc.b = arc.a) SELECT a, b FROM tc")
add("tc_doubling", lambda s, d: graph.transitive_closure_doubling(supplier_dag(s, d)).toDF("a", "b"),
    f"WITH RECURSIVE {DAG_S}, tc(a, b) AS (SELECT a, b FROM arc UNION SELECT tc.a, arc.b FROM tc JOIN arc ON tc.b = arc.a) SELECT a, b FROM tc")
add("tc_logic_nonlinear", logic("linked(From, To) <- lanes(From, To, _). linked(From, To) <- linked(From, Mid), linked(Mid, To).", "linked(A,B)", ["a", "b"], lanes=supplier_dag),
    f"WITH RECURSIVE {DAG_S}, tc(a, b) AS (SELECT a, b FROM arc UNION SELECT tc.a, arc.b FROM tc JOIN arc ON tc.b = arc.a) SELECT a, b FROM tc")
add("tc_logic_bound", logic("line(Elder, New) <- brought(Elder, New). line(Elder, New) <- line(Elder, Mid), brought(Mid, New).", "line(3,B)", ["b"], brought=customer_tree),
    f"WITH RECURSIVE {TREE_C}, tc(b) AS (SELECT b FROM arc WHERE a = 3 UNION SELECT arc.b FROM tc JOIN arc ON tc.b = arc.a) SELECT b FROM tc")
add("same_generation", script("-- hint: broadcast\n" + FEEDS + "WITH recursive peers (one, other) AS (SELECT 1, 1) UNION (SELECT l.outlet, r.outlet FROM feeds l, peers, feeds r WHERE peers.one = l.hub AND r.hub = peers.other) SELECT one AS x, other AS y FROM peers WHERE one <> other", feeds=supplier_tree),
    f"WITH RECURSIVE {TREE_S}, sg(x, y) AS (SELECT p.b, q.b FROM arc p JOIN arc q ON p.a = q.a AND p.b <> q.b UNION SELECT p.b, q.b FROM sg JOIN arc p ON p.a = sg.x JOIN arc q ON q.a = sg.y) SELECT x, y FROM sg")
add("reach", lambda s, d: RecursiveSql(s).script("-- hint: shuffle\n" + USES + "WITH recursive within (item) AS (SELECT piece FROM uses WHERE whole = {top}) UNION (SELECT uses.piece FROM uses JOIN within ON uses.whole = within.item) SELECT item AS node FROM within", {"uses": part_dag(s, d)}, top=5),
    f"WITH RECURSIVE {DAG_P}, reach(node) AS (SELECT b FROM arc WHERE a = 5 UNION SELECT b FROM reach JOIN arc ON node = a) SELECT node FROM reach")
add("sssp", lambda s, d: RecursiveSql(s).script(USES + "WITH recursive nearest (item, min() AS steps) AS (SELECT {top}, 0) UNION (SELECT uses.piece, uses.amount + nearest.steps FROM uses JOIN nearest ON uses.whole = nearest.item) SELECT item AS node, steps AS cost FROM nearest", {"uses": part_dag(s, d)}, top=1),
    f"WITH RECURSIVE {DAG_P}, sp(node, cost) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT b, cost + w FROM sp JOIN arc ON node = a) SELECT node, min(cost) AS cost FROM sp GROUP BY node")
add("sssp_witness", lambda s, d: graph.shortest_path_tree(part_dag(s, d), s.range(1, 2)),
    f"WITH RECURSIVE {DAG_P}, r(node, cost) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT b, cost + w FROM r JOIN arc ON node = a), sp AS (SELECT node, min(cost) AS cost FROM r GROUP BY node) SELECT x.node, x.cost, min(arc.a) AS via FROM sp x LEFT JOIN (arc JOIN sp y ON y.node = arc.a) ON arc.b = x.node AND y.cost + arc.w = x.cost GROUP BY x.node, x.cost")
add("apsp", script(LANES + "WITH recursive fare (origin, target, min() AS price) AS (SELECT * FROM lanes) UNION (SELECT lanes.origin, fare.target, fare.price + lanes.toll FROM fare, lanes WHERE fare.origin = lanes.target) SELECT origin AS a, target AS b, price AS cost FROM fare", lanes=supplier_dag),
    f"WITH RECURSIVE {DAG_S}, sp(a, b, cost) AS (SELECT a, b, w FROM arc UNION SELECT sp.a, arc.b, cost + w FROM sp JOIN arc ON sp.b = arc.a) SELECT a, b, min(cost) AS cost FROM sp GROUP BY a, b")
GROUPS = LANES + "WITH recursive grp (node, min() AS label) AS (SELECT origin, least(origin, target) FROM lanes) UNION (SELECT target, origin FROM lanes) UNION (SELECT lanes.target, grp.label FROM lanes, grp WHERE lanes.origin = grp.node) UNION (SELECT lanes.origin, grp.label FROM lanes, grp WHERE lanes.target = grp.node) "
GROUPS_O = f"WITH RECURSIVE {DAG_S}, e AS (SELECT a, b FROM arc UNION SELECT b, a FROM arc), c(x, l) AS (SELECT a, a FROM e UNION SELECT e.b, l FROM c JOIN e ON x = e.a), cc AS (SELECT x, min(l) AS l FROM c GROUP BY x) "
add("cc_labels", script(GROUPS + "SELECT node AS x, label FROM grp", lanes=supplier_dag), GROUPS_O + "SELECT x, l AS label FROM cc")
add("cc_count", script(GROUPS + "SELECT count(DISTINCT label) AS n FROM grp", lanes=supplier_dag), GROUPS_O + "SELECT count(DISTINCT l) AS n FROM cc")
add("cc_two_hops", script(GROUPS + "SELECT far.target AS y, far.toll + near.toll AS toll FROM lanes near JOIN lanes far ON near.target = far.origin JOIN grp ON grp.node = far.target AND grp.label = near.origin", lanes=supplier_dag), GROUPS_O + "SELECT a2.b AS y, a1.w + a2.w AS toll FROM cc, arc a1, arc a2 WHERE cc.x = a2.b AND cc.l = a1.a AND a1.b = a2.a")
add("count_paths", lambda s, d: RecursiveSql(s).script(USES + "WITH recursive ways (item, count() AS n) AS (SELECT {top}, 1) UNION (SELECT uses.piece, ways.n FROM uses, ways WHERE uses.whole = ways.item) SELECT item AS x, n FROM ways WHERE item <> {top}", {"uses": part_dag(s, d)}, top=1),
    f"WITH RECURSIVE {DAG_P}, p(x) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT b FROM p JOIN arc ON x = a) SELECT x, count(*) AS n FROM p WHERE x <> 1 GROUP BY x")
add("count_paths_all", script("create table lanes(origin long, target long); WITH recursive routes (origin, target, count() AS n) AS (SELECT origin, target, 1 FROM lanes) UNION (SELECT lanes.origin, routes.target, routes.n FROM lanes, routes WHERE routes.origin = lanes.target) SELECT origin AS x, target AS y, n FROM routes", lanes=lambda s, d: supplier_dag(s, d).select("a", "b")),
    f"WITH RECURSIVE {DAG_S}, e AS (SELECT DISTINCT a, b FROM arc), p(x, y) AS (SELECT a, b FROM e UNION ALL SELECT x, b FROM p JOIN e ON y = a) SELECT x, y, count(*) AS n FROM p GROUP BY x, y")
add("delivery", script(USES + "create table stock(part long, wait long); WITH recursive ready (part, max() AS wait) AS (SELECT * FROM stock) UNION (SELECT uses.whole, ready.wait FROM ready JOIN uses ON ready.part = uses.piece) SELECT part, wait AS days FROM ready", uses=part_dag, stock=lambda s, d: read(s, d, "part").select("p_partkey", F.col("p_size").cast("long"))),
    f"WITH RECURSIVE {DAG_P}, r(part, days) AS (SELECT p_partkey, CAST(p_size AS BIGINT) FROM part UNION SELECT a, days FROM r JOIN arc ON part = b) SELECT part, max(days) AS days FROM r GROUP BY part")
add("management", script(BROUGHT + "WITH recursive team (lead, count() AS heads) AS (SELECT giver, 1 FROM brought) UNION (SELECT brought.giver, team.heads FROM brought, team WHERE team.lead = brought.taker) SELECT lead AS mgr, heads AS n FROM team", brought=customer_tree),
    f"WITH RECURSIVE {TREE_C}, r(mgr, n) AS (SELECT a, count(*) OVER (PARTITION BY a) FROM arc QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = 1 UNION ALL SELECT a, n FROM r JOIN arc ON mgr = b) SELECT mgr, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY mgr")
add("mlm_bonus", script(BROUGHT + "create table orders_of(buyer long, price double); WITH recursive credit (who, sum() AS points) AS (SELECT buyer, price / 7 FROM orders_of) UNION (SELECT brought.giver, credit.points / 3 FROM brought JOIN credit ON credit.who = brought.taker WHERE credit.who = brought.taker) SELECT who AS m, round(points, 4) AS b FROM credit", orders_of=lambda s, d: read(s, d, "orders").select("o_custkey", "o_totalprice"), brought=customer_tree),
    f"WITH RECURSIVE {TREE_C}, r(m, v) AS (SELECT o_custkey, sum(o_totalprice / 7) FROM (SELECT DISTINCT o_custkey, o_totalprice FROM orders) GROUP BY o_custkey UNION ALL SELECT a, v / 3 FROM r JOIN arc ON m = b) SELECT m, round(sum(v), 4) AS b FROM r GROUP BY m")


def _intervals(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "supplier").select((F.col("s_suppkey") * 4).alias("s"), (F.col("s_suppkey") * 4 + F.col("s_nationkey") % 7).cast("long").alias("e"))


ISLANDS = "WITH i AS ({}), m AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i), g AS (SELECT s, e, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m) SELECT min(s) AS s, max(e) AS e FROM g GROUP BY g"
SPANS = "SELECT s_suppkey * 4 AS s, s_suppkey * 4 + s_nationkey % 7 AS e FROM supplier"
RUNS = "WITH recursive run (head, max() AS tail) AS (SELECT openers.t, spans.e FROM openers, spans WHERE spans.s = openers.t) UNION (SELECT run.head, spans.e FROM spans, run WHERE spans.s BETWEEN run.head AND run.tail) SELECT head AS s, tail AS e FROM run"
add("coalesce", script("-- hint: broadcast\ncreate table spans(s long, e long); create view openers(t) as (SELECT late.s FROM spans late LEFT ANTI JOIN spans early ON early.s < late.s AND early.e >= late.s); " + RUNS, spans=_intervals), ISLANDS.format(SPANS))
add("coalesce_given_starts", script("-- hint: broadcast\ncreate table spans(s long, e long); create table openers(t long); " + RUNS, spans=_intervals, openers=lambda s, d: graph.coalesce_intervals(_intervals(s, d)).select("start")), ISLANDS.format(SPANS))
add("coalesce_running_max", lambda s, d: graph.coalesce_intervals(read(s, d, "orders").select((F.col("o_orderkey") * 5).alias("s"), (F.col("o_orderkey") * 5 + F.col("o_custkey") % 9).alias("e"))).toDF("s", "e"),
    ISLANDS.format("SELECT o_orderkey * 5 AS s, o_orderkey * 5 + o_custkey % 9 AS e FROM orders"))
add("out_degree", script("create table uses(whole long, piece long); SELECT whole AS f, piece AS t, count(*) OVER (PARTITION BY whole) AS w FROM uses", uses=lambda s, d: part_dag(s, d).select("a", "b")),
    f"WITH {DAG_P}, e AS (SELECT DISTINCT a, b FROM arc) SELECT e.a AS f, e.b AS t, n.w FROM e JOIN (SELECT a, count(*) AS w FROM e GROUP BY a) n ON e.a = n.a")
add("pagerank_step", script("create table uses(whole long, piece long); create view fan(whole, n) as (SELECT whole, count(*) FROM uses GROUP BY whole); SELECT piece AS t, round(sum(double(1) / n), 6) AS w FROM uses JOIN fan USING (whole) GROUP BY piece", uses=lambda s, d: part_dag(s, d).select("a", "b")),
    f"WITH {DAG_P}, e AS (SELECT DISTINCT a, b FROM arc) SELECT e.b AS t, CAST(round(sum(CAST(1.0 AS DOUBLE) / n.c), 6) AS DOUBLE) AS w FROM e JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) n ON e.a = n.a GROUP BY e.b")
add("pagerank_step_partial", script("create table uses(whole long, piece long, amount double); SELECT piece AS t, round(sum(power(amount, -1)), 6) AS w FROM uses WHERE whole IN (SELECT whole FROM uses) GROUP BY piece", uses=part_dag),
    f"WITH {DAG_P} SELECT b AS t, round(sum(1.0 / w), 6) AS w FROM (SELECT DISTINCT a, b, CAST(w AS DOUBLE) AS w FROM arc) GROUP BY b")
FLAT = USES + "WITH recursive flat (whole, piece, amount) AS (SELECT whole, piece, amount FROM uses) "
add("exit_only_self_join", script(FLAT + "SELECT top.whole, mid.piece AS middle, low.piece AS lowest, top.amount * mid.amount * low.amount AS amount FROM flat top JOIN flat mid ON top.piece = mid.whole JOIN flat low ON mid.piece = low.whole WHERE low.amount < 3", uses=part_dag),
    f"WITH {DAG_P} SELECT x.a AS whole, y.b AS middle, z.b AS lowest, x.w * y.w * z.w AS amount FROM arc x JOIN arc y ON x.b = y.a JOIN arc z ON y.b = z.a AND z.w < 3")
add("exit_only_group", script(FLAT + "SELECT top.whole AS a, count(*) AS n, sum(low.amount) AS amount FROM flat top, flat low WHERE low.whole = top.piece GROUP BY 1", uses=part_dag),
    f"WITH {DAG_P} SELECT x.a, count(*) AS n, CAST(sum(y.w) AS BIGINT) AS amount FROM arc x JOIN arc y ON x.b = y.a GROUP BY x.a")
add("mutual_recursion", script(BROUGHT + "WITH recursive odd (elder, member) AS (SELECT giver, taker FROM brought) UNION (SELECT even.elder, brought.taker FROM even, brought WHERE even.member = brought.giver), even (elder, member) AS (SELECT odd.elder, brought.taker FROM odd, brought WHERE brought.giver = odd.member) SELECT elder AS a, member AS b FROM even", brought=customer_tree),
    f"WITH RECURSIVE {TREE_C}, p(a, b, n) AS (SELECT a, b, 1 FROM arc UNION SELECT p.a, arc.b, n + 1 FROM p JOIN arc ON p.b = arc.a) SELECT a, b FROM p WHERE n % 2 = 0")

# logic programs
add("logic_negation", logic("busy(X) <- brought(X,_). idle(Y) <- brought(_,Y), ~busy(Y).", "idle(X)", ["x"], brought=customer_tree),
    f"WITH {TREE_C} SELECT DISTINCT b AS x FROM arc WHERE b NOT IN (SELECT a FROM arc)")
add("logic_stratified_aggregates", logic("deg(X, count<Y>, sum<W>, min<W>, max<W>) <- arc(X,Y,W).", "deg(A,B,C,D,E)", ["a", "n", "s", "lo", "hi"], arc=part_dag),
    f"WITH {DAG_P} SELECT a, count(*) AS n, CAST(sum(w) AS BIGINT) AS s, min(w) AS lo, max(w) AS hi FROM arc GROUP BY a")
add("logic_countd_avg", logic("d(X, countd<W>) <- arc(X,_,W). a(X, avg<W>) <- arc(X,_,W). r(X,N,M) <- d(X,N), a(X,M).", "r(A,B,C)", ["a", "n", "m"], arc=lambda s, d: part_dag(s, d)),
    f"WITH {DAG_P} SELECT a, count(DISTINCT w) AS n, avg(w) AS m FROM (SELECT DISTINCT a, w FROM arc) GROUP BY a")
add("logic_if_then_else", logic("kind(X, K) <- arc(X,_,W), if (W > 25 then K = \"big\" else K = \"small\").", "kind(A,B)", ["a", "kind"], arc=part_dag),
    f"WITH {DAG_P} SELECT DISTINCT a, CASE WHEN w > 25 THEN 'big' ELSE 'small' END AS kind FROM arc")
add("logic_if_exists", logic("kind(X, K) <- node(X), if (arc(X,_,_) then K = \"inner\" else K = \"leaf\").", "kind(A,B)", ["a", "kind"], arc=supplier_dag, node=lambda s, d: read(s, d, "supplier").select("s_suppkey")),
    f"WITH {DAG_S} SELECT s_suppkey AS a, CASE WHEN s_suppkey IN (SELECT a FROM arc) THEN 'inner' ELSE 'leaf' END AS kind FROM supplier")
add("logic_choice", logic("one(X,Y) <- arc(X,Y,_), choice((X),(Y)).", "one(A,B)", ["a", "b"], arc=part_dag),
    f"WITH {DAG_P} SELECT a, min(b) AS b FROM arc GROUP BY a")
add("logic_sort_limit", logic("top(X,Y,W) <- arc(X,Y,W), sort((W,desc),(X,asc),(Y,asc)), limit(7).", "top(A,B,C)", ["a", "b", "w"], arc=part_dag),
    f"WITH {DAG_P} SELECT DISTINCT a, b, w FROM arc ORDER BY w DESC, a, b LIMIT 7")
add("logic_comparisons", logic("r(X, Z) <- arc(X,Y,W), W >= 3, W ~= 4, Z = X * 2 + Y mod 7 - W.", "r(A,B)", ["a", "z"], arc=part_dag),
    f"WITH {DAG_P} SELECT DISTINCT a, a * 2 + b % 7 - w AS z FROM arc WHERE w >= 3 AND w <> 4")
add("logic_like", logic("r(K) <- part(K,N), N *= \"red%\". s(K) <- part(K,N), N ~*= \"red%\", K < 50. u(K) <- r(K). u(K) <- s(K).", "u(A)", ["k"], part=lambda s, d: read(s, d, "part").select("p_partkey", "p_name")),
    "SELECT p_partkey AS k FROM part WHERE p_name LIKE 'red%' OR p_partkey < 50")
add("logic_lists", logic("got(K, L, H, N) <- sup(K, R), L = [R, 9, K], append([R], [K], M), member(H, M), cardinality(L, N).", "got(A,B,C,D)", ["a", "l", "h", "n"], sup=lambda s, d: read(s, d, "supplier").select(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long"))),
    "SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS a, [s_nationkey, 9, s_suppkey]::BIGINT[] AS l, CAST(h AS BIGINT) AS h, 3 AS n FROM supplier, unnest([s_suppkey, s_nationkey]) t(h)")
add("logic_functors", logic("f(X, F) <- nat(X, R), F = pair(X, R). g(A, B) <- f(_, pair(A, B)).", "g(A,B)", ["a", "b"], nat=lambda s, d: read(s, d, "nation").select("n_nationkey", "n_regionkey")),
    "SELECT n_nationkey AS a, n_regionkey AS b FROM nation")
add("logic_dates", lambda s, d: LogicEngine(s, {"ord": read(s, d, "orders").select("o_orderkey", "o_orderdate")}).load("r(K, Y, D) <- ord(K, T), datepart(\"year\", T, Y), N = 3, dateadd(\"day\", N, T, U), datediff(\"day\", T, U, D).").query("r(A,B,C)").toDF("k", "y", "d"),
    "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(3 AS BIGINT) AS d FROM orders")
add("logic_user_aggregate", lambda s, d: _user_aggregate(s, d), "SELECT n_regionkey AS r, CAST(product(n_nationkey % 5 + 1) AS BIGINT) AS p FROM nation GROUP BY n_regionkey")
add("logic_module", lambda s, d: LogicEngine(s, {"uses": part_dag(s, d)}).load('''begin module "stock".
database({uses(Whole: integer, Piece: integer, Amount: integer), spare(Piece: integer, Note: string)}). key(spare, [0]).
export short(A, B).
spare(2, "two"). spare(3, "three"). spare(6, "six").
short(W, substring_of) <- never(W). never(W) <- uses(W, W, _).
short(W, N) <- uses(W, P, A), A > 10, spare(P, M), substring(M, 1, 2, N).
end module.''').query("short(A,B)").toDF("a", "b"),
    f"WITH {DAG_P} SELECT DISTINCT a, CASE b WHEN 2 THEN 'tw' WHEN 3 THEN 'th' ELSE 'si' END AS b FROM arc WHERE b IN (2, 3, 6) AND w > 10")
add("logic_list_builtins", logic("pair(K, L) <- sup(K, N), L = [N, K]. got(K, S, M, C) <- pair(K, L), sort(L, S), nth_member(S, 1, M), subset([M], L), cardinality(L, C).", "got(A,B,C,D)", ["k", "l", "m", "n"], sup=lambda s, d: read(s, d, "supplier").select(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long"))),
    "SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS k, list_sort([CAST(s_nationkey AS BIGINT), CAST(s_suppkey AS BIGINT)]) AS l, CAST(least(s_nationkey, s_suppkey) AS BIGINT) AS m, 2 AS n FROM supplier")
add("logic_functor_parts", logic("made(F) <- nat(N, R), functor(F, \"spot\", [R, N]). seen(H, A) <- made(F), functor(F, H, L), nth_member(L, 2, A).", "seen(A,B)", ["h", "a"], nat=lambda s, d: read(s, d, "nation").select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"))),
    "SELECT 'spot' AS h, CAST(n_nationkey AS BIGINT) AS a FROM nation")
add("logic_witness", logic("far(1, mmin<C>, sample<V>) <- C = 0, V = 0. far(Y, mmin<C>, sample<X>) <- far(X, B, _), uses(X, Y, W), C = B + W.", "far(A,B,C)", ["node", "cost", "via"], uses=part_dag),
    f"WITH RECURSIVE {DAG_P}, r(node, cost) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT b, cost + w FROM r JOIN arc ON node = a), sp AS (SELECT node, min(cost) AS cost FROM r GROUP BY node) SELECT x.node, x.cost, coalesce(min(arc.a), 0) AS via FROM sp x LEFT JOIN (arc JOIN sp y ON y.node = arc.a) ON arc.b = x.node AND y.cost + arc.w = x.cost GROUP BY x.node, x.cost")


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Parts that are made of nothing, with their weight."""
    uses = part_dag(s, d)
    return read(s, d, "part").join(uses, F.col("p_partkey") == F.col("a"), "left_anti").select("p_partkey", F.col("p_size").cast("long"))


def _amounts(s: SparkSession, d: str) -> DataFrame:
    return part_dag(s, d).select("a", "b", F.col("w") % 3 + 1)


RAW = "raw AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS g FROM part WHERE p_partkey NOT IN (SELECT a FROM arc))"
add("bom_count_parts", logic("grams(Part, msum<(Part, G)>) <- raw(Part, G). grams(Part, msum<(Sub, (Times, G))>) <- grams(Sub, G), uses(Part, Sub, Times).", "grams(A,B)", ["part", "n"], raw=_raw, uses=_amounts),
    f"WITH RECURSIVE {DAG_P}, {RAW}, up(part, n) AS (SELECT part, g FROM raw UNION ALL SELECT a, n * (w % 3 + 1) FROM up JOIN arc ON part = b) SELECT part, CAST(sum(n) AS BIGINT) AS n FROM up GROUP BY part")
add("bom_ready_hours", logic("done(Part, mmax<T>) <- raw(Part, G), T = 5 * G. done(Part, mmax<T>) <- done(Sub, S), uses(Part, Sub, Times), T = S + Times. longest(Part, max<T>) <- done(Part, T).", "longest(A,B)", ["part", "hours"], raw=_raw, uses=_amounts),
    f"WITH RECURSIVE {DAG_P}, {RAW}, r(part, h) AS (SELECT part, 5 * g FROM raw UNION SELECT a, h + w % 3 + 1 FROM r JOIN arc ON part = b) SELECT part, max(h) AS hours FROM r GROUP BY part")


def _stakes(s: SparkSession, d: str) -> DataFrame:
    """Each supplier is held by those of a half and a third of its number."""
    return supplier_dag(s, d).select("a", "b", (20 + F.pmod(F.col("w"), F.lit(45))).alias("p"))


STAKES = DAG_S + ", stake AS (SELECT a, b, 20 + w % 45 AS p FROM arc)"
add("company_control", logic("arm(F, F) <- firm(F). arm(F, G) <- votes(F, G, V), V > 50. votes(F, G, msum<(H, V)>) <- arm(F, H), stake(H, G, V). rules(F, G) <- arm(F, G), F ~= G.", "rules(A,B)", ["a", "b"], firm=lambda s, d: read(s, d, "supplier").select("s_suppkey"), stake=_stakes),
    rounds("SELECT s_suppkey AS f, s_suppkey AS g FROM supplier", "SELECT f, g FROM {r} UNION SELECT f, b FROM {r} JOIN stake ON g = stake.a GROUP BY f, b HAVING sum(p) > 50", 16, "SELECT f AS a, g AS b FROM {r} WHERE f <> g", STAKES))
add("party_attendance", logic("goes(X) <- host(X). goes(X) <- urged(X, N), N >= 2. urged(X, mcount<Y>) <- knows(X, Y), goes(Y).", "goes(A)", ["x"], knows=lambda s, d: part_dag(s, d).select("b", "a"), host=lambda s, d: s.range(1, 7)),
    rounds("SELECT i AS x FROM range(1, 7) t(i)", "SELECT x FROM {r} UNION SELECT b FROM (SELECT DISTINCT a, b FROM arc) e JOIN {r} ON e.a = x GROUP BY b HAVING count(*) >= 2", 20, "SELECT x FROM {r}", DAG_P))
add("threshold_diffusion", logic("has(X) <- first(X). has(X) <- push(X, K), bar(X, B), K >= B. push(X, msum<(Y, W)>) <- has(Y), uses(Y, X, W).", "has(A)", ["x"], uses=part_dag, first=lambda s, d: s.range(1, 4), bar=lambda s, d: read(s, d, "part").select("p_partkey", F.lit(30))),
    rounds("SELECT i AS x FROM range(1, 4) t(i)", "SELECT x FROM {r} UNION SELECT b FROM arc JOIN {r} ON a = x WHERE b IN (SELECT p_partkey FROM part) GROUP BY b HAVING sum(w) >= 30", 20, "SELECT x FROM {r}", DAG_P))


def _flows(s: SparkSession, d: str) -> DataFrame:
    e = part_dag(s, d).select("a", "b").distinct()
    return e.withColumn("f", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("a")))


add("markov_monotonic", logic("mass(X, msum<(X, M)>) <- start(X, M). mass(Y, msum<(X, (F, M))>) <- mass(X, M), flow(X, Y, F).", "mass(A,B)", ["x", "p"], start=lambda s, d: s.range(1, 4).select("id", F.lit(0.25)), flow=_flows),
    f"WITH RECURSIVE {DAG_P}, e AS (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS f FROM (SELECT DISTINCT a, b FROM arc)), r(x, m) AS (SELECT CAST(i AS BIGINT), 0.25::DOUBLE FROM range(1, 4) t(i) UNION ALL SELECT b, m * f FROM r JOIN e ON x = a) SELECT x, sum(m) AS p FROM r GROUP BY x")
RINGS = "ring(0, X) <- hub(X). ring(J + 1, Y) <- ring(J, X), lanes(X, Y, _), ~seen(J, Y). seen(J, X) <- ring(J, X). seen(J + 1, X) <- seen(J, X)."
add("xy_rings", lambda s, d: LogicEngine(s, {"lanes": supplier_lanes(s, d), "hub": s.range(1, 2)}).load(RINGS).query("ring(A,B)").select(F.col("A").cast("long").alias("hops"), F.col("B").alias("node")),
    f"WITH RECURSIVE {BACK}, r(node, hops) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT b, hops + 1 FROM r JOIN arc ON node = a WHERE hops < 40) SELECT min(hops) AS hops, node FROM r GROUP BY node")

# graph library
add("graph_connected_components", lambda s, d: graph.connected_components(supplier_dag(s, d)).select("node", "component"),
    f"WITH RECURSIVE {DAG_S}, e AS (SELECT a, b FROM arc UNION SELECT b, a FROM arc), r(x, y) AS (SELECT a, a FROM e UNION SELECT x, b FROM r JOIN e ON y = a) SELECT x AS node, min(y) AS component FROM r GROUP BY x")


REACHED = f"WITH RECURSIVE {BACK}, t(a, b) AS (SELECT a, b FROM arc UNION SELECT t.a, arc.b FROM t JOIN arc ON t.b = arc.a)"
add("graph_strong_components", lambda s, d: graph.strongly_connected_components(supplier_lanes(s, d)).select("node", "component"),
    REACHED + ", n AS (SELECT a AS x FROM arc UNION SELECT b FROM arc) SELECT n.x AS node, least(n.x, coalesce(min(t.b), n.x)) AS component FROM n LEFT JOIN (SELECT t1.a, t1.b FROM t t1 JOIN t t2 ON t1.a = t2.b AND t1.b = t2.a) t ON n.x = t.a GROUP BY n.x")
add("tc_cyclic", lambda s, d: graph.transitive_closure(supplier_lanes(s, d)).toDF("a", "b"), REACHED + " SELECT a, b FROM t")
add("graph_triangles", lambda s, d: graph.triangles(trades(s, d)).select("node", "triangles"),
    f"WITH {TRADES}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM arc WHERE a <> b), t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), v AS (SELECT i AS node FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t), n AS (SELECT a AS node FROM arc UNION SELECT b FROM arc) SELECT n.node, count(v.node) AS triangles FROM n LEFT JOIN v ON n.node = v.node GROUP BY n.node")
add("graph_landmarks", lambda s, d: graph.landmark_distances(supplier_dag(s, d), s.createDataFrame([(48,), (36,)], "x long")).select("node", "landmark", F.col("hops").cast("long").alias("hops")),
    f"WITH RECURSIVE {DAG_S}, r(node, landmark, hops) AS (SELECT * FROM (VALUES (CAST(48 AS BIGINT), CAST(48 AS BIGINT), CAST(0 AS BIGINT)), (36, 36, 0)) UNION SELECT a, landmark, hops + 1 FROM r JOIN arc ON node = b) SELECT node, landmark, min(hops) AS hops FROM r GROUP BY node, landmark")
RANK_STEP = "SELECT n.x, 0.15 / c + 0.85 * (SELECT coalesce(sum(r), 0) FROM {r} WHERE x NOT IN (SELECT a FROM o)) / c + 0.85 * coalesce(g, 0) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT arc.b AS x, sum(r / o) AS g FROM {r} JOIN arc ON {r}.x = arc.a JOIN o ON o.a = arc.a GROUP BY arc.b) g ON n.x = g.x"
add("graph_pagerank", lambda s, d: graph.pagerank(trades(s, d)).select("node", F.round("rank", 6).alias("rank")),
    rounds("SELECT x, 1.0::DOUBLE / c AS r FROM n, c", RANK_STEP, 10, "SELECT x AS node, round(r, 6) AS rank FROM {r}", TRADES + ", n AS (SELECT a AS x FROM arc UNION SELECT b FROM arc), c AS (SELECT count(*) AS c FROM n), o AS (SELECT a, count(*) AS o FROM arc GROUP BY a)"))
add("graph_label_propagation", lambda s, d: graph.label_propagation(supplier_dag(s, d).select("a", "b"), 4).select("node", "label"),
    rounds("SELECT DISTINCT a AS node, a AS label FROM e", "SELECT node, arg_min(label, (-n, label)) AS label FROM (SELECT e.b AS node, label, count(*) AS n FROM e JOIN {r} ON e.a = node GROUP BY 1, 2) GROUP BY node", 4, "SELECT node, label FROM {r}", DAG_S + ", e AS (SELECT a, b FROM (SELECT DISTINCT a, b FROM arc) UNION ALL SELECT b, a FROM (SELECT DISTINCT a, b FROM arc))"))
add("graph_pregel_max", lambda s, d: graph.pregel(read(s, d, "supplier").select("s_suppkey", "s_suppkey"), supplier_dag(s, d).select("b", "a"), lambda v, a, b: v, lambda m: F.max(m), lambda old, new: F.greatest(old, new)).toDF("id", "value"),
    f"WITH RECURSIVE {DAG_S}, r(id, v) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT a, v FROM r JOIN arc ON id = b) SELECT id, max(v) AS value FROM r WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY id")

# mining
add("mining_frequent_itemsets", lambda s, d: mining.frequent_itemsets(read(s, d, "lineitem").select("l_orderkey", F.concat_ws("", "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))), 200, 3).select(F.concat_ws(",", "items").alias("items"), "size", "support"),
    "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linestatus || (l_linenumber % 3) AS i FROM lineitem), s1 AS (SELECT i AS items, 1 AS size, count(*) AS support FROM b GROUP BY i), s2 AS (SELECT x.i || ',' || y.i AS items, 2 AS size, count(*) AS support FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY 1), s3 AS (SELECT x.i || ',' || y.i || ',' || z.i AS items, 3 AS size, count(*) AS support FROM b x JOIN b y ON x.k = y.k AND x.i < y.i JOIN b z ON y.k = z.k AND y.i < z.i GROUP BY 1) SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE support >= 200")


def _kmeans(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    start = v.orderBy("vec_id").limit(4).select((F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("center"), "embedding")
    _, where = mining.kmeans(v, start, 3)
    return where.toDF("id", "center")


def _tree(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string").alias("y"))
    nodes = mining.decision_tree(rows, "o_orderstatus", ["o_orderpriority", "y"], 2)
    return mining.predict(nodes, rows).select("o_orderkey", "predicted")


def _user_aggregate(s: SparkSession, d: str) -> DataFrame:
    engine = LogicEngine(s, {"nat": read(s, d, "nation").select("n_regionkey", "n_nationkey")})
    engine.register_aggregate("product", F.lit(1).cast("long"), lambda acc, x: acc * (x % 5 + 1).cast("long"))
    return engine.load("p(R, product<K>) <- nat(R, K).").query("p(A,B)").toDF("r", "p")


NEAR = "SELECT vec_id, arg_min(center, (d, center)) AS center FROM (SELECT v.vec_id, c.center, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN {c} c) GROUP BY vec_id"
MOVED = "SELECT c.center, coalesce(m.x, c.x) AS x FROM {r} c LEFT JOIN (SELECT center, list(a ORDER BY i) AS x FROM (SELECT near.center, t.i, avg(v.x[t.i]) AS a FROM ({near}) near JOIN v ON v.vec_id = near.vec_id, unnest(range(1, len(v.x) + 1)) t(i) GROUP BY near.center, t.i) GROUP BY center) m ON c.center = m.center"
add("mining_kmeans", _kmeans, rounds("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS center, x FROM (SELECT * FROM v ORDER BY vec_id LIMIT 4)", MOVED.replace("{near}", NEAR.replace("{c}", "{r}")), 3, "SELECT vec_id AS id, center FROM (" + NEAR.replace("{c}", "{r}") + ")", "v AS (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL)"))
# after both features each row has the label most frequent among rows with its values, whichever feature came first
add("mining_decision_tree", _tree,
    "WITH t AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate) AS y FROM orders), c AS (SELECT p, y, arg_min(s, (-n, s)) AS predicted FROM (SELECT p, y, s, count(*) AS n FROM t GROUP BY p, y, s) GROUP BY p, y) SELECT o_orderkey, predicted FROM t JOIN c ON t.p = c.p AND t.y = c.y")

QUERIES = {name: q for name, (q, _) in PROGRAMS.items()}
ORACLE_SQL = {name: text for name, (_, text) in PROGRAMS.items() if text}
