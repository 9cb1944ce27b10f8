"""Scripts of the recursive SQL dialect on small graphs, against closures by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lattica import store
from lattica.operators.fixpoint import NoFixpoint
from lattica.plans import recsql

LINE = """-- hint: broadcast
create table brought(giver int, taker int);
WITH recursive line (elder, member) AS (SELECT giver, taker FROM brought)
  UNION (SELECT brought.giver, line.member FROM line, brought WHERE line.elder = brought.taker)
SELECT elder, member FROM line"""
GRAPHS = {
    "chain": [(i, i + 1) for i in range(8)],
    "cycle": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)],
    "tree": [(i // 2, i) for i in range(2, 16)],
    "random": [(random.Random(i).randrange(9), random.Random(i + 50).randrange(9)) for i in range(20)],
    "empty": [],
}


def closure(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


def run(spark, text, tables, **parameters):
    session = recsql.RecursiveSql(spark)
    frames = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()}
    return sorted(map(tuple, session.script(text, frames, **parameters).collect()))


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_transitive_closure(spark, name):
    assert run(spark, LINE, {"brought": (GRAPHS[name], "a int, b int")}) == sorted(closure(GRAPHS[name]))


@pytest.mark.parametrize("hint", ["broadcast", "shuffle", "sortMerge"])
def test_hints(spark, hint):
    text = LINE.replace("broadcast", hint)
    assert run(spark, text, {"brought": (GRAPHS["cycle"], "a int, b int")}) == sorted(closure(GRAPHS["cycle"]))


def test_large_base_relations_stand_in_buckets(spark, monkeypatch):
    """Rounds don't exchange them: the join with the changes moves the changes only."""
    monkeypatch.setattr(store, "BUCKET_BYTES", 100)
    edges = [(i // 2, i) for i in range(2, 400)]
    assert run(spark, LINE, {"brought": (edges, "a int, b int")}) == sorted(closure(edges))
    base = store.Store(spark, "t").base(spark.createDataFrame(edges, "a int, b int"), "a")
    changes = base.limit(5).select(F.col("b").alias("x")).distinct()
    monkeypatch.setattr(store, "BUCKET_BYTES", 1 << 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = changes.join(base, changes.x == base.a)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    assert not any("Exchange" in x for x in lines[at - 2 : at]) and any("Exchange" in x for x in lines)
    assert recsql.join_columns("SELECT 1 FROM uses u JOIN ways ON u.`whole` = ways.item", {"ways"}) == {"uses": "whole"}


def test_least_fares_with_reserved_names(spark):
    text = "create table hop(From integer, To integer, Order double); WITH recursive fare (To, min() AS Order) AS (SELECT hop.To, hop.Order FROM hop WHERE hop.From = {home}) UNION (SELECT hop.To, hop.Order + fare.Order FROM hop JOIN fare ON fare.To = hop.From) SELECT To, Order FROM fare"
    hops = [(1, 2, 1.5), (2, 3, 1.0), (1, 3, 9.0), (3, 1, 1.0)]
    assert run(spark, text, {"hop": (hops, "a int, b int, c double")}, home=1) == [(1, 3.5), (2, 1.5), (3, 2.5)]


def test_counts_follow_occurrences(spark):
    text = "create table lanes(origin integer, target integer); WITH recursive routes (origin, target, count() AS n) AS (SELECT origin, target, 1 FROM lanes) UNION (SELECT lanes.origin, routes.target, routes.n FROM lanes, routes WHERE routes.origin = lanes.target) SELECT origin, target, n FROM routes"
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (2, 5), (2, 5)]
    counts = {}
    edge_set = set(edges)

    def walk(start, at):
        for a, b in edge_set:
            if a == at:
                counts[start, b] = counts.get((start, b), 0) + 1
                walk(start, b)

    for n in range(1, 6):
        walk(n, n)
    assert run(spark, text, {"lanes": (edges, "a int, b int")}) == sorted((a, b, n) for (a, b), n in counts.items())


def test_sum_with_decay(spark):
    text = "create table bought(buyer integer, price double); create table brought(giver integer, taker integer); WITH recursive credit (who, sum() AS points) AS (SELECT buyer, price / 5 FROM bought) UNION (SELECT brought.giver, credit.points / 4 FROM brought, credit WHERE credit.who = brought.taker) SELECT who, round(points, 6) AS points FROM credit"
    got = run(spark, text, {"bought": ([(1, 10.0), (2, 20.0), (2, 5.0), (3, 1.0)], "m int, p double"), "brought": ([(1, 2), (2, 3)], "a int, b int")})
    assert got == [(1, 3.2625), (2, 5.05), (3, 0.2)]


def test_mutual_recursion(spark):
    text = "create table e(A integer, B integer); WITH recursive even (A, B) AS (SELECT odd.A, e.B FROM odd, e WHERE odd.B = e.A), odd (A, B) AS (SELECT A, B FROM e) UNION (SELECT even.A, e.B FROM even, e WHERE even.B = e.A) SELECT A, B FROM even"
    assert run(spark, text, {"e": ([(1, 2), (2, 3), (3, 4), (4, 5)], "a int, b int")}) == [(1, 3), (1, 5), (2, 4), (3, 5)]


def test_nulls_end(spark):
    got = recsql.RecursiveSql(spark).script(LINE, {"brought": spark.createDataFrame([(1, None), (2, 1)], "a int, b int")}).collect()
    assert {tuple(r) for r in got} == {(1, None), (2, 1), (2, None)}


def test_cycle_of_counts_is_refused(spark):
    session = recsql.RecursiveSql(spark, max_iterations=6)
    text = "create table ring(here integer, next integer); WITH recursive turns (at, count() AS n) AS (SELECT 1, 1) UNION (SELECT ring.next, turns.n FROM ring, turns WHERE ring.here = turns.at) SELECT at, n FROM turns"
    with pytest.raises(NoFixpoint):
        session.script(text, {"ring": spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")})


def test_mistakes_are_told(spark):
    session = recsql.RecursiveSql(spark)
    with pytest.raises(recsql.ScriptError, match="parameter"):
        session.script("SELECT {x}")
    with pytest.raises(recsql.ScriptError, match="type"):
        session.script("create table t(a blob)")
    with pytest.raises(recsql.ScriptError, match="hint"):
        session.script("-- hint: magic\nSELECT 1")
    with pytest.raises(recsql.ScriptError, match="two aggregates"):
        recsql.parse_recursive("WITH recursive v(min() AS a, max() AS b) AS (SELECT 1, 2) SELECT * FROM v")


def test_plain_sql_and_views(spark):
    got = run(spark, "create table t(A integer, B integer); create view v(X) AS (SELECT A + B FROM t); SELECT X FROM v WHERE X > 3", {"t": ([(1, 2), (3, 4)], "a int, b int")})
    assert got == [(7,)]


PEERS = """create table feeds(hub long, outlet long);
WITH recursive peers (one, other) AS (SELECT 1, 1)
  UNION (SELECT l.outlet, r.outlet FROM feeds l, peers, feeds r WHERE peers.one = l.hub AND r.hub = peers.other)
SELECT one, other FROM peers WHERE one <> other"""


@pytest.mark.parametrize("name", ["tree", "cycle", "rings"])
def test_pairs_of_a_generation_are_not_written(spark, monkeypatch, name):
    """A tree's generations are kept by node, in blocks for their products; where rounds meet again, pairs are."""
    rings = [(1, 2), (2, 3), (3, 1), (2, 5), (5, 6), (6, 1), (1, 7), (7, 8)]
    edges = [(i // 2, i) for i in range(2, 512)] if name == "tree" else rings if name == "rings" else GRAPHS["cycle"]
    want, new = {(1, 1)}, {(1, 1)}
    below = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    while new:
        new = {(x, y) for a, b in new for x in below.get(a, ()) for y in below.get(b, ())} - want
        want |= new
    written, put = [], store.Store.put

    def counted(self, df):
        path = put(self, df)
        written.append(self.rows[path])
        return path

    monkeypatch.setattr(store.Store, "put", counted)
    monkeypatch.setattr(recsql, "BLOCK_ROWS", 20)
    got = run(spark, PEERS, {"feeds": (edges, "a long, b long")})
    assert got == sorted((a, b) for a, b in want if a != b)
    if name == "tree":
        assert sum(written) <= 3 * 511 < len(want) / 50


def test_independent_parts_of_an_arm():
    view = recsql.View("peers", ["one", "other"], None, None)
    arm = "SELECT l.outlet, r.outlet FROM feeds l, peers, feeds r WHERE peers.one = l.hub AND r.hub = peers.other"
    assert [c for c, _ in recsql.factors(arm, view)] == [[0], [1]]
    for other in [arm + " AND l.outlet = r.outlet", arm.replace("l.outlet, r.outlet", "r.outlet, l.outlet"), arm + " AND l.hub < 3", arm.replace("SELECT", "SELECT DISTINCT"), arm.replace("r.outlet", "r.outlet + 1", 1), arm.replace("peers,", "peers, peers p,"), arm + " OR l.hub = r.hub"]:
        assert recsql.factors(other, view) is None
