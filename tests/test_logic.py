"""Logic programs: the dialect's literals, aggregates, recursion over stages, and its errors."""

import pytest

from lattica.operators.fixpoint import NoFixpoint
from lattica.plans.ast import Aggregate, Atom, Compare, Const, IfThenElse, ListTerm, Op, Var
from lattica.plans.datalog import ProgramError, parse
from lattica.plans.engine import LogicEngine
from lattica.plans.graph import components

ARCS = "arc(1,2,1). arc(2,3,1). arc(1,3,5). arc(3,4,2)."


def rows(spark, text, query, **options):
    return sorted(map(tuple, LogicEngine(spark, **options).load(text).query(query).collect()), key=str)


def test_parser():
    p = parse('begin module "M". database({p(X: integer, Y: [string], Z: (a: float)), q(A: string)}). key(p,[0]). export r($A, B). % note\nr(X, fscnt<(Y,(K,N))>) <- p(X,Y,_), ~q(X), N = 2 * K + 1, if (X > 1 then K = 1 else K = 2). @monotonic\nq("a"). r(-1, [1,2|T]) <- s(T). query r(1,B). end module.')
    assert p.module == "M" and p.keys == {"p": (0,)} and p.exports == [("r", ("$A", "B"))]
    assert p.schemas["p"] == (("X", "integer"), ("Y", ("list", "string")), ("Z", ("struct", (("a", "float"),))))
    head = p.rules[0].head
    assert head.args[1] == Aggregate("fscnt", Var("N"), (Var("Y"),), Var("K")) and p.rules[0].annotation == "monotonic"
    assert p.rules[0].body[1] == Atom("q", (Var("X"),), True)
    assert p.rules[0].body[2] == Compare("=", Var("N"), Op("+", (Op("*", (Const(2), Var("K"))), Const(1))))
    assert isinstance(p.rules[0].body[3], IfThenElse)
    assert p.rules[1].head.args == (Const(-1), ListTerm((Const(1), Const(2)), Var("T")))
    assert p.facts == [Atom("q", (Const("a"),))] and p.queries == [Atom("r", (Const(1), Var("B")))]


@pytest.mark.parametrize("text", ["p(X <- q(X).", "p(X) <- .", "p(X) <- q(X) r(X).", "p(#)."])
def test_parser_refuses(text):
    with pytest.raises(ProgramError):
        parse(text)


def test_components_come_in_order():
    assert components({"a": {"b"}, "b": {"c", "b2"}, "b2": {"b"}, "c": set()}) == [["c"], ["b", "b2"], ["a"]]


def test_sets_and_keys(spark):
    assert rows(spark, "p(1,2). p(1,2). p(3,4). q(Y) <- p(_,Y).", "q(A)") == [(2,), (4,)]
    assert len(rows(spark, "database({p(X: integer, Y: integer)}). key(p,[0]). p(1,2). p(1,3).", "p(A,B)")) == 1


def test_negation_and_constants(spark):
    assert rows(spark, ARCS + "inner(X) <- arc(X,_,_). leaf(Y) <- arc(_,Y,_), ~inner(Y).", "leaf(A)") == [(4,)]
    assert rows(spark, ARCS, "arc(1,B,C)") == [(2, 1), (3, 5)]
    assert rows(spark, ARCS + "p(X) <- arc(X,X,_).", "p(A)") == []


def test_bound_query_restricts_the_start(spark):
    text = ARCS + "tc(X,Y) <- arc(X,Y,_). tc(X,Y) <- tc(X,Z), arc(Z,Y,_)."
    e = LogicEngine(spark).load(text)
    assert e._preserved("tc", {0: 2}) == {0: 2} and e._preserved("tc", {1: 4}) == {}
    assert sorted(r.B for r in e.query("tc(2,B)").collect()) == [3, 4]
    assert sorted(r.A for r in e.query("tc(A,4)").collect()) == [1, 2, 3]
    assert sorted(r.B for r in e.query("tc($S,B)", S=3).collect()) == [4]


def test_witness_of_the_best(spark):
    text = "uses(1,2,4). uses(1,3,1). uses(3,2,3). uses(2,4,1). uses(3,4,9). near(1, mmin<C>, sample<V>) <- C = 0, V = 0. near(Y, mmin<C>, sample<X>) <- uses(X,Y,W), near(X,B,_), C = W + B."
    assert rows(spark, text, "near(A,B,C)") == [(1, 0, 0), (2, 4, 1), (3, 1, 1), (4, 5, 2)]
    # 3 is reached at the same cost by 2, and a round later by 1's other way
    later = "uses(1,5,1). uses(5,3,9). uses(1,4,2). uses(4,2,3). uses(2,3,5). far(1, mmin<C>, sample<V>) <- C = 0, V = 0. far(Y, mmin<C>, sample<X>) <- uses(X,Y,W), far(X,B,_), C = W + B."
    assert (3, 10, 2) in rows(spark, later, "far(A,B,C)")
    assert rows(spark, "p(1,5,7). p(1,5,3). p(1,4,9). q(X, max<Y>, cmax<Z>) <- p(X,Y,Z).", "q(A,B,C)")[0][:2] == (1, 5)


def test_mutual_recursion_with_threshold(spark):
    text = "firm(a). firm(b). firm(c). firm(d). firm(e). stake(a,b,51). stake(a,c,61). stake(b,d,11). stake(c,d,40). stake(c,e,60). arm(F,F) <- firm(F). arm(F,G) <- votes(F,G,V), V > 50. votes(F,G,msum<(H,V)>) <- arm(F,H), stake(H,G,V). held(F,G) <- arm(F,G), F ~= G."
    assert rows(spark, text, "held(A,B)") == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("c", "e")]


def test_one_answer_by_three_kinds_of_recursion(spark):
    """Fewest steps: grouping all bounded walks, a minimum inside the recursion, and stages that stop when nothing is new."""
    steps = "step(1,2). step(2,3). step(1,3). step(3,4). step(4,2). step(3,1). "
    want = [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(spark, steps + "walk(1, N) <- N = 0. walk(Y, N) <- walk(X, M), step(X, Y), M < 5, N = M + 1. few(X, min<N>) <- walk(X, N).", "few(A,B)") == want
    assert rows(spark, steps + "few(1, mmin<N>) <- N = 0. few(Y, mmin<N>) <- few(X, M), step(X, Y), N = M + 1.", "few(A,B)") == want
    staged = steps + "start(1). ring(0, X) <- start(X). ring(J + 1, Y) <- ring(J, X), step(X, Y), ~seen(J, Y). seen(J, X) <- ring(J, X). seen(J + 1, X) <- seen(J, X). few(X, J) <- ring(J, X)."
    assert rows(spark, staged, "few(A,B)") == want


def test_lists_functors_strings_dates(spark):
    assert rows(spark, "p([1,2,3]). h(H,T) <- p([H|T]).", "h(A,B)") == [(1, [2, 3])]
    assert rows(spark, "p([3,1,2]). m(X) <- p(L), member(X,L), X > 1.", "m(A)") == [(2,), (3,)]
    assert rows(spark, "p([3,1,2]). s(S,N,E) <- p(L), sort(L,S), cardinality(L,N), nth_member(L,2,E).", "s(A,B,C)") == [([1, 2, 3], 3, 1)]
    assert rows(spark, "p([1],[1,2]). p([3],[1,2]). s(A) <- p(A,B), subset(A,B).", "s(A)") == [([1],)]
    assert rows(spark, "p([1],[2]). a(C) <- p(A,B), append(A,B,C).", "a(A)") == [([1, 2],)]
    assert rows(spark, 'p(1). f(F) <- p(X), functor(F, "pair", [X, 2]). n(N,L) <- f(F), functor(F,N,L).', "n(A,B)") == [("pair", [1, 2])]
    assert rows(spark, 'p("hello"). s(S) <- p(X), substring(X,2,3,S).', "s(A)") == [("ell",)]
    assert rows(spark, 'p("2020-01-31"). s(Y,D) <- p(T), datepart("month",T,Y), dateadd("day",2,T,U), datediff("day",T,U,D).', "s(A,B)") == [(1, 2)]
    assert len(rows(spark, "p(1). n(D) <- p(_), getdate(D).", "n(A)")) == 1


def test_like_choice_sort_limit_truth(spark):
    text = 'p(1,"red x"). p(2,"blue"). p(1,"blue"). l(K) <- p(K,N), N *= "red%". o(K,N) <- p(K,N), N ~*= "red%". c(K,N) <- p(K,N), choice((K),(N)). t(K,N) <- p(K,N), sort((N,desc),(K,asc)), limit(2). f(K) <- p(K,_), false. g(K) <- p(K,_), true.'
    assert rows(spark, text, "l(A)") == [(1,)]
    assert rows(spark, text, "o(A,B)") == [(1, "blue"), (2, "blue")]
    assert rows(spark, text, "c(A,B)") == [(1, "blue"), (2, "blue")]
    assert rows(spark, text, "t(A,B)") == [(1, "blue"), (1, "red x")]
    assert rows(spark, text, "f(A)") == [] and rows(spark, text, "g(A)") == [(1,), (2,)]


def test_arithmetic(spark):
    text = "p(7,2). r(A,B,C,D,E) <- p(X,Y), A = X div Y, B = X mod Y, C = -X, D = X / Y, E = step(Y - 3)."
    assert rows(spark, text, "r(A,B,C,D,E)") == [(3, 1, -7, 3.5, 0)]


def test_refused_programs(spark):
    with pytest.raises(ProgramError, match="negation"):
        rows(spark, "q(1). p(X) <- q(X), ~p(X).", "p(A)")
    with pytest.raises(ProgramError, match="not bound"):
        rows(spark, "q(1). p(X,Y) <- q(X).", "p(A,B)")
    with pytest.raises(ProgramError, match="columns"):
        rows(spark, "q(1). p(X) <- q(X,X).", "p(A)")
    with pytest.raises(ProgramError, match="unknown relation"):
        rows(spark, "p(X) <- nothing(X).", "p(A)")
    with pytest.raises(ProgramError, match="avg"):
        rows(spark, "q(1,1). p(X,avg<Y>) <- q(X,Y). p(X,avg<Y>) <- p(X,Y).", "p(A,B)")
    with pytest.raises(NoFixpoint):
        rows(spark, "q(1). p(X) <- q(X). p(Y) <- p(X), Y = X + 1.", "p(A)", max_iterations=3)


def test_exports_and_queries_run(spark):
    e = LogicEngine(spark).load("export q(A). p(1). q(X) <- p(X).")
    assert [tuple(r) for r in e.run()["q"].collect()] == [(1,)]
