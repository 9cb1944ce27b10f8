"""Rule bodies as DataFrame joins.

A body is evaluated over a table of bindings: one column for each variable. Positive literals join
on the variables they share, comparisons filter or bind, negation is an anti-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ast import Atom, Choice, Compare, Const, Functor, IfThenElse, Limit, ListTerm, Op, Sort, Truth, Var, variables
from .datalog import ProgramError

#: Built-in predicates and their numbers of arguments.
BUILTINS = {"append": 3, "member": 2, "subset": 2, "cardinality": 2, "nth_member": 3, "sort": 2, "functor": 3, "getdate": 1, "datepart": 3, "dateadd": 4, "datediff": 4, "substring": 4}


def is_builtin(a: Atom) -> bool:
    return BUILTINS.get(a.name) == len(a.args)


def column(term) -> Column:
    """A term as an expression over the bindings."""
    if isinstance(term, Var):
        return F.col(f"`{term.name}`")
    if isinstance(term, Const):
        return F.lit(term.value)
    if isinstance(term, Functor):
        return F.struct(F.lit(term.name).alias("name"), *(column(a).alias(f"a{i}") for i, a in enumerate(term.args)))
    if isinstance(term, ListTerm):
        items = F.array(*map(column, term.items))
        return items if term.tail is None else F.concat(items, column(term.tail))
    if isinstance(term, Op):
        x = [column(a) for a in term.args]
        name = term.name
        if name in ("+", "-", "*", "/"):
            return {"+": lambda: x[0] + x[1], "-": lambda: x[0] - x[1], "*": lambda: x[0] * x[1], "/": lambda: x[0] / x[1]}[name]()
        return {"div": lambda: F.floor(x[0] / x[1]).cast("long"), "mod": lambda: x[0] % x[1], "neg": lambda: -x[0], "log": lambda: F.log(x[0]), "exp": lambda: F.exp(x[0]), "step": lambda: F.when(x[0] >= 0, 1).otherwise(0), "abs": lambda: F.abs(x[0])}[name.lower()]()
    raise ProgramError(f"no expression for {term}")


def compare(op: str, a: Column, b: Column) -> Column:
    return {"=": lambda: a == b, "~=": lambda: a != b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b, "*=": lambda: F.like(a, b), "~*=": lambda: ~F.like(a, b)}[op]()


def matched(df: DataFrame, terms: tuple, columns: list[str]) -> DataFrame:
    """Rows of df whose columns fit the terms, as bindings of the terms' variables."""
    conditions, binds, later = [], {}, []
    for term, name in zip(terms, columns):
        later += _match(term, F.col(f"`{name}`"), conditions, binds)
    for term, value in later:
        conditions.append(_over(term, binds) == value)
    if conditions:
        df = df.where(reduce(lambda x, y: x & y, conditions))
    return df.select(*(c.alias(v) for v, c in binds.items())) if binds else df.select(F.lit(1).alias("one__"))


def _over(term, binds: dict[str, Column]) -> Column:
    if isinstance(term, Var):
        return binds[term.name]
    if isinstance(term, Op):
        inner = {f"v{i}__": _over(a, binds) for i, a in enumerate(term.args)}
        x = list(inner.values())
        return {"+": lambda: x[0] + x[1], "-": lambda: x[0] - x[1], "*": lambda: x[0] * x[1], "/": lambda: x[0] / x[1], "neg": lambda: -x[0]}[term.name]()
    return column(term)


def _match(term, value: Column, conditions: list, binds: dict) -> list:
    if isinstance(term, Var):
        if not term.anonymous:
            if term.name in binds:
                conditions.append(binds[term.name] == value)
            else:
                binds[term.name] = value
        return []
    if isinstance(term, Const):
        conditions.append(value.isNull() if term.value is None else value == F.lit(term.value))
        return []
    if isinstance(term, Functor):
        conditions.append(value["name"] == term.name)
        return [x for i, a in enumerate(term.args) for x in _match(a, value[f"a{i}"], conditions, binds)]
    if isinstance(term, ListTerm):
        n = len(term.items)
        conditions.append(F.size(value) == n if term.tail is None else F.size(value) >= n)
        out = [x for i, a in enumerate(term.items) for x in _match(a, value[i], conditions, binds)]
        return out + ([] if term.tail is None else _match(term.tail, F.slice(value, n + 1, F.greatest(F.size(value) - n, F.lit(0))), conditions, binds))
    return [(term, value)]


class Bindings:
    """A table of bindings that literals extend one after the other."""

    def __init__(self, spark: SparkSession, relation, hint: str | None = None):
        self.spark, self.relation, self.hint = spark, relation, hint
        self.df: DataFrame | None = None
        self.bound: set[str] = set()

    def copy(self) -> Bindings:
        other = Bindings(self.spark, self.relation, self.hint)
        other.df, other.bound = self.df, set(self.bound)
        return other

    def start(self) -> DataFrame:
        return self.df if self.df is not None else self.spark.range(1).select(F.lit(1).alias("one__"))

    def bind(self, name: str, value: Column) -> None:
        self.df = self.start().withColumn(name, value)
        self.bound.add(name)

    def keep(self, condition: Column) -> None:
        self.df = self.start().where(condition)

    def join(self, df: DataFrame, how: str = "inner") -> None:
        new = [c for c in df.columns if c != "one__"]
        shared = [c for c in new if c in self.bound]
        if self.df is None and how == "inner":
            self.df = df
        elif shared:
            right = df.select(*(F.col(f"`{c}`").alias(f"r__{c}") for c in new))
            if self.hint and how == "inner":
                right = right.hint(self.hint)
            on = reduce(lambda x, y: x & y, (F.col(f"`{c}`") == F.col(f"`r__{c}`") for c in shared))
            joined = self.start().join(right, on, how)
            self.df = joined if how != "inner" else joined.select(*(F.col(f"`{c}`") for c in self.start().columns), *(F.col(f"`r__{c}`").alias(c) for c in new if c not in shared))
        elif how == "inner":
            self.df = self.start().crossJoin(df.drop("one__") if new else df.limit(1).drop("one__"))
        else:
            some = df.limit(1).select(F.lit(1).alias("some__"))
            self.df = self.start().join(some, F.lit(True), how)
        if how == "inner":
            self.bound |= set(new)

    # literals

    def ready(self, literal) -> bool:
        """Whether the literal can be evaluated now."""
        need = variables(literal)
        if isinstance(literal, Atom):
            if literal.negated:
                return True
            if is_builtin(literal):
                return self._builtin_ready(literal)
            return True
        if isinstance(literal, Compare):
            if need <= self.bound:
                return True
            if literal.op != "=":
                return False
            return any(isinstance(a, Var) and variables(b) <= self.bound for a, b in ((literal.left, literal.right), (literal.right, literal.left)))
        if isinstance(literal, IfThenElse):
            own = set().union(*map(variables, literal.condition))
            return bool(own & self.bound) or not self.bound or not own
        return True

    def _builtin_ready(self, a: Atom) -> bool:
        unbound = [i for i, t in enumerate(a.args) if not variables(t) <= self.bound]
        if a.name == "functor":
            return 0 not in unbound or unbound == [0]
        free = {"append": (2,), "member": (0,), "subset": (), "cardinality": (1,), "nth_member": (2,), "sort": (1,), "getdate": (0,), "datepart": (2,), "dateadd": (3,), "datediff": (3,), "substring": (3,)}[a.name]
        return all(i in free for i in unbound)

    def add(self, body: tuple) -> Bindings:
        """All literals of a body; each when what it needs is bound, joins that share variables first."""
        waiting = [x for x in body if not isinstance(x, (Limit, Sort, Choice))]
        while waiting:
            usable = [x for x in waiting if self.ready(x)]
            plain = [x for x in usable if not isinstance(x, Atom) or is_builtin(x) and not x.negated]
            atoms = [x for x in usable if isinstance(x, Atom) and not x.negated and not is_builtin(x)]
            sharing = [x for x in atoms if variables(x) & self.bound]
            cheap = [x for x in plain if not isinstance(x, IfThenElse)]
            conditional = [x for x in plain if isinstance(x, IfThenElse)]
            negated = [x for x in usable if isinstance(x, Atom) and x.negated and not any(v in set().union(*(variables(y) for y in waiting if y is not x and not (isinstance(y, Atom) and y.negated)), set()) - self.bound for v in variables(x))]
            choice = (cheap or sharing or (atoms if not self.bound else []) or (conditional if not atoms else []) or atoms or conditional or negated)
            if not choice:
                raise ProgramError(f"unbound variables in {waiting}")
            self.one(choice[0])
            waiting.remove(choice[0])
        return self

    def one(self, literal) -> None:
        if isinstance(literal, Truth):
            if not literal.value:
                self.keep(F.lit(False))
        elif isinstance(literal, Compare):
            left, right = literal.left, literal.right
            if variables(literal) <= self.bound:
                self.keep(compare(literal.op, column(left), column(right)))
            elif isinstance(left, Var) and left.name not in self.bound:
                self.bind(left.name, column(right))
            else:
                self.bind(right.name, column(left))
        elif isinstance(literal, IfThenElse):
            self._if(literal)
        elif is_builtin(literal):
            self._builtin(literal)
        else:
            df, columns = self.relation(literal)
            if len(columns) != len(literal.args):
                raise ProgramError(f"{literal.name} has {len(columns)} columns, not {len(literal.args)}")
            literal, later = self._computed(literal)
            rows = matched(df, literal.args, columns)
            if literal.negated:
                known = [c for c in rows.columns if c in self.bound]
                self.join(rows.select(*(F.col(f"`{c}`") for c in known)).distinct() if known else rows, "left_anti")
            else:
                self.join(rows)
            for name, term in later:
                self.keep(F.col(f"`{name}`") == column(term))

    def _computed(self, a: Atom) -> tuple[Atom, list]:
        """Arithmetic arguments become variables: joined on where it can be computed, else compared after the join."""
        args, later = [], []
        for i, t in enumerate(a.args):
            if isinstance(t, Op):
                name = f"op{i}__{len(self.bound)}"
                if variables(t) <= self.bound:
                    self.bind(name, column(t))
                else:
                    later.append((name, t))
                t = Var(name)
            args.append(t)
        return Atom(a.name, tuple(args), a.negated), later

    def _if(self, literal: IfThenElse) -> None:
        """Rows that meet the condition go on with `then`, the others with `else` (none: as they are)."""
        base = self.start().withColumn("row__", F.struct(*(F.col(f"`{c}`") for c in self.start().columns)))
        met = self.copy()
        met.df = base
        met.add(literal.condition)
        missed = self.copy()
        hits = met.df.select(F.col("row__").alias("hit__")).distinct()
        missed.df = base.join(hits, F.col("row__").eqNullSafe(F.col("hit__")), "left_anti").drop("row__")
        met.df = met.df.drop("row__")
        met.add(literal.then)
        if literal.otherwise is not None:
            missed.add(literal.otherwise)
        names = sorted(met.bound & missed.bound)
        self.bound = set(names)
        self.df = met.df.select(*(F.col(f"`{c}`") for c in names)).unionByName(missed.df.select(*(F.col(f"`{c}`") for c in names)))

    def _give(self, term, value: Column) -> None:
        """term = value: binds a free variable, else filters."""
        if isinstance(term, Var) and term.anonymous:
            return
        if isinstance(term, Var) and term.name not in self.bound:
            self.bind(term.name, value)
        elif variables(term) <= self.bound:
            self.keep(column(term) == value)
        else:
            conditions: list = []
            binds: dict = {}
            _match(term, value, conditions, binds)
            self.df = self.start()
            for c in conditions:
                self.keep(c)
            for v, c in binds.items():
                if v in self.bound:
                    self.keep(F.col(f"`{v}`") == c)
                else:
                    self.bind(v, c)

    def _builtin(self, a: Atom) -> None:
        t = a.args
        known = lambda i: variables(t[i]) <= self.bound
        if a.name == "append":
            self._give(t[2], F.concat(column(t[0]), column(t[1])))
        elif a.name == "member":
            if known(0):
                self.keep(F.array_contains(column(t[1]), column(t[0])))
            else:
                self.df = self.start().withColumn("member__", F.explode(column(t[1])))
                self._give(t[0], F.col("member__"))
                self.df = self.df.drop("member__")
        elif a.name == "subset":
            self.keep(F.size(F.array_except(column(t[0]), column(t[1]))) == 0)
        elif a.name == "cardinality":
            self._give(t[1], F.size(column(t[0])))
        elif a.name == "nth_member":
            at, items = column(t[1]), column(t[0])
            self.keep((at >= 1) & (at <= F.size(items)))
            self._give(t[2], F.element_at(items, at))
        elif a.name == "sort":
            self._give(t[1], F.array_sort(column(t[0])))
        elif a.name == "functor":
            if known(0):
                value = column(t[0])
                self._give(t[1], value["name"])
                fields = next(f for f in self.start().select(value.alias("x")).schema.fields).dataType
                self._give(t[2], F.array(*(value[n] for n in fields.names if n != "name")))
            else:
                if not isinstance(t[2], ListTerm) or t[2].tail is not None:
                    raise ProgramError("functor/3 builds from a list of known length")
                self._give(t[0], F.struct(column(t[1]).alias("name"), *(column(x).alias(f"a{i}") for i, x in enumerate(t[2].items))))
        elif a.name == "getdate":
            self._give(t[0], F.current_timestamp())
        elif a.name == "datepart":
            self._give(t[2], F.date_part(F.lit(t[0].value), column(t[1])).cast("int"))
        elif a.name == "dateadd":
            self._give(t[3], _date_add(t[0].value, column(t[1]), column(t[2])))
        elif a.name == "datediff":
            self._give(t[3], _date_diff(t[0].value, column(t[1]), column(t[2])))
        elif a.name == "substring":
            self._give(t[3], F.substring(column(t[0]), column(t[1]), column(t[2])))


#: Date units by the interval that one of them is.
UNITS = {"year": (12, 0), "month": (1, 0), "week": (0, 604800), "day": (0, 86400), "hour": (0, 3600), "minute": (0, 60), "second": (0, 1)}


def _date_add(unit: str, amount: Column, date: Column) -> Column:
    months, seconds = UNITS[unit]
    date = date.cast("timestamp")
    return date + F.make_ym_interval(F.lit(0), (amount * months).cast("int")) if months else date + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (amount * seconds).cast("decimal(18,6)"))


def _date_diff(unit: str, start: Column, end: Column) -> Column:
    months, seconds = UNITS[unit]
    if months:
        return F.floor(F.months_between(end.cast("timestamp"), start.cast("timestamp")) / months).cast("long")
    return F.floor((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / seconds).cast("long")


def chosen(df: DataFrame, body: tuple) -> DataFrame:
    """choice((X), (Y)): of each X only the least Y stays."""
    for c in body:
        if isinstance(c, Choice):
            window = Window.partitionBy(*map(column, c.left)).orderBy(*map(column, c.right))
            df = df.withColumn("place__", F.rank().over(window)).where("place__ = 1").drop("place__")
    return df
