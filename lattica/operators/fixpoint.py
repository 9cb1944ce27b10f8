"""Semi-naive fixpoints of mutually recursive predicates over DataFrames.

A predicate's rows are a set, or it keeps one value for each key: the least or greatest
(`min`, `max`), or the sum of contributions (`sum`; counts are sums of ones). A contribution
belongs to (key, rule, occurrence); a later one from the same occurrence replaces it.

Each round evaluates every rule once for each recursive reference, with the last round's changes
in its place and the full relations elsewhere, and keeps what is new. Changes are written to the
shared folder, so that a round's plan starts from files. A full relation is the log of
its changes; a log of `COMPACT` parts is merged into one. A full relation of at most SMALL_ROWS
rows, by count, is broadcast to the derived rows. A larger one is first reduced to the rows that meet the
derived ones: by broadcasting these where they are few, by count, so that it is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.store import Store

MODES = ("set", "min", "max", "sum")
COMPACT, FEW_ROWS, SMALL_ROWS, MAX_ITERATIONS = 6, 50_000, 200_000, 1000


class NoFixpoint(RuntimeError):
    """The rounds reached their limit while rows still changed."""


@dataclass
class Predicate:
    """columns: all of them; for min, max and sum the one at `value` is the aggregate, the others are
    the key, but for `witness` columns, which come from the row that won; of rows with equal values the
    one with the least witnesses (for max: the greatest) wins, whatever the rounds in which they came."""

    name: str
    columns: list[str]
    mode: str = "set"
    value: int | None = None
    witness: tuple[int, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [c for i, c in enumerate(self.columns) if i != self.value and i not in self.witness]


@dataclass
class Rule:
    """head: predicate name. reads: recursive predicates that the body refers to, in order (a name may
    repeat). body: gets a DataFrame for each of them and gives the head's columns by position; for
    mode sum a further last column may hold the occurrence."""

    head: str
    reads: list[str]
    body: Callable[[list[DataFrame]], DataFrame]


@dataclass
class _State:
    predicate: Predicate
    schema: T.StructType | None = None
    log: list[str] = field(default_factory=list)
    delta: str | None = None
    rows: int = 0
    dropped: list[str] = field(default_factory=list)
    parts_schema: T.StructType | None = None
    parts: list[str] = field(default_factory=list)


ORDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def wider(a: T.DataType, b: T.DataType, loose: bool = False) -> T.DataType:
    """A type for the values of both; loose: decimals become doubles, as they would grow without end."""
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or a == b and not (loose and isinstance(a, T.DecimalType)):
        return a
    numbers = (T.NumericType,)
    if isinstance(a, numbers) and isinstance(b, numbers):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DoubleType()
        return max((a, b), key=lambda t: ORDER.index(type(t)))
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    raise ValueError(f"rules give {a.simpleString()} and {b.simpleString()} for one column")


def _same(a: DataFrame, b: DataFrame, columns: list[str]):
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns), F.lit(True))


class Clique:
    """The predicates of one recursive component, and their rules."""

    def __init__(self, spark: SparkSession, predicates: list[Predicate], rules: list[Rule], max_iterations: int = MAX_ITERATIONS, stop_at_limit: bool = False):
        self.spark, self.rules, self.limit, self.stop_at_limit = spark, rules, max_iterations, stop_at_limit
        self.states = {p.name: _State(p) for p in predicates}
        self.store, self.iterations = Store(spark), 0

    # what rules see

    def _full(self, s: _State) -> DataFrame:
        log = self.store.get(s.schema, *s.log)
        p = s.predicate
        if p.mode == "set":
            return log
        if p.mode == "sum":
            return log.groupBy(*p.keys).agg(F.max_by(p.columns[p.value], "round__").alias(p.columns[p.value])).select(*p.columns)
        return self._best(log, p)

    @staticmethod
    def _order(p: Predicate):
        """What is compared: the value, and of equal values the witnesses."""
        names = [p.columns[p.value], *(p.columns[i] for i in p.witness)]
        return F.struct(*names) if p.witness else F.col(names[0])

    def _best(self, df: DataFrame, p: Predicate) -> DataFrame:
        v, pick = p.columns[p.value], F.min if p.mode == "min" else F.max
        if not p.witness:
            return df.groupBy(*p.keys).agg(pick(v).alias(v)).select(*p.columns)
        best = df.groupBy(*p.keys).agg(pick(self._order(p)).alias("best__"))
        return best.select(*(c if c in p.keys else F.col(f"best__.{c}") for c in p.columns))

    def _delta(self, s: _State) -> DataFrame:
        return self.store.get(s.schema, s.delta).select(*s.predicate.columns)

    # one round

    def _columns(self, number: int, rule: Rule, inputs: list[DataFrame]) -> DataFrame:
        """A rule's rows with the head's column names; for sums also the occurrence."""
        p = self.states[rule.head].predicate
        df = rule.body(inputs)
        width = len(p.columns)
        df = df.toDF(*p.columns, *(["occurrence__"] if len(df.columns) > width else []))
        if p.mode == "sum":
            occurrence = F.to_json(F.struct("occurrence__")) if len(df.columns) > width else F.lit("")
            return df.select(*p.columns, F.concat(F.lit(f"{number}:"), occurrence).alias("occurrence__"))
        return df.select(*p.columns)

    def _derived(self, name: str, first: bool) -> DataFrame | None:
        """All rows that the rules of a predicate give from the last changes."""
        s, out = self.states[name], []
        for number, rule in enumerate(self.rules):
            if rule.head != name or first == bool(rule.reads):
                continue
            for i, at in enumerate(rule.reads) if rule.reads else [(None, None)]:
                if at is not None and self.states[at].delta is None:
                    continue
                out.append(self._columns(number, rule, [self._delta(self.states[r]) if j == i else self._full(self.states[r]) for j, r in enumerate(rule.reads)]))
        if not out:
            return None
        kind = {f.name: f.dataType for f in s.schema.fields}
        return reduce(DataFrame.unionByName, [df.select(*(F.col(f"`{c}`").cast(kind[c]).alias(c) if c in kind else F.col(c) for c in df.columns)) for df in out])

    def _infer(self) -> None:
        """Column types that hold what every rule gives: bodies are analysed over empty inputs."""
        types: dict[str, list | None] = {n: None for n in self.states}
        for round_ in range(8):
            before = {n: list(t) if t else None for n, t in types.items()}
            for number, rule in enumerate(self.rules):
                if any(types[r] is None for r in rule.reads):
                    continue
                empty = [self.spark.createDataFrame([], self._struct(r, types[r])) for r in rule.reads]
                p = self.states[rule.head].predicate
                found = [f.dataType for f in self._columns(number, rule, empty).schema.fields[: len(p.columns)]]
                if p.mode == "sum":
                    whole = isinstance(found[p.value], T.IntegralType)
                    found[p.value] = T.LongType() if whole else T.DoubleType()
                known = types[rule.head]
                types[rule.head] = found if known is None else [wider(a, b, round_ > 2) for a, b in zip(known, found)]
            if types == before:
                break
        for n, s in self.states.items():
            if types[n] is None:
                raise ValueError(f"{n} has no rule that starts it")
            s.schema = self._struct(n, types[n])
            if s.predicate.mode == "sum":
                s.schema.add("round__", T.IntegerType(), True)
            s.log = [self.store.put(self.spark.createDataFrame([], s.schema))]

    def schema(self, name: str) -> T.StructType:
        """The columns of a predicate with the types that hold what its rules give."""
        if self.states[name].schema is None:
            self._infer()
        return self.states[name].schema

    def _struct(self, name: str, types: list) -> T.StructType:
        return T.StructType([T.StructField(c, t, True) for c, t in zip(self.states[name].predicate.columns, types)])

    def _put(self, s: _State, new: DataFrame) -> bool:
        """Write changes; true if there are any."""
        path = self.store.put(new.select(*s.schema.names))
        n = self.store.count(path)
        s.delta = path if n else None
        if n:
            s.log.append(path)
            s.rows += n
        return bool(n)

    def _compact(self, s: _State) -> None:
        """Merge long logs; what they replace is removed, but for the changes that the next round reads."""
        self.store.drop(*(p for p in s.dropped if p != s.delta))
        s.dropped = []
        if len(s.log) > COMPACT:
            full = self._full(s)
            if s.predicate.mode == "sum":
                full = full.withColumn("round__", F.lit(self.iterations))
            merged = self.store.put(full.select(*s.schema.names))
            self.store.drop(*(p for p in s.log if p != s.delta))
            s.dropped = [s.delta] if s.delta else []
            s.log = [merged]
        if len(s.parts) > COMPACT:
            old, s.parts = s.parts, [self.store.put(self._parts(s))]
            self.store.drop(*old)

    def _known(self, full: DataFrame, derived: DataFrame, keys: list[str], rows: int) -> DataFrame:
        """The rows of full with a key of derived."""
        if rows <= FEW_ROWS and keys:
            few = F.broadcast(derived.select(*keys).distinct())
            return full.join(few, _same(full, few, keys), "left_semi")
        return full

    def _counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        df = self.store.written(df)
        return df, self.store.count(self.store.passing[-1])

    def _merge_set(self, s: _State, derived: DataFrame) -> DataFrame:
        derived = derived.distinct()
        if not self.iterations:
            return derived
        if s.rows <= SMALL_ROWS:
            known = F.broadcast(self._full(s))
            return derived.join(known, _same(derived, known, s.predicate.columns), "left_anti")
        derived, n = self._counted(derived)
        known = self._known(self._full(s), derived, s.predicate.columns, n)
        return derived.join(known, _same(derived, known, s.predicate.columns), "left_anti")

    def _merge_best(self, s: _State, derived: DataFrame) -> DataFrame:
        p, v = s.predicate, s.predicate.columns[s.predicate.value]
        best = self._best(derived.where(F.col(v).isNotNull()), p)
        if not self.iterations:
            return best
        if s.rows <= SMALL_ROWS:
            known = F.broadcast(self._full(s).select(*p.keys, self._order(p).alias("known__")))
        else:
            best, n = self._counted(best)
            known = self._known(self._full(s), best, p.keys, n).select(*p.keys, self._order(p).alias("known__"))
        joined = best.join(known, _same(best, known, p.keys), "left").select(*(best[c] for c in p.columns), known["known__"])
        now = self._order(p)
        better = now < F.col("known__") if p.mode == "min" else now > F.col("known__")
        return joined.where(F.col("known__").isNull() | better).select(*p.columns)

    def _parts(self, s: _State) -> DataFrame:
        """The present contribution of each (key, occurrence)."""
        p = s.predicate
        v = p.columns[p.value]
        return self.store.get(s.parts_schema, *s.parts).groupBy(*p.keys, "occurrence__").agg(F.max_by(v, "round__").alias(v), F.max("round__").alias("round__")).select(*s.parts_schema.names)

    def _merge_sum(self, s: _State, derived: DataFrame) -> DataFrame:
        p = s.predicate
        v = p.columns[p.value]
        fresh = derived.where(F.col(v).isNotNull()).groupBy(*p.keys, "occurrence__").agg(F.max(v).alias(v)).withColumn("round__", F.lit(self.iterations))
        path = self.store.put(fresh)
        s.parts.append(path)
        s.parts_schema = s.parts_schema or T.StructType([T.StructField(f.name, f.dataType, True) for f in fresh.schema.fields])
        fresh = self.store.get(s.parts_schema, path)
        touched = fresh.select(*p.keys).distinct()
        rows = self.store.count(path)
        parts = self._parts(s)
        mine = self._known(parts, touched, p.keys, rows) if rows <= FEW_ROWS else parts.join(touched, _same(parts, touched, p.keys), "left_semi") if p.keys else parts
        now = mine.groupBy(*p.keys).agg(F.sum(v).alias(v)).select(*p.columns, F.lit(self.iterations).alias("round__"))
        if not self.iterations:
            return now
        if s.rows <= SMALL_ROWS:
            known = F.broadcast(self._full(s).select(*p.keys, F.col(v).alias("known__")))
        else:
            now, n = self._counted(now)
            known = self._known(self._full(s), now, p.keys, n).select(*p.keys, F.col(v).alias("known__"))
        joined = now.join(known, _same(now, known, p.keys), "left").select(*(now[c] for c in now.columns), known["known__"])
        return joined.where(~F.col("known__").eqNullSafe(F.col(v))).select(*now.columns)

    def solve(self) -> dict[str, DataFrame]:
        """The predicates' full relations."""
        self._infer()
        merge = {"set": self._merge_set, "min": self._merge_best, "max": self._merge_best, "sum": self._merge_sum}
        for name, s in self.states.items():
            derived = self._derived(name, first=True)
            if derived is not None:
                self._put(s, merge[s.predicate.mode](s, derived))
        while any(s.delta for s in self.states.values()):
            self.iterations += 1
            if self.iterations > self.limit:
                if self.stop_at_limit:
                    break
                raise NoFixpoint(f"{', '.join(self.states)}: rows still change after {self.limit} rounds")
            derived = {name: self._derived(name, first=False) for name in self.states}
            merged = {name: merge[self.states[name].predicate.mode](self.states[name], d) for name, d in derived.items() if d is not None}
            paths = {name: self.store.put(m.select(*self.states[name].schema.names)) for name, m in merged.items()}
            for name, s in self.states.items():
                s.delta = None
                n = self.store.count(paths[name]) if name in paths else 0
                if n:
                    s.delta = paths[name]
                    s.log.append(paths[name])
                    s.rows += n
                self._compact(s)
            self.store.sweep()
        return {name: self._full(s).select(*s.predicate.columns) for name, s in self.states.items()}


def set_fixpoint(exit_rows: DataFrame, step: Callable[[DataFrame], DataFrame], max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Rows of exit_rows and of step over them, again and again, each once."""
    return _linear(exit_rows, step, "set", None, max_iterations)


def best_fixpoint(exit_rows: DataFrame, step: Callable[[DataFrame], DataFrame], mode: str, value: str, max_iterations: int = MAX_ITERATIONS, witness: tuple[str, ...] = ()) -> DataFrame:
    """The least (mode min) or greatest (max) value for each key."""
    return _linear(exit_rows, step, mode, value, max_iterations, witness)


def sum_fixpoint(exit_rows: DataFrame, step: Callable[[DataFrame], DataFrame], value: str, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Sums of contributions for each key; step gives the columns and the occurrence last."""
    return _linear(exit_rows, step, "sum", value, max_iterations)


def _linear(exit_rows, step, mode, value, max_iterations, witness=()):
    columns = exit_rows.columns
    p = Predicate("p", columns, mode, columns.index(value) if value else None, tuple(columns.index(w) for w in witness))
    if mode == "sum":
        keys = [c for c in columns if c != value]
        exit_rows = exit_rows.groupBy(*keys).agg(F.sum(value).alias(value)).select(*columns)
    rules = [Rule("p", [], lambda _: exit_rows), Rule("p", ["p"], lambda d: step(d[0]))]
    return Clique(exit_rows.sparkSession, [p], rules, max_iterations).solve()["p"]
