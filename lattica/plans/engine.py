"""Evaluation of logic programs: strata in order, recursive components by fixpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.fixpoint import MAX_ITERATIONS, Clique, Predicate, Rule
from lattica.store import Store

from .ast import Aggregate, Atom, Compare, Const, IfThenElse, Limit, Op, Program, RuleText, Sort, Var, variables
from .datalog import Parser, ProgramError
from .graph import components
from .lower import Bindings, chosen, column, is_builtin, matched

#: Declared types, and aggregates by what they do inside a recursion.
TYPES = {"integer": "int", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "byte": "tinyint", "short": "smallint", "datetime": "timestamp"}
MODES = {"min": "min", "max": "max", "mmin": "min", "mmax": "max", "fsmin": "min", "fsmax": "max", "mcount": "sum", "msum": "sum", "fscnt": "sum", "fssum": "sum", "count": "sum", "sum": "sum"}
WITNESSES = ("sample", "cmax", "cmin")


def spark_type(kind) -> str:
    if isinstance(kind, tuple) and kind[0] == "list":
        return f"array<{spark_type(kind[1])}>"
    if isinstance(kind, tuple):
        return f"struct<{','.join(f'`{n}`:{spark_type(t)}' for n, t in kind[1])}>"
    if kind not in TYPES:
        raise ProgramError(f"unknown type {kind}")
    return TYPES[kind]


def atoms_of(body: tuple) -> list[tuple[Atom, bool]]:
    """Relations that a body refers to, and whether under negation or in a condition."""
    out = []
    for x in body:
        if isinstance(x, Atom) and not is_builtin(x):
            out.append((x, x.negated))
        elif isinstance(x, IfThenElse):
            out += [(a, True) for a, _ in atoms_of(x.condition)]
            out += [(a, True) for a, _ in atoms_of(x.then + (x.otherwise or ()))]
    return out


class LogicEngine:
    """Relations by name, the rules of a program over them, and its queries."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame] | None = None, max_iterations: int = MAX_ITERATIONS, hint: str | None = None, stop_at_limit: bool = False):
        self.spark, self.limit, self.hint, self.stop_at_limit = spark, max_iterations, hint, stop_at_limit
        self.base: dict[str, DataFrame] = {}
        self.program = Program()
        self.aggregates: dict[str, tuple] = {}
        self.iterations: dict[str, int] = {}
        self._solved: dict[str, DataFrame] = {}
        self._settled: dict[str, DataFrame] = {}
        for name, df in (relations or {}).items():
            self.register(name, df)

    # declarations

    def register(self, name: str, df: DataFrame) -> None:
        """A base relation: a set of rows, or one row for each key where a key is declared."""
        keys = self.program.keys.get(name)
        self.base[name] = df.dropDuplicates([df.columns[i] for i in keys]) if keys else df.distinct()
        self._settled.pop(name, None)
        self._solved.clear()

    def register_aggregate(self, name: str, zero, merge, finish=lambda acc: acc) -> None:
        """A user-defined aggregate: Columns zero, merge(acc, value), finish(acc); over the sorted values."""
        self.aggregates[name] = (zero, merge, finish)

    def load(self, text: str) -> LogicEngine:
        """Add a program's declarations, facts, rules and queries."""
        new = Parser(text, tuple(self.aggregates)).program()
        p = self.program
        p.schemas |= new.schemas
        p.keys |= new.keys
        p.module = new.module or p.module
        for name in ("exports", "facts", "rules", "queries"):
            getattr(p, name).extend(getattr(new, name))
        for name, columns in new.schemas.items():
            schema = ", ".join(f"`{c}` {spark_type(t)}" for c, t in columns)
            if name in self.base:
                df = self.base[name]
                self.register(name, df.select(*(F.col(f"`{o}`").cast(spark_type(t)).alias(c) for o, (c, t) in zip(df.columns, columns))))
            else:
                self.base[name] = self.spark.createDataFrame([], schema)
        facts: dict[str, list] = {}
        for fact in new.facts:
            facts.setdefault(fact.name, []).append(fact)
        for name, own in facts.items():
            rows = reduce(DataFrame.unionByName, [self.spark.range(1).select(*(column(a).alias(f"c{i}") for i, a in enumerate(f.args))) for f in own]) if any(not all(isinstance(a, Const) for a in f.args) for f in own) else self.spark.createDataFrame([tuple(a.value for a in f.args) for f in own], [f"c{i}" for i in range(len(own[0].args))])
            known = self.base.get(name)
            if known is not None:
                rows = rows.select(*(F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, known.schema.fields)))
                rows = known.unionByName(rows)
            self.register(name, rows)
        self._solved.clear()
        return self

    # evaluation

    def relation(self, name: str) -> DataFrame:
        """The rows of a base or derived relation."""
        if name not in {r.head.name for r in self.program.rules}:
            if name not in self.base:
                raise ProgramError(f"unknown relation {name}")
            return self.base[name]
        self._solve({name})
        return self._solved[name]

    def query(self, text: str | Atom, **parameters) -> DataFrame:
        """Rows for a query form p(A, 1, $B): constants filter, $ parameters take given values, variables are columns."""
        atom = Parser(text.rstrip(". ")).atom() if isinstance(text, str) else text
        args = tuple(Const(parameters[a.name]) if isinstance(a, Var) and a.name in parameters else a for a in atom.args)
        seed = {i: a.value for i, a in enumerate(args) if isinstance(a, Const)}
        derived = any(r.head.name == atom.name for r in self.program.rules)
        if seed and derived and atom.name not in self._solved and (preserved := self._preserved(atom.name, seed)):
            other = LogicEngine(self.spark, None, self.limit, self.hint, self.stop_at_limit)
            other.base, other.program, other.aggregates = self.base, self.program, self.aggregates
            other._solve({atom.name}, {atom.name: preserved})
            df, self.iterations = other._solved[atom.name], other.iterations
        else:
            df = self.relation(atom.name)
        found = matched(df, args, df.columns)
        names = [a.name for a in args if isinstance(a, Var) and not a.anonymous]
        return found.select(*dict.fromkeys(names)).distinct() if names else found.distinct()

    def run(self) -> dict[str, DataFrame]:
        """The program's queries, or its exports if it has none."""
        asked = self.program.queries or [Atom(n, tuple(Var(f"A{i}") for i, _ in enumerate(a))) for n, a in self.program.exports]
        return {f"{a.name}/{i}" if sum(b.name == a.name for b in asked) > 1 else a.name: self.query(a) for i, a in enumerate(asked)}

    def _preserved(self, name: str, seed: dict) -> dict:
        """Of the bound arguments those that every recursive rule hands on unchanged, so that they can
        restrict the rules that start the recursion."""
        rules = [r for r in self.program.rules if r.head.name == name]
        out = dict(seed)
        for r in rules:
            inner = [a for a, _ in atoms_of(r.body) if self._reaches(a.name, name)]
            if not inner:
                continue
            if len(inner) != 1 or inner[0].name != name or inner[0].negated:
                return {}
            out = {i: v for i, v in out.items() if isinstance(r.head.args[i], Var) and not r.head.args[i].anonymous and r.head.args[i] == inner[0].args[i]}
        return {i: v for i, v in out.items() if not any(isinstance(r.head.args[i], Aggregate) for r in rules)}

    def _reaches(self, start: str, goal: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x == goal:
                return True
            if x not in seen:
                seen.add(x)
                todo += [a.name for r in self.program.rules if r.head.name == x for a, _ in atoms_of(r.body)]
        return False

    def _solve(self, wanted: set[str], seeds: dict | None = None) -> None:
        rules: dict[str, list[RuleText]] = {}
        for r in self.program.rules:
            rules.setdefault(r.head.name, []).append(r)
        uses = {n: {a.name for r in rs for a, _ in atoms_of(r.body)} for n, rs in rules.items()}
        needed, todo = set(), list(wanted)
        while todo:
            x = todo.pop()
            if x not in needed:
                needed.add(x)
                todo += uses.get(x, ())
        for part in components({n: u for n, u in uses.items() if n in needed}):
            if any(n in self._solved for n in part):
                continue
            own = [r for n in part for r in rules[n]]
            recursive = len(part) > 1 or any(a.name in part for r in own for a, _ in atoms_of(r.body))
            if not recursive:
                self._solved[part[0]] = self._plain(part[0], own)
            elif self._staged(own):
                self._stages(part, own)
            else:
                self._recursive(part, own, (seeds or {}))

    def _lookup(self, own: dict | None = None):
        def find(atom: Atom):
            if own and atom.name in own:
                df = own[atom.name]
            elif atom.name in self._solved:
                df = self._solved[atom.name]
            elif atom.name in self.base:
                df = self._settled.get(atom.name, self.base[atom.name])
            else:
                raise ProgramError(f"unknown relation {atom.name}")
            return df, df.columns

        return find

    def _bindings(self, rule: RuleText, lookup) -> DataFrame:
        b = Bindings(self.spark, lookup, self.hint).add(rule.body)
        unbound = variables(Atom("", rule.head.args)) - b.bound
        if unbound:
            raise ProgramError(f"{rule.head.name}: {', '.join(sorted(unbound))} not bound by the body")
        return chosen(b.start(), rule.body)

    def _names(self, name: str) -> list[str]:
        first = next(r for r in self.program.rules if r.head.name == name)
        out: list[str] = []
        for i, a in enumerate(first.head.args):
            inner = a.value if isinstance(a, Aggregate) else a
            wish = inner.name if isinstance(inner, Var) and not inner.anonymous else f"c{i}"
            out.append(wish if wish.lower() not in {x.lower() for x in out} else f"{wish}_{i}")
        return out

    def _plain(self, name: str, rules: list[RuleText], lookup=None) -> DataFrame:
        """A predicate that is not recursive: the union of its rules as a set; head aggregates group."""
        names, outs = self._names(name), []
        lookup = lookup or self._lookup()
        for rule in rules:
            df = self._bindings(rule, lookup)
            args = rule.head.args
            if any(isinstance(a, Aggregate) for a in args):
                df = self._grouped(df, args, names)
            else:
                df = df.select(*(column(a).alias(n) for a, n in zip(args, names)))
                df = df.distinct()
            outs.append(self._ordered(df, rule, names))
        if len(outs) == 1:
            return outs[0]
        return reduce(DataFrame.unionByName, outs).distinct()

    def _ordered(self, df: DataFrame, rule: RuleText, names: list[str]) -> DataFrame:
        """sort and limit: over the different head rows; together they are a top-k."""
        sort = next((x for x in rule.body if isinstance(x, Sort)), None)
        limit = next((x for x in rule.body if isinstance(x, Limit)), None)
        if sort:
            by = []
            for term, ascending in sort.keys:
                at = next((n for a, n in zip(rule.head.args, names) if a == term or isinstance(a, Aggregate) and a.value == term), None)
                if at is None:
                    raise ProgramError("sort names a term that is not in the head")
                by.append(F.col(f"`{at}`").asc() if ascending else F.col(f"`{at}`").desc())
            df = df.orderBy(*by)
        return df.limit(limit.count) if limit else df

    def _grouped(self, df: DataFrame, args: tuple, names: list[str]) -> DataFrame:
        keys = [(column(a).alias(n)) for a, n in zip(args, names) if not isinstance(a, Aggregate)]
        lead = next((a for a in args if isinstance(a, Aggregate) and a.name not in WITNESSES), None)
        df = df.distinct()
        plain, out = [], {}
        for a, n in zip(args, names):
            if isinstance(a, Aggregate):
                out[n] = self._aggregate(a, lead)
            else:
                plain.append(n)
        if any(isinstance(a, Aggregate) and MODES.get(a.name) == "sum" and (a.occurrence or a.name in ("mcount", "fscnt", "msum", "fssum")) for a in args):
            a = next(a for a in args if isinstance(a, Aggregate))
            df = df.select(*keys, *self._contribution(a)).groupBy(*plain, "occurrence__").agg(F.max("value__").alias("value__"))
            n = next(n for a, n in zip(args, names) if isinstance(a, Aggregate))
            return df.groupBy(*plain).agg(F.sum("value__").alias(n)).select(*names)
        return df.groupBy(*keys).agg(*(c.alias(n) for n, c in out.items())).select(*names)

    def _aggregate(self, a: Aggregate, lead: Aggregate | None):
        v = column(a.value)
        if a.name in self.aggregates:
            zero, merge, finish = self.aggregates[a.name]
            return F.aggregate(F.array_sort(F.collect_list(v)), zero, merge, finish)
        if a.name in WITNESSES:
            by = column(lead.value)
            best = F.min_by if MODES.get(lead.name) == "min" else F.max_by
            return best(v, by)
        return {"min": F.min, "max": F.max, "mmin": F.min, "mmax": F.max, "fsmin": F.min, "fsmax": F.max, "sum": F.sum, "count": F.count, "avg": F.avg, "mavg": F.avg, "countd": F.countDistinct, "mcount": F.count, "fscnt": F.count, "msum": F.sum, "fssum": F.sum}[a.name](v)

    def _contribution(self, a: Aggregate) -> list:
        """value and occurrence of a monotonic count or sum."""
        counts = a.name in ("mcount", "fscnt", "count")
        if not a.occurrence:
            value = F.lit(1).cast("long") if counts else column(a.value)
            return [value.alias("value__"), F.struct(column(a.value)).alias("occurrence__")]
        value = column(a.value) if a.factor is None else column(a.factor) * column(a.value)
        return [value.alias("value__"), F.struct(*map(column, a.occurrence)).alias("occurrence__")]

    def _settle(self, part: list[str], rules: list[RuleText]) -> None:
        """Write the relations that recursive rules join once, by the arguments that they share with the
        recursive atom (`Store.base`), so that no round computes or moves them again."""
        store = Store(self.spark, "base")
        for r in rules:
            atoms = [a for a, _ in atoms_of(r.body)]
            inner = [a for a in atoms if a.name in part]
            for a in atoms:
                if not inner or a.name in part or a.name in self._settled or a.name in self._solved or a.name not in self.base:
                    continue
                df = self.base[a.name]
                shared = variables(inner[0])
                keys = [c for c, x in zip(df.columns, a.args) if isinstance(x, Var) and x.name in shared]
                self._settled[a.name] = store.base(df, *keys[:1])

    def _recursive(self, part: list[str], rules: list[RuleText], seeds: dict) -> None:
        predicates = []
        for name in part:
            heads = [r.head for r in rules if r.head.name == name]
            names, mode, value, witness = self._names(name), "set", None, []
            for i, a in enumerate(heads[0].args):
                if isinstance(a, Aggregate) and a.name in WITNESSES:
                    witness.append(i)
                elif isinstance(a, Aggregate) or any(isinstance(h.args[i], Aggregate) for h in heads):
                    agg = next(h.args[i] for h in heads if isinstance(h.args[i], Aggregate) and (h.args[i].name not in WITNESSES))
                    kinds = {MODES.get(h.args[i].name) for h in heads if isinstance(h.args[i], Aggregate)}
                    if MODES.get(agg.name) is None:
                        raise ProgramError(f"{name}: {agg.name} inside its own recursion")
                    mode, value = "sum" if "sum" in kinds else MODES[agg.name], i
            predicates.append(Predicate(name, names, mode, value, tuple(witness)))
        by_name = {p.name: p for p in predicates}
        compiled = []
        for r in rules:
            for a, under in atoms_of(r.body):
                if a.name in part and under:
                    raise ProgramError(f"{r.head.name} depends on the negation of {a.name} within their recursion")
            compiled.append(self._compiled(r, by_name, part, seeds.get(r.head.name)))
        self._settle(part, rules)
        clique = Clique(self.spark, predicates, compiled, self.limit, self.stop_at_limit)
        self._solved |= clique.solve()
        self.iterations |= {name: clique.iterations for name in part}

    def _compiled(self, rule: RuleText, by_name: dict[str, Predicate], part: list[str], seed: dict | None) -> Rule:
        p = by_name[rule.head.name]
        reads = [a.name for a, _ in atoms_of(rule.body) if a.name in part]
        body, n = [], 0
        for x in rule.body:
            if isinstance(x, Atom) and x.name in part:
                x = Atom(f"{x.name}#{n}", x.args)
                n += 1
            body.append(x)
        numbered = RuleText(rule.head, tuple(body), rule.annotation)

        def run(inputs: list[DataFrame]) -> DataFrame:
            own = {f"{name}#{i}": df for i, (name, df) in enumerate(zip(reads, inputs))}
            df = self._bindings(numbered, self._lookup(own))
            cols, occurrence = [], None
            for a, c in zip(rule.head.args, p.columns):
                if isinstance(a, Aggregate) and MODES.get(a.name) == "sum" and a.name not in WITNESSES:
                    value, occurrence = self._contribution(a)
                    cols.append(value.alias(c))
                elif isinstance(a, Aggregate):
                    cols.append(column(a.value).alias(c))
                else:
                    cols.append(column(a).alias(c))
            df = df.select(*cols, *([occurrence] if occurrence is not None else []))
            if seed and not reads:
                df = df.where(reduce(lambda x, y: x & y, (F.col(f"`{p.columns[i]}`") == F.lit(v) for i, v in seed.items())))
            return df

        return Rule(rule.head.name, reads, run)

    # programs whose recursion runs over stages J, J + 1

    @staticmethod
    def _next_stage(term) -> bool:
        return isinstance(term, Op) and term.name == "+" and isinstance(term.args[0], Var) and term.args[1] == Const(1)

    def _staged(self, rules: list[RuleText]) -> bool:
        return any(r.head.args and self._next_stage(r.head.args[0]) for r in rules)

    def _stages(self, part: list[str], rules: list[RuleText]) -> None:
        """Stage by stage: a rule with head stage J + 1 reads stage J (and J + 1 where it says so), one
        with head stage J reads J. Ends when no predicate that feeds itself has rows, or nothing changes."""
        store = Store(self.spark, "stages")
        names = {n: self._names(n) for n in part}
        start = [r for r in rules if not any(a.name in part for a, _ in atoms_of(r.body))]
        stepping = [r for r in rules if r not in start]

        def copies(r: RuleText) -> bool:
            inner = [a for a, neg in atoms_of(r.body) if a.name == r.head.name and not a.negated]
            return len(inner) == 1 and inner[0].args[1:] == r.head.args[1:] and self._next_stage(r.head.args[0])

        drivers = {r.head.name for r in stepping if self._next_stage(r.head.args[0]) and not copies(r) and any(a.name == r.head.name and not a.negated for a, _ in atoms_of(r.body))}
        same: dict[str, set[str]] = {n: set() for n in part}
        for r in stepping:
            for a, _ in atoms_of(r.body):
                if a.name in part and a.args[0] == r.head.args[0]:
                    same[r.head.name].add(a.name)
        order = [n for c in components(same) for n in c]
        every: dict[str, list[DataFrame]] = {n: [] for n in part}
        before: dict[str, DataFrame] = {}
        types: dict[str, T.StructType] = {}
        for stage in range(self.limit + 1):
            now: dict[str, DataFrame] = {}
            for name in order:
                outs = []
                for r in rules:
                    if r.head.name != name or (r in start) != (not any(a.name in part for a, _ in atoms_of(r.body))):
                        continue
                    if r in start:
                        if r.head.args[0] == Const(stage):
                            outs.append(self._plain(name, [r]))
                        continue
                    later = self._next_stage(r.head.args[0])
                    if later and stage == 0:
                        continue
                    own = {}
                    for a, _ in atoms_of(r.body):
                        if a.name in part:
                            table = now if a.args[0] == r.head.args[0] else before
                            if a.name not in table and a.name in types:
                                table[a.name] = self.spark.createDataFrame([], types[a.name])
                            own[a.name] = table.get(a.name)
                    positive = [a.name for a, neg in atoms_of(r.body) if a.name in part and not neg]
                    if any(own[n] is None for n in positive):
                        continue
                    body = tuple(x for x in self._at_stage(r.body, part, own))
                    stage_name = r.head.args[0].args[0] if later else r.head.args[0]
                    fixed = RuleText(Atom(name, (Const(stage), *r.head.args[1:])), (*body, *self._bind_stage(stage_name, stage - 1 if later else stage)))
                    outs.append(self._plain(name, [fixed], self._lookup({f"{k}@": v for k, v in own.items()})))
                if outs:
                    df = reduce(DataFrame.unionByName, [o.toDF(*names[name]) for o in outs]).distinct()
                    now[name] = store.written(df)
                    types.setdefault(name, now[name].schema)
            rows = {n: df.count() for n, df in now.items()}
            for n, df in now.items():
                if rows[n]:
                    every[n].append(df)
            if stage and (drivers and not any(rows.get(n) for n in drivers) or not any(rows.values())):
                break
            if stage and not drivers and all(n in before and now[n].drop(names[n][0]).exceptAll(before[n].drop(names[n][0])).isEmpty() for n in now):
                break
            before = now
        else:
            raise ProgramError(f"{', '.join(part)}: stages without end")
        for n in part:
            kind = types.get(n)
            if kind is None:
                raise ProgramError(f"{n} has no rule that starts it")
            self._solved[n] = reduce(DataFrame.unionByName, every[n]) if every[n] else self.spark.createDataFrame([], kind)
            self.iterations[n] = stage

    def _at_stage(self, body: tuple, part: list[str], own: dict):
        for x in body:
            if isinstance(x, Atom) and x.name in part:
                if own[x.name] is None:
                    continue  # the negation of a relation that has no rows yet
                yield Atom(f"{x.name}@", (Var("_"), *x.args[1:]), x.negated)
            elif isinstance(x, IfThenElse):
                condition = tuple(self._at_stage(x.condition, part, own))
                yield IfThenElse(condition, x.then, x.otherwise) if len(condition) == len(x.condition) else IfThenElse((), x.then, x.otherwise)
            else:
                yield x

    @staticmethod
    def _bind_stage(name, value: int) -> tuple:
        return (Compare("=", name, Const(value)),) if isinstance(name, Var) else ()
