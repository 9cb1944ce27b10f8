"""Scripts of the recursive SQL dialect.

A script is a sequence of statements: `create table t(c type, ...)` declares a base relation,
`create view v(cols) as (query)`, and queries, of which
`WITH recursive v(col, min() AS col) AS (query) UNION (query) ... SELECT ...` is evaluated by a
fixpoint. In the column list min, max, count or sum marks the aggregate; the other columns are the
key. `-- hint: broadcast | shuffle | sortMerge` sets the join strategy; {name} takes a parameter.
All else goes to Spark SQL as it stands.

A set view that starts from one row and whose only recursive arm moves two parts of its columns on
independently (`factors`) is the union over rounds of products: each part's rows of a round are kept,
and their products are only made when the view is read (`_by_levels`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.fixpoint import MAX_ITERATIONS, Clique, Predicate, Rule
from lattica.store import Store

from .graph import components

TOKEN = re.compile(r"(?P<space>\s+)|(?P<string>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<quoted>`[^`]*`)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+(?:\.\d+)?)|(?P<op><=>|<>|!=|>=|<=|\|\||.)", re.S)
#: Declared types, hints, and words after which a name can't be a keyword.
TYPES = {"integer": "int", "int": "int", "long": "bigint", "bigint": "bigint", "float": "float", "double": "double", "string": "string"}
HINTS = {"broadcast": "broadcast", "shuffle": "shuffle_hash", "sortmerge": "merge"}
CLAUSES = {"where", "group", "having", "order", "limit", "union", "join", "inner", "left", "right", "full", "cross", "on", "natural", "lateral", "window", "intersect", "except"}
BEFORE_NAME = {"select", "distinct", "where", "and", "or", "on", "by", "not", "having", "then", "else", "when", "case", "between", "as"}
#: A round's rows of a part beyond BLOCK_ROWS are dealt into BLOCKS for the product with the other part's.
BLOCKS, BLOCK_ROWS = 16, 4096
RESERVED = {"from", "to", "order", "group", "where", "select", "union", "join", "on"}


class ScriptError(ValueError):
    """The script can't be read or evaluated."""


@dataclass
class View:
    name: str
    columns: list[str]
    aggregate: str | None
    place: int | None
    arms: list[str] = field(default_factory=list)


def lexed(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in TOKEN.finditer(text)]


def joined(parts: list[tuple[str, str]]) -> str:
    return "".join(v for _, v in parts)


def solid(parts: list[tuple[str, str]]) -> list[int]:
    return [i for i, (k, _) in enumerate(parts) if k != "space"]


def closing(parts, at: int) -> int:
    """Index of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(parts)):
        if parts[i] == ("op", "("):
            depth += 1
        elif parts[i] == ("op", ")"):
            depth -= 1
            if not depth:
                return i
    raise ScriptError("a parenthesis is not closed")


def split_statements(text: str) -> list[str]:
    out, now = [], []
    for k, v in lexed(text):
        if (k, v) == ("op", ";"):
            out.append(joined(now))
            now = []
        else:
            now.append((k, v))
    out.append(joined(now))
    return [x.strip() for x in out if x.strip()]


def quote_names(text: str, names: set[str]) -> str:
    """Back-quote declared columns that are also keywords, where they stand as names."""
    names = {n.lower() for n in names if n.lower() in RESERVED}
    if not names:
        return text
    parts = lexed(text)
    at = solid(parts)
    for n, i in enumerate(at):
        kind, value = parts[i]
        if kind == "name" and value.lower() in names:
            before = parts[at[n - 1]] if n else ("", "")
            if before[0] == "op" and before[1] != ")" or before[1].lower() in BEFORE_NAME:
                parts[i] = ("quoted", f"`{value}`")
    return joined(parts)


def from_items(parts: list[tuple[str, str]]) -> list[tuple[int, str, str | None]]:
    """(index, table, alias) of the plain tables in every FROM list and JOIN of a query."""
    at, out = solid(parts), []
    for n, i in enumerate(at):
        if parts[i][0] != "name" or parts[i][1].lower() not in ("from", "join"):
            continue
        m, listed = n + 1, parts[i][1].lower() == "from"
        while m < len(at):
            kind, value = parts[at[m]]
            if (kind, value) == ("op", "("):
                end = closing(parts, at[m])
                m = next((j for j in range(m, len(at)) if at[j] > end), len(at))
                index = None
            elif kind in ("name", "quoted"):
                index, m = at[m], m + 1
            else:
                break
            alias = None
            if m < len(at) and parts[at[m]][1].lower() == "as":
                m += 1
            if m < len(at) and parts[at[m]][0] in ("name", "quoted") and parts[at[m]][1].lower() not in CLAUSES:
                alias, m = parts[at[m]][1], m + 1
            if index is not None:
                out.append((index, parts[index][1].strip("`"), alias))
            if not (listed and m < len(at) and parts[at[m]] == ("op", ",")):
                break
            m += 1
    return out


def with_tables(text: str, name_of) -> str:
    """text with every FROM table replaced by name_of(number, table), its name kept as the alias."""
    parts = lexed(text)
    for number, (i, table, alias) in enumerate(from_items(parts)):
        new = name_of(number, table)
        if new:
            parts[i] = ("name", f"{new} AS {table}" if alias is None else new)
    return joined(parts)


def parse_recursive(text: str) -> tuple[list[View], str]:
    """The views of a WITH RECURSIVE statement, and the query over them."""
    parts = lexed(text)
    at = solid(parts)
    n, views = 2, []
    while True:
        name = parts[at[n]][1].strip("`")
        if parts[at[n + 1]] != ("op", "("):
            raise ScriptError(f"{name} has no column list")
        end = closing(parts, at[n + 1])
        columns, aggregate, place = [], None, None
        for item in _comma(parts[at[n + 1] + 1 : end]):
            m = re.fullmatch(r"(?is)\s*(min|max|count|sum)\s*\(\s*\)\s+as\s+`?(\w+)`?\s*", item)
            if m:
                if aggregate:
                    raise ScriptError(f"{name} has two aggregates")
                aggregate, place = m[1].lower(), len(columns)
                columns.append(m[2])
            else:
                columns.append(item.strip().strip("`"))
        n = next(j for j in range(n, len(at)) if at[j] > end)
        if parts[at[n]][1].lower() != "as":
            raise ScriptError(f"{name} has no AS")
        view, n = View(name, columns, aggregate, place), n + 1
        while True:
            if parts[at[n]] != ("op", "("):
                raise ScriptError(f"{name}: an arm is not in parentheses")
            end = closing(parts, at[n])
            view.arms.append(joined(parts[at[n] + 1 : end]).strip())
            n = next((j for j in range(n, len(at)) if at[j] > end), len(at))
            if n < len(at) and parts[at[n]][1].lower() == "union":
                n += 2 if parts[at[n + 1]][1].lower() == "all" else 1
            else:
                break
        views.append(view)
        if n < len(at) and parts[at[n]] == ("op", ","):
            n += 1
            continue
        break
    return views, joined(parts[at[n] :]) if n < len(at) else ""


def _comma(parts: list[tuple[str, str]]) -> list[str]:
    out, now, depth = [], [], 0
    for k, v in parts:
        depth += {"(": 1, ")": -1}.get(v, 0) if k == "op" else 0
        if (k, v) == ("op", ",") and not depth:
            out.append(joined(now))
            now = []
        else:
            now.append((k, v))
    return [*out, joined(now)]


def occurrence(arm: str, view: View, views: dict[str, View]) -> str:
    """The expression that tells a count's or sum's contributions apart: the recursive side of the only
    equi-join with the recursive view, else the first key column's expression."""
    parts = lexed(arm)
    aliases = {(alias or table).lower(): table for _, table, alias in from_items(parts) if table.lower() in views}
    where = re.search(r"(?is)\bwhere\b(.*?)(\bgroup\s+by\b|\border\s+by\b|$)", arm)
    found = []
    for pair in equalities(where[1]) if where else ():
        sides = [x for x in pair if x.split(".")[0].lower() in aliases]
        if len(sides) == 1:
            found.append(".".join(f"`{x}`" for x in sides[0].split(".")))
    if len(found) == 1:
        return found[0]
    keys = [i for i in range(len(view.columns)) if i != view.place]
    if not keys:
        raise ScriptError(f"{view.name}: no occurrence for its {view.aggregate}")
    select = re.match(r"(?is)\s*select\s+(?:distinct\s+)?", arm)
    body = lexed(arm[select.end() :])
    depth, items = 0, []
    for k, v in body:
        depth += {"(": 1, ")": -1}.get(v, 0) if k == "op" else 0
        if k == "name" and v.lower() == "from" and not depth:
            break
        items.append((k, v))
    return re.sub(r"(?is)\s+as\s+\w+\s*$", "", _comma(items)[keys[0]])


def equalities(arm: str) -> list[tuple[str, str]]:
    """Pairs of qualified columns that WHERE or ON sets equal."""
    return [(a.replace("`", ""), b.replace("`", "")) for a, b in re.findall(r"([\w`]+\.[\w`]+)\s*=\s*([\w`]+\.[\w`]+)", arm)]


def join_columns(arm: str, recursive: set[str]) -> dict[str, str]:
    """For each other table of an arm the first column that an equality ties to a recursive view."""
    tables = {(alias or table).strip("`").lower(): table for _, table, alias in from_items(lexed(arm))}
    out: dict[str, str] = {}
    for pair in equalities(arm):
        for own, other in (pair, pair[::-1]):
            alias, column = other.split(".")
            if tables.get(own.split(".")[0].lower(), "").lower() in recursive and tables.get(alias.lower(), "").lower() not in recursive | {""}:
                out.setdefault(tables[alias.lower()], column)
    return out


def factors(arm: str, view: View) -> list[tuple[list[int], str]] | None:
    """Two independent parts of a recursive arm: for each the places of the view's columns that it moves on, and the arm
    over these alone. The arm must be SELECT columns FROM tables WHERE equalities of columns (all qualified), with
    no equality between the parts; None for any other."""
    m = re.fullmatch(r"(?is)\s*select\s+(.*?)\s+from\s+(.*?)\s+where\s+(.*?)\s*", arm)
    if not m:
        return None
    items, tables, conditions = m[1].split(","), m[2].split(","), re.split(r"(?i)\band\b", m[3])
    aliases: dict[str, str] = {}
    for x in tables:
        found = re.fullmatch(r"(?is)\s*(`\w+`|\w+)(?:\s+(?:as\s+)?(`\w+`|\w+))?\s*", x)
        if not found or (alias := (found[2] or found[1]).strip("`").lower()) in aliases:
            return None
        aliases[alias] = found[1].strip("`").lower()
    recursive = [a for a, t in aliases.items() if t == view.name.lower()]
    places = {c.lower(): i for i, c in enumerate(view.columns)}
    group: dict = {n: n for n in [*(a for a in aliases if a not in recursive), *range(len(view.columns))]}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    def node(text: str):
        a, _, c = (x.strip("` ").lower() for x in text.strip().partition("."))
        return places.get(c) if [a] == recursive else a

    column = r"\s*(?:`\w+`|\w+)\.(?:`\w+`|\w+)\s*"
    pairs = [c.split("=") for c in conditions]
    if len(recursive) != 1 or len(items) != len(view.columns) or any(len(p) != 2 for p in pairs):
        return None
    if not all(re.fullmatch(column, x) and node(x) in group for x in [*items, *(x for p in pairs for x in p)]):
        return None
    for a, b in [*((node(x), i) for i, x in enumerate(items)), *((node(a), node(b)) for a, b in pairs)]:
        group[top(a)] = top(b)
    first = {n for n in group if top(n) == top(0)}
    out = []
    for mine in (first, set(group) - first):
        columns = sorted(n for n in mine if isinstance(n, int))
        own = [t for a, t in zip(aliases, tables) if a in mine]
        tests = [c for c, (a, _) in zip(conditions, pairs) if node(a) in mine]
        if not columns or not own or not tests:
            return None
        out.append((columns, f"SELECT {', '.join(items[i] for i in columns)} FROM {', '.join([*own, tables[list(aliases).index(recursive[0])]])} WHERE {' AND '.join(tests)}"))
    return out


class RecursiveSql:
    """A session for scripts over registered relations."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame] | None = None, max_iterations: int = MAX_ITERATIONS):
        self.spark, self.limit, self.iterations = spark, max_iterations, 0
        self.declared: dict[str, list[tuple[str, str]]] = {}
        self.columns: set[str] = set()
        self.hint: str | None = None
        self.store = Store(spark, "base")
        self.relations: dict[str, DataFrame] = {}
        for name, df in (relations or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame) -> None:
        """A base relation: the different rows of df. The first recursion that reads it writes it once, by the
        column that it joins on (`Store.base`)."""
        self.relations[name] = df.distinct()
        self.relations[name].createOrReplaceTempView(name)
        self.columns |= set(df.columns)

    def _settle(self, arms: list[str], own: set[str]) -> None:
        """Write the base relations that recursive arms read."""
        keys: dict[str, str] = {}
        for arm in arms:
            keys = join_columns(arm, own) | keys
        used = {t for arm in arms for _, t, _ in from_items(lexed(arm))}
        for name in used & set(self.relations):
            df = self.relations.pop(name)
            key = next((c for c in df.columns if c.lower() == keys.get(name, "").lower()), None)
            self.store.base(df, *([key] if key else [])).createOrReplaceTempView(name)

    def script(self, text: str, relations: dict[str, DataFrame] | None = None, **parameters) -> DataFrame | None:
        """Run all statements; the last query's rows."""
        hint = re.search(r"(?im)^\s*--\s*hint:\s*(\w+)", text)
        if hint:
            if hint[1].lower() not in HINTS:
                raise ScriptError(f"unknown hint {hint[1]}")
            self.hint = HINTS[hint[1].lower()]
        text = re.sub(r"--[^\n]*", "", text)
        for name in set(re.findall(r"\{(\w+)\}", text)):
            if name not in parameters:
                raise ScriptError(f"parameter {name} is not given")
            text = text.replace(f"{{{name}}}", str(parameters[name]))
        out = None
        for statement in split_statements(text):
            out = self.statement(statement, relations or {})
        return out

    def statement(self, text: str, relations: dict[str, DataFrame]) -> DataFrame | None:
        table = re.fullmatch(r"(?is)create\s+table\s+(\w+)\s*\((.*)\)", text)
        if table:
            columns = []
            for item in table[2].split(","):
                name, kind = item.split()
                if kind.lower() not in TYPES:
                    raise ScriptError(f"{table[1]}: unknown type {kind}")
                columns.append((name, TYPES[kind.lower()]))
            self.declared[table[1]] = columns
            self.columns |= {c for c, _ in columns}
            if table[1] in relations:
                df = relations[table[1]]
                self.register(table[1], df.toDF(*(f"c{i}" for i in range(len(df.columns)))).selectExpr(*(f"cast(c{i} as {t}) as `{c}`" for i, (c, t) in enumerate(columns))))
            return None
        view = re.fullmatch(r"(?is)create\s+view\s+(\w+)\s*\(([^)]*)\)\s+as\s+(.*)", text)
        if view:
            names = [c.strip() for c in view[2].split(",")]
            self.columns |= set(names)
            body = view[3].strip()
            if body.startswith("(") and closing(lexed(body), 0) == len(lexed(body)) - 1:
                body = body[1:-1]
            self.query(body).toDF(*names).createOrReplaceTempView(view[1])
            return None
        return self.query(text)

    def query(self, text: str) -> DataFrame:
        if not re.match(r"(?is)\s*with\s+recursive\b", text):
            return self.spark.sql(quote_names(text, self.columns))
        views, outer = parse_recursive(text)
        self.columns |= {c for v in views for c in v.columns}
        by_name = {v.name.lower(): v for v in views}
        uses = {v.name.lower(): {t.lower() for arm in v.arms for _, t, _ in from_items(lexed(arm)) if t.lower() in by_name} for v in views}
        for part in components(uses):
            if len(part) == 1 and part[0] not in uses[part[0]] and not by_name[part[0]].aggregate:
                v = by_name[part[0]]
                df = None
                for arm in v.arms:
                    one = self._arm(arm)
                    df = one if df is None else df.union(one)
                df.toDF(*v.columns).distinct().createOrReplaceTempView(v.name)
            else:
                self._fixpoint([by_name[n] for n in part], by_name)
        return self.spark.sql(quote_names(outer, self.columns))

    def _arm(self, text: str) -> DataFrame:
        text = quote_names(text, self.columns)
        if self.hint and self.hint != "broadcast":
            names = [a or t for _, t, a in from_items(lexed(text))]
            if len(names) > 1:
                text = re.sub(r"(?is)^\s*select\b", f"SELECT /*+ {self.hint.upper()}({', '.join(names[1:])}) */", text, count=1)
        return self.spark.sql(text)

    def _fixpoint(self, views: list[View], by_name: dict[str, View]) -> None:
        own = {v.name.lower() for v in views}
        predicates = [Predicate(v.name, v.columns, {"min": "min", "max": "max", "count": "sum", "sum": "sum", None: "set"}[v.aggregate], v.place) for v in views]
        rules = []
        quoted = [quote_names(arm, self.columns) for v in views for arm in v.arms]
        self._settle([arm for arm in quoted if any(t.lower() in own for _, t, _ in from_items(lexed(arm)))], own)
        for v in views:
            for arm in v.arms:
                tables = [t for _, t, _ in from_items(lexed(quote_names(arm, self.columns)))]
                reads = [by_name[t.lower()].name for t in tables if t.lower() in own]
                rules.append(Rule(v.name, reads, self._body(v, quote_names(arm, self.columns), own, by_name)))
        clique = Clique(self.spark, predicates, rules, self.limit)
        if len(views) == 1 and views[0].aggregate is None and [len(r.reads) for r in rules] == [0, 1] and not re.search(r"(?i)\bfrom\b", quoted[0]):
            parts = factors(quoted[1], views[0])
            df = self._by_levels(views[0], quoted[0], parts, clique.schema(views[0].name), own, by_name) if parts else None
            if df is not None:
                df.createOrReplaceTempView(views[0].name)
                return
        for name, df in clique.solve().items():
            df.createOrReplaceTempView(name)
        self.iterations = clique.iterations

    def _by_levels(self, view: View, start: str, parts: list[tuple[list[int], str]], schema: T.StructType, own: set[str], by_name: dict[str, View]) -> DataFrame | None:
        """A view of two independent parts: a round's rows are the product of its rows of either part. The rounds
        of one part must have no row in common, so that no pair comes twice; else None."""
        store, logs, sizes = Store(self.spark, "levels"), [[], []], []
        names = [[view.columns[i] for i in columns] for columns, _ in parts]
        kinds = [T.StructType([*(schema.fields[i] for i in columns), T.StructField("level__", T.IntegerType(), True)]) for columns, _ in parts]
        steps = [self._body(view, arm, own, by_name) for _, arm in parts]

        def apart() -> bool:
            return any(store.get(kind, *log).select(*columns).distinct().count() == store.count(*log) for kind, log, columns in zip(kinds, logs, names))

        level, rows = 0, self._arm(start).toDF(*view.columns)
        frames = [rows.select(*columns) for columns in names]
        while True:
            paths = [store.put(df.toDF(*kind.names[:-1]).withColumn("level__", F.lit(level)).select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in kind))) for df, kind in zip(frames, kinds)]
            if not all(store.count(p) for p in paths):
                break
            for log, path in zip(logs, paths):
                log.append(path)
            sizes.append((level, *(BLOCKS if store.count(p) > BLOCK_ROWS else 1 for p in paths)))
            level += 1
            if level > self.limit or level & (level - 1) == 0 and not apart():
                return None
            frames = [step([store.get(kind, p).select(*columns)]).distinct() for step, kind, p, columns in zip(steps, kinds, paths, names)]
        if not apart():
            return None
        self.iterations = level
        dealt = F.broadcast(self.spark.createDataFrame(sizes, "level__ int, one__ int, other__ int"))
        mine, others = F.pmod(F.xxhash64(*names[0]), "one__"), F.pmod(F.xxhash64(*names[1]), "other__")
        copies = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("other__", "one__")]
        one, other = (store.get(kind, *log).join(dealt, "level__").select("*", c.alias("copy__")) for kind, log, c in zip(kinds, logs, copies))
        place = F.col("level__").cast("long") * (BLOCKS * BLOCKS)
        one = one.select(*names[0], (place + mine * BLOCKS + F.col("copy__")).alias("block__"))
        other = other.select(*names[1], (place + F.col("copy__") * BLOCKS + others).alias("block__"))
        return one.join(other.hint("shuffle_hash"), "block__").select(*view.columns)

    def _body(self, view: View, arm: str, own: set[str], by_name: dict[str, View]):
        summed = view.aggregate in ("count", "sum")
        recursive = any(t.lower() in own for _, t, _ in from_items(lexed(arm)))
        if summed and recursive:
            extra = occurrence(arm, view, {n: by_name[n] for n in own})
            parts, depth = lexed(arm), 0
            for i, (k, v) in enumerate(parts):
                depth += {"(": 1, ")": -1}.get(v, 0) if k == "op" else 0
                if k == "name" and v.lower() == "from" and not depth:
                    arm = f"{joined(parts[:i]).rstrip()}, {extra} AS occurrence__ {joined(parts[i:])}"
                    break

        def run(inputs: list[DataFrame]) -> DataFrame:
            waiting = list(enumerate(inputs))

            def name_of(_, table: str) -> str | None:
                if table.lower() not in own:
                    return None
                i, df = waiting.pop(0)
                label = f"{table}__in{i}"
                df.createOrReplaceTempView(label)
                return label

            df = self._arm(with_tables(arm, name_of))
            if summed and not recursive:  # different exit rows are different occurrences: their plain sum
                df = df.toDF(*view.columns)
                keys = [c for i, c in enumerate(view.columns) if i != view.place]
                value = view.columns[view.place]
                df = df.groupBy(*(f"`{k}`" for k in keys)).agg(F.sum(f"`{value}`").alias(value)).select(*(f"`{c}`" for c in view.columns))
            return df

        return run
