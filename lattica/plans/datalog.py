"""Recursive-descent parser of the logic dialect.

Statements end with a full stop: database({p(C: type, ...)}). key(p, [0]). index(p, [0]).
export p($A, B). query p(A, 1). facts, and rules head <- literal, literal. with an optional
@annotation. % begins a comment. Variables start with an upper-case letter or underscore; a
lower-case name alone is a string constant.
"""

from __future__ import annotations

import re
from decimal import Decimal

from .ast import Aggregate, Atom, Choice, Compare, Const, Functor, IfThenElse, Limit, ListTerm, Op, Program, RuleText, Sort, Truth, Var

TOKEN = re.compile(
    r"""\s+|%[^\n]*|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_]*)|(?P<op><-|~\*=|\*=|~=|<>|!=|>=|<=|[-+*/<>=~().,:{}\[\]|@])"""
)
#: Names that open an aggregate in a head, and comparison signs.
AGGREGATES = ("sum", "count", "avg", "max", "min", "countd", "fsmax", "fsmin", "fscnt", "fssum", "mmax", "mmin", "mcount", "msum", "mavg", "sample", "cmax", "cmin")
COMPARISONS = ("=", "~=", "<>", "!=", ">", "<", ">=", "<=", "*=", "~*=")
FUNCTIONS = ("log", "exp", "step", "abs")


class ProgramError(ValueError):
    """The text is no program, or one that can't be evaluated."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ProgramError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    out.append(("end", ""))
    return out


class Parser:
    def __init__(self, text: str, aggregates: tuple[str, ...] = ()):
        self.t, self.i, self.own = tokens(text), 0, set(aggregates)

    def peek(self, ahead: int = 0) -> str:
        return self.t[min(self.i + ahead, len(self.t) - 1)][1]

    def kind(self, ahead: int = 0) -> str:
        return self.t[min(self.i + ahead, len(self.t) - 1)][0]

    def take(self, want: str | None = None) -> str:
        kind, value = self.t[self.i]
        if want is not None and value != want:
            raise ProgramError(f"expected {want!r}, found {value!r} near {' '.join(v for _, v in self.t[max(0, self.i - 6) : self.i + 4])!r}")
        self.i += 1
        return value

    def maybe(self, want: str) -> bool:
        if self.peek() == want and self.kind() != "string":
            self.i += 1
            return True
        return False

    def listed(self, item, close: str) -> tuple:
        out = []
        while not self.maybe(close):
            out.append(item())
            if not self.maybe(","):
                self.take(close)
                break
        return tuple(out)

    # statements

    def program(self) -> Program:
        p = Program()
        while self.kind() != "end":
            self.statement(p)
        return p

    def statement(self, p: Program) -> None:
        word = self.peek()
        if word == "begin" and self.peek(1) == "module":
            self.i += 2
            p.module = self.constant(self.take())
            self.take(".")
        elif word == "end" and self.peek(1) == "module":
            self.i += 2
            self.take(".")
        elif word == "database" and self.peek(1) == "(":
            self.i += 2
            self.take("{")
            for name, columns in self.listed(self.declaration, "}"):
                p.schemas[name] = columns
            self.take(")")
            self.take(".")
        elif word in ("key", "index") and self.peek(1) == "(" and self.peek(3) == ",":
            self.i += 2
            name = self.take()
            self.take(",")
            self.take("[")
            places = self.listed(lambda: int(self.take()), "]")
            self.take(")")
            self.take(".")
            if word == "key":
                p.keys[name] = places
        elif word == "export":
            self.i += 1
            name = self.take()
            self.take("(")
            p.exports.append((name, self.listed(self.take, ")")))
            self.take(".")
        elif word == "query" and self.kind(1) == "name":
            self.i += 1
            p.queries.append(self.atom())
            self.take(".")
        else:
            head = self.atom(head=True)
            body: tuple = ()
            if self.maybe("<-"):
                body = self.body()
                self.take(".")
                note = self.take() and self.take() if self.peek() == "@" else None
                p.rules.append(RuleText(head, body, note))
            else:
                self.take(".")
                p.facts.append(head)

    def declaration(self):
        name = self.take()
        self.take("(")
        return name, self.listed(self.column, ")")

    def column(self):
        name = self.take()
        self.take(":")
        return name, self.column_type()

    def column_type(self):
        if self.maybe("("):
            return ("struct", self.listed(self.column, ")"))
        if self.maybe("["):
            inner = self.column_type()
            self.take("]")
            return ("list", inner)
        return self.take()

    # bodies

    def body(self) -> tuple:
        out = [self.literal()]
        while self.maybe(","):
            out.append(self.literal())
        return tuple(out)

    def literal(self):
        word = self.peek()
        if self.maybe("~"):
            a = self.atom()
            return Atom(a.name, a.args, True)
        if self.kind() == "name" and self.peek(1) == "(":
            if word == "if":
                self.i += 2
                condition = self.body()
                self.take("then")
                then = self.body()
                otherwise = self.body() if self.maybe("else") else None
                self.take(")")
                return IfThenElse(condition, then, otherwise)
            if word == "choice":
                self.i += 2
                left = self.group()
                self.take(",")
                right = self.group()
                self.take(")")
                return Choice(left, right)
            if word == "limit":
                self.i += 2
                n = int(self.take())
                self.take(")")
                return Limit(n)
            if word == "sort" and self.peek(2) == "(":
                self.i += 2
                keys = self.listed(self.sort_key, ")")
                return Sort(keys)
        if word in ("true", "false") and self.peek(1) in (",", ".", ")", "then", "else"):
            self.i += 1
            return Truth(word == "true")
        start = self.i
        left = self.term()
        if self.peek() in COMPARISONS and self.kind() == "op":
            op = self.take()
            return Compare({"<>": "~=", "!=": "~="}.get(op, op), left, self.term())
        self.i = start
        return self.atom()

    def sort_key(self):
        self.take("(")
        term = self.term()
        ascending = True
        if self.maybe(","):
            ascending = self.take() != "desc"
        self.take(")")
        return term, ascending

    def group(self) -> tuple:
        self.take("(")
        return self.listed(self.term, ")")

    def atom(self, head: bool = False) -> Atom:
        if self.kind() != "name":
            raise ProgramError(f"expected a predicate, found {self.peek()!r}")
        name = self.take()
        if not self.maybe("("):
            return Atom(name, ())
        return Atom(name, self.listed(self.head_term if head else self.term, ")"))

    def head_term(self):
        if self.kind() == "name" and self.peek(1) == "<" and (self.peek() in AGGREGATES or self.peek()[0].islower()):
            name = self.take()
            self.take("<")
            occurrence, factor = (), None
            if self.peek() == "(":
                parts = self.nested()
                if len(parts) == 1:
                    value = parts[0]
                else:
                    *occurrence, value = parts
                    if isinstance(value, tuple):
                        factor, value = value
            else:
                value = self.term()
            self.take(">")
            return Aggregate(name, value, tuple(occurrence), factor)
        return self.term()

    def nested(self) -> tuple:
        self.take("(")
        return self.listed(lambda: self.nested() if self.peek() == "(" else self.term(), ")")

    # terms

    def term(self):
        left = self.product()
        while self.peek() in ("+", "-") and self.kind() == "op":
            left = Op(self.take(), (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while self.kind() in ("op", "name") and self.peek().lower() in ("*", "/", "div", "mod"):
            left = Op(self.take().lower(), (left, self.unary()))
        return left

    def unary(self):
        if self.maybe("-"):
            inner = self.unary()
            return Const(-inner.value) if isinstance(inner, Const) else Op("neg", (inner,))
        if self.maybe("("):
            inner = self.term()
            self.take(")")
            return inner
        if self.maybe("["):
            items, tail = [], None
            while not self.maybe("]"):
                items.append(self.term())
                if self.maybe("|"):
                    tail = self.term()
                    self.take("]")
                    break
                if not self.maybe(","):
                    self.take("]")
                    break
            return ListTerm(tuple(items), tail)
        kind, value = self.t[self.i]
        self.i += 1
        if kind in ("number", "string"):
            return Const(self.constant(value))
        if kind != "name":
            raise ProgramError(f"unexpected {value!r} in a term")
        if value == "nil":
            return Const(None)
        if self.peek() == "(" and not value[0].isupper():
            self.i += 1
            args = self.listed(self.term, ")")
            return Op(value, args) if value.lower() in FUNCTIONS else Functor(value, args)
        if value[0].isupper() or value[0] in "_$":
            return Var("_" if value == "_" else value.lstrip("$"))
        return Const(value)

    @staticmethod
    def constant(text: str):
        if text[0] in "\"'":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        return float(Decimal(text)) if "." in text or "e" in text.lower() else int(text)


def parse(text: str) -> Program:
    return Parser(text).program()
