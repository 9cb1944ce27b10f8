"""Terms, literals and rules of the logic dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def anonymous(self) -> bool:
        return self.name == "_"


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Op:
    """Arithmetic: + - * / div mod, neg, and functions log exp step abs."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Functor:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListTerm:
    items: tuple
    tail: object = None


@dataclass(frozen=True)
class Aggregate:
    """name<value>, name<(occurrence, value)> or name<(occurrence, (factor, value))>."""

    name: str
    value: object
    occurrence: tuple = ()
    factor: object = None


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple
    negated: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IfThenElse:
    condition: tuple
    then: tuple
    otherwise: tuple | None


@dataclass(frozen=True)
class Choice:
    left: tuple
    right: tuple


@dataclass(frozen=True)
class Limit:
    count: int


@dataclass(frozen=True)
class Sort:
    keys: tuple


@dataclass(frozen=True)
class Truth:
    value: bool


@dataclass(frozen=True)
class RuleText:
    head: Atom
    body: tuple
    annotation: str | None = None


@dataclass
class Program:
    """Everything that a program text declares."""

    schemas: dict = field(default_factory=dict)
    keys: dict = field(default_factory=dict)
    exports: list = field(default_factory=list)
    facts: list = field(default_factory=list)
    rules: list = field(default_factory=list)
    queries: list = field(default_factory=list)
    aggregates: dict = field(default_factory=dict)
    module: str | None = None


def variables(term) -> set[str]:
    """Names of the variables in a term or literal, without anonymous ones."""
    if isinstance(term, Var):
        return set() if term.anonymous else {term.name}
    if isinstance(term, (Op, Functor, Atom)):
        return set().union(*map(variables, term.args)) if term.args else set()
    if isinstance(term, ListTerm):
        return set().union(*map(variables, term.items), variables(term.tail))
    if isinstance(term, Aggregate):
        return variables(term.value) | variables(term.factor) | set().union(*map(variables, term.occurrence), set())
    if isinstance(term, Compare):
        return variables(term.left) | variables(term.right)
    if isinstance(term, IfThenElse):
        return set().union(*map(variables, term.condition + term.then + (term.otherwise or ())))
    if isinstance(term, Choice):
        return set().union(*map(variables, term.left + term.right))
    if isinstance(term, Sort):
        return set().union(*(variables(k) for k, _ in term.keys))
    return set()
