"""Syntax tree and algebra of a query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def hidden(self) -> bool:
        """Blank nodes of the query and helpers, never part of SELECT *."""
        return self.name.startswith("_")


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str | None = None
    lang: str | None = None


Term = Var | Iri | Lit


# -- property paths


@dataclass(frozen=True)
class Step:
    iri: str


@dataclass(frozen=True)
class Inverse:
    of: Any


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """mark is one of ? * +"""

    of: Any
    mark: str


# -- patterns


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Any  # a term, or a path
    o: Term


@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any


@dataclass(frozen=True)
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Minus:
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    condition: Any
    of: Any


@dataclass(frozen=True)
class Extend:
    of: Any
    var: str
    expr: Any


@dataclass(frozen=True)
class Graph:
    name: Term
    of: Any


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple, ...]  # of Iri, Lit or None


@dataclass(frozen=True)
class SubSelect:
    query: Any


UNIT = Bgp(())


# -- expressions


@dataclass(frozen=True)
class Call:
    """A function or an operator, its name in upper case."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    of: Any
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any  # None: *
    distinct: bool = False
    separator: str = " "


# -- queries


@dataclass
class Query:
    form: str  # SELECT, ASK, DESCRIBE, CONSTRUCT
    where: Any = UNIT
    star: bool = False
    items: list[tuple[str, Any]] = field(default_factory=list)  # (name, expression or None)
    distinct: bool = False
    group: list[tuple[str | None, Any]] | None = None
    having: list = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    targets: list[Term] = field(default_factory=list)  # of DESCRIBE
    template: list[Triple] = field(default_factory=list)  # of CONSTRUCT


def children(x: Any) -> list:
    if isinstance(x, Call):
        return list(x.args)
    if isinstance(x, Agg):
        return [x.arg] if x.arg is not None else []
    return []


def aggregates(x: Any) -> list[Agg]:
    """Aggregates of an expression, outermost only."""
    return [x] if isinstance(x, Agg) else [a for c in children(x) for a in aggregates(c)]


def replace(x: Any, swap: dict) -> Any:
    """x with whole sub-expressions replaced."""
    if x in swap:
        return swap[x]
    return Call(x.name, tuple(replace(a, swap) for a in x.args)) if isinstance(x, Call) else x


def expr_vars(x: Any) -> set[str]:
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Exists):
        return variables(x.of)
    return set().union(*(expr_vars(c) for c in children(x)))


def variables(x: Any) -> set[str]:
    """In-scope variables of a pattern, hidden ones included."""
    if isinstance(x, Bgp):
        return {t.name for tr in x.triples for t in (tr.s, tr.p, tr.o) if isinstance(t, Var)}
    if isinstance(x, Join | LeftJoin):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Minus):
        return variables(x.left)
    if isinstance(x, Union):
        return set().union(*(variables(p) for p in x.parts))
    if isinstance(x, Filter):
        return variables(x.of)
    if isinstance(x, Extend):
        return variables(x.of) | {x.var}
    if isinstance(x, Graph):
        return variables(x.of) | ({x.name.name} if isinstance(x.name, Var) else set())
    if isinstance(x, Values):
        return set(x.names)
    if isinstance(x, SubSelect):
        q = x.query
        return {v for v in variables(q.where) if not Var(v).hidden} if q.star else {n for n, _ in q.items}
    raise TypeError(type(x).__name__)


def mentioned(x: Any) -> set[str]:
    """All variables that a pattern or an expression names, inside of filters, EXISTS and subselects too."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, tuple | list):
        return set().union(*map(mentioned, x))
    names = {x.var} if isinstance(x, Extend) else set(x.names) if isinstance(x, Values) else {n for n, _ in x.query.items} if isinstance(x, SubSelect) else set()
    return names.union(*(mentioned(getattr(x, f)) for f in getattr(x, "__dataclass_fields__", ())))
