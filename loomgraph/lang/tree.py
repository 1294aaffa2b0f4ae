"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Base of all expressions."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    base: Expr
    key: str


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class AtTime(Expr):
    """A node's state at a time; only a hyperedge's participant can be one."""

    node: Expr
    time: Expr


@dataclass(frozen=True)
class NodePattern:
    var: str
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()
    named: bool = True


@dataclass(frozen=True)
class RelPattern:
    """direction: out, in or both; hops: None for one, else (least, most)."""

    var: str
    types: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()
    direction: str = "out"
    hops: tuple[int, int] | None = None
    named: bool = True


@dataclass(frozen=True)
class Chain:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...] = ()


class Clause:
    """Base of all clauses."""


@dataclass(frozen=True)
class Temporal:
    """kind: at (first only) or between."""

    kind: str
    first: Expr
    second: Expr | None = None


@dataclass(frozen=True)
class Match(Clause):
    chains: tuple[Chain, ...]
    where: Expr | None = None
    temporal: Temporal | None = None
    optional: bool = False


@dataclass(frozen=True)
class MatchHyperedge(Clause):
    var: str
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Sort:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Return(Clause):
    items: tuple[Item, ...]
    distinct: bool = False
    order: tuple[Sort, ...] = ()
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass(frozen=True)
class With(Clause):
    items: tuple[Item, ...]
    distinct: bool = False
    where: Expr | None = None


@dataclass(frozen=True)
class Unwind(Clause):
    expr: Expr
    var: str


@dataclass(frozen=True)
class Create(Clause):
    chains: tuple[Chain, ...]


@dataclass(frozen=True)
class Assign:
    var: str
    key: str
    value: Expr


@dataclass(frozen=True)
class SetClause(Clause):
    items: tuple[Assign, ...]


@dataclass(frozen=True)
class Remove(Clause):
    """items: (variable, property key or None, label or None)."""

    items: tuple[tuple[str, str | None, str | None], ...]


@dataclass(frozen=True)
class Delete(Clause):
    exprs: tuple[Expr, ...]
    detach: bool = False


@dataclass(frozen=True)
class Merge(Clause):
    chains: tuple[Chain, ...]
    on_match: tuple[Assign, ...] = ()
    on_create: tuple[Assign, ...] = ()


@dataclass(frozen=True)
class CreateIndex(Clause):
    name: str | None
    on: str
    key: str
    edge: bool = False


@dataclass(frozen=True)
class DropIndex(Clause):
    name: str


@dataclass(frozen=True)
class CreateSnapshot(Clause):
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]
    anchor: Expr | None
    match: Match
    items: tuple[Item, ...]


@dataclass(frozen=True)
class CreateHyperedge(Clause):
    var: str | None
    types: tuple[str, ...]
    sources: tuple[Expr, ...]
    targets: tuple[Expr, ...]


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = field(default_factory=tuple)


def parts(node) -> tuple:
    """The expressions directly below an expression."""
    match node:
        case Prop():
            return (node.base,)
        case ListOf():
            return node.items
        case Call():
            return node.args
        case Unary() | IsNull():
            return (node.operand,)
        case Binary():
            return (node.left, node.right)
        case AtTime():
            return (node.node, node.time)
    return ()


def walk(node):
    """An expression and all below it."""
    yield node
    for x in parts(node):
        yield from walk(x)
