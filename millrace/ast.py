"""Syntax tree; nodes compare by structure."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """Any value expression."""


class Pred:
    """Any predicate."""


@dataclass(frozen=True)
class Ref(Expr):
    name: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Num(Expr):
    text: str


@dataclass(frozen=True)
class Str(Expr):
    value: str


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    when: Pred
    then: Expr
    other: Expr


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    arg: Expr
    distinct: bool = False


@dataclass(frozen=True)
class Compare(Pred):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class And(Pred):
    left: Pred
    right: Pred


@dataclass(frozen=True)
class Like(Pred):
    expr: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class In(Pred):
    expr: Expr
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    table: str
    alias: str | None = None
    where: Pred | None = None
    group: tuple[Expr, ...] = ()
    having: Pred | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0


def label(expr: Expr, inside: bool = False) -> str:
    """Default output name of an expression; qualifiers show inside calls only."""
    match expr:
        case Ref(name, qualifier):
            return f"{qualifier}.{name}" if inside and qualifier else name
        case Num(text):
            return text
        case Str(value):
            return value
        case Star():
            return "*"
        case Arith(op, left, right):
            return f"{label(left, inside)} {op} {label(right, inside)}"
        case Case():
            return "CASE"
        case Agg(name, arg, distinct):
            return f"{name}({'DISTINCT ' if distinct else ''}{label(arg, True)})"
        case Call(name, args):
            return f"{name}({', '.join(label(a, True) for a in args)})"
    raise TypeError(expr)
