"""Frozen logical-plan and expression nodes."""

from __future__ import annotations

from dataclasses import dataclass

#: The four value types, the type of a statically NULL expression, and the type of
#: columns outside the model (timestamps, lists), which can only be projected or null-tested.
INT, FLOAT, TEXT, BOOL, NULL, OTHER = "INT", "FLOAT", "TEXT", "BOOL", "NULL", "OTHER"

COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Column:
    name: str


@dataclass(frozen=True)
class Literal:
    value: object
    type: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull:
    operand: Expr
    negated: bool = False


Expr = Column | Literal | Binary | IsNull


def chain(expr: Binary) -> tuple[Expr, list[tuple[str, Expr]]]:
    """The innermost left operand of a left-deep chain, and the operators with their right operands from there on.

    A predicate of thousands of ORs is such a chain, too deep to recurse into.
    """
    rest = []
    while isinstance(expr, Binary):
        rest.append((expr.op, expr.right))
        expr = expr.left
    return expr, rest[::-1]


@dataclass(frozen=True)
class Scan:
    table: str


@dataclass(frozen=True)
class Filter:
    input: Scan
    predicate: Expr


@dataclass(frozen=True)
class Project:
    input: Scan | Filter
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Literal], ...]
    predicate: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    predicate: Expr | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


Statement = Project | Insert | Update | Delete | CreateTable | CreateIndex
