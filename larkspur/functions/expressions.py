"""Analyzed expression to Spark Column. Types are already checked by the analyzer."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.plans import nodes as n
from larkspur.plans.analyzer import binary_type, find

#: Spark's type for each type of the model; INT is 64-bit and FLOAT is double precision.
SPARK = {n.INT: "bigint", n.FLOAT: "double", n.TEXT: "string", n.BOOL: "boolean", n.NULL: "boolean"}


def reference(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: n.Literal, kind: str | None = None) -> Column:
    return F.lit(value.value).cast(SPARK[kind or value.type])


def lower(expr: n.Expr, columns: Sequence[n.ColumnDef]) -> Column:
    """Narrow physical columns (int32, float32) are widened, so `+` and comparisons are 64-bit."""
    return _typed(expr, columns)[1]


def _typed(expr: n.Expr, columns: Sequence[n.ColumnDef]) -> tuple[str, Column]:
    """The type and the column of an expression, each subexpression visited once."""
    match expr:
        case n.Column(name):
            kind = find(columns, name).type
            return kind, reference(name) if kind == n.OTHER else reference(name).cast(SPARK[kind])
        case n.Literal():
            return expr.type, literal(expr)
        case n.IsNull(operand, negated):
            inner = reference(operand.name) if isinstance(operand, n.Column) and find(columns, operand.name) else _typed(operand, columns)[1]
            return n.BOOL, inner.isNotNull() if negated else inner.isNull()
        case n.Binary():
            first, rest = n.chain(expr)
            rest = deque(rest)
            kind, value = _typed(first, columns)
            while rest:
                op = rest[0][0]
                run = []
                while rest and rest[0][0] == op and (op in ("AND", "OR") or not run):
                    run.append(_typed(rest.popleft()[1], columns))
                for other, _ in run:
                    kind = binary_type(op, kind, other)
                value = F.lit(None).cast("boolean") if kind == n.NULL else _joined(op, [value, *(x for _, x in run)])
            return kind, value
    raise AssertionError(expr)


def _joined(op: str, values: list[Column]) -> Column:
    """Many ANDs or ORs as a balanced tree, which Catalyst can recurse into."""
    if len(values) > 2:
        half = len(values) // 2
        values = [_joined(op, values[:half]) if half > 1 else values[0], _joined(op, values[half:])]
    a, b = values
    match op:
        case "=":
            return a == b
        case "<>":
            return a != b
        case "<":
            return a < b
        case "<=":
            return a <= b
        case ">":
            return a > b
        case ">=":
            return a >= b
        case "+":
            return a + b
        case "AND":
            return a & b
        case "OR":
            return a | b
    raise AssertionError(op)
