"""Scan, Filter, Project and the access path that they amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.expressions import lower, reference
from larkspur.plans import nodes as n
from larkspur.plans.analyzer import check_predicate, find
from larkspur.sources.catalog import Catalog

_FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def select(catalog: Catalog, plan: n.Project) -> DataFrame:
    """Filters and column lists reach the Parquet scan through Catalyst."""
    predicate, scan = (plan.input.predicate, plan.input.input) if isinstance(plan.input, n.Filter) else (None, plan.input)
    table = catalog.table(scan.table)
    for name in plan.columns:
        find(table.columns, name)
    df = catalog.scan(table)
    if predicate is not None:
        kind = check_predicate(predicate, table.columns)
        df = df.filter(F.lit(False) if kind == n.NULL else lower(predicate, table.columns))
    return df.select([reference(name) for name in plan.columns])


def fold(expr: n.Expr) -> n.Expr:
    """Literal pairs of one type become a literal; only access_path needs it, Catalyst folds by itself."""
    if isinstance(expr, n.IsNull):
        return n.IsNull(fold(expr.operand), expr.negated)
    if not isinstance(expr, n.Binary):
        return expr
    first, rest = n.chain(expr)
    out = fold(first)
    for op, right in rest:
        out = _fold_pair(n.Binary(op, out, fold(right)))
    return out


def _fold_pair(expr: n.Binary) -> n.Expr:
    a, b = expr.left, expr.right
    if isinstance(a, n.Literal) and isinstance(b, n.Literal) and a.type == b.type != n.NULL:
        x, y = a.value, b.value
        if expr.op == "+" and a.type in (n.INT, n.FLOAT):
            if a.type == n.FLOAT or x + y < 2**63:
                return n.Literal(x + y, a.type)
        elif a.type == n.BOOL and expr.op in ("AND", "OR"):
            return n.Literal(x and y if expr.op == "AND" else x or y, n.BOOL)
        elif expr.op in ("=", "<>"):
            return n.Literal((x == y) == (expr.op == "="), n.BOOL)
        elif expr.op in _FLIP and a.type != n.BOOL:
            return n.Literal({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[expr.op], n.BOOL)
    return expr


def access_path(catalog: Catalog, plan: n.Project) -> str:
    """SeqScan, IndexScan or RangeIndexScan: whether one comparison on an indexed column decides the rows.

    It is a report. Execution never branches on it, so an index cannot change a result.
    """
    if not isinstance(plan.input, n.Filter):
        catalog.table(plan.input.table)
        return "SeqScan"
    table = catalog.table(plan.input.input.table)
    indexed = catalog.index_columns(table.name)
    match fold(plan.input.predicate):
        case n.IsNull(n.Column(name), negated) if name in indexed:
            return "RangeIndexScan" if negated else "IndexScan"
        case n.Binary(op, n.Column(name), n.Literal(_, kind)) | n.Binary(op, n.Literal(_, kind), n.Column(name)) if name in indexed and kind != n.NULL and op in _FLIP:
            return "IndexScan" if op == "=" else "RangeIndexScan"
    return "SeqScan"
