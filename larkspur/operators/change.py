"""INSERT, UPDATE and DELETE as copy-on-write of the files that are touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.expressions import SPARK, lower, reference
from larkspur.plans import nodes as n
from larkspur.plans.analyzer import check_insert, check_predicate, check_update, find
from larkspur.sources.catalog import Catalog, Table, matches_by_file


def insert(catalog: Catalog, plan: n.Insert) -> None:
    table = catalog.writable(plan.table)
    rows = check_insert(plan, table.columns)
    df = catalog.spark.createDataFrame(rows, table.schema()).coalesce(1)
    catalog.replace_files(table, table.files + catalog.write(table, df))


def _matches(table: Table, predicate: n.Expr | None) -> Column:
    """True where the predicate holds; a NULL predicate holds nowhere."""
    if predicate is None:
        return F.lit(True)
    kind = check_predicate(predicate, table.columns)
    return F.lit(False) if kind == n.NULL else F.coalesce(lower(predicate, table.columns), F.lit(False))


def _rewrite(catalog: Catalog, table: Table, hit: Column, change) -> int:
    """Rewrites the files with matching rows and keeps the others; returns how many rows matched.

    One pass over the predicate's columns counts the matches of each file, one pass rewrites the files that have any.
    """
    touched = matches_by_file(catalog.scan(table), hit) if table.files else {}
    if touched:
        files = catalog.write(table, change(catalog.scan(table, [x for x in table.files if x in touched])))
        catalog.replace_files(table, [x for x in table.files if x not in touched] + files)
    return sum(touched.values())


def _count(catalog: Catalog, name: str, value: int) -> DataFrame:
    return catalog.spark.createDataFrame([(value,)], f"{name} bigint")


def update(catalog: Catalog, plan: n.Update) -> DataFrame:
    """All columns change in one projection, so the predicate sees old values only."""
    table = catalog.writable(plan.table)
    values = check_update(plan, table.columns)
    hit = _matches(table, plan.predicate)

    def change(df: DataFrame) -> DataFrame:
        new = {name: F.lit(x.value).cast(SPARK[find(table.columns, name).type]) for name, x in values.items()}
        return df.select([F.when(hit, new[c.name]).otherwise(reference(c.name)).alias(c.name) if c.name in new else reference(c.name) for c in table.columns])

    return _count(catalog, "updated", _rewrite(catalog, table, hit, change))


def delete(catalog: Catalog, plan: n.Delete) -> DataFrame:
    table = catalog.writable(plan.table)
    hit = _matches(table, plan.predicate)
    return _count(catalog, "deleted", _rewrite(catalog, table, hit, lambda df: df.filter(~hit)))
