"""Durable tables: a JSON manifest over immutable Parquet files.

A statement writes new files first and then swaps the manifest, so it takes effect wholly or not at
all, a reader keeps the files that it started with, and files that no manifest names are ignored until
`vacuum` removes them. The manifest counts its versions; a statement that started from another version
than the stored one is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import ConcurrentChangeError, TableAlreadyExistsError, TableNotFoundError, UnsupportedError
from larkspur.functions.expressions import reference
from larkspur.plans import nodes as n
from larkspur.plans.analyzer import find
from larkspur.sources.storage import Storage

_SPARK_TYPES = {n.INT: T.LongType(), n.FLOAT: T.DoubleType(), n.TEXT: T.StringType(), n.BOOL: T.BooleanType()}
_MODEL_TYPES = {"tinyint": n.INT, "smallint": n.INT, "int": n.INT, "bigint": n.INT, "float": n.FLOAT, "double": n.FLOAT, "string": n.TEXT, "boolean": n.BOOL}


@dataclass
class Table:
    name: str
    columns: list[n.ColumnDef]
    files: list[str] = field(default_factory=list)  # relative to the table's folder
    source: str | None = None  # of a registered, read-only table

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, _SPARK_TYPES[c.type]) for c in self.columns])


class Catalog:
    """Tables and indexes of one data folder. Without a folder only registered tables exist."""

    def __init__(self, spark: SparkSession, data_dir: str | None):
        self.spark, self.data_dir = spark, data_dir and data_dir.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, tuple[str, str]] = {}
        self.storage, self.version = Storage(spark) if data_dir else None, 0
        if self.storage and (text := self.storage.read(f"{self.data_dir}/catalog.json")):
            stored = json.loads(text)
            for name, x in stored["tables"].items():
                self.tables[name] = Table(name, [n.ColumnDef(**c) for c in x["columns"]], x["files"])
            self.indexes = {name: tuple(x) for name, x in stored["indexes"].items()}
            self.version = stored.get("version", 0)

    # -- manifest --------------------------------------------------------------------------
    def _commit(self, tables: dict[str, Table], indexes: dict[str, tuple[str, str]]) -> None:
        text = self.storage.read(f"{self.data_dir}/catalog.json")
        if (json.loads(text).get("version", 0) if text else 0) != self.version:
            raise ConcurrentChangeError(f"{self.data_dir} was changed by another engine")
        own = {t.name: {"columns": [asdict(c) for c in t.columns], "files": t.files} for t in tables.values() if t.source is None}
        self.storage.replace(f"{self.data_dir}/catalog.json", json.dumps({"version": self.version + 1, "tables": own, "indexes": indexes}, indent=1))
        self.tables, self.indexes, self.version = tables, indexes, self.version + 1

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise TableNotFoundError(name)
        return self.tables[name]

    def writable(self, name: str) -> Table:
        table = self.table(name)
        if table.source is not None:
            raise UnsupportedError(f"{name} is a registered source and read-only")
        return table

    def register(self, name: str, path: str) -> None:
        """A read-only table over Parquet files of any writer."""
        if name in self.tables:
            raise TableAlreadyExistsError(name)
        schema = self.spark.read.parquet(path).schema
        columns = [n.ColumnDef(f.name, _MODEL_TYPES.get(f.dataType.simpleString(), n.OTHER)) for f in schema]
        self.tables[name] = Table(name, columns, source=path)

    def create_table(self, plan: n.CreateTable) -> None:
        if not self.data_dir:
            raise UnsupportedError("CREATE TABLE needs a data folder")
        if plan.table in self.tables:
            raise TableAlreadyExistsError(plan.table)
        names = [c.name.lower() for c in plan.columns]
        if len(set(names)) < len(names):
            raise UnsupportedError("column names that are equal or differ in case only")
        self._commit(self.tables | {plan.table: Table(plan.table, list(plan.columns))}, self.indexes)

    # -- data ------------------------------------------------------------------------------
    def _folder(self, table: Table) -> str:
        return f"{self.data_dir}/tables/{quote(table.name, safe='').replace('.', '%2E')}"

    def scan(self, table: Table, files: list[str] | None = None) -> DataFrame:
        """The table's rows as of now: the DataFrame names its files and later statements don't change them."""
        if table.source is not None:
            return self.spark.read.parquet(table.source)
        files = table.files if files is None else files
        if not files:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*(f"{self._folder(table)}/{x}" for x in files))

    def write(self, table: Table, df: DataFrame) -> list[str]:
        """New files for rows of this table, each sorted by the column of the latest index. They count once the manifest names them."""
        version, keys = uuid.uuid4().hex, self.index_columns(table.name)
        writer = (df.sortWithinPartitions(reference(keys[-1]).asc_nulls_last()) if keys else df).write
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self._folder(table)}/{version}")
        return [f"{version}/{x}" for x in self.storage.data_files(f"{self._folder(table)}/{version}")]

    def replace_files(self, table: Table, files: list[str]) -> None:
        self._commit(self.tables | {table.name: Table(table.name, table.columns, files)}, self.indexes)

    def compact(self, name: str, file_bytes: int = 128 << 20) -> int:
        """Rewrites a table as files of about `file_bytes`, dealt by the latest index; returns how many there are then."""
        table = self.writable(name)
        if len(table.files) > 1:
            size = sum(self.storage.size(f"{self._folder(table)}/{x}") for x in table.files)
            count, keys, rows = max(1, -(-size // file_bytes)), self.index_columns(name), self.scan(table)
            if count < len(table.files):
                rows = rows.repartitionByRange(count, reference(keys[-1]).asc_nulls_last()) if keys and count > 1 else rows.coalesce(count)
                self.replace_files(table, self.write(table, rows))
        return len(self.tables[name].files)

    def vacuum(self, name: str) -> int:
        """Removes what earlier statements left behind, files that the manifest no longer names; returns how many those were.

        DataFrames that were made before the latest change of the table can't be read any more.
        """
        table, gone = self.writable(name), 0
        named = set(table.files)
        for version in self.storage.folders(self._folder(table)):
            files = [f"{version}/{x}" for x in self.storage.data_files(f"{self._folder(table)}/{version}")]
            if not named.intersection(files):
                self.storage.remove(f"{self._folder(table)}/{version}")
                gone += len(files)
            else:
                for x in set(files) - named:
                    self.storage.remove(f"{self._folder(table)}/{x}")
                    gone += 1
        return gone

    # -- indexes ---------------------------------------------------------------------------
    def index_columns(self, table: str) -> list[str]:
        """From the oldest to the latest."""
        return list(dict.fromkeys(reversed([column for t, column in self.indexes.values() if t == table])))[::-1]

    def create_index(self, plan: n.CreateIndex) -> None:
        """An index is a layout: files sorted by the key, whose row-group statistics and Bloom filters Spark prunes by.

        A table has one order. A second index on another column brings its own order, and the first keeps its Bloom filters.
        """
        if plan.name in self.indexes:
            raise TableAlreadyExistsError(plan.name)
        table = self.writable(plan.table)
        find(table.columns, plan.column)
        indexes = self.indexes | {plan.name: (plan.table, plan.column)}
        before, self.indexes = self.indexes, indexes
        try:
            files = table.files
            if files:
                files = self.write(table, self.scan(table).repartitionByRange(reference(plan.column).asc_nulls_last()))
            self._commit(self.tables | {table.name: Table(table.name, table.columns, files)}, indexes)
        except BaseException:
            self.indexes = before
            raise


def matches_by_file(df: DataFrame, predicate) -> dict[str, int]:
    """How many rows of each of a scan's files satisfy the predicate, where any does; as many as there are files at most."""
    rows = df.filter(predicate).groupBy(F.input_file_name().alias("f")).count().collect()
    return {"/".join(r.f.rsplit("/", 2)[-2:]): r["count"] for r in rows}
