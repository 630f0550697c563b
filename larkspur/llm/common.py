"""What the operators share: reading tables, cutting lineage, fetching a few texts, and Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.storage import Storage, scratch

#: While a table is written: Spark removes the query's shuffle files when it ends, instead of when the driver next collects
#: garbage, and sends Python batches of some megabytes of text.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Bytes of a table's files up to which it is broadcast.
LIGHT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For each `temporary` that this thread is in, from the outermost: what it is to remove.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Writes the rows to the folder that all executors share and reads them back.

    That ends the lineage: a lost executor costs the tasks that it ran, nothing before them, what is read
    twice is computed once, and the shuffle files behind it go. Inside `temporary` the files go when that
    ends, or, if kept, when the next outer one does.
    """
    spark = df.sparkSession
    path, scopes = scratch(spark, what), _scopes.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    materialize_to(df, path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_to(df: DataFrame, path: str) -> None:
    """Writes the rows; the shuffle files behind them go when that is done."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def light(df: DataFrame) -> DataFrame:
    """A materialized table, marked for broadcasting if its files have LIGHT_BYTES at most; larger ones are joined by shuffling."""
    files = df.inputFiles()
    size = Storage(df.sparkSession).total(files[0].rsplit("/", 1)[0]) if files else 0
    return F.broadcast(df) if size <= LIGHT_BYTES else df


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes what is materialized inside when it ends; what outlasts it must be kept and not depend on the rest."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        store = Storage(spark)
        for path in paths:
            store.remove(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame) -> list[Column]:
    """All columns of a frame, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name, which itself takes no dots; `run` may go by position only."""
    names = [f"c{k}" for k in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    plain = T.StructType([T.StructField(name, f.dataType) for name, f in zip(names, schema, strict=True)])
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(renamed, plain).toDF(*schema.names)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell rows apart by id and text; null and empty text are the same, a null id is not 0."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit("")))))


def key_words(column: pa.Array) -> np.ndarray:
    """16-byte keys as two 64-bit numbers each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


#: Bits of a membership table for each key, and the most bits: beyond 8 million keys it lets more and more others pass.
KEY_BITS, MOST_BITS = 8, 1 << 26


def membership(keys: DataFrame) -> np.ndarray:
    """A Bloom table of a column of distinct 16-byte keys, as bytes; its size follows their number up to 8 MB.

    Keys are dealt by their part of the table, so each part is made in one task without holding the keys.
    """
    spark, n = keys.sparkSession, keys.count()
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (KEY_BITS * n).bit_length()))
    name = keys.columns[0]
    parts = 64
    width = bits // parts

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                k = key_words(b.column(0))
                part = b.column(1).to_numpy()
                for p in np.unique(part).tolist():
                    own = held.setdefault(p, np.zeros(width, bool))
                    own[_places(k[part == p], width)] = True
        if held:
            yield batch("part int,bits binary", part=list(held), bits=[np.packbits(x, bitorder="little").tobytes() for x in held.values()])

    # The part comes from the first byte, the places from the numbers, less those bits.
    part = F.conv(F.substring(F.hex(name), 1, 2), 16, 10).cast("int") % parts
    rows = keys.select(name, part.alias("part")).repartition(min(parts, partitions(spark)), "part").mapInArrow(fill, "part int,bits binary").collect()  # 8 MB at most
    out = np.zeros((parts, width // 8), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _places(keys: np.ndarray, width: int) -> np.ndarray:
    mask = np.uint64(width - 1)
    return np.concatenate([keys[:, 0] >> np.uint64(8) & mask, keys[:, 1] & mask]).astype(np.int64)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the membership table: all that are, and a few others."""
    parts = 64
    width = len(table) * 8 // parts
    base = (keys[:, 0] & np.uint64(0xFF)).astype(np.int64) % parts * width
    a, b = _places(keys, width).reshape(2, -1)
    a, b = a + base, b + base
    return (table[a >> 3] >> (a & 7).astype(np.uint8) & table[b >> 3] >> (b & 7).astype(np.uint8) & 1) > 0


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) for each of the distinct keys in `wanted`; rows has (key, text), with rows that repeat.

    Only texts whose keys may be wanted are moved, and each once a task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(membership(wanted))  # 8 MB at most

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            if not b.num_rows:
                continue
            keep = may_hold(shared.value, key_words(b.column(0)))
            names = b.column(0).to_pylist()
            for k in np.flatnonzero(keep).tolist():
                keep[k] = names[k] not in seen
                seen.add(names[k])
            yield b.filter(pa.array(keep))

    found = rows.select("key", "text").mapInArrow(near, "key binary,text string")
    return found.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: str, **columns) -> pa.RecordBatch:
    """Columns as an Arrow batch of a schema of longs, ints, doubles, booleans, strings and binaries."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], types[kind]) for name, kind in fields], names=[name for name, _ in fields])


def tokenizer(name: str) -> str:
    """A public tokenizer's file. The package is installed on every executor; its files are not copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
