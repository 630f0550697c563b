"""Token ids as canonical, length-limited Huffman code in independent blocks.

The file format is a folder of Parquet files, so that any store that Spark reaches can hold it. A row
of `blocks` is one block: the ids of consecutive documents, in ascending doc_id order. Code lengths come
from the ids' counts over the whole corpus, the codes are the canonical ones of those lengths, and
`checkpoints` holds the bit offset of every CHECKPOINT-th id, from which decoding can start. The code
lengths lie beside the blocks in `lengths`, one row an id, and `parts` says how many ids stand before
each range of documents.

Texts are tokenized where they are read, and counted in the same pass; only ids, two bytes each where
the vocabulary allows, are sorted by doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import batch, materialize, materialize_to, partitions, temporary
from larkspur.llm.tokens import encoder
from larkspur.llm.vectors import blocks
from larkspur.sources.storage import scratch

CHECKPOINT = 256
#: ids after which a block is closed; a document is never divided.
BLOCK_IDS = 1 << 18

#: ids of a long document that are one row until it is coded.
SLICE_IDS = 1 << 22

_RAW = "doc_id long,tie binary,place long,slice int,n long,ids binary,width int,id long,times long"
_CODED = "part int,block int,before long,doc_ids binary,doc_nulls binary,lengths binary,n_ids long,bits binary,checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    weights = np.sort(counts[used])
    order = used[np.argsort(counts[used], kind="stable")]
    # Level by level from the longest codes: a row is the sorted merge of the coins and the pairs below.
    is_coin, merged = [], weights
    for level in range(limit):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
            merged = np.concatenate([weights, pairs])
            by = np.argsort(merged, kind="stable")
            is_coin.append(by < len(weights))
            merged = merged[by]
        else:
            is_coin.append(np.ones(len(weights), bool))
    take = 2 * len(weights) - 2
    depth = np.zeros(len(weights) + 1, np.int64)
    for coins in reversed(is_coin):
        n = int(coins[:take].sum())
        depth[0] += 1
        depth[n] -= 1
        take = 2 * (take - n)
    out[order] = np.cumsum(depth)[:-1]
    return out


@dataclass
class Code:
    """The canonical code of given lengths, with its decoding table."""

    lengths: np.ndarray
    limit: int

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        n = self.lengths[order].astype(np.int64)
        steps = np.left_shift(1, self.limit - n)
        starts = np.cumsum(steps) - steps  # each code, moved to the left end of `limit` bits
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = starts >> (self.limit - n)
        self.symbols = np.repeat(order, steps).astype(np.uint32)
        if len(self.symbols) < 1 << self.limit:
            self.symbols = np.concatenate([self.symbols, np.zeros((1 << self.limit) - len(self.symbols), np.uint32)])

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Big-endian 64-bit words of code, and the bit offset of every CHECKPOINT-th id."""
        n = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(n)
        at = ends - n
        words = np.zeros((int(ends[-1]) if len(ids) else 0) // 64 + 2, np.uint64)
        if len(ids):
            codes, word, room = self.codes[ids], at >> 6, 64 - (at & 63) - n
            high = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[begins]] = np.bitwise_or.reduceat(high, begins)
            over = np.flatnonzero(room < 0)
            words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8"), at[::CHECKPOINT]

    def decode(self, words: np.ndarray, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """Every checkpoint's run is a lane; all lanes take one table step at a time."""
        out = np.zeros((len(checkpoints), CHECKPOINT), np.uint32)
        words = words.astype(np.uint64)
        at, shift = checkpoints.astype(np.int64), np.uint64(64 - self.limit)
        last = n - CHECKPOINT * (len(checkpoints) - 1)
        for k in range(min(CHECKPOINT, n)):
            if k == last:  # the last run is shorter
                at = at[:-1]
            word, off = at >> 6, (at & 63).astype(np.uint64)
            seen = words[word] << off
            seen |= np.where(off > 0, words[word + 1] >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
            ids = self.symbols[seen >> shift]
            out[: len(at), k] = ids
            at = at + self.lengths[ids]
        return out.reshape(-1)[:n]


def _tokenized(path: str, end_id: int, added: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ids of each row, with the end id, in slices of `most`, and how often the task has met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, total = encoder(path, added), np.zeros(1, np.int64)
        # Rows that are equal in id and text are told apart by where they were read, so that any number of them is dealt out.
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            names, ties = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x in blocks(b.column(2)):
                got, at = code.rows(x.data, x.offsets)
                count = np.bincount(got, minlength=len(total))
                count[: len(total)] += total
                total = count
                rows: list[tuple] = []
                for k in range(x.hi - x.lo):
                    ids = np.append(got[at[k] : at[k + 1]], np.uint32(end_id))
                    for j, lo in enumerate(range(0, len(ids), most)):
                        some = ids[lo : lo + most]
                        width = 2 if int(some.max()) < 1 << 16 else 4
                        rows.append((names[x.lo + k], ties[x.lo + k], place + k, j, len(ids) if not j else 0, some.astype(f"<u{width}").tobytes(), width))
                place += x.hi - x.lo
                total = np.pad(total, (0, max(0, end_id + 1 - len(total))))
                total[end_id] += x.hi - x.lo
                doc_id, tie, at_place, part, n, ids, width = zip(*rows, strict=True)
                none = [None] * len(rows)
                yield batch(_RAW, doc_id=doc_id, tie=tie, place=at_place, slice=part, n=n, ids=ids, width=width, id=none, times=none)
        used = np.flatnonzero(total)
        none = [None] * len(used)
        yield batch(_RAW, doc_id=none, tie=none, place=none, slice=none, n=none, ids=none, width=none, id=used, times=total[used])

    return run


def _blocks(lengths: np.ndarray, limit: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Coded blocks of the documents of a partition, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code, block, before = TaskContext.get().partitionId(), Code(lengths, limit), 0, 0
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        have = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, docs, sizes, held, have
            ids = np.concatenate(held)
            words, marks = code.encode(ids)
            out = batch(
                _CODED, part=[part], block=[block], before=[before], doc_ids=[np.array([d or 0 for d in docs], "<i8").tobytes()], doc_nulls=[np.array([d is None for d in docs]).tobytes()],
                lengths=[np.array(sizes, "<i8").tobytes()], n_ids=[len(ids)], bits=[words.tobytes()], checkpoints=[marks.astype("<i8").tobytes()],
            )
            block, before = block + 1, before + len(ids)
            docs, sizes, held, have = [], [], [], 0
            return out

        for b in batches:
            for doc_id, n, raw, width in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if n:  # the first slice of a document
                    if have >= most:
                        yield flush()
                    docs.append(doc_id)
                    sizes.append(n)
                held.append(np.frombuffer(raw, f"<u{width}"))
                have += len(held[-1])
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, limit: int = 16, added: bool = False) -> None:
    """Encodes (doc_id, text) rows into a folder: `path`/blocks, `path`/lengths and `path`/parts.

    Null text is empty and has the end id only. Rows of equal doc_ids are neighbours, ordered by a hash of
    their texts; repeated rows repeat; a null doc_id comes first. A very long text is tokenized in pieces and
    moved in slices; its codes are one block. An empty table gives no block. Other columns are ignored. With
    `added`, a literal of one of the tokenizer's added tokens is that token's id, else it is text like any other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("tie"), F.col("text").cast("string"))
    with temporary(spark):
        raw = materialize(rows.mapInArrow(_tokenized(tokenizer, end_id, added, SLICE_IDS), _RAW), "ids")
        counted = raw.filter("id IS NOT NULL").groupBy("id").agg(F.sum("times").alias("n")).collect()  # a row an id of the vocabulary
        counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
        for r in counted:
            counts[r.id] = r.n
        limit = max(limit, int(np.ceil(np.log2(max(2, len(counted))))))
        lengths = code_lengths(counts, limit)
        spark.createDataFrame([(int(k), int(n), limit) for k, n in enumerate(lengths) if n], "id int,bits int,max_bits int").coalesce(1).write.parquet(f"{path}/lengths")
        order = ["doc_id", "tie", "place"]  # a document's slices stay together
        dealt = raw.filter("id IS NULL").drop("id", "times").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "slice")
        materialize_to(dealt.select("doc_id", "n", "ids", "width").mapInArrow(_blocks(lengths, limit, BLOCK_IDS), _CODED), f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a partition
    bases, at = [], 0
    for r in totals:
        bases.append((r.part, at))
        at += r.n
    spark.createDataFrame(bases, "part int,first long").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Code | None]:
    """The blocks, each with how many ids stand before it, and the code."""
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/parts")  # a row a partition
    blocks = blocks.join(F.broadcast(parts), "part").withColumn("first", F.col("first") + F.col("before"))
    rows = spark.read.parquet(f"{path}/lengths").collect()  # a row an id of the vocabulary
    if not rows:
        return blocks, None
    lengths = np.zeros(max(r.id for r in rows) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.bits
    return blocks, Code(lengths, rows[0].max_bits)


_DIGEST = "doc_id long,start long,n_tokens long,ids_crc32 long"


def digest(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: where its ids start, how many there are, and their crc32."""
    coded, code = read(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = code.decode(np.frombuffer(r["bits"], ">u8"), np.frombuffer(r["checkpoints"], "<i8"), r["n_ids"]).astype("<u4")
                n = np.frombuffer(r["lengths"], "<i8")
                at = np.concatenate([[0], np.cumsum(n)])
                names = np.frombuffer(r["doc_ids"], "<i8").tolist()
                nulls = np.frombuffer(r["doc_nulls"], bool)
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield batch(_DIGEST, doc_id=[None if x else d for d, x in zip(names, nulls, strict=True)], start=at[:-1] + r["first"], n_tokens=n, ids_crc32=crc)

    return coded.mapInArrow(run, _DIGEST)


def query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and reads the digest back from them."""
    path = scratch(spark, "huffman")
    write(docs, path, tokenizer, added=True)
    return digest(spark, path)
