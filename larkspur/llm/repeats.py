"""Exact removal of repeated windows by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first `width` tokens only, most significant digit first; the groups that the
last pass leaves equal are exactly the windows that occur more than once. A token is a byte or a word. A
digit is a fingerprint of tokens that all equal windows agree on, so its order is arbitrary but its groups
are right:

* First pass: the digit is the window's anchor, the smallest of its runs of `run` tokens by hash. The
  windows of a stretch of text share their anchors, so this pass moves one row for some hundred suffixes.
  Anchors that occur once hold no repeated window, and their suffixes fall out.
* Second pass: the digit is the whole window, compared within its anchor. A window's distinct
  fingerprints are first made unique in chunks of text, so a passage that very many documents share is
  sent once a chunk, not once a document. Windows under a very frequent anchor go by their own
  fingerprints, so that no group grows with the passage's copies.

Equal texts are one throughout: all their windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, every, fetch, light, map_rows, materialize, partitions, row_key, temporary, unused
from larkspur.llm.vectors import NOT_SPACE, SYMBOLS, Block, Ranges, blocks, word_hashes


@dataclass(frozen=True)
class Windows:
    """Windows of `width` tokens, bytes or words, whose anchors are runs of `run` tokens."""

    width: int
    run: int
    of_words: bool = False
    block: int = 1 << 20  # tokens that are sorted at once

    def tokens(self, block: Block) -> Tokens:
        if not self.of_words:
            return Tokens(None, block.data, block.offsets)
        w, hashes = word_hashes(block.data, block.offsets, NOT_SPACE, lower=False)
        return Tokens((w.starts, w.ends), hashes, w.first)


class Tokens(NamedTuple):
    """The tokens of a block's rows: bytes, or words with their bounds, and where each row's begin."""

    bounds: tuple[np.ndarray, np.ndarray] | None
    values: np.ndarray
    offsets: np.ndarray


BYTES = Windows(400, 192)
WORDS = Windows(50, 24, True)
#: Bytes of a chunk.
CHUNK_BYTES = 3 << 20
#: Suffixes by their distance from the anchor, so that a frequent anchor is several groups.
PART = 64
#: Places of an anchor beyond which its windows go by their own fingerprints.
FREQUENT = 1 << 10

_U = np.uint64
_ANCHORS = "text_key binary,key binary,anchor long,times int"
_WINDOWS = "chunk long,run int,anchor long,part int,hashes binary,known binary"
_MASKS = "chunk long,run int,mask binary"
_SPANS = "text_key binary,spans binary,n_removed long,n_spans long,kept_sha256 string"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


class Suffixes:
    """The suffixes of a stretch of tokens that have a whole window: where they start, their row, and their digits."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, windows: Windows):
        width, run = windows.width, windows.run
        n = np.maximum(np.diff(offsets) - width + 1, 0)
        self.row = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(int(n.sum())) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)
        if not len(self.start):
            self.at = self.anchor = np.zeros(0, np.int64)
            return
        self.ranges = Ranges(values)
        runs = self.ranges.windows(run)
        span = width - run + 1
        # The leftmost smallest of the `span` runs from each position on: by blocks of that length, from both ends.
        value = (runs >> _U(32) << _U(32)) | np.arange(len(runs), dtype=np.uint64)
        padded = np.full(-(-(len(value) + 1) // span) * span, np.iinfo(np.uint64).max)
        padded[: len(value)] = value
        table = padded.reshape(-1, span)
        before = np.minimum.accumulate(table, 1).reshape(-1)
        after = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].reshape(-1)
        smallest = np.minimum(after[self.start], before[self.start + span - 1])
        self.at = (smallest & _U(0xFFFFFFFF)).astype(np.int64)
        self.anchor = runs[self.at].view(np.int64)
        self.width = width

    def windows(self, use: np.ndarray) -> np.ndarray:
        return self.ranges.hash(self.start[use], self.start[use] + self.width)


def stretches(tokens: Tokens, windows: Windows) -> Iterator[tuple[int, int, Suffixes]]:
    """The suffixes of a block: all at once, or those of a very long row in stretches that overlap by a window, with the first token and row."""
    values, offsets = tokens.values, tokens.offsets
    if len(values) <= 2 * windows.block:
        yield 0, 0, Suffixes(values, offsets, windows)
        return
    for row, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if z - a < windows.width:
            continue
        for lo in range(a, z - windows.width + 1, windows.block):
            hi = min(lo + windows.block + windows.width - 1, z)
            yield lo, row, Suffixes(values[lo:hi], np.array([0, hi - lo]), windows)


def _anchors(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each text with the number of places, and a row without an anchor for each row that has any."""
        for b in batches:
            texts, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x in blocks(b.column(2), windows.block):
                tokens = windows.tokens(x)
                for lo, base, s in stretches(tokens, windows):
                    places = np.flatnonzero(np.diff(s.at, prepend=-1))
                    row, anchor = s.row[places], s.anchor[places]
                    order = np.lexsort((anchor, row))
                    row, anchor = row[order], anchor[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])]) if len(row) else [])
                    times = np.diff(np.append(new, len(row)))
                    have = np.unique(row) if lo == tokens.offsets[base] else row[:0]  # of a row in stretches once
                    at = np.concatenate([row[new], have]) + x.lo + base
                    yield batch(
                        _ANCHORS, text_key=[texts[k] for k in at], key=[keys[k] for k in at], anchor=pa.array(np.concatenate([anchor[new], np.zeros(len(have), np.int64)]), mask=np.arange(len(at)) >= len(new)),
                        times=np.concatenate([times, np.ones(len(have), np.int64)]),
                    )

    return run


@dataclass
class Chunk:
    """The candidate suffixes of a chunk's texts, in one order however its rows come, and their distinct windows."""

    keys: list[bytes]
    copied: np.ndarray
    blocks: list[tuple[Block, Tokens, np.ndarray]]  # with the candidates' starts
    code: np.ndarray  # of each candidate, its window's number
    anchor: np.ndarray  # of each distinct window, as are the next four
    part: np.ndarray
    frequent: np.ndarray
    window: np.ndarray
    known: np.ndarray  # it occurs twice here, or in a text with copies

    @classmethod
    def of(cls, table: pa.Table, windows: Windows) -> Chunk:
        keys = table.column("text_key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        table = table.take(order).combine_chunks()
        copied = np.array(table.column("copied").to_pylist(), bool)
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        kept = []
        for b in table.to_batches():
            wanted, often = (np.unique(b.column(c).flatten().to_numpy()) for c in ("anchors", "frequent"))
            for x in blocks(b.column("text"), windows.block):
                tokens, starts = windows.tokens(x), []
                for lo, base, s in stretches(tokens, windows):
                    use = np.flatnonzero(_among(s.anchor, wanted))
                    starts.append(s.start[use] + lo)
                    if len(use):
                        for out, value in zip(found, (s.anchor[use], (s.at[use] - s.start[use]) // PART, _among(s.anchor[use], often), s.windows(use), copied[x.lo + base + s.row[use]]), strict=True):
                            out.append(value)
                kept.append((x, tokens, np.concatenate(starts)))
        keys = [keys[k] for k in order]
        if not found[0]:
            none = np.zeros(0, np.int64)
            return cls(keys, copied, kept, none, none, none, none > 0, none.view(np.uint64), none > 0)
        anchor, part, frequent, window, known = (np.concatenate(x) for x in found)
        code, window = pd.factorize(window)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
        return cls(keys, copied, kept, code, anchor[first], part[first], frequent[first], window, (np.bincount(code) > 1) | (np.bincount(code, known) > 0))


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(some) or not len(values):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _windows(windows: Windows) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The distinct windows of a chunk in runs of one anchor and part; under a frequent anchor each by itself (part -1)."""
        c = Chunk.of(table, windows)
        begins = (c.anchor[1:] != c.anchor[:-1]) | (c.part[1:] != c.part[:-1]) | c.frequent[1:] | c.frequent[:-1]
        cut = np.flatnonzero(np.concatenate([[True], begins])) if len(c.anchor) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(c.anchor)) if len(cut) else cut
        raw, bits = c.window.tobytes(), c.known.astype(np.uint8).tobytes()
        pairs = list(zip(cut.tolist(), ends.tolist(), strict=True))
        alone = c.frequent[cut]
        return pa.Table.from_batches([
            batch(
                _WINDOWS, chunk=np.full(len(cut), key[0].as_py()), run=np.arange(len(cut)), anchor=np.where(alone, c.window[cut].view(np.int64), c.anchor[cut]), part=np.where(alone, -1, c.part[cut]),
                hashes=[raw[8 * a : 8 * z] for a, z in pairs], known=[bits[a:z] for a, z in pairs],
            )
        ])

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks' windows sorted by anchor and part: which are repeated, in the chunk or in another.

    A group is held until it ends, but for part -1, whose groups are one window that may be in any number of chunks.
    """

    def marked(some: pa.Table) -> pa.RecordBatch:
        # Windows that are equal have equal anchors, so those of several groups can be sorted together.
        hashes, known = some.column("hashes").to_pylist(), some.column("known").to_pylist()
        n = np.array([len(x) for x in known])
        value, sure = np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(known), np.uint8) > 0
        order = np.argsort(value, kind="stable")
        sorted_value = value[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_value[1:] != sorted_value[:-1]]))
        times = np.diff(np.append(first, len(value)))
        repeated = np.empty(len(value), bool)
        repeated[order] = np.repeat(np.logical_or.reduceat(sure[order], first) | (times > 1), times)
        raw, ends = repeated.astype(np.uint8).tobytes(), np.cumsum(n)
        return batch(_MASKS, chunk=some.column("chunk").to_numpy(), run=some.column("run").to_numpy(), mask=[raw[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)])

    def yes(some: pa.Table) -> pa.RecordBatch:
        return batch(_MASKS, chunk=some.column("chunk").to_numpy(), run=some.column("run").to_numpy(), mask=[b"\1"] * some.num_rows)

    rest: pa.Table | None = None
    sure: int | None = None  # the window of part -1 that the rows before ended in, which is known to be repeated
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        if rest is not None:
            now, rest = pa.concat_tables([rest, now]), None
        a, p = now.column("anchor").to_numpy(), now.column("part").to_numpy()
        change = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1])) + 1
        if sure is not None:
            same = 0 if a[0] != sure or p[0] != -1 else int(change[0]) if len(change) else len(a)
            if same:
                yield yes(now.slice(0, same))
            if same == len(a):
                continue
            now, change, sure = now.slice(same), change[change > same] - same, None
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield marked(now.slice(0, cut))
        rest = now.slice(cut)
        if rest.num_rows > 1 and rest.column("part")[0].as_py() == -1:
            yield yes(rest)
            sure, rest = rest.column("anchor")[0].as_py(), None
    if rest is not None and rest.num_rows:
        yield marked(rest)


def _spans(windows: Windows) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        """The removed spans of a chunk's texts, in bytes."""
        c = Chunk.of(table, windows)
        order = np.argsort(masks.column("run").to_numpy())
        column = masks.column("mask").to_pylist()
        repeated = np.frombuffer(b"".join(column[k] for k in order.tolist()), np.uint8) > 0  # in the order of the windows
        if len(repeated) != len(c.window):
            raise ValueError("a chunk's windows changed between two passes")
        out: dict[str, list] = {name.split()[0]: [] for name in _SPANS.split(",")}
        at = 0
        for x, tokens, start in c.blocks:
            hit = start[repeated[c.code[at : at + len(start)]]]
            at += len(start)
            edges = np.bincount(hit, minlength=len(tokens.values) + 1) - np.bincount(hit + windows.width, minlength=len(tokens.values) + 1)
            removed = np.cumsum(edges[:-1]) > 0
            raw = x.data.tobytes()
            for k, (a, z) in enumerate(zip(tokens.offsets[:-1].tolist(), tokens.offsets[1:].tolist(), strict=True)):
                mask = np.ones(z - a, bool) if c.copied[x.lo + k] and z - a >= windows.width else removed[a:z]
                if not mask.any():
                    continue
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                spans = turns.reshape(-1, 2)
                begin, end = x.offsets[k : k + 2].tolist()
                if tokens.bounds is not None:
                    spans = np.stack([tokens.bounds[0][a + spans[:, 0]], tokens.bounds[1][a + spans[:, 1] - 1]], 1) - begin
                left = np.concatenate([[0], spans[:, 1]]), np.concatenate([spans[:, 0], [end - begin]])
                sha = hashlib.sha256()
                for p, q in zip(left[0].tolist(), left[1].tolist(), strict=True):
                    sha.update(raw[begin + p : begin + q])
                for name, value in zip(out, (c.keys[x.lo + k], spans.astype("<i8").tobytes(), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha.hexdigest()), strict=True):
                    out[name].append(value)
        return pa.Table.from_batches([batch(_SPANS, **out)])

    return run


def repeated_spans(docs: DataFrame, windows: Windows) -> DataFrame:
    """(text_key, spans, n_removed, n_spans, kept_sha256) of each distinct text that has repeated windows.

    text_key is that of the text; spans holds little-endian 64-bit pairs of byte offsets.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(text_key(F.col("text")).alias("text_key"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    with temporary(spark):
        anchors = materialize(rows.mapInArrow(_anchors(windows), _ANCHORS), "anchors")
        repeated = anchors.filter("anchor IS NOT NULL").groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", F.when(F.col("n") > FREQUENT, F.col("anchor")).alias("often"))
        # Of equal texts, the row with the least key stands for all.
        copies = anchors.filter("anchor IS NULL").groupBy("text_key").agg(F.count("*").alias("copies"), F.min("key").alias("key"))
        wanted = anchors.select("text_key", "anchor").join(repeated, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("often").alias("frequent"))
        wanted = wanted.join(copies, "text_key").select("text_key", "key", "anchors", "frequent", (F.col("copies") > 1).alias("copied"))
        wanted = materialize(wanted, "wanted")
        texts = materialize(wanted.join(fetch(rows, wanted.select("key")), "key").drop("key"), "texts", keep=True)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(n, -(-size // CHUNK_BYTES))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("text_key"), F.lit(chunks)).cast("long"))
    found = texts.groupBy("chunk").applyInArrow(_windows(windows), _WINDOWS)
    masks = found.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_masks, _MASKS)
    return texts.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(_spans(windows), _SPANS)


def digest(docs: DataFrame, windows: Windows = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of (doc_id, text).

    Null text is empty. Texts of fewer tokens than a window lose nothing; a repeated row, or the same text under
    two ids, loses everything if it has a window. Matches never cross rows. Very long texts are read in stretches
    that overlap by a window. An empty table gives no row; other columns are ignored. Windows are compared by
    64-bit hashes within an anchor's.
    """
    with temporary(docs.sparkSession):
        spans = materialize(repeated_spans(docs, windows).select("text_key", "n_removed", "n_spans", "kept_sha256"), "digest", keep=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(spans, "text_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, windows: Windows = WORDS) -> DataFrame:
    """The documents with the repeated spans cut out of their text, and n_chars to match if there is a column of that name and of numbers.

    Windows of words are the same whatever white space stands between their words; white space around a span
    stays. Of windows of bytes, a character that a span covers in part stays. Null and empty texts, and texts
    without a repeated window, stay as they are; of equal texts nothing is left, wherever they are long enough.
    No row goes, an empty table stays empty, and other columns, of any type and name, are kept.
    """
    names = docs.columns
    key, cuts, spans_key = unused(docs, "key", "spans", "spans_key")
    with temporary(docs.sparkSession):
        spans = materialize(repeated_spans(docs, windows).select(F.col("text_key").alias(spans_key), F.col("spans").alias(cuts)), "spans", keep=True)
    joined = docs.withColumn(key, text_key(docs["text"])).join(light(spans), F.col(key) == F.col(spans_key), "left").select(*every(docs), cuts)
    at = names.index("text")
    count = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k) for k in range(len(names))]
            spans, texts = b.column(len(names)).to_pylist(), b.column(at).to_pylist()
            changed = [k for k, s in enumerate(spans) if s]
            for k in changed:
                raw = texts[k].encode()
                mask = np.zeros(len(raw), bool)
                for a, z in np.frombuffer(spans[k], "<i8").reshape(-1, 2).tolist():
                    while a < z and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
                        z -= 1
                    mask[a:z] = True
                texts[k] = np.frombuffer(raw, np.uint8)[~mask].tobytes().decode()
            if changed:
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    n = columns[count].to_pylist()
                    for k in changed:
                        n[k] = len(texts[k])
                    columns[count] = pa.array(n, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_rows(joined, cut, docs.schema)
