"""Packing token ids into fixed-size sequences by the sum-of-squares rule.

Each task packs the documents of its partition one after the other. Whole sequences are cut off a long
document at once; what is left goes to the fill level that keeps the sum of squared counts of partly
filled sequences least, which the level array gives for all levels in one step. When the documents
end, the partly filled sequences are closed: the emptiest are cut up to fill the fullest, so that at
most one is left over, and that one is divided into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch
from larkspur.llm.tokens import encoder
from larkspur.llm.vectors import blocks

SIZE = 2048

_PIECES = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long,ids binary"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Packer:
    """Online packing of one stream of documents; `done` collects closed sequences of pieces."""

    size: int = SIZE
    done: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        self.counts = np.zeros(self.size + 1, np.int64)  # partly filled sequences by level
        self.levels: list[list[list[Piece]]] = [[] for _ in range(self.size)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.size:
            self.done.append([Piece(doc_id, at, ids[at : at + self.size], n)])
            at += self.size
        if at < n:  # a copy, so that what waits for company does not keep a long document's ids
            self._place(Piece(doc_id, at, ids[at:].copy(), n))

    def _place(self, piece: Piece) -> None:
        n = len(piece.ids)
        level = choose(self.counts, n, self.size)
        sequence = self.levels[level].pop() if level else []
        self.counts[level] -= level > 0
        sequence.append(piece)
        if level + n == self.size:
            self.done.append(sequence)
        else:
            self.levels[level + n].append(sequence)
            self.counts[level + n] += 1

    def close(self) -> None:
        """Closes the partly filled sequences: pieces of the emptiest fill the gaps of the fullest."""
        left = [x for some in self.levels for x in some]  # from the emptiest to the fullest
        self.counts[:], self.levels = 0, [[] for _ in range(self.size)]
        loose: list[Piece] = []  # pieces of sequences that are cut up
        lo, hi = 0, len(left)
        while lo < hi or loose:
            if lo < hi:
                hi -= 1
                sequence = left[hi]
            else:
                sequence = []
            room = self.size - sum(len(p.ids) for p in sequence)
            while room and (loose or lo < hi):
                if not loose:
                    loose = left[lo]
                    lo += 1
                piece = loose.pop()
                if len(piece.ids) > room:
                    loose.append(Piece(piece.doc_id, piece.start + room, piece.ids[room:], piece.doc_tokens))
                    piece = Piece(piece.doc_id, piece.start, piece.ids[:room], piece.doc_tokens)
                sequence.append(piece)
                room -= len(piece.ids)
            self.done += [sequence] if not room else powers(sequence)


def choose(counts: np.ndarray, n: int, size: int) -> int:
    """The level to put n ids on: 0 opens a sequence, a used level h takes one of its sequences to h + n.

    Taking one from level h changes the sum of squares by 1 - 2 N(h), adding one to level h + n by
    2 N(h + n) + 1; full sequences don't count. Of equal changes the fullest level wins.
    """
    change = np.zeros(size - n + 1, np.int64)
    change[:-1] = 2 * counts[n:size] + 1
    change[1:] += 1 - 2 * counts[1 : size - n + 1]
    change[1:][counts[1 : size - n + 1] == 0] = np.iinfo(np.int64).max
    return int(size - n - np.argmin(change[::-1]))


def powers(sequence: list[Piece]) -> list[list[Piece]]:
    """The same ids in sequences of powers of two, from the largest; these need no padding."""
    out, total = [], sum(len(p.ids) for p in sequence)
    rest = list(reversed(sequence))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if not room:
            continue
        out.append([])
        while room:
            piece = rest.pop()
            if len(piece.ids) > room:
                rest.append(Piece(piece.doc_id, piece.start + room, piece.ids[room:], piece.doc_tokens))
                piece = Piece(piece.doc_id, piece.start, piece.ids[:room], piece.doc_tokens)
            out[-1].append(piece)
            room -= len(piece.ids)
    return out


def _packed(path: str, end_id: int, with_ids: bool, added: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Partition numbers keep sequences of different tasks apart; a task that is run again gives the same rows.
        code, packer, number = encoder(path, added), Packer(), TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)

        def out() -> pa.RecordBatch:
            nonlocal number
            rows: dict[str, list] = {name.split()[0]: [] for name in _PIECES.split(",")}
            for sequence in packer.done:
                at = 0
                for p in sequence:
                    raw = p.ids.astype("<u4").tobytes()
                    for name, x in zip(rows, (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, number, at, raw if with_ids else None), strict=True):
                        rows[name].append(x)
                    at += len(p.ids)
                number += 1
            packer.done = []
            return batch(_PIECES, **rows)

        for b in batches:
            names = b.column(0).to_pylist()
            for x in blocks(b.column(1)):
                got, at = code.rows(x.data, x.offsets)
                for k in range(x.hi - x.lo):
                    packer.add(names[x.lo + k], np.concatenate([got[at[k] : at[k + 1]], end]))
                yield out()
        packer.close()
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = True, added: bool = False) -> DataFrame:
    """Pieces of (doc_id, text) rows in sequences of SIZE ids, without a shuffle.

    Each task packs its partition by itself, in the order of its rows; it holds its partly filled sequences, so
    less than the ids of a partition. Null text is empty and has the end id only; every row is packed, repeated
    ones too; an empty table gives no piece; other columns are ignored. A null doc_id stays null. A very long
    text is tokenized in pieces, and its whole sequences are closed at once. Of equally good levels the fullest
    wins. ids holds the piece's ids as
    little-endian 32-bit values if with_ids is set. With `added`, a literal of one of the tokenizer's
    added tokens is that token's id, else it is text like any other.
    """
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packed(tokenizer, end_id, with_ids, added), _PIECES)
    return out if with_ids else out.drop("ids")
