"""Token ids of whole texts through the tokenizers library, once per distinct piece of text.

A text is cut before every ASCII white-space byte that follows a byte which cannot end a white-space
character, and between a letter and ASCII punctuation. At such a place both tokenizers' patterns end a
pre-token whatever stands around it, and normalisation does not reach across, so the ids of a text are
the ids of its pieces in a row. Pieces repeat, hence each process encodes a piece when it first meets
it and looks it up from then on.

The tokenizer's file has added tokens, such as <|endoftext|>. With `added`, a text is divided at their
literals first, each of which is one id, as the library does by default; without, they are ordinary text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from larkspur.llm.vectors import Ranges, ragged

#: Bytes that are read at once.
LONG = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_CONTINUATION = np.zeros(256, bool)
_CONTINUATION[0x80:0xC0] = True
_LEAD = np.zeros(256, bool)  # of two bytes that are not white space
_LEAD[0xC3:0xE0] = True
_LATIN = np.zeros(256, bool)  # of two bytes that are a letter, but for the signs of U+00D7 and U+00F7
_LATIN[0xC3:0xCA] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCTUATION = _VISIBLE & ~_LETTER
_PUNCTUATION[0x30:0x3A] = False


class Index:
    """Numbers by 64-bit key, looked up and added many at a time: a table with open addressing."""

    def __init__(self, most: int):
        self.most, self.count = most, 0
        slots = 1 << (3 * most // 2).bit_length()
        self.keys, self.values, self.mask = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), np.uint64(slots - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that it does not have."""
        out = np.full(len(keys), -1, np.int32)
        rest, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(rest):
            have, same = self.values[slot], self.keys[slot] == keys[rest]
            found = same & (have >= 0)
            out[rest[found]] = have[found]
            go = ~same & (have >= 0)
            rest, slot = rest[go], (slot[go] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are distinct and that it does not have."""
        self.count += len(keys)
        rest, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(rest):
            free = self.values[slot] < 0
            self.values[slot[free]] = values[rest[free]]  # of several for one slot the last stays
            self.keys[slot[free]] = keys[rest[free]]
            go = (self.values[slot] != values[rest]) | (self.keys[slot] != keys[rest])
            rest, slot = rest[go], (slot[go] + 1) & int(self.mask)


class Encoder:
    """ids of rows, with a bounded cache of pieces."""

    def __init__(self, path: str, most: int = 1_200_000, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces hold no literal of an added token, or are to be read as text
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if odd := [t.content for t in tokens.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]:
            raise ValueError(f"{path}: added tokens that are not plain literals: {odd}")
        self.literals = {t.content.encode(): k for k, t in tokens.items()}  # the longest of several at a place counts
        self.numbers = {x: k for k, x in enumerate(self.literals)}
        self.literal = re.compile(b"|".join(re.escape(x) for x in sorted(self.literals, key=len, reverse=True))) if tokens else None
        self.most = most
        self.byte_lengths = _byte_lengths(self.tokenizer) if self.tokenizer.normalizer is None else None
        self.mark = None if self.byte_lengths is not None else self._mark()
        self._clear()

    def _mark(self) -> tuple[int, int] | None:
        """A control character that is one id, to tell pieces apart that are encoded in a row."""
        ids = self.tokenizer.encode("a \x01 a", add_special_tokens=False).ids
        return (1, ids[1]) if len(ids) == 3 and ids[0] == ids[2] else None

    def _clear(self) -> None:
        self.index = Index(self.most)
        self.ids = np.array(list(self.literals.values()), np.uint32)  # the added tokens come first, outside the index
        self.starts, self.lengths = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)

    def _single(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _joined(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of pieces one after the other, how many each has in that order, and the place of each piece in it."""
        if self.byte_lengths is not None:  # white space in front and a visible end keep neighbours apart
            together = _SPACE[data[starts]] & _VISIBLE[data[ends - 1]]
        else:
            together = np.full(len(starts), self.mark is not None)
            if self.mark and (data == self.mark[0]).any():
                marks = np.concatenate([[0], np.cumsum(data == self.mark[0])])
                together = marks[ends] == marks[starts]
        order = np.concatenate([np.flatnonzero(together), np.flatnonzero(~together)])
        count = int(together.sum())
        ids, lengths, raw = [], [], data.tobytes()
        for at in range(0, count, 512):
            some = order[at : min(at + 512, count)]
            pieces = [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            if self.byte_lengths is not None:
                got = self._joined(b"".join(pieces).decode())
                last = np.searchsorted(np.cumsum(self.byte_lengths[got]), np.cumsum(ends[some] - starts[some])) + 1
                lengths.append(np.diff(last, prepend=0))
            else:
                got = self._joined(b" \x01 ".join(pieces).decode())
                marks = np.flatnonzero(got == self.mark[1])
                lengths.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
                got = np.delete(got, marks)
            ids.append(got)
        if count < len(order):
            got, n = self._single([raw[a:b].decode() for a, b in zip(starts[order[count:]].tolist(), ends[order[count:]].tolist(), strict=True)])
            ids.append(got)
            lengths.append(n)
        lengths = np.concatenate(lengths)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return np.concatenate(ids), lengths, place

    def _found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Begin, end and number of each literal of an added token; none crosses rows."""
        if self.literal is None or not self.literal.search(raw := data.tobytes()):
            return []
        bounds = offsets.tolist()
        return [(m.start(), m.end(), self.numbers[m[0]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self.literal.finditer(raw, a, b)]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in a row, and where each row's begin (one more at the end).

        Beyond LONG bytes, as of a very long row, pieces are read one after the other; they end where a visible ASCII
        character is followed by white space, which is a cut as good as any.
        """
        if len(data) <= LONG or any(c in literal for literal in self.literals for c in b" \t\n\v\f\r"):
            return self._rows(data, offsets)
        ids, starts, have, lo = [], [], 0, 0
        while lo < len(data):
            hi = lo + LONG
            while hi < len(data):
                cuts = np.flatnonzero(_VISIBLE[data[hi - LONG : hi - 1]] & _SPACE[data[hi - LONG + 1 : hi]])
                if len(cuts):
                    hi = hi - LONG + 1 + int(cuts[-1])
                    break
                hi += LONG - 1
            hi = min(hi, len(data))
            inside = offsets[(offsets > lo) & (offsets < hi)] - lo
            got, at = self._rows(data[lo:hi], np.concatenate([[0], inside, [hi - lo]]))
            first = np.searchsorted(offsets, lo), np.searchsorted(offsets, hi)
            starts.append(have + at[np.searchsorted(np.concatenate([[0], inside, [hi - lo]]), offsets[first[0] : first[1]] - lo)])
            ids.append(got)
            have, lo = have + len(got), hi
        starts.append(np.full(len(offsets) - sum(map(len, starts)), have))
        return np.concatenate(ids), np.concatenate(starts)

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pairs = np.zeros(len(data), bool)  # the byte is the second of a two-byte character
        pairs[1:] = _CONTINUATION[data[1:]]
        letter, ends_char = _LETTER[data], _VISIBLE[data]
        ends_char[1:] |= pairs[1:] & _LEAD[data[:-1]]
        letter[1:] |= pairs[1:] & _LATIN[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (ends_char[:-1] & _SPACE[data[1:]]) | (letter[:-1] & _PUNCTUATION[data[1:]])
        cut[offsets] = True
        found = np.array(self._found(data, offsets), np.int64).reshape(-1, 3)
        cut[ragged(found[:, 0], found[:, 1] - found[:, 0])] = False
        cut[found[:, :2]] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        text = np.ones(len(starts), bool)
        text[literals := np.searchsorted(starts, found[:, 0])] = False
        places = np.empty(len(starts), np.int64)
        places[literals] = found[:, 2]
        places[text] = self._places(data, starts[text], ends[text])
        lengths = self.lengths[places]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged(self.starts[places], lengths)], before[np.searchsorted(starts, offsets)]

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each piece's ids are kept."""
        codes, distinct = pd.factorize(Ranges(data).hash(starts, ends))
        if self.index.count + len(distinct) > max(self.most, len(distinct)):
            self._clear()
        if len(distinct) > self.index.most:  # a block with more pieces than are kept
            self.index = Index(len(distinct))
        place = self.index.get(distinct).astype(np.int64)
        if len(new := np.flatnonzero(place < 0)):
            example = np.empty(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            ids, lengths, order = self._encode(data, starts[example[new]], ends[example[new]])
            place[new] = order + len(self.starts)
            self.index.add(distinct[new], place[new].astype(np.int32))
            self.starts = np.concatenate([self.starts, np.cumsum(lengths) - lengths + len(self.ids)])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        return place[codes]


def _byte_lengths(tokenizer: Tokenizer) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for: its characters are one a byte."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for text, k in vocab.items():
        out[k] = len(text)
    return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """The process's encoder of that file."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added=added)
    return _encoders[path, added]
