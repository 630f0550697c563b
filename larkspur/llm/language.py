"""Language ID by cross-parsing: the language whose training text parses a text into the fewest phrases.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is read
greedily: a phrase goes on while it occurs in the language's sample, then a new one begins. The
number of phrases for each character estimates the cross entropy; the language with the fewest wins.

All texts of a batch take one automaton step at a time for every language. So that a long text does not
hold the others up it is read in lanes, and each lane's parse is then replaced by that of the lane before
it, read on, up to the first place where both begin a phrase; from there they are the same. The phrases
counted are those of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, held_out

#: Bounds of the fit. Characters of training text for each language, in whole documents, and documents read for them.
SAMPLE_CHARS, SAMPLE_ROWS = 24_000, 200
#: Characters of all languages together, as long as that leaves LEAST_CHARS for each, and the most languages that are learnt, those with the most rows.
ALL_CHARS, LEAST_CHARS, MOST_LANGUAGES = 240_000, 4_000, 512
#: Bytes of the table of steps; what does not fit is looked up in a sorted list.
TABLE_BYTES = 96 << 20
#: Characters of a lane.
LANE = 512
#: How sharply a difference in phrases for each character turns into the score.
SHARPNESS = 60.0

_ROWS = "doc_id long,held_out boolean,lang_pred string,score double"


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, which belongs to the letter before it, else 0."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(k))[0], 0) for k in range(0x110000)], np.uint8)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and marks of each text, with one space for whatever stands between them, as code points one text after the
    other, and where each begins. Nothing of a text without a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])
    kind = _kinds()[codes]
    word = kind > 0
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(word)]] = False
    places = np.concatenate([[-1], np.flatnonzero(word)])
    last = places[np.searchsorted(places, offsets[1:]) - 1]
    letters = np.concatenate([[0], np.cumsum(kind == 1)])
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = (word | before & (np.arange(len(word)) < last[row])) & (np.diff(letters[offsets]) > 0)[row]
    return np.where(word, codes, np.uint32(32))[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _automaton(text: str) -> list[dict[str, int]]:
    """The suffix automaton of a text: for each state, the next by character."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                new = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = new
                    p = link[p]
                link[q] = link[cur] = new
        last = cur
    return following


@dataclass
class Model:
    """The automata of all languages in one table; a language's root is where its states begin.

    A language's most frequent characters have columns in the table, the others are in a sorted list of steps.
    """

    languages: list[str]
    symbols: np.ndarray  # language by code point: 0 for those that its sample lacks, a column, or the last symbol for the others
    table: np.ndarray  # state by column to state, -1 where there is none
    roots: np.ndarray
    keys: np.ndarray  # state and code point of the steps that are not in the table
    following: np.ndarray

    @classmethod
    def of(cls, samples: dict[str, str]) -> Model:
        automata = [_automaton(v) for v in samples.values()]
        states = sum(map(len, automata))
        width = max(8, min(64, TABLE_BYTES // 4 // max(1, states)))
        symbols = np.zeros((len(samples), max((ord(c) for v in samples.values() for c in v), default=0) + 2), np.uint8)
        table = np.full((max(1, states), width), -1, np.int32)
        roots, steps, at = [], [], 0
        for j, (text, automaton) in enumerate(zip(samples.values(), automata, strict=True)):
            counts = Counter(text)
            order = sorted(counts, key=lambda c: (-counts[c], c))  # noqa: B023
            for k, c in enumerate(order):
                symbols[j, ord(c)] = min(k + 1, width - 1)
            column = {c: k + 1 for k, c in enumerate(order[: width - 2])}
            for k, x in enumerate(automaton):
                for c, to in x.items():
                    if c in column:
                        table[at + k, column[c]] = at + to
                    else:
                        steps.append(((at + k) << 21 | ord(c), at + to))
            roots.append(at)
            at += len(automaton)
        steps = np.array(sorted(steps), np.int64).reshape(-1, 2)
        return cls(list(samples), symbols, table, np.array(roots, np.int32), steps[:, 0], steps[:, 1].astype(np.int32))

    def _next(self, state: np.ndarray, symbol: np.ndarray, code: np.ndarray, rare: bool = True) -> np.ndarray:
        """-1 where there is no step."""
        width = self.table.shape[1]
        out = self.table.reshape(-1)[state * np.int64(width) + symbol]
        if rare and len(self.keys) and (others := symbol == width - 1).any():
            key = state[others].astype(np.int64) << 21 | code[others]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[others] = np.where(self.keys[at] == key, self.following[at], -1)
        return out

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text by language."""
        known = codes < self.symbols.shape[1]
        symbols = np.where(known, self.symbols[:, np.where(known, codes, 0)], 0)
        rare = bool((symbols == self.table.shape[1] - 1).any())
        codes = np.broadcast_to(codes.astype(np.int64), symbols.shape)
        roots = np.broadcast_to(self.roots[:, None], symbols.shape)
        # Where the automaton is after a character that begins a phrase. One that the language lacks is a phrase by itself.
        fresh = self._next(roots, symbols, codes, rare)
        fresh = np.where(fresh < 0, roots, fresh)
        n = np.diff(offsets)
        lanes = -(-n // LANE)
        row = np.repeat(np.arange(len(n)), lanes)
        within = (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        start = offsets[:-1][row] + within
        size = np.minimum(n[row] - within, LANE)
        begins = np.zeros(symbols.shape, bool)
        final = np.repeat(self.roots[:, None], len(row), 1)
        order = np.argsort(-size, kind="stable")
        state, steps = final[:, order], int(size.max()) if len(size) else 0
        place = start[order] + np.arange(steps)[:, None]  # step by lane
        inside = np.arange(steps)[:, None] < size[order]
        place[~inside] = 0
        live = inside.sum(1).tolist()
        ways = [np.ascontiguousarray(x[:, place].swapaxes(0, 1)) for x in (symbols, fresh)]  # step by language by lane
        begun = np.zeros(ways[0].shape, bool)
        for k in range(steps):
            m = live[k]
            now = state[:, :m]
            after = self._next(now, ways[0][k, :, :m], codes[:, place[k, :m]] if rare else codes, rare)
            ended = after < 0
            begun[k, :, :m] = ended | (now == self.roots[:, None])  # no step leads back to a root
            state[:, :m] = np.where(ended, ways[1][k, :, :m], after)
        final[:, order] = state
        begins[:, place[inside]] = begun.swapaxes(0, 1)[:, inside]
        # Each lane but a text's last is read on from its end, until its parse meets that of the next lane.
        lane = np.flatnonzero((row[:-1] == row[1:]) if len(row) else row)
        language, lane = np.repeat(np.arange(len(self.roots)), len(lane)), np.tile(lane, len(self.roots))
        state, lane = final[language, lane], lane + 1
        at = start[lane]
        while len(lane):
            after = self._next(state, symbols[language, at], codes[language, at], rare)
            begin = (after < 0) | (state == self.roots[language])
            state = np.where(after < 0, fresh[language, at], after)
            met = begin & begins[language, at]
            begins[language, at] = begin
            at = at + 1
            go = ~met & (at < offsets[row[lane] + 1])  # the lane after the next one goes on the same way
            language, lane, state, at = language[go], lane[go], state[go], at[go]
        out = np.zeros((len(n), len(self.languages)), np.int64)
        for j in range(len(self.languages)):
            sums = np.concatenate([[0], np.cumsum(begins[j])])
            out[:, j] = sums[offsets[1:]] - sums[offsets[:-1]]
        return out


def fit(docs: DataFrame) -> Model:
    """Learns from rows with a language that are not held out: a bounded sample of whole texts of each language, by a hash of the id.

    Of a language whose texts are all longer than its sample may be, the shortest is learnt. A language without a
    letter in its sample is not learnt.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("l"))
    rows = rows.filter(~held_out(F.col("doc_id"))).filter("l IS NOT NULL AND t IS NOT NULL").select("l", "t", F.char_length("t").alias("n"), F.xxhash64("doc_id", "t").alias("h"))
    # The row with the least hash of each of SAMPLE_ROWS parts of a language; partial aggregation keeps as many a task, so a hot language needs no large group.
    part = F.when(F.col("n") <= SAMPLE_CHARS, F.pmod("h", F.lit(SAMPLE_ROWS)))
    found = rows.groupBy("l", part.alias("k")).agg(F.count("*").alias("rows"), F.min(F.when(F.col("n") <= SAMPLE_CHARS, F.struct("h", "t"))).alias("x"))
    counted = found.groupBy("l").agg(F.sum("rows").alias("rows"), F.count("x").alias("texts")).orderBy(F.desc("rows"), "l").limit(MOST_LANGUAGES).collect()
    names = [r.l for r in counted]
    held: dict[str, list[tuple[int, str]]] = {name: [] for name in names}
    for r in found.filter(F.col("l").isin(names)).filter("x IS NOT NULL").select("l", "x.h", "x.t").collect() if names else []:  # SAMPLE_ROWS a language
        held[r.l].append((r.h, r.t))
    if missing := [r.l for r in counted if not r.texts]:
        for r in rows.filter(F.col("l").isin(missing)).groupBy("l").agg(F.min(F.struct("n", "t")).alias("x")).select("l", "x.t").collect():
            held[r.l].append((0, r.t))
    most = max(LEAST_CHARS, min(SAMPLE_CHARS, ALL_CHARS // max(1, len(names))))
    samples: dict[str, str] = {}
    for name in names:  # in the order of their rows
        texts = [t for _, t in sorted(held[name])]
        codes, offsets = normalise(texts)
        whole = [codes[a:z].tobytes().decode("utf-32-le", "surrogatepass") for a, z in zip(offsets[:-1], offsets[1:], strict=True) if z > a]
        taken, room = [], most
        for t in whole:
            if len(t) < room:
                taken.append(t)
                room -= len(t) + 1
        if sample := " ".join(taken or sorted(whole, key=lambda t: (len(t), t))[:1]):
            samples[name] = sample
    return Model.of(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; the score is the winner's share of exp(-SHARPNESS * phrases / characters).

    Null texts and texts without a letter are `und` with score 0. Ties go to the language with the most rows, then the
    first by name. Texts are read whole, however long. Repeated rows repeat, a null doc_id stays null and is not held out,
    other columns are ignored, an empty table gives no row, and without any learnt language all texts are `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi in _cuts(b.column(1), max(1 << 15, (8 << 20) // max(8, len(m.languages)))):
                codes, offsets = normalise([t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()])
                n = np.diff(offsets)
                names, scores = ["und"] * len(n), np.zeros(len(n))
                if m.languages and len(codes):
                    rate = m.phrases(codes, offsets) / np.maximum(n, 1)[:, None]
                    share = np.exp(-SHARPNESS * (rate - rate.min(1, keepdims=True)))
                    names = [m.languages[k] if length else "und" for k, length in zip(rate.argmin(1).tolist(), n.tolist(), strict=True)]
                    scores = np.where(n > 0, 1 / share.sum(1), 0.0)
                ids = b.column(0).slice(lo, hi - lo)
                yield batch(_ROWS, doc_id=ids, held_out=b.column(2).slice(lo, hi - lo), lang_pred=names, score=scores)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, _ROWS)


def _cuts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text."""
    lo, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > limit:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(column):
        yield lo, len(column)
