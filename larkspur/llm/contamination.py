"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of digits, lower-case letters and characters beyond ASCII, after A-Z are lowered. The
automaton's alphabet is the items' words. A document's words stream through it; the state tracks the
longest match that ends at each word, so every window (WINDOW consecutive words of an item, or a
shorter item as a whole) that occurs is seen where it ends. Words, and pairs of neighbours, that no
item has cannot be in a match; they are ruled out for whole blocks of rows at once, and only the
remaining runs are streamed.

Items that fill more than one automaton of GROUP_BYTES are held against the corpus in one pass all the
same: a table of all their pairs of neighbours, of bounded size, leaves the runs of words that can match,
and the automata, one after the other, read only these.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import batch, every, map_rows, materialize, may_hold, membership, row_key, temporary, unused
from larkspur.llm.vectors import ALNUM, Block, Words, blocks, mix, word_hashes

WINDOW = 13
#: Bytes of item text that travel with the tasks as one automaton.
GROUP_BYTES = 2 << 20
#: A document is contaminated if it has hits and they are at least this share of its words (as 1 / SHARE).
SHARE = 20

_ROWS = "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean"


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that each state's windows belong to."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, list[object]] = {}  # state of a whole item shorter than the window
        paths = []
        for name, seq in items:
            last, path = 0, []
            for c in seq:
                last = self._extend(last, c)
                path.append(last)
            paths.append((name, seq, last))
        full: dict[int, set] = {}  # items that have the words of a state, for states of whole windows
        for name, seq, last in paths:
            if 0 < len(seq) < window:
                self.short.setdefault(self._locate(seq), []).append(name)
            state, length = 0, 0
            for c in seq:
                state, length = self.step(state, length, c)
                if length >= window:
                    full.setdefault(self._window(state), set()).add(name)
        self.items = {state: list(names) for state, names in full.items()}
        self.shortest = min([len(seq) for _, seq in items if seq], default=window)
        self.shortest = min(self.shortest, window)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _locate(self, seq: list[int]) -> int:
        state = 0
        for c in seq:
            state = self.next[state][c]
        return state

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The longest suffix of what was read, c included, that occurs in an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def _window(self, state: int) -> int:
        """The state of the last `window` words of a match that is as long at least."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, list[object]]]:
        """(end, words, items) for each window that occurs in seq; end is the index after its last word."""
        state, length = 0, 0
        for k, c in enumerate(seq):
            state, length = self.step(state, length, c)
            if length >= self.window:
                yield k + 1, self.window, self.items.get(self._window(state), [])
            if self.short and length:
                at = state
                while at > 0:
                    if at in self.short and self.length[at] <= length:
                        yield k + 1, self.length[at], self.short[at]
                    at = self.link[at]


class Matcher:
    """An automaton with the word and neighbour filters in front of it."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        w, hashes = word_hashes(data, np.cumsum([0] + [len(t) for _, t in items]), ALNUM)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        seqs = [numbers[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.automaton = Automaton([(name, seq) for (name, _), seq in zip(items, seqs, strict=True)], window)
        pairs = {(a, b) for seq in seqs for a, b in zip(seq, seq[1:], strict=False)}
        self.pairs = np.unique(np.array([a * len(self.vocabulary) + b for a, b in pairs], np.int64))

    def hits(self, w: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[object]]]:
        """(first word, end word, items) of each window that occurs in a block's rows."""
        if not len(hashes) or not len(self.vocabulary):
            return
        number = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == hashes
        joined = np.zeros(len(hashes), bool)  # with the word before it
        joined[1:] = known[1:] & known[:-1]
        joined[w.first[:-1][w.first[:-1] < len(hashes)]] = False
        at = np.flatnonzero(joined)
        if len(self.pairs):
            key = number[at - 1] * len(self.vocabulary) + number[at]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[at[self.pairs[place] != key]] = False
        else:
            joined[:] = False
        begins = np.flatnonzero(known & ~joined)
        breaks = np.flatnonzero(~joined)
        ends = np.append(breaks, len(hashes))[np.searchsorted(breaks, begins) + 1]
        long = ends - begins >= self.automaton.shortest
        for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            for end, n, names in self.automaton.stream(number[a:b].tolist()):
                yield a + end - n, a + end, names


def hits_by_row(matcher: Matcher, block: Block) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For each row: how many words, the hit words as disjoint (first, end) runs, and the items whose windows occur."""
    w, hashes = word_hashes(block.data, block.offsets, ALNUM)
    out: list[tuple[int, list, set]] = [(n, [], set()) for n in np.diff(w.first).tolist()]
    found = sorted(((a, b, names) for a, b, names in matcher.hits(w, hashes)), key=lambda x: x[:2])
    rows = np.searchsorted(w.first, [a for a, _, _ in found], "right") - 1
    for row, (a, b, names) in zip(rows.tolist(), found, strict=True):
        _, runs, items = out[row]
        a, b = a - int(w.first[row]), b - int(w.first[row])
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
        items.update(names)
    return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_groups(benchmark: DataFrame, limit: int, window: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """(item_id as text or None, text) in groups of bounded bytes; the driver holds one group at a time.

    An item beyond the bound is divided into pieces that overlap by all but one word of a window.
    """
    group, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("t IS NOT NULL")
    for r in rows.toLocalIterator():
        text = r.t.encode()
        for piece in [text] if len(text) <= limit else _pieces(text, limit, window):
            if group and size + len(piece) > limit:
                yield group
                group, size = [], 0
            group.append((r.i, piece))
            size += len(piece)
    if group:
        yield group


def _pieces(text: bytes, limit: int, window: int) -> Iterator[bytes]:
    w, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)
    lo, n = 0, len(w.starts)
    while lo < n:
        hi = max(min(int(np.searchsorted(w.ends, w.starts[lo] + limit, "right")), n), min(lo + window, n))
        yield text[w.starts[lo] : w.ends[hi - 1]]
        if hi == n:
            return
        lo = hi - window + 1


_matchers: OrderedDict[str, Matcher] = OrderedDict()


def _matcher(name: str, group: Broadcast, window: int) -> Matcher:
    """The process's matcher of a group of items; tasks share it, and the two latest are kept."""
    if name not in _matchers:
        _matchers[name] = Matcher(group.value, window)
        while len(_matchers) > 2:
            _matchers.popitem(last=False)
    return _matchers[name]


def _found(columns: list[pa.Array], count: list[int], runs: list[list[tuple[int, int]]], items: list[set]) -> pa.RecordBatch:
    """A batch with what was found in each row in three further columns: words, hit runs, item ids."""
    columns = [*columns, pa.array(count, pa.int64()), pa.array([np.array(r, "<i8").tobytes() for r in runs], pa.binary()), pa.array([sorted(i, key=lambda x: (x is None, x or "")) for i in items], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What `finish` makes of each batch of documents and what was found in them."""
    spark = docs.sparkSession
    groups = item_groups(benchmark, GROUP_BYTES, window)
    first, second = next(groups, []), next(groups, None)
    width, at = len(docs.columns), docs.columns.index("text")
    if second is None:
        shared, name = spark.sparkContext.broadcast(first), uuid.uuid4().hex  # GROUP_BYTES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [x for block in blocks(b.column(at)) for x in hits_by_row(_matcher(name, shared, window), block)]
                count, runs, items = zip(*found, strict=True) if found else ((), (), ())
                yield finish(_found(b.columns, count, runs, items))

        return map_rows(docs, run, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = [n for x in blocks(b.column(at)) for n in np.diff(word_hashes(x.data, x.offsets, ALNUM)[0].first).tolist()]
            parts = [b.column(width + k).to_pylist() for k in (0, 1)]
            runs = [merged([tuple(p) for raw in some or () for p in np.frombuffer(raw, "<i8").reshape(-1, 2).tolist()]) for some in parts[0]]
            items = [{i for more in some or () for i in more} for some in parts[1]]
            yield finish(_found(b.columns[:width], count, runs, items))

    hits = _hits_of_many(docs, benchmark, window)
    key, *other = unused(docs, "key", "runs", "items")
    hits = hits.select(F.col("key").alias(key), F.col("runs").alias(other[0]), F.col("items").alias(other[1]))
    joined = docs.withColumn(key, row_key(F.lit(None).cast("long"), docs["text"])).join(hits, key, "left").select(*every(docs), *other)
    return map_rows(joined, merge, schema)


def _hits_of_many(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(key of the text, lists of hit runs and of item ids) for each text with hits, for any number of groups of items."""
    spark = docs.sparkSession

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of neighbouring words, single words of items that have no other, and how long the shortest item is."""
        for b in batches:
            for x in blocks(b.column(0)):
                w, h = word_hashes(x.data, x.offsets, ALNUM)
                n = np.diff(w.first)
                pair = np.ones(len(h), bool)
                pair[w.first[:-1][n > 0]] = False
                at = np.flatnonzero(pair)
                one = w.first[:-1][n == 1]
                keys = np.concatenate([_pair_keys(h[at - 1], h[at]), _pair_keys(h[one], h[one])])
                yield batch("key binary,least long", key=[k.tobytes() for k in keys], least=np.full(len(keys), int(n[n > 0].min()) if (n > 0).any() else window))

    pairs = benchmark.select(F.col("text").cast("string")).mapInArrow(neighbours, "key binary,least long")
    shortest = min(window, pairs.agg(F.min("least")).first()[0] or window)
    table = spark.sparkContext.broadcast(membership(pairs.select("key").distinct()))  # 8 MB at most

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of words whose neighbours may all be neighbours in an item, of each distinct text of a task."""
        seen: set[bytes] = set()
        for b in batches:
            keys = b.column(0).to_pylist()
            for x in blocks(b.column(1)):
                w, h = word_hashes(x.data, x.offsets, ALNUM)
                if not len(h):
                    continue
                joined = np.zeros(len(h), bool)
                joined[1:] = may_hold(table.value, _pair_keys(h[:-1], h[1:]))
                joined[w.first[:-1][w.first[:-1] < len(h)]] = False
                alone = may_hold(table.value, _pair_keys(h, h)) if shortest == 1 else np.zeros(len(h), bool)
                begins = np.flatnonzero(~joined)
                ends = np.append(begins[1:], len(h))
                use = (ends - begins >= max(2, shortest)) | (shortest == 1) & alone[begins]
                out: list[tuple] = []
                rows = np.searchsorted(w.first, begins[use], "right") - 1
                new = {k for k in np.unique(rows).tolist() if keys[x.lo + k] not in seen}
                for row, a, z in zip(rows.tolist(), begins[use].tolist(), ends[use].tolist(), strict=True):
                    if row in new:
                        out.append((keys[x.lo + row], a - int(w.first[row]), h[a:z].tobytes()))
                seen.update(keys[x.lo + k] for k in new)
                key, first, run = zip(*out, strict=True) if out else ((), (), ())
                yield batch("key binary,first long,words binary", key=key, first=first, words=run)

    rows = docs.select(row_key(F.lit(None).cast("long"), F.col("text")).alias("key"), F.col("text").cast("string"))
    with temporary(spark):
        runs = materialize(rows.mapInArrow(suspects, "key binary,first long,words binary"), "runs")
        found = None
        for group in item_groups(benchmark, GROUP_BYTES, window):
            part = materialize(runs.mapInArrow(_streamed(spark.sparkContext.broadcast(group), window), _PART), "hits")
            found = part if found is None else found.unionByName(part)
        return materialize(found.groupBy("key").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items")), "found", keep=True)


_PART = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("runs", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = mix(a * np.uint64(3) + b)
    return np.stack([x, mix(x ^ np.uint64(0x5851F42D4C957F2D))], 1)


def _streamed(group: Broadcast, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matcher, out = _matcher(name, group, window), []
            for key, first, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                h = np.frombuffer(raw, np.uint64)
                found = list(matcher.hits(Words(np.zeros(0, int), np.zeros(0, int), np.array([0, len(h)])), h))
                if found:
                    out.append((key, np.array(merged([(a + first, z + first) for a, z, _ in found]), "<i8").tobytes(), list({i for _, _, items in found for i in items})))
            key, runs, items = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["key", "runs", "items"])

    return run


def _digest(share: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        n, items = b.column(2).to_pylist(), b.column(4).to_pylist()
        hit = [sum(z - a for a, z in _pairs(r)) for r in b.column(3).to_pylist()]
        return batch(
            _ROWS, doc_id=b.column(0), n_words=n, n_hit=hit, n_items=[len(x) for x in items],
            items_sha256=[hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in items], contaminated=[h > 0 and share * h >= k for h, k in zip(hit, n, strict=True)],
        )

    return finish


def _pairs(raw: bytes) -> list[list[int]]:
    return np.frombuffer(raw, "<i8").reshape(-1, 2).tolist()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document with what the benchmark's items share with it.

    Null and empty texts have no words; items without words have no windows; items that share an id count
    once. Items without an id hit like any other; in n_items they count as one together, in items_sha256 they
    are left out. A share of exactly 1 / share is contaminated. Very long texts and items are read in pieces. A
    repeated document row gives a repeated result row, an empty benchmark hits nothing, an empty table gives no
    row, and other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _with_hits(rows, benchmark, window, _digest(share), T.StructType.fromDDL(_ROWS))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with hit spans of `window` words at least cut out of the others.

    The length limit takes spans: a passage of an item goes, with n_chars to match if there is a column of that name
    and of whole numbers. Hits of items shorter than a window, and the spaces around a span, stay. The coverage
    limit takes documents: one whose hit words, of short items too, are 1 / share of all words or more goes as a
    whole. Null and empty texts stay; repeated rows stay or go together; an empty benchmark changes nothing; an empty
    table stays empty; all other columns, of any type and name, are kept.
    """
    names, at, width = docs.columns, docs.columns.index("text"), len(docs.columns)
    count = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        runs = [_pairs(r) for r in b.column(width + 1).to_pylist()]
        hit = [sum(z - a for a, z in r) for r in runs]
        keep = [not (h and share * h >= n) for h, n in zip(hit, b.column(width).to_pylist(), strict=True)]
        kept = b.filter(pa.array(keep, pa.bool_()))
        columns = [kept.column(k) for k in range(width)]
        runs = [[x for x in r if x[1] - x[0] >= window] for r, stays in zip(runs, keep, strict=True) if stays]
        if any(runs):
            texts, n = columns[at].to_pylist(), columns[count].to_pylist() if count is not None else None
            for k, spans in enumerate(runs):
                if spans:
                    raw = texts[k].encode()
                    w, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                    edges = [0, *(int(e) for a, z in spans for e in (w.starts[a], w.ends[z - 1])), len(raw)]
                    texts[k] = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)).decode()
                    if n:
                        n[k] = len(texts[k])
            columns[at] = pa.array(texts, columns[at].type)
            if n:
                columns[count] = pa.array(n, columns[count].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _with_hits(docs, benchmark, window, finish, docs.schema)
