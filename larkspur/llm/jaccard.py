"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its 5-word shingles, as 64-bit hashes in one order for all documents: from
the rarest to the most frequent, by counts over the whole corpus. Two sets that are similar enough share
at least l of the first n - T + l shingles, where n is a set's size and T the overlap it needs, for any
l. Each document picks the l that its estimated cost of candidates favours: a longer prefix that asks
for more shared shingles. Of two documents the smaller l counts.

Equal sets are one node throughout. Postings are sorted by shingle, and shingles in one prefix only
fall away. In a first round every node is compared with one other, the one that most of its lists begin
with, so that a large group of near copies becomes one component without any list of pairs. In a second
round all pairs of different components that share l postings, and that sizes and positions allow, are
compared. Pairs inside a component need no comparison, as they cannot change it.

Candidates are compared by sketches first, bitmaps of some four bits a shingle: bits that one set has
and the other lacks bound their overlap from above, so what falls out is surely not similar. In the second
round a small one goes with the postings, so that most pairs fall out where they meet. Only the texts of the pairs that are left are fetched, and their whole sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, every, fetch, light, materialize, partitions, row_key, temporary, unused
from larkspur.llm.components import components
from larkspur.llm.vectors import NOT_SPACE, Block, blocks, mix, ragged, whole_groups, word_hashes

SHINGLE = 5
#: Least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: The most prefix shingles that two documents are asked to share: a parameter of the search, no limit to the result.
MOST_MATCHES = 8
#: Bytes of text for each bucket of the count table, and its least and most buckets (as powers of two). Collisions only
#: change the order, not the result; the table is broadcast, a byte a bucket.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 512, 12, 24
#: Buckets that are summed as one row.
SLICE = 4096
#: Steps of the table's logarithmic scale for each power of two.
STEPS = 8
#: Bits of a sketch for each shingle, rounded up to a power of two; the least bits.
SKETCH_BITS, LEAST_SKETCH = 4, 64
#: Bits of the small bitmap that goes with a set's postings in the second round.
FINGER = 1024
#: Pairs of postings that are looked at at once.
PAIRS = 1 << 16
#: Cost of verifying one shingle of a candidate, against reading one posting.
VERIFY_COST = 0.5
#: Members that are verified against one set in one go; more are dealt to several tasks.
MEMBERS = 1024
#: Postings of a shingle, as estimated, beyond which they are dealt to several lists in the first round.
LIST = 1 << 20
#: Postings of a list that meet in one piece of the second round; longer lists are divided into pairs of shares.
SHARE = 4096

_U = np.uint64
_FEATURES = "doc_id long,key binary,n long,node long,check long,sketch binary,finger binary,slice int,counts binary"
_POSTINGS = "token long,part int,node long,place long"
_SHARED = "token long,node long,place long,leader long,leader_place long"
_PAIRS = "a long,b long,need int"
_PLACE = 28


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a block's rows, by row and hash, and where each row begins."""
    w, h = word_hashes(block.data, block.offsets, NOT_SPACE)
    count = np.diff(w.first)
    row = np.repeat(np.arange(len(count)), count)
    value = h.copy()
    left = np.repeat(w.first[1:], count) - np.arange(len(h))  # words from here to the end of the row
    for k in range(1, SHINGLE):
        value[: len(h) - k] = np.where(left[: len(h) - k] > k, mix(value[: len(h) - k] * _U(3) + h[k:]), value[: len(h) - k])
    whole = np.minimum(count, SHINGLE)[row]
    use = left >= whole  # the full shingles; of a shorter row the one that begins at its first word
    row, value = row[use], mix(value[use] + whole[use].astype(np.uint64))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.searchsorted(row, np.arange(len(count) + 1))


def _sums(value: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate([[_U(0)], np.cumsum(mix(value ^ _U(seed)))])
    n = np.diff(first).astype(np.uint64)
    return np.where(n > 0, mix(sums[first[1:]] - sums[first[:-1]] + n * _U(0x9E3779B97F4A7C15)), _U(0)).astype(np.int64)


def nodes(value: np.ndarray, first: np.ndarray, crowded: frozenset[int] = frozenset()) -> np.ndarray:
    """A 64-bit name of each row's set; 0 for the empty set. Sets with crowded names, which others have too, go by their check."""
    out = _sums(value, first, 0x5851F42D4C957F2D)
    if crowded and (shared := np.isin(out, np.fromiter(crowded, np.int64))).any():
        out = np.where(shared, checks(value, first), out)
    return out


def checks(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A second name, so that two sets with one name are noticed: 128 bits in all."""
    return _sums(value, first, 0x2545F4914F6CDD1D)


def sketches(row: np.ndarray, value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A bitmap of each row's set: a power of two of bits, of which each shingle sets one."""
    bits = np.array([max(LEAST_SKETCH, 1 << int(n * SKETCH_BITS - 1).bit_length()) if n else 0 for n in np.diff(first).tolist()], np.int64)
    begins = np.cumsum(bits) - bits
    out = np.zeros(int(bits.sum()), bool)
    out[begins[row] + (mix(value) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(out, bitorder="little").tobytes()
    return [raw[a // 8 : (a + n) // 8] for a, n in zip(begins.tolist(), bits.tolist(), strict=True)]


def fingers(row: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bitmap of FINGER bits of each row's set, by row."""
    out = np.zeros((len(first) - 1, FINGER), bool)
    out[row, (mix(value) >> _U(20) & _U(FINGER - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little")


def most_overlap(n: int, m: int, s: bytes, t: bytes) -> int:
    """The most shingles that sets of sizes n and m with these sketches can share."""
    x, y, bits, other = int.from_bytes(s, "little"), int.from_bytes(t, "little"), 8 * len(s), 8 * len(t)
    while bits > other:
        bits //= 2
        x = x >> bits | x & (1 << bits) - 1
    while other > bits:
        other //= 2
        y = y >> other | y & (1 << other) - 1
    both = x & y
    return min(n - (x ^ both).bit_count(), m - (y ^ both).bit_count())


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shared shingles that a set of size n needs, whatever the other's size."""
    return -(-NUMERATOR * n // DENOMINATOR)


def pair_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared shingles that sets of sizes n and m need."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def pack(n: np.ndarray, matches: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (n << 32) | (matches << _PLACE) | position


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> _PLACE) & 15, place & ((1 << _PLACE) - 1)


def _features(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document, the sketch at the first of equal sets, and the task's shingle counts in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int32)  # of a task's own text
        seen: set[int] = set()
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x in blocks(b.column(2)):
                row, value, first = shingles(x)
                np.add.at(counts, (value % _U(buckets)).astype(np.int64), 1)
                k, names = x.hi - x.lo, nodes(value, first)
                new = [name not in seen and not seen.add(name) for name in names.tolist()]
                drawn = [s if fresh and s else None for s, fresh in zip(sketches(row, value, first), new, strict=True)]
                small = [x.tobytes() if s else None for x, s in zip(fingers(row, value, first), drawn, strict=True)]
                yield batch(_FEATURES, doc_id=ids[x.lo : x.hi], key=keys[x.lo : x.hi], n=np.diff(first), node=names, check=checks(value, first), sketch=drawn, finger=small, slice=[None] * k, counts=[None] * k)
        parts = [(k, x) for k, x in enumerate(counts.reshape(-1, SLICE)) if x.any()]
        if parts:
            none = [None] * len(parts)
            yield batch(_FEATURES, doc_id=none, key=none, n=none, node=none, check=none, sketch=none, finger=none, slice=[k for k, _ in parts], counts=[x.astype(np.min_scalar_type(int(x.max()))).tobytes() for _, x in parts])

    return run


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices, less what a bucket holds by chance, a byte a bucket."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(k, np.zeros(SLICE, np.int64))
            held[k] += np.frombuffer(raw, f"u{len(raw) // SLICE}")
    for k, total in held.items():
        over = np.maximum(total - np.int64(np.median(total)), 0)
        yield batch("slice int,counts binary", slice=[k], counts=[np.minimum(np.round(STEPS * np.log2(1 + over)), 255).astype(np.uint8).tobytes()])


def count_table(features: DataFrame, buckets: int) -> np.ndarray:
    """How frequent the corpus's shingles are by bucket, on a logarithmic scale."""
    rows = features.filter("slice IS NOT NULL").select("slice", "counts").repartition(partitions(features.sparkSession), "slice").mapInArrow(_scaled, "slice int,counts binary").collect()  # a byte a bucket
    out = np.zeros((buckets // SLICE, SLICE), np.uint8)
    for r in rows:
        out[r.slice] = np.frombuffer(r.counts, np.uint8)
    return out.reshape(-1)


def choose_matches(cost: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of estimated posting lengths in prefix order: how many matches to ask for, and the prefix length.

    The candidates of l matches are estimated as the postings of the prefix divided by l; each costs a
    share of the set's size to verify.
    """
    n = np.diff(first)
    needed = least_overlap(n)
    sums = np.concatenate([[0.0], np.cumsum(cost)])
    best, price = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for l in range(1, MOST_MATCHES + 1):
        ends = first[:-1] + np.minimum(n - needed + l, n)
        read = sums[ends] - sums[first[:-1]]
        now = read * (1 + VERIFY_COST * n / l)
        better = (now < price) & (l <= np.maximum(needed, 1))
        best, price = np.where(better, l, best), np.where(better, now, price)
    return best, np.where(n > 0, np.minimum(n - needed + best, n), 0)


def _postings(table: np.ndarray, longest: int, crowded: frozenset[int] = frozenset()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are posted once
        for b in batches:
            for x in blocks(b.column(0)):
                row, value, first = shingles(x)
                names = nodes(value, first, crowded)
                cost = np.exp2(table[(value % _U(len(table))).astype(np.int64)] / np.float32(STEPS)) - 1
                order = np.lexsort((value, cost, row))
                value, cost = value[order], cost[order]
                matches, length = choose_matches(cost, row, first)
                new = np.array([k not in seen and not seen.add(k) for k in names.tolist()], bool)
                length = np.where(new, length, 0)
                position = np.arange(len(value)) - first[row]
                use = position < length[row]
                at = row[use]
                # Part 0 is a whole list. The parts of a divided one count from 1 and come together again in the second round.
                parts = (cost[use] // longest).astype(np.int64) + 1
                part = np.where(parts > 1, (mix(names[at].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64) + 1, 0)
                yield batch(_POSTINGS, token=value[use].view(np.int64), part=part, node=names[at], place=pack(np.diff(first)[at], matches[at], position[use]))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, part, an order of nodes: those of lists with two nodes at least, with the list's first.

    A part of a divided list is kept even if it has one node, since the list may go on in another part.
    """
    last: tuple | None = None  # the latest row
    leader: tuple | None = None  # (node, place) that its list begins with
    waiting = False  # that first row is not out, since it is alone so far
    for b in batches:
        t, part, node, p = (b.column(k).to_numpy() for k in range(4))
        if not len(t):
            continue
        same_list, same_node = np.zeros(len(t), bool), np.zeros(len(t), bool)
        same_list[1:] = (t[1:] == t[:-1]) & (part[1:] == part[:-1])
        same_node[1:] = node[1:] == node[:-1]
        if last is not None:
            same_list[0], same_node[0] = last[:2] == (t[0], part[0]), last[2] == node[0]
        fresh = ~(same_list & same_node)  # an equal set of another task is posted again
        final = (int(t[-1]), int(part[-1]), int(node[-1]))
        t, part, node, p, begins = t[fresh], part[fresh], node[fresh], p[fresh], ~same_list[fresh]
        if len(t):
            group = np.cumsum(begins) - int(begins[0])  # 0: the list of the first row
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            first_node, first_place = node[starts].copy(), p[starts].copy()
            size = np.bincount(group)
            if not begins[0]:
                first_node[0], first_place[0] = leader
                size[0] += 1
                if waiting:
                    yield batch(_SHARED, token=t[:1], node=[leader[0]], place=[leader[1]], leader=[leader[0]], leader_place=[leader[1]])
            out = (size[group] > 1) | (part > 0)
            waiting = not out[-1]
            leader = (int(first_node[-1]), int(first_place[-1]))
            g = group[out]
            yield batch(_SHARED, token=t[out], node=node[out], place=p[out], leader=first_node[g], leader_place=first_place[g])
        last = final


def allowed(place: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether two postings of one token can be among the first l that a similar pair shares, and that l."""
    (n, l, i), (m, k, j) = unpack(place), unpack(other)
    need = np.minimum(l, k)
    fits = (np.minimum(n, m) * DENOMINATOR >= NUMERATOR * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= pair_overlap(n, m) - need + 1)
    return fits, need


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, first and second share, and place: pairs in different components that may be similar."""
    for g in whole_groups(batches, 3):
        token, first, second, share, node, place, component = (g.column(k).to_numpy() for k in range(7))
        bits = np.frombuffer(b"".join(g.column(7).to_pylist()), np.uint64).reshape(len(node), -1)
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        unit = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]))])
        within, size = first == second, place >> 32  # sizes ascend in a unit
        # Each row meets those after it in its unit, up to the size that can be similar.
        end = np.searchsorted((unit << 32) + size, (unit << 32) + size * DENOMINATOR // NUMERATOR, "right")
        meets = end - np.arange(len(node)) - 1
        sums = np.cumsum(meets)
        cuts = np.unique(np.searchsorted(sums, np.arange(0, int(sums[-1]) + PAIRS, PAIRS), "left")).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(node)], strict=True):
            i = np.arange(lo, hi)
            a, b = np.repeat(i, meets[i]), ragged(i + 1, meets[i])
            meet = (component[a] != component[b]) & (within[a] | (share[a] != share[b]))
            a, b = a[meet], b[meet]
            fits, need = allowed(place[a], place[b])
            a, b, need = a[fits], b[fits], need[fits]
            both = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
            fits = np.minimum(size[a] - ones[a], size[b] - ones[b]) + both >= pair_overlap(size[a], size[b])
            a, b = node[a[fits]], node[b[fits]]
            if len(a):
                yield batch(_PAIRS, a=np.minimum(a, b), b=np.maximum(a, b), need=need[fits])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow the overlap that they need."""
    for batch_ in batches:
        a, b, n, m, s, t = (batch_.column(k).to_pylist() for k in range(6))
        need = pair_overlap(np.array(n, np.int64), np.array(m, np.int64)).tolist()
        keep = [k for k in range(len(a)) if most_overlap(n[k], m[k], s[k], t[k]) >= need[k]]
        yield batch("a long,b long", a=[a[k] for k in keep], b=[b[k] for k in keep])


def possible(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by their sketches; `sets` has (node, n, sketch)."""
    first, second = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_possible, "a long,b long")


def _verify(crowded: frozenset[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of texts sorted by hub and role: the members (role 1) that are similar to the hub's own text (role 0)."""
        hub, own = None, None
        for b in batches:
            hubs, salts, roles, names = (b.column(k).to_pylist() for k in range(4))
            left, right = [], []
            for x in blocks(b.column(4)):
                _, value, first = shingles(x)
                found = nodes(value, first, crowded)
                for k in range(x.hi - x.lo):
                    at = x.lo + k
                    if found[k] != names[at]:  # another row with the same key
                        continue
                    some = value[first[k] : first[k + 1]]
                    if roles[at] == 0:
                        hub, own = (hubs[at], salts[at]), some
                    elif hub == (hubs[at], salts[at]):
                        shared = len(np.intersect1d(own, some, assume_unique=True))
                        if DENOMINATOR * shared >= NUMERATOR * (len(own) + len(some) - shared):
                            left.append(names[at])
                            right.append(hubs[at])
            yield batch("a long,b long", a=left, b=right)

    return run


def verify(rows: DataFrame, sets: DataFrame, pairs: DataFrame, crowded: frozenset[int] = frozenset()) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; `sets` has (node, key), `rows` (key, text).

    The text of a goes to where the texts of its b's are; a hub with many members is dealt to several tasks.
    """
    per_hub = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(per_hub, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("node"))
    own = per_hub.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("node"))
    wanted = materialize(members.union(own).join(sets.select("node", "key"), "node").select("hub", "salt", "role", "node", "key"), "wanted")
    texts = fetch(rows, wanted.select("key").distinct())
    dealt = wanted.join(texts, "key").select("hub", "salt", "role", "node", "text").repartition(partitions(pairs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return dealt.mapInArrow(_verify(crowded), "a long,b long")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, component_id, and the component's node, for each row; the basis of `join` and `deduplicated`."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(LEAST_BUCKETS, min(MOST_BUCKETS, (size // BUCKET_BYTES).bit_length()))
    features = materialize(rows.mapInArrow(_features(buckets), _FEATURES), "features")
    documents = features.filter("slice IS NULL").select("doc_id", "key", "n", "node", "check", "sketch", "finger")
    # Of 10^10 different sets some three pairs have the same name by chance; they take their checks as names.
    named_twice = documents.filter("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high")
    crowded = frozenset(r.node for r in named_twice.select("node").collect())  # a few names
    if crowded:
        documents = documents.withColumn("node", F.when(F.col("node").isin(list(crowded)), F.col("check")).otherwise(F.col("node")))
    sets = documents.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("sketch", ignorenulls=True).alias("sketch"), F.first("finger", ignorenulls=True).alias("finger"))
    sets = materialize(sets, "sets")
    table, longest = spark.sparkContext.broadcast(count_table(features, buckets)), LIST  # a byte a bucket

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _postings(table.value, longest, crowded)(batches)

    posted = rows.select("text").mapInArrow(post, _POSTINGS).repartition(n, "token", "part")
    # Of the sets with a shingle, the one with the fewest rarer shingles for its size is the most central, and comes first.
    posted = posted.sortWithinPartitions("token", "part", F.expr(f"(place & {(1 << _PLACE) - 1}) / (place >> 32)"), "node")
    shared = materialize(posted.mapInArrow(_shared, _SHARED), "shared")

    pairs = materialize(possible(sets, leaders(shared)), "pairs")
    edges = materialize(verify(rows, sets, pairs, crowded), "links")
    found = components(edges, "a", "b")
    labelled = shared.join(found.withColumnRenamed("component", "c"), "node", "left").select("token", "node", "place", F.coalesce("c", "node").alias("component"))
    labelled = materialize(labelled, "labelled")
    # Only lists with several components go on, the long ones as pairs of shares.
    lists = labelled.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    dealt = labelled.join(lists.select("token", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "token").join(sets.select("node", "finger"), "node")
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.select("token", F.least("share", "other").alias("first"), F.greatest("share", "other").alias("second"), "share", "node", "place", "component", "finger")
    crossing = dealt.repartition(n, "token", "first", "second").sortWithinPartitions("token", "first", "second", "place", "node").mapInArrow(_cross, _PAIRS)
    pairs = crossing.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("need").alias("need")).filter("k >= need").select("a", "b")
    pairs = materialize(possible(sets, pairs), "pairs")
    edges = edges.union(materialize(verify(rows, sets, pairs, crowded), "links"))
    found = components(edges, "a", "b")

    named = sets.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component", "component_id")
    return documents.select("doc_id", "key", "n", "node").join(named, "node", "left").select("doc_id", "key", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of (doc_id, text); two documents are joined when
    DENOMINATOR * intersection >= NUMERATOR * union of their shingle sets, and components follow the links.

    Null, empty and blank texts have no shingles and are linked with nothing. Texts of fewer than SHINGLE
    words have their whole sequence as one shingle. Very long texts are read whole, their words in pieces; what
    a task holds of one follows its number of words. Repeated rows are linked with each other, rows that share
    a doc_id but not the text stand for themselves. A null doc_id counts as none for component_id: such rows
    get the least doc_id that they reach, or null. Similarities at the threshold count. An empty table gives no
    row, and other columns are ignored, whatever their names and types. Shingles are compared by 64-bit hashes.
    """
    with temporary(docs.sparkSession):
        return materialize(grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "joined", keep=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, one of each component: the one with the least doc_id, of several with that id the one with the least key.

    Of rows that repeat in id and text one stays, any one if they differ in other columns. Rows without a doc_id stay
    only if nothing in their component has one. Null, empty and blank texts all stay, as they are like nothing. An empty
    table stays empty. Other columns, of any type and name, are kept as they are.
    """
    (name,) = unused(docs, "key")
    with temporary(docs.sparkSession):
        rows = grouped(docs).filter("n > 0").groupBy("key", "component").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
        rows = materialize(rows, "members")
        best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")))["key"].alias("best"))
        fate = rows.join(best, "component").select(F.col("key").alias(name), (F.col("key") == F.col("best")).alias("stays"), "times").filter("NOT stays OR times > 1")
        fate = materialize(fate, "fate", keep=True)
    keyed = docs.withColumn(name, row_key(docs["doc_id"], docs["text"]))
    kept = keyed.join(light(fate.select(name)), name, "left_anti").select(*every(docs))
    repeated = fate.filter("stays").select(name)
    if repeated.isEmpty():
        return kept
    one = keyed.join(light(repeated), name, "left_semi").groupBy(name).agg(F.first(F.struct(*every(docs))).alias("row"))
    return kept.unionByName(one.select("row.*"))


def leaders(shared: DataFrame) -> DataFrame:
    """For each node (a) the one other (b) that begins most of its lists, among those that may be similar to it."""

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, place, leader, other = (b.column(k).to_numpy() for k in range(4))
            fits, _ = allowed(place, other)
            fits &= node != leader
            yield batch("a long,b long", a=node[fits], b=leader[fits])

    counted = shared.select("node", "place", "leader", "leader_place").mapInArrow(fitting, "a long,b long").groupBy("a", "b").agg(F.count("*").alias("k"))
    return counted.groupBy("a").agg(F.max(F.struct("k", "b"))["b"].alias("b"))
