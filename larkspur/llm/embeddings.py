"""Near-duplicate vectors by binary codes of randomly rotated vectors, with stored correction factors.

Each distinct vector is rotated once by a few fixed random rotations. What is stored is its code (the signs
of the first rotation), a correction factor (the inner product of the rotated vector and its own code), the
rotated vector in bytes, and bucket keys, tables of a few sign bits each, that candidates come from. In a
bucket, one vector's code and factor with the other's bytes give an unbiased estimate of their cosine, and a
confidence bound on it. Only these go to the buckets; the vectors themselves follow where a pair's bound
reaches the threshold, and it is computed exactly, in double precision. A pair counts in the first table that
it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, materialize, partitions, temporary
from larkspur.llm.components import components
from larkspur.llm.vectors import Ranges, ragged, whole_groups

THRESHOLD = 0.95
#: Share of the pairs at the threshold itself that the tables are to find; nearer pairs are found more surely.
RECALL = 0.995
#: Standard deviations of the estimate within which a pair is computed exactly.
CONFIDENCE = 4.0
#: Rows of a bucket that meet in one piece of work; larger buckets are divided into pairs of shares.
SHARE = 1024

_VECTORS = "vec_id long,node long,size int,vector binary"
_CODES = "node long,weight long,size int,code binary,factor double,levels binary,step double,keys array<bigint>"
_UNITS = "table int,bucket long,first int,second int,share int,node long"
_UNIT = [x.split()[0] for x in _UNITS.split(",")]
_LINKS = "node long,links long,root long"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles of length 1 with a 64-bit name; null, zero and non-finite ones have none."""
    for b in batches:
        lists = b.column(1)
        flat, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy()) * ~np.asarray(lists.is_null()))
        nulls = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out: dict[str, list] = {"vec_id": b.column(0).to_pylist(), "node": [], "size": [], "vector": []}
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            v = x[a:z]
            most = np.abs(v).max() if len(v) else 0.0
            if nulls[z] > nulls[a] or not np.isfinite(most) or most == 0:
                raw = None
            else:
                v = v / most
                raw = (v / np.sqrt(v @ v)).tobytes()
            out["node"].append(None if raw is None else int(Ranges(np.frombuffer(raw, np.uint8)).hash(np.array([0]), np.array([len(raw)])).view(np.int64)[0]))
            out["size"].append(len(v))
            out["vector"].append(raw)
        yield batch(_VECTORS, **out)


def rotations(size: int, bits: int) -> np.ndarray:
    """As many random rotations as the bits need, one below the other; fixed by the size."""
    rng = np.random.default_rng(size)
    out = []
    for _ in range(-(-bits // size)):
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n distinct vectors: buckets of some four chance neighbours, however large n is."""
    same = 1 - math.acos(threshold) / math.pi  # of one bit of a pair at the threshold
    bits = max(6, math.ceil(math.log2(max(2, n))) - 2)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def _coded(bits: int, tables: int):
    """The code, the factor, the levels and the bucket keys of each vector; nothing rotates it again.

    The code is the signs of the first rotation; the levels are the rotated vector itself in steps of a 127th of its
    largest component. A table's key is `bits` signs of the rotations in a row.
    """
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                sizes, raw = np.array(some.column(2).to_pylist()), some.column(3).to_pylist()
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    if size not in turns:
                        turns[size] = rotations(size, bits * tables)
                    turned = np.stack([np.frombuffer(raw[k], np.float64) for k in rows]) @ turns[size].T
                    keys = ((turned[:, : bits * tables] > 0).reshape(len(rows), tables, bits) * weights).sum(2).astype(np.uint64) * np.uint64(31) + np.uint64(size % 31)
                    turned = turned[:, :size]
                    step = np.abs(turned).max(1) / 127
                    columns = {
                        "node": some.column(0).take(pa.array(rows)), "weight": some.column(1).take(pa.array(rows)), "size": pa.array([size] * len(rows), pa.int32()),
                        "code": pa.array([x.tobytes() for x in np.packbits(turned > 0, axis=1)], pa.binary()), "factor": pa.array(np.abs(turned).sum(1) / math.sqrt(size), pa.float64()),
                        "levels": pa.array([x.tobytes() for x in np.round(turned / step[:, None]).astype(np.int8)], pa.binary()), "step": pa.array(step, pa.float64()),
                        "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(keys.astype(np.int64).reshape(-1))),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _candidates(g: pa.Table, threshold: float, confidence: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit whose confidence bound reaches the threshold.

    The inner product of one vector's code with the other's levels, over the code's factor, is an unbiased estimate of the
    cosine; what the levels' rounding and the code's residual can change is added.
    """
    sine = math.sqrt(max(0.0, 1 - threshold * threshold))
    keys = np.stack([g.column(j).to_numpy() for j in range(4)], 1)
    unit = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
    share, same = g.column("share").to_numpy(), keys[:, 2] == keys[:, 3]
    sizes, codes, levels = g.column("size").to_numpy(), g.column("code").to_pylist(), g.column("levels").to_pylist()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if len(rows) < 2:
            continue
        factor, step = (g.column(c).to_numpy()[rows] for c in ("factor", "step"))
        sign = np.unpackbits(np.frombuffer(b"".join(codes[k] for k in rows), np.uint8).reshape(len(rows), -1), axis=1, count=size).astype(np.float32) * 2 - 1
        level = np.frombuffer(b"".join(levels[k] for k in rows), np.int8).reshape(len(rows), size).astype(np.float32)
        scale = 1 / (factor * math.sqrt(size))
        spread = confidence * sine * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, size - 1))
        rounding = size / 2 * scale  # of the other's step
        own, first = unit[rows], np.searchsorted(unit[rows], unit[rows])
        last = np.searchsorted(own, own, "right")
        small = last - first <= 48

        def near(a: np.ndarray, b: np.ndarray, product: np.ndarray) -> np.ndarray:
            return product * scale[a] * step[b] >= threshold - spread[a] - rounding[a] * step[b] - 1e-5

        # Rows of small units meet all rows after them in the unit; a large one is a product of matrices.
        left = np.flatnonzero(small)
        for lo in range(0, len(left), 1024):
            i = left[lo : lo + 1024]
            n = last[i] - i - 1
            a, b = np.repeat(i, n), ragged(i + 1, n)
            meet = same[rows[a]] | (share[rows[a]] != share[rows[b]])
            a, b = a[meet], b[meet]
            kept = np.concatenate([near(a[k : k + 65536], b[k : k + 65536], np.einsum("ij,ij->i", sign[a[k : k + 65536]], level[b[k : k + 65536]])) for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            yield rows[a[kept]], rows[b[kept]]
        for lo in np.unique(first[~small]).tolist():
            hi = int(last[lo])
            for at in range(lo, hi, 256):
                i, j = np.arange(at, min(at + 256, hi)), np.arange(at + 1, hi)
                product = sign[i] @ level[j].T
                fits = near(i[:, None], j[None, :], product) & (i[:, None] < j[None, :])
                if not same[rows[lo]]:
                    fits &= share[rows[i]][:, None] != share[rows[j]][None, :]
                a, b = np.nonzero(fits)
                yield rows[i[a]], rows[j[b]]


def _survivors(threshold: float, confidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each unit that have a candidate in it."""
        for g in whole_groups(batches, 4):
            hit = np.zeros(g.num_rows, bool)
            for a, b in _candidates(g, threshold, confidence):
                hit[a] = hit[b] = True
            for b in g.select(_UNIT).filter(pa.array(hit)).to_batches():
                yield b

    return run


def _links(threshold: float, confidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and spanning edges of the links of each unit: candidates are computed exactly, in the first table that a pair shares."""
        for g in whole_groups(batches, 4, 2048):
            number, node, weight = (g.column(c).to_numpy() for c in ("table", "node", "weight"))
            sizes, raw = g.column("size").to_numpy(), g.column("vector").to_pylist()
            keys = g.column("keys").combine_chunks()
            tables = len(keys.flatten()) // len(node)
            keys = keys.flatten().to_numpy().reshape(-1, tables)
            earlier = np.arange(tables)[None, :] < number[:, None]
            place, vectors = np.empty(len(node), np.int64), {}
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                place[rows] = np.arange(len(rows))
                vectors[size] = np.frombuffer(b"".join(raw[k] for k in rows), np.float64).reshape(len(rows), size)
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for a_all, b_all in _candidates(g, threshold, confidence):
                step = max(1, (1 << 21) // int(sizes[a_all[0]])) if len(a_all) else 1
                for at in range(0, len(a_all), step):
                    a, b = a_all[at : at + step], b_all[at : at + step]
                    fresh = np.concatenate([~((keys[a[k : k + 65536]] == keys[b[k : k + 65536]]) & earlier[a[k : k + 65536]]).any(1) for k in range(0, len(a), 65536)])
                    a, b = a[fresh], b[fresh]
                    if not len(a):
                        continue
                    x = vectors[int(sizes[a[0]])]
                    exact = np.einsum("ij,ij->i", x[place[a]], x[place[b]]) >= threshold
                    a, b = a[exact], b[exact]
                    links += np.bincount(a, weight[b], len(node)).astype(np.int64) + np.bincount(b, weight[a], len(node)).astype(np.int64)
                    while True:
                        low = np.minimum(root[a], root[b])
                        new = root.copy()
                        for x_ in (a, b, root[a], root[b]):
                            np.minimum.at(new, x_, low)
                        new = new[new]
                        if (new == root).all():
                            break
                        root = new
            use = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
            yield batch(_LINKS, node=node[use], links=links[use], root=node[root[use]])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, confidence: float = CONFIDENCE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing and are
    their own component. Vectors of different sizes are never linked. Equal vectors are one node with a weight;
    repeated rows are linked with each other. A null vec_id counts as none for component_id. A cosine at the
    threshold is a link, and no link is below it; links at the threshold are found with the given probability,
    nearer ones more surely. An empty table gives no row; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    with temporary(spark):
        rows = materialize(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_distinct, _VECTORS), "vectors")
        distinct = rows.filter("node IS NOT NULL").groupBy("node", "size").agg(F.count("*").alias("weight"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"))
        distinct = materialize(distinct, "distinct")
        bits, tables = plan(distinct.count(), threshold, recall)
        codes = materialize(distinct.select("node", "weight", "size", "vector").mapInArrow(_coded(bits, tables), _CODES), "codes")
        entries = codes.select("node", F.posexplode("keys").alias("table", "bucket"))
        shares = entries.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter("n > 1").select("table", "bucket", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
        dealt = entries.join(shares, ["table", "bucket"]).withColumn("share", F.pmod(F.xxhash64("node", "table"), F.col("shares")).cast("int"))
        # A share meets itself and every other share of its bucket once.
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        dealt = dealt.select("table", "bucket", F.least("share", "other").alias("first"), F.greatest("share", "other").alias("second"), "share", "node")
        unit = ["table", "bucket", "first", "second"]
        coded = dealt.join(codes.select("node", "size", "code", "factor", "levels", "step"), "node").select(*_UNIT, "size", "code", "factor", "levels", "step")
        near = coded.repartition(n, *unit).sortWithinPartitions(*unit, "share").mapInArrow(_survivors(threshold, confidence), _UNITS)
        near = materialize(near, "near")
        # Only what has a candidate meets again, with its vector.
        whole = near.join(codes, "node").join(distinct.select("node", "vector"), "node").select(*_UNIT, "size", "code", "factor", "levels", "step", "weight", "keys", "vector")
        links = materialize(whole.repartition(n, *unit).sortWithinPartitions(*unit, "share").mapInArrow(_links(threshold, confidence), _LINKS), "links")
        found = components(links.select("node", "root"), "node", "root")
        counted = links.groupBy("node").agg(F.sum("links").alias("links"))
        named = distinct.select("node", "weight", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").join(counted, "node", "left")
        named = named.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        out = rows.select("vec_id", "node").join(named, "node", "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "linked", keep=True)
