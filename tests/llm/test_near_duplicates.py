"""Shingle join, embedding join and components against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import embeddings, jaccard
from larkspur.llm.components import components

from conftest import ascii_lower  # isort: skip


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def least_by_component(n, links, ids):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for k in range(n):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(n)]


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = least_by_component(len(rows), links, [r[0] for r in rows])
    return sorted([(r[0], len(s), c) for r, s, c in zip(rows, sets, least, strict=True)], key=repr)


def joined(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()], key=repr)


def test_hostile_rows(documents, hostile):
    assert joined(documents(hostile)) == brute(hostile)


def test_empty_table(documents):
    assert joined(documents([])) == [] and jaccard.deduplicated(documents([])).count() == 0


def test_near_copies_of_every_degree(documents, words):
    rows = []
    for group in range(12):
        base = words.text([6, 8, 12, 25, 60, 200][group % 6])
        for k in range(12):
            rows.append((len(rows), words.vary(base, 0.008 * k)))
    assert joined(documents(rows)) == brute(rows)


def test_pairs_at_the_threshold(documents, words):
    """Sets of 70 shingles that share 60 have 60 / 80 = 0.75; one less is too few."""
    rows = []
    for shared in (60, 59):
        for _ in range(5):
            head = words.text(shared + 4)
            rows += [(len(rows), head + " " + words.text(10)), (len(rows) + 1, head + " " + words.text(10))]
    found = joined(documents(rows))
    assert found == brute(rows) and len({c for _, _, c in found}) == 15


def test_a_large_group_and_a_common_passage(documents, words):
    base, passage = words.text(80), words.text(60)
    rows = [(k, words.vary(base, 0.02)) for k in range(250)] + [(k, passage + " " + words.text(25)) for k in range(250, 400)] + [(k, base) for k in range(400, 450)]
    assert joined(documents(rows)) == brute(rows)


def test_deduplicated_keeps_one_of_each(documents, hostile):
    df = documents(hostile)
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns
    names = {(d, c) for d, _, c in joined(df)}
    assert sorted({r.doc_id for r in kept.collect()} - {None}) == sorted({d for d, c in names if d == c and d is not None})
    assert kept.filter("doc_id = 9").count() == 0 and kept.filter("doc_id = -5").count() == 1 and kept.filter("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("name", ["LIST", "SHARE", "MEMBERS"])
def test_divided_lists_give_the_same(documents, words, monkeypatch, name):
    monkeypatch.setattr(jaccard, name, 3)
    base, passage = words.text(60), words.text(40)
    rows = [(k, words.vary(base, 0.03)) for k in range(40)] + [(k, passage + " " + words.text(14)) for k in range(40, 80)]
    assert joined(documents(rows)) == brute(rows)


def test_streams_do_not_depend_on_batches(monkeypatch):
    """Postings and crossing pairs are the same however the sorted rows are cut into batches, and pairs into portions."""
    rng = np.random.default_rng(2)
    n = 400
    token, node = rng.integers(0, 60, n), rng.integers(0, 30, n)
    part = np.where(token % 7 == 0, node % 3 + 1, 0)
    place = jaccard.pack(np.full(n, 10), np.ones(n, int), node % 2)
    order = np.lexsort((node, place, part, token))
    token, part, node, place = token[order], part[order], node[order], place[order]
    postings = pa.table({"token": token, "part": part, "node": node, "place": place}).combine_chunks().to_batches()[0]
    expected = set()
    for t, k in set(zip(token.tolist(), part.tolist(), strict=True)):
        rows = sorted({(p, v) for a, b, v, p in zip(token.tolist(), part.tolist(), node.tolist(), place.tolist(), strict=True) if (a, b) == (t, k)})
        if len(rows) > 1 or k:
            expected |= {(t, v, p, rows[0][1], rows[0][0]) for p, v in rows}
    first, second = np.zeros(n, int), (token % 3 == 0).astype(int)
    crossing = pa.table({"token": token, "first": first, "second": second, "share": np.where(second, node % 2, 0), "node": node, "place": place, "component": node // 3, "finger": [bytes([255] * 128)] * n}).combine_chunks().to_batches()[0]
    results = []
    for size in (1, 2, 3, 7, 50, n):
        cut = lambda rows, size=size: iter([rows.slice(k, size) for k in range(0, n, size)])
        shared = [tuple(r.values()) for b in jaccard._shared(cut(postings)) for r in b.to_pylist()]
        assert len(shared) == len(set(shared)) and set(shared) == expected
        monkeypatch.setattr(jaccard, "PAIRS", 7 * size)
        results.append(sorted(str(r) for b in jaccard._cross(cut(crossing)) for r in b.to_pylist()))
    assert all(r == results[0] for r in results) and results[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 3), (20, 21), (30, 30)] + [(k, k + 1) for k in range(100, 160)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**dict.fromkeys((1, 2, 3, 8, 9, 10), 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 161), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- embeddings ----------------------------------------------------------------------------


def brute_vectors(rows):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a][1], rows[b][1]
            if usable(u) and usable(v) and len(u) == len(v):
                u, v = np.array(u, float), np.array(v, float)
                u, v = u / np.abs(u).max(), v / np.abs(v).max()
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.95:
                    links.append((a, b))
    count = np.zeros(len(rows), int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    ids = [r[0] for r in rows]
    least = least_by_component(len(rows), links, ids)
    return sorted([(i, int(c), m, i == m or i is None) for i, c, m in zip(ids, count, least, strict=True)], key=repr)


def found_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, weight int")
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()], key=repr)


def cloud(seed, groups, members, noise, size=32):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.standard_normal(size)
        for _ in range(members):
            out.append((len(out), (base + noise * rng.standard_normal(size)).tolist()))
    return out


def test_hostile_vectors(spark):
    v = np.arange(1.0, 9).tolist()
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan"), *v[1:]]), (5, [float("inf"), *v[1:]]), (6, [None, *v[1:]]), (7, v), (8, v), (8, v), (9, [2 * x for x in v]), (10, [-x for x in v]), (11, v[:4]), (None, v), (12, [1e-300 * x for x in v]), (13, [1e300 * x for x in v])]
    assert found_vectors(spark, rows) == brute_vectors(rows)
    assert found_vectors(spark, []) == []


@pytest.mark.parametrize("noise", [0.05, 0.1, 0.14])
def test_clouds(spark, noise):
    rows = cloud(1, 30, 8, noise)
    got, expected = found_vectors(spark, rows), brute_vectors(rows)
    assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(expected, key=lambda r: r[0]), strict=True))
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in expected)
    if noise < 0.12:
        assert got == expected


def test_a_bucket_larger_than_a_share(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARE", 16)
    rows = cloud(4, 2, 70, 0.03)
    assert found_vectors(spark, rows) == brute_vectors(rows)


def test_more_vectors_need_more_bits():
    assert embeddings.plan(10**9)[0] > embeddings.plan(10**4)[0]
    bits, tables = embeddings.plan(50_000)
    same = 1 - np.arccos(0.95) / np.pi
    assert 1 - (1 - same**bits) ** tables >= embeddings.RECALL


def test_many_texts_under_one_id(documents, words, monkeypatch):
    """Each text is fetched once, not once for each text of its id."""
    base = words.text(70)
    rows = [(1, words.vary(base, 0.01)) for _ in range(60)] + [(1, base)] * 40 + [(2, base + " end"), (3, words.text(70))]
    fetched = []
    real = jaccard.fetch

    def counted(*args):
        out = real(*args)
        fetched.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "fetch", counted)
    assert joined(documents(rows)) == brute(rows)
    assert max(fetched) <= len({t for _, t in rows})


def test_names_that_two_sets_share(documents, words, monkeypatch):
    """Sets whose 64-bit names are equal go by their second names."""
    real = jaccard._sums
    monkeypatch.setattr(jaccard, "_sums", lambda value, first, seed: real(value, first, seed) % (5 if seed == 0x5851F42D4C957F2D else 1 << 62) + (np.diff(first) > 0))
    rng = np.random.default_rng(0)
    value = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    first = np.arange(0, 41, 4)
    names, second = jaccard.nodes(value, first), jaccard.checks(value, first)
    assert len(set(names.tolist())) < 10 == len(set(second.tolist()))
    crowded = frozenset(names.tolist())
    assert jaccard.nodes(value, first, crowded).tolist() == second.tolist()
    assert jaccard.nodes(value, first, frozenset({int(names[0])})).tolist() == [s if k == names[0] else k for k, s in zip(names.tolist(), second.tolist(), strict=True)]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(1, 1 << 62, 400).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 300)))) for _ in range(2)]
        value, first = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])
        row = np.repeat([0, 1], np.diff(first))
        s, t = jaccard.sketches(row, value, first)
        shared = len(np.intersect1d(*sets))
        n, m = (len(x) for x in sets)
        assert shared <= jaccard.most_overlap(n, m, s, t) <= min(n, m)
        bits = [x.tobytes() for x in jaccard.fingers(row, value, first)]
        assert shared <= jaccard.most_overlap(n, m, *bits)
    assert jaccard.most_overlap(n, n, s[:8] * 2, s[:8] * 2) == n


def test_maps_and_clashing_columns_stay(spark, words):
    text = words.text(40)
    schema = "doc_id long, text string, key map<string,int>, n array<int>, node string, `a.b` int, sketch binary"
    rows = [(1, text, {"a": 1}, [1], "x", 1, b"1"), (1, text, {"a": 1}, [1], "x", 1, b"1"), (2, text + " more", None, None, None, None, None), (3, None, {}, [], "", 0, b""), (3, None, {}, [], "", 0, b""), (None, words.text(9), None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    kept = jaccard.deduplicated(df)
    assert kept.dtypes == df.dtypes
    assert sorted(map(str, kept.collect())) == sorted(str(r) for k, r in enumerate(df.collect()) if k not in (1, 2))


def test_rows_without_an_id_bridge_others(documents, words):
    """b shares 62 of 70 shingles with a and with c, which share 54: only b, without an id, links them."""
    w = words.text(90).split(" ")
    a, b, c = " ".join(w[:74]), " ".join(w[8:82]), " ".join(w[16:])
    rows = [(1, a), (2, c), (3, words.text(70)), (None, b), (None, b.upper().replace("É", "é").replace("SS", "ß")), (None, words.text(50)), (None, ""), (None, None)]
    found = joined(documents(rows))
    assert found == brute(rows)
    assert [c for d, _, c in found if d in (1, 2)] == [1, 1] and [c for _, _, c in brute(rows[:3])] == [1, 2, 3]
