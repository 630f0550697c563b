"""Decontamination against brute force over word windows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import contamination
from larkspur.llm.contamination import Automaton

from conftest import ascii_lower  # isort: skip


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute(rows, items, window=13):
    windows = {}
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name if name is None else str(name))
    out = []
    for doc_id, text in rows:
        w, names = split(text), set()
        hit = np.zeros(len(w), bool)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = True
                    names |= windows[tuple(w[k : k + n])]
        h = int(hit.sum())
        out.append((doc_id, len(w), h, len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture
def items(words):
    long, other = words.text(40), words.text(25)
    return [(1, long), (2, other), (3, words.text(13)), (4, words.text(12)), (5, "lonely"), (6, "Two, WORDS!"), (7, None), (8, ""), (9, "... !"), (10, long), (10, other + " tail"), (None, words.text(14)), (11, "a a a a a a a a a a a a a a a")]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def rows_for(words, items, hostile):
    text = [t for _, t in items if t]
    return [
        *hostile, (100, words.text(30) + " " + text[0] + " " + words.text(30)), (101, " ".join(text[0].split()[5:17])), (102, " ".join(text[0].split()[5:18]).upper()), (103, text[3]), (104, " ".join(text[3].split()[1:])),
        (105, words.text(300) + " lonely, " + words.text(5)), (106, "two-words two  words"), (107, "a " * 40), (108, text[1] + " tail " + text[0]), (109, words.text(700) + " " + text[2]), (110, text[1].replace(" ", ", ")),
    ]


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_hostile_rows(spark, documents, words, items, hostile):
    rows = rows_for(words, items, hostile)
    assert found(contamination.scan(documents(rows), benchmark(spark, items))) == brute(rows, items)


def test_groups_of_items(spark, documents, words, items, hostile, monkeypatch):
    """A benchmark beyond one group gives the same result, items beyond one group too."""
    rows = rows_for(words, items, hostile)
    monkeypatch.setattr(contamination, "GROUP_BYTES", 200)
    groups = list(contamination.item_groups(benchmark(spark, items), 200, 13))
    assert len(groups) > 3 and sum(map(len, groups)) > 12 and all(sum(len(t) for _, t in g) <= 200 for g in groups)
    assert found(contamination.scan(documents(rows), benchmark(spark, items))) == brute(rows, items)


def test_empty_tables(spark, documents, hostile):
    assert found(contamination.scan(documents([]), benchmark(spark, [(1, "x")]))) == []
    assert all(not r.contaminated and r.n_hit == 0 for r in contamination.scan(documents(hostile), benchmark(spark, [])).collect())


def cut(text, items, window=13):
    """The text without the words of whole windows and what stands between them; None if it is contaminated."""
    w = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))]
    seqs = {tuple(v[k : k + min(window, len(v))]) for _, t in items for v in [split(t)] if v for k in range(len(v) - min(window, len(v)) + 1)}
    hit = np.zeros(len(w), bool)
    for k in range(len(w)):
        for n in {len(x) for x in seqs}:
            if tuple(x for _, _, x in w[k : k + n]) in seqs:
                hit[k : k + n] = True
    if hit.any() and 20 * hit.sum() >= len(w):
        return None
    out, before, k = "", 0, 0
    while k < len(w):
        z = k
        while z < len(w) and hit[z]:
            z += 1
        if z - k >= window:
            out, before = out + text[before : w[k][0]], w[z - 1][1]
        k = max(z, k + 1)
    return text and out + text[before:]


@pytest.mark.parametrize("limit", [contamination.GROUP_BYTES, 150])
def test_decontaminated_cuts_spans_and_drops_documents(spark, documents, words, items, hostile, monkeypatch, limit):
    monkeypatch.setattr(contamination, "GROUP_BYTES", limit)
    rows = [*rows_for(words, items, hostile), (120, "É. " + words.text(900) + " -- " + items[1][1].upper().replace("É", "é").replace("SS", "ß") + "! " + words.text(900) + " lonely ")]
    df = documents(rows)
    kept = contamination.decontaminated(df, benchmark(spark, items))
    assert kept.dtypes == df.dtypes
    expected = [(d, t if t is None else left) for d, t in rows for left in [cut(t, items)] if t is None or left is not None]
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(expected, key=repr) and all(r.n_chars == len(r.text or "") for r in got)
    assert {109, 120} <= {r.doc_id for r in got} and all(items[1][1] not in (r.text or "") for r in got)


def test_clashing_columns_and_ids_with_commas(spark, words):
    a, b = words.text(20), words.text(20)
    schema = "doc_id long, text string, words string, runs map<string,int>, items int, `k.e` string"
    df = spark.createDataFrame([(1, a, "w", {"x": 1}, 2, "k"), (2, words.text(30), "v", None, 3, "l"), (3, b + " " + a, None, {}, None, None)], schema)
    bench = spark.createDataFrame([("a,b", a), ("c", b)], "item_id string, text string")
    rows = sorted(contamination.scan(df, bench).collect())
    assert [r.n_items for r in rows] == [1, 0, 2] and rows[2].items_sha256 == hashlib.sha256(b"a,b,c").hexdigest()
    kept = contamination.decontaminated(df, bench)
    assert kept.dtypes == df.dtypes and [tuple(r) for r in kept.collect()] == [tuple(r) for r in df.collect() if r.doc_id == 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=5), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 4))
def test_automaton(items, text, window):
    automaton = Automaton(list(enumerate(items)), window)
    expected = set()
    for name, seq in enumerate(items):
        n = min(window, len(seq))
        for k in range(len(seq) - n + 1 if n else 0):
            expected |= {(at + n, n, name) for at in range(len(text) - n + 1) if text[at : at + n] == seq[k : k + n]}
    assert {(end, n, name) for end, n, names in automaton.stream(text) for name in names} == expected


@pytest.mark.parametrize("limit", [contamination.GROUP_BYTES, 1])
def test_items_without_an_id_hit_as_in_sql(spark, documents, words, monkeypatch, limit):
    import duckdb

    from larkspur.llm import oracles

    monkeypatch.setattr(contamination, "GROUP_BYTES", limit)
    a, b, c = words.text(20), words.text(20), words.text(20)
    items = [(None, a), (1, b), (None, c)]
    rows = [(1, words.text(9) + " " + a), (2, a + " " + b + " " + c), (3, b), (4, words.text(50))]
    df = documents(rows)
    got = sorted(map(tuple, contamination.scan(df, benchmark(spark, items)).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert got == sorted(con.execute(oracles.OP4).fetchall())
    assert [r[5] for r in got] == [True, True, True, False]
    assert sorted(r.doc_id for r in contamination.decontaminated(df, benchmark(spark, items)).collect()) == [4]
