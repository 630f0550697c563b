"""Repeated-window removal against brute force over bytes."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import repeats
from larkspur.llm.vectors import blocks


def brute(rows, width=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                mask[k : k + width] = True
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((doc_id, len(t), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mask])).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(df).collect()], key=repr)


def test_hostile_rows(documents, hostile):
    assert found(documents(hostile)) == brute(hostile)


def test_empty_table(documents):
    assert found(documents([])) == [] and repeats.without_repeats(documents([])).count() == 0


def test_lengths_around_the_threshold(documents, words):
    """Shared strings of 399, 400 and 401 bytes, inside one document, at its ends, overlapping, and across several."""
    rows = []
    for n in (399, 400, 401, 650):
        shared = words.text(200).encode()[: n - 2].decode(errors="ignore").ljust(n - 2, "x")
        shared = "<" + shared.encode()[: n - 2].decode(errors="ignore") + ">"
        rows += [(len(rows), words.text(30) + shared + words.text(30)), (len(rows) + 1, shared + words.text(5)), (len(rows) + 2, words.text(5) + shared)]
        rows += [(len(rows), words.text(9) + shared + "|" + shared), (len(rows) + 1, shared[: n // 2] + words.text(20) + shared[n // 2 :])]
    rows += [(100, "ab" * 230), (101, "a" * 400), (102, "a" * 401), (103, "é" * 200), (104, "é" * 201)]
    assert found(documents(rows)) == brute(rows)


def test_chains_of_overlapping_passages(documents, words):
    text = words.text(600)
    rows = [(k, text[k * 150 : k * 150 + 520]) for k in range(20)] + [(50 + k, words.vary(text, 0.01)) for k in range(6)]
    assert found(documents(rows)) == brute(rows)


def test_small_chunks_and_blocks(documents, words, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    passage = words.text(120)
    rows = [(k, words.text(20) + " " + passage + " " + words.text(20)) for k in range(60)]
    assert found(documents(rows)) == brute(rows)


def test_first_pass_digits_agree_for_equal_windows(words):
    passage = words.text(150).encode()
    texts = [words.text(k).encode() + passage + words.text(7).encode() for k in (1, 30, 200)]
    digits = []
    for x in blocks(pa.array(texts, pa.binary()), 1 << 20):
        s = repeats.Suffixes(x.data, x.offsets, repeats.BYTES)
        for k, t in enumerate(texts):
            at = t.index(passage) + x.offsets[k]
            use = np.flatnonzero((s.start >= at) & (s.start + repeats.BYTES.width <= at + len(passage)) & (s.row == k))
            digits.append((s.anchor[use].tolist(), s.windows(use).tolist()))
    assert digits[0] == digits[1] == digits[2] and digits[0][0]


def test_kept_text_is_cut_at_characters(documents, words):
    passage = "é" + words.text(200) + "é"
    rows = [(1, "ü" + passage + "ß fin"), (2, "Ü" + passage + "ä end"), (3, words.text(80)), (4, None), (5, "")]
    df = documents(rows)
    out = repeats.without_repeats(df, repeats.BYTES)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[3].text == rows[2][1] and kept[4].text is None and kept[5].text == ""
    assert passage[1:-1] not in kept[1].text and kept[1].text.startswith("ü") and kept[1].text.endswith("ß fin") and kept[1].n_chars == len(kept[1].text)


def test_streams_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    n = 120
    anchor, part = np.sort(rng.integers(0, 25, n)), np.zeros(n, np.int64)
    hashes = [np.unique(rng.integers(0, 9, 4)).astype(np.uint64) + np.uint64(100 * a) for a in anchor]
    known = [bytes(rng.integers(0, 2, len(h)).astype(np.uint8) * (rng.random() < 0.2)) for h in hashes]
    rows = repeats.batch(repeats._WINDOWS, chunk=np.arange(n), run=np.arange(n), anchor=anchor, part=part, hashes=[h.tobytes() for h in hashes], known=known)
    results = [pa.Table.from_batches(list(repeats._masks(iter([rows.slice(k, size) for k in range(0, n, size)])))).to_pylist() for size in (1, 2, 5, 40, n)]
    assert all(r == results[0] for r in results)
    seen, sure = Counter(x for h in hashes for x in h.tolist()), {x for h, k in zip(hashes, known, strict=True) for x, y in zip(h.tolist(), k, strict=True) if y}
    assert [list(r["mask"]) for r in results[0]] == [[int(seen[x] > 1 or x in sure) for x in h.tolist()] for h in hashes]


@pytest.mark.parametrize("seed", range(2))
def test_random_small_alphabet(documents, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("ab"), 300)) for _ in range(4)]
    rows = [(k, "".join(pool[j] for j in rng.integers(0, 4, rng.integers(1, 6)))) for k in range(15)]
    assert found(documents(rows)) == brute(rows)


def brute_words(rows, width):
    """Of each text, what is left without the words of windows that start elsewhere too."""
    texts = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    window = lambda w, k: tuple(x for _, _, x in w[k : k + width])
    seen = Counter(window(w, k) for w in texts for k in range(len(w) - width + 1))
    out = []
    for (doc_id, t), w in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[window(w, k)] > 1:
                gone |= set(range(k, k + width))
        left, before = "", 0
        for k in sorted(gone):
            if k - 1 not in gone:
                left, before = left + t[before : w[k][0]], None
            if k + 1 not in gone:
                before = w[k][1]
        out.append((doc_id, t and left + t[before:]))
    return sorted(out, key=repr)


def without(df, windows):
    return sorted([(r.doc_id, r.text) for r in repeats.without_repeats(df, windows).collect()], key=repr)


@pytest.mark.parametrize("width", [50, 7])
def test_words_against_brute_force(documents, hostile, words, width):
    passage = words.text(51)
    rows = [*hostile, (30, "a " + passage + " b"), (31, passage.replace(" ", " \n\t")), (32, words.text(49)), (33, words.text(80) + " " + passage), (34, " ".join(passage.split(" ")[2:]) + " x")]
    assert without(documents(rows), repeats.Windows(width, width // 2, True)) == brute_words(rows, width)


def test_long_rows_in_stretches_and_frequent_anchors(documents, words, monkeypatch):
    """Rows many times as long as what is sorted at once, and anchors whose windows go by themselves."""
    monkeypatch.setattr(repeats, "FREQUENT", 5)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    passage = words.text(130)
    rows = [(k, words.text(15) + " " + passage + " " + words.text(15)) for k in range(25)] + [(40, words.text(900) + passage + words.text(700) + passage), (41, words.text(1500)), (42, "ab" * 1500)]
    df = documents(rows)
    got = repeats.digest(df, repeats.Windows(400, 192, block=300)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute(rows)
    assert without(df, repeats.Windows(20, 9, True, 35)) == brute_words(rows, 20)


def test_many_equal_rows_under_one_id_are_read_once(documents, words):
    text = words.text(120)
    rows = [(1, text)] * 400 + [(2, words.text(5) + text)]
    assert found(documents(rows)) == brute(rows)


def test_clashing_columns_stay(spark, words):
    text = words.text(90)
    schema = "doc_id long, text string, n_chars string, key string, spans map<string,int>, spans_key int, `n.o` string"
    df = spark.createDataFrame([(1, "x " + text, "a", "k", {"m": 1}, 5, "u"), (2, text + " y", "b", "l", None, 6, "v"), (3, None, "c", None, {}, 7, "w")], schema)
    out = repeats.without_repeats(df)
    assert out.dtypes == df.dtypes
    left = {1: "x ", 2: " y", 3: None}
    assert sorted([tuple(r) for r in out.collect()], key=repr) == sorted([(r.doc_id, left[r.doc_id], *r[2:]) for r in df.collect()], key=repr)


def test_a_window_in_many_chunks_is_not_held():
    """Groups of part -1 come out row by row from the second on, whatever the batches."""
    n = 40
    one = np.array([7], np.uint64).tobytes()
    rows = repeats.batch(repeats._WINDOWS, chunk=np.arange(n), run=np.zeros(n, int), anchor=[1, *[7] * (n - 3), 8, 9], part=[-1] * n, hashes=[one if 0 < k < n - 2 else np.array([k + 100], np.uint64).tobytes() for k in range(n)], known=[b"\0"] * (n - 1) + [b"\1"])
    for size in (1, 2, 3, 11, n):
        out = [r for b in repeats._masks(iter([rows.slice(k, size) for k in range(0, n, size)])) for r in b.to_pylist()]
        assert [r["mask"] for r in sorted(out, key=lambda r: r["chunk"])] == [b"\0", *[b"\1"] * (n - 3), b"\0", b"\1"]
