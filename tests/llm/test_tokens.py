"""Cached encoding, token output and packing against the tokenizers library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import huffman, packing, queries, tokens
from larkspur.llm.common import tokenizer
from larkspur.llm.tokens import Encoder
from larkspur.llm.vectors import blocks
from larkspur.sources.storage import scratch

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name, texts, end):
    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    t = Tokenizer.from_file(tokenizer(request.param))
    t.encode_special_tokens = True
    return t, Encoder(tokenizer(request.param), most=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t.,!?'s×÷é \u0085　\x01\x1c日a1Zß|<>"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(both, texts):
    t, encoder = both
    for x in blocks(pa.array(texts, pa.string()), 30):
        ids, at = encoder.rows(x.data, x.offsets)
        for k in range(x.hi - x.lo):
            assert ids[at[k] : at[k + 1]].tolist() == t.encode(texts[x.lo + k], add_special_tokens=False).ids


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, limit in ((2, 4), (3, 2), (40, 6), (300, 16), (65, 7)):
        counts = rng.zipf(1.3, n).clip(max=10**9)
        lengths = huffman.code_lengths(counts, limit).astype(int)
        assert lengths.max() <= limit and (2.0**-lengths).sum() <= 1
        if limit == 16:  # enough for the unlimited code
            heap = sorted(counts.tolist())
            cost = 0
            while len(heap) > 1:
                a, b, *heap = sorted(heap)
                cost += a + b
                heap.append(a + b)
            assert cost == (counts * lengths).sum() or lengths.max() == limit
    assert huffman.code_lengths(np.array([0, 5, 0]), 16).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.2, n).clip(max=4000).astype(np.uint32)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=2), 16), 16)
    bits, marks = code.encode(ids)
    assert len(marks) == -(-n // huffman.CHECKPOINT)
    assert code.decode(bits, marks, n).tolist() == ids.tolist() if n else len(marks) == 0


def test_token_output(spark, documents, hostile):
    path = scratch(spark, "test")
    huffman.write(documents(hostile), path, tokenizer(NAMES[1]))
    rows = sorted(huffman.digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in hostile), key=lambda x: (x is not None, x or 0))
    ids = plain(NAMES[1], [t or "" for _, t in hostile], 2)
    expected, got, at = Counter(), Counter(), 0
    for (doc_id, _), x in zip(hostile, ids, strict=True):
        expected[doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        got[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    assert got == expected
    assert huffman.query(spark, documents([]), tokenizer(NAMES[1])).count() == 0


def test_packing(spark, documents, hostile):
    pieces = packing.pack(documents(hostile), tokenizer(NAMES[0])).collect()
    ids = plain(NAMES[0], [t or "" for _, t in hostile], 1)
    by_sequence = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_sequence[p.sequence_id].append(p)
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == packing.SIZE or at & (at - 1) == 0
    spans = Counter((p.doc_id, p.start, p.length, p.doc_tokens) for p in pieces)
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    unique = [k for k, n in Counter(d for d, _ in hostile).items() if n == 1]
    for (doc_id, _), x in zip(hostile, ids, strict=True):
        if doc_id in unique:
            own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
            assert b"".join(p.ids for p in own) == np.array(x, "<u4").tobytes()
            assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and all(p.doc_tokens == len(x) for p in own)
    assert spans
    assert packing.pack(documents([]), tokenizer(NAMES[0]), with_ids=False).count() == 0


def test_placement_is_the_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = 12
        counts = np.zeros(size + 1, np.int64)
        counts[1:size] = rng.integers(0, 4, size - 1)
        n = int(rng.integers(1, size))

        def squares(level, counts=counts, n=n):
            after = counts.copy()
            after[level] -= level > 0
            after[level + n] += level + n < size
            return int((after[1:size] ** 2).sum())

        allowed = [h for h in range(size - n + 1) if h == 0 or counts[h]]
        least = min(map(squares, allowed))
        assert packing.choose(counts, n, size) == max(h for h in allowed if squares(h) == least)


def test_packer_keeps_every_id():
    rng = np.random.default_rng(5)
    packer, total = packing.Packer(size=64), 0
    for k in range(9000):
        n = int(rng.integers(1, 63))
        packer.add(k, np.full(n, k, np.uint32))
        total += n
    packer.close()
    assert sum(len(p.ids) for s in packer.done for p in s) == total
    short = [s for s in packer.done if sum(len(p.ids) for p in s) < 64]
    assert packer.counts.sum() == 0 and all((n := sum(len(p.ids) for p in s)) & (n - 1) == 0 for s in short) and len(short) < 7


@pytest.fixture(scope="module", params=NAMES)
def both_added(request):
    return Tokenizer.from_file(tokenizer(request.param)), Encoder(tokenizer(request.param), most=50, added=True)


def test_index_is_a_dictionary():
    rng = np.random.default_rng(4)
    index, plain = tokens.Index(500), {}
    for _ in range(12):
        keys = np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64) << np.uint64(int(rng.integers(0, 40))))
        assert index.get(keys).tolist() == [plain.get(k, -1) for k in keys.tolist()]
        new = np.array([k for k in keys.tolist() if k not in plain], np.uint64)
        values = np.arange(len(plain), len(plain) + len(new), dtype=np.int32)
        index.add(new, values)
        plain.update(zip(new.tolist(), values.tolist(), strict=True))
    every = np.array(list(plain), np.uint64)
    assert index.get(every).tolist() == list(plain.values()) and index.count == len(plain)


def test_long_rows_are_read_in_pieces(monkeypatch, both_added):
    t, encoder = both_added
    texts = ["abc d,e é日 <|endoftext|> " * 40, "x" * 300, "", "a b " * 90 + "\u00a0 \u0301"]
    whole = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for size in (5, 17, 64, 1000):
        monkeypatch.setattr(tokens, "LONG", size)
        for limit in (1, 1 << 20):
            got = []
            for x in blocks(pa.array(texts, pa.string()), limit):
                ids, at = encoder.rows(x.data, x.offsets)
                got += [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]
            assert got == whole


def test_tails_do_not_keep_whole_documents():
    packer, ids = packing.Packer(size=64), np.arange(6401, dtype=np.uint32)
    packer.add(1, ids)
    (tail,) = [p for some in packer.levels for s in some for p in s]
    assert tail.ids.tolist() == [6400] and tail.ids.base is None


def test_rows_of_one_id_come_in_one_order(spark, documents, words, monkeypatch):
    """However the rows are dealt and sliced: by id, then by text."""
    rows = [(7, words.text(k % 9 + 1)) for k in range(40)] + [(7, "same")] * 20 + [(3, words.text(2000)), (None, "x")]
    results = []
    for size in (1 << 18, 30):
        monkeypatch.setattr(huffman, "SLICE_IDS", size)
        monkeypatch.setattr(huffman, "BLOCK_IDS", 7 * size)
        for parts in (1, 5):
            path = scratch(spark, "test")
            huffman.write(documents(rows).repartition(parts), path, tokenizer(NAMES[1]))
            results.append(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in huffman.digest(spark, path).collect()))
            rows.reverse()
    assert all(r == results[0] for r in results) and len(results[0]) == 62


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "<|", " ", "abc", "\u0301", "\u3000"]), st.text(max_size=5)), max_size=8).map("".join), max_size=6))
def test_added_tokens_give_the_ids_of_the_library(both_added, texts):
    t, encoder = both_added
    for x in blocks(pa.array(texts, pa.string()), 60):
        ids, at = encoder.rows(x.data, x.offsets)
        for k in range(x.hi - x.lo):
            assert ids[at[k] : at[k + 1]].tolist() == t.encode(texts[x.lo + k], add_special_tokens=False).ids


def test_queries_read_added_tokens_as_the_library_does(spark, documents, tmp_path):
    rows = [(1, "abc <|endoftext|> def"), (2, "<|startoftext|>abc<|endoftext|><|endoftext|>"), (3, "<|endof"), (4, "text|> abc"), (5, None)]
    documents(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for name, end in zip(NAMES, (1, 2), strict=True):
        t = Tokenizer.from_file(tokenizer(name))
        expected[name] = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4").tobytes() for k, x in rows}
    packed = queries.op6_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {k: len(x) // 4 for k, x in expected[NAMES[0]].items()}
    pieces = corpus_pipeline.pack(spark, documents(rows), str(tmp_path)).orderBy("doc_id", "start").collect()
    assert {k: b"".join(p.ids for p in pieces if p.doc_id == k) for k, _ in rows} == expected[NAMES[0]]
    got = sorted(queries.op9_huffman(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {k: (len(x) // 4, zlib.crc32(x)) for k, x in expected[NAMES[1]].items()}
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
