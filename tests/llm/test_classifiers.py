"""Quality and language: held-out accuracy, and that nothing held out is learnt."""

import unicodedata
import zlib
from collections import Counter
from random import Random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from larkspur.llm import language, quality
from larkspur.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(docs, labels):
    return quality.fit(docs, labels)


def test_held_out_is_the_remainder(spark):
    ids = [0, 1, 2, 3, -7, 10**12, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "i long").select(held_out(F.col("i"))).collect()]
    assert got == [x is not None and zlib.crc32(str(x).encode()) % 4 == 2 for x in ids]


def test_quality_on_held_out_rows(docs, labels, model):
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert len(own) > 50 and np.mean([r.predicted == r.quality for r in own]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    good, bad = (np.mean([r.score for r in own if r.quality == q]) for q in (1, 0))
    assert good - bad > 0.5


def test_quality_learns_nothing_from_held_out_labels(docs, labels, model):
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, turned) == model


def test_quality_of_hostile_rows(documents, hostile, model):
    df = documents(hostile)
    rows = quality.score(df, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in hostile) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1 and empty.pop() == pytest.approx(model.prior)
    assert len({r.score for r in rows if r.doc_id in (7, 9, -5)}) == 1
    kept = quality.accepted(df, model)
    assert kept.dtypes == df.dtypes
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.predicted)


def test_quality_without_labels_or_rows(spark, documents, hostile, labels, model):
    none = quality.fit(documents(hostile), spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality.score(documents(hostile), none).collect()} == {0.5}
    assert quality.score(documents([]), model).count() == 0
    assert quality.fit(documents([]), labels).prior == 0.5


def test_scores_by_the_definition(documents, hostile, model):
    """Sizes with either dictionary by zstandard's own calls, and the curve by its formula."""
    rows = {(r.doc_id, round(r.score, 9)) for r in quality.score(documents(hostile), model).collect()}
    expected = set()
    for doc_id, text in hostile:
        raw = (text or "").encode()
        if not raw:
            expected.add((doc_id, round(model.prior, 9)))
            continue
        good, bad = (sizes(raw, d) for d in (model.good, model.bad))
        features = [1, (bad - good) / len(raw), (bad - good) / max(good, bad, 1), 1 / len(raw) ** 0.5]
        expected.add((doc_id, round(1 / (1 + np.exp(-np.dot(features, model.weights))), 9)))
    assert rows == expected


def sizes(raw, dictionary):
    tool = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(tool.compress(raw[k : k + quality.PIECE])) for k in range(0, len(raw), quality.PIECE))


def test_whole_texts_are_learnt_and_conflicts_are_not(spark):
    """What tells the labels apart stands at the ends of long texts only."""
    w = np.random.default_rng(1)
    noise = lambda n: " ".join("".join(w.choice(list("abcdefgh"), 5)) for _ in range(n))
    ends = {1: "solid careful reasoning about evidence ", 0: "cheap pills click here now buy "}
    rows = [(k, noise(500) + " " + ends[k % 2] * 8) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, k % 2) for k, _ in rows]
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = [r for r in quality.score(docs, model).collect() if r.held_out]
    assert len(got) > 40 and np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in got]) > 0.95
    both = labels + [(k, 1 - y) for k, y in labels[:9]]
    rest = spark.createDataFrame(labels[9:], "doc_id long, quality int")
    assert quality.fit(docs, spark.createDataFrame(both, "doc_id long, quality int")) == quality.fit(docs, rest)


# -- language ------------------------------------------------------------------------------


def phrases(text, sample):
    """Greedy longest matches of the whole text; a character that the sample lacks is a phrase."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while text[at] in sample and at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def plain_words(text):
    """Letters and marks, lowered, with one space between runs; nothing without a letter."""
    kind = lambda c: unicodedata.category(c)[0]
    text = text.lower()
    if not any(kind(c) == "L" for c in text):
        return ""
    return " ".join("".join(c if kind(c) in "LM" else " " for c in text).split())


def normalised(texts):
    codes, offsets = language.normalise(texts)
    return [codes[a:z].tobytes().decode("utf-32-le") for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def test_letters_and_marks_are_kept():
    texts = ["", "½ ² Ⅷ 12 _", "  Ab--C9d ", "é́x हिन्दी!", "\u0301 ٣", "İX", "a", "日本 語", "\U0001f600"]
    assert normalised(texts) == [plain_words(t) for t in texts]
    assert normalised(texts)[1] == "" and normalised(["हिन्दी में"]) == ["हिन्दी में"]


@pytest.mark.parametrize("lane,size", [(1, 96 << 20), (5, 96 << 20), (16, 4 * 9 * 20), (512, 96 << 20)])
def test_phrases_are_greedy_longest_matches_of_whole_texts(monkeypatch, lane, size):
    monkeypatch.setattr(language, "LANE", lane)
    monkeypatch.setattr(language, "TABLE_BYTES", size)
    samples = {"x": "abracadabra banana", "y": "the cat sat on the mat", "z": "日本語の日本 ああ", "w": "a" * 60 + "b"}
    m = language.Model.of(samples)
    assert (len(m.keys) > 0) == (size < 1 << 20)
    rng = np.random.default_rng(0)
    texts = ["", "a", "zzz", "the cat", "a" * 150, "banana cat éé"] + ["".join(rng.choice(list("abcdhnt e日本a"), int(n))) for n in rng.integers(1, 300, 30)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    got = m.phrases(codes, np.cumsum([0] + [len(t) for t in texts]))
    assert got.tolist() == [[phrases(t, s) for s in samples.values()] for t in texts]


SCRIPTS = {"en": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 24), "hy": (0x561, 38), "he": (0x5D0, 27), "ar": (0x627, 36), "hi": (0x905, 53), "ka": (0x10D0, 33), "ko": (0xAC00, 900), "zh": (0x4E00, 2000)}


def test_ten_scripts_and_the_winner_by_brute_force(documents):
    """Prediction and score follow from the phrases of all languages, by the samples that were learnt."""
    random = Random(3)
    rows = []
    for name, (base, n) in SCRIPTS.items():
        stock = ["".join(chr(base + min(int(random.expovariate(6 / n)), n - 1)) for _ in range(random.randint(2, 7))) for _ in range(150)]
        rows += [(len(rows) + k, " ".join(random.choices(stock, k=60)), name) for k in range(24)]
    df = documents(rows)
    model = language.fit(df)
    assert set(model.languages) == set(SCRIPTS)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    own = [(r[0], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[k].held_out and got[k].lang_pred == name for k, name in own) and len(own) > 40
    texts = normalised([t for _, t, _ in rows])
    samples = {name: " ".join(t for t, r in zip(texts, rows, strict=True) if r[2] == name and zlib.crc32(str(r[0]).encode()) % 4 != 2) for name in SCRIPTS}
    whole = language.Model.of({name: samples[name] for name in model.languages})
    best = {r.doc_id: r for r in language.predict(df, whole).collect()}
    for (doc_id, _, _), t in list(zip(rows, texts, strict=True))[::17]:
        rate = [phrases(t, samples[name]) / len(t) for name in model.languages]
        assert best[doc_id].lang_pred == model.languages[int(np.argmin(rate))]
        assert best[doc_id].score == pytest.approx(1 / sum(np.exp(-language.SHARPNESS * (r - min(rate))) for r in rate))


def test_samples_are_whole_texts(documents, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHARS", 60)
    short, long = "abc def ghi jkl", "xyz " * 40
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    model = language.fit(documents([(ids[0], short, "s"), (ids[1], long, "l"), (ids[2], long + "uvw", "l"), (ids[3], long, "s")]))
    assert set(model.languages) == {"s", "l"}
    letters = {name: {chr(k) for k in np.flatnonzero(model.symbols[j])} for j, name in enumerate(model.languages)}
    assert letters == {"s": set(short), "l": set("xyz ")}


@pytest.fixture(scope="module")
def speakers(docs):
    return language.fit(docs)


def test_language_on_held_out_rows(docs, speakers):
    assert sorted(speakers.languages) == ["de", "en", "es", "fr"]
    rows = language.predict(docs, speakers).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert len(own) > 150 and np.mean([r.lang_pred == r.lang for r in own]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_learns_nothing_from_held_out_rows(docs, speakers):
    turned = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    again = language.fit(turned)
    assert again.languages == speakers.languages and (again.table == speakers.table).all()


def test_language_of_hostile_rows(documents, hostile, speakers):
    rows = language.predict(documents(hostile), speakers).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in hostile)
    numbers = language.predict(documents([(1, "½ ² Ⅷ"), (2, "\u0301"), (3, "½a")]), speakers).collect()
    assert [r.lang_pred == "und" for r in sorted(numbers)] == [True, True, False]
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[k].lang_pred, by_id[k].score) == ("und", 0.0) for k in (1, 2, 3))
    assert by_id[17].lang_pred != "und"  # letters that no language has
    assert language.predict(documents([]), speakers).count() == 0
    nothing = language.fit(documents([(1, "text", None), (2, None, "en"), (3, "12 !", "en")]))
    assert nothing.languages == [] and {r.lang_pred for r in language.predict(documents(hostile), nothing).collect()} == {"und"}
