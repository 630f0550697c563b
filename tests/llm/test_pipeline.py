"""The pipeline's stages and the registered queries."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from larkspur.llm import quality, queries, repeats
from larkspur.llm.common import materialize, table, temporary, tokenizer
from larkspur.sources.storage import Storage

from test_contamination import cut as cut_spans  # isort: skip
from test_near_duplicates import brute as near_brute  # isort: skip
from test_repeats import brute_words  # isort: skip

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = db.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in expected.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)

    kept = materialize(stages["quality_classifier"](spark, docs, SF), "test")
    scores = quality.score(docs, quality.fit(docs, table(spark, SF, "labels")))
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.filter("predicted = 1").collect())

    single = materialize(stages["ngram_jaccard_join"](spark, kept, SF), "test")
    components = {c for _, _, c in near_brute([(r.doc_id, r.text) for r in kept.collect()])}
    assert single.dtypes == docs.dtypes and sorted(r.doc_id for r in single.collect()) == sorted(components)

    cut = materialize(stages["suffix_array_dedup"](spark, single, SF), "test")
    rows = {r.doc_id: r for r in single.collect()}
    assert cut.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == brute_words([(r.doc_id, r.text) for r in rows.values()], repeats.WORDS.width)
    assert all(r.n_chars == (len(r.text) if r.text != rows[r.doc_id].text else rows[r.doc_id].n_chars) for r in cut.collect())

    clean = materialize(stages["benchmark_decontamination"](spark, cut, SF), "test")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id: cut_spans(r.text, items) for r in cut.collect()}
    assert clean.dtypes == docs.dtypes and {r.doc_id: r.text for r in clean.collect()} == {k: t for k, t in left.items() if t is not None}

    pieces = materialize(stages["packing"](spark, clean, SF), "test").collect()
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    own = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        own[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert own == {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in clean.collect()}


PASSAGE = 51


def test_planted_passages_of_over_fifty_words_go(spark, documents, words):
    """Verbatim in several documents, whatever stands around them; documents without one stay as they are."""
    planted = [words.text(n) for n in (PASSAGE, 60, 75, 300)]
    rows = [(k, words.text(40 + k) + "\n" + planted[k % 4] + " " + words.text(60)) for k in range(12)] + [(k, words.text(120)) for k in range(12, 40)]
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, documents(rows), SF).collect()}
    assert all(planted[k % 4] not in out[k] and len(out[k].split()) == 100 + k for k in range(12))
    assert all(out[k] == t for k, t in rows[12:])


def test_run_is_the_stages_in_a_row(spark):
    whole = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
    columns = ["doc_id", "doc_tokens"]
    assert sorted(map(tuple, whole.select(columns).distinct().collect())) == sorted(map(tuple, docs.select(columns).distinct().collect()))


def test_every_stage_takes_hostile_and_empty_documents(spark, documents, hostile):
    extra = ("key map<string,int>", "node string", "spans binary", "words array<string>", "stays int", "__key string", "a.b int")
    for rows in (hostile, []):
        docs = documents(rows).drop("node", "key", "spans").selectExpr("*", *(f"CAST(NULL AS {x.split()[1]}) AS `{x.split()[0]}`" for x in extra))
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, SF), "test")
            if name != "packing":
                assert out.dtypes == docs.dtypes
                docs = out


def test_temporary_tables_go(spark):
    with temporary(spark):
        with temporary(spark):
            inner = materialize(spark.range(3), "test", keep=True)
        assert inner.count() == 3
        gone = materialize(spark.range(3), "test")
        kept = materialize(gone.selectExpr("id + 1 AS id"), "test", keep=True)
        files = gone.inputFiles() + inner.inputFiles()
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    store = Storage(spark)
    assert not any(store._fs(f).exists(store._path(f)) for f in files)
