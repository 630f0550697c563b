"""The operators' registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import contamination, embeddings, html, huffman, jaccard, language, licenses, oracles, packing, quality, repeats
from larkspur.llm.common import table, tokenizer


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False, added=True)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.query(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_quality, op2_jaccard, op3_repeats, op4_contamination, op5_language,
        op6_packing, op7_embeddings, op8_html, op9_huffman, op10_licenses,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    """The other operators learn, tokenize or parse, which SQL does not; tests hold them against brute force."""
    return {"op2_jaccard": oracles.OP2, "op3_repeats": oracles.OP3, "op4_contamination": oracles.OP4, "op7_embeddings": oracles.OP7}
