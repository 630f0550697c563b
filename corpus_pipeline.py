"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents, of any type and name. Columns other than doc_id, text and n_chars pass
through; a null doc_id is an id like any other but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import contamination, jaccard, packing, quality, repeats
from larkspur.llm.common import materialize, table, temporary, tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the share of good labels as their score. Repeated rows go or stay together, a score at the
    threshold stays, very long texts are scored whole, an empty table stays empty, and without labels every score is 0.5.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id; of repeated rows one.

    Null, empty and blank texts are like nothing and all stay. Of several texts under the least id the one with the least
    key stays. Very long texts are compared whole; an empty table stays empty.
    """
    return jaccard.deduplicated(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of repeats.WORDS.width words or more that occur elsewhere too are cut out, wherever they occur.

    No document goes. Null and empty texts stay as they are; texts that are equal, as repeated rows, lose all windows;
    very long texts are read in overlapping stretches; an empty table stays empty.
    """
    return repeats.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; in the others, passages of contamination.WINDOW words or more of an item are cut out.

    Null and empty texts stay; repeated rows go or stay together; a share at the limit is contaminated; very long texts are
    read whole; an empty benchmark changes nothing, and an empty table stays empty.
    """
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids.

    Null and empty texts have the end id only; every row is packed, repeated ones too; very long texts are divided; an
    empty table gives no piece.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: None of the stages can be expressed in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again. Only what the last stage reads stays."""
    docs, last = table(spark, sf_dir, "documents"), len(STAGES) - 1
    with temporary(spark):
        for k, (name, stage) in enumerate(STAGES[:last]):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=k == last - 1)
    return STAGES[last][1](spark, docs, sf_dir)
