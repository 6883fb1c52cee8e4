"""Training-data pipeline over ``documents``.

Each stage is one operator of ``platewise.llm`` and works on all that its
predecessor kept: documents that a quality rule rejects go; of each group of
SimHash near duplicates (3-word shingles, 2 bits) the document that names the
group stays; bytes that repeat across documents are cut out; documents that
hold a benchmark window go; what is left is encoded.

Defined results: null and empty texts fail the quality rules; rows that
repeat an id stay or go by their text; an empty table gives an empty result;
columns beyond those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import decontaminate, quality, repeats, sentencepiece_codec, simhash
from platewise.llm.common import checkpointed, table
from platewise.llm.registry import PIECES, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=3, distance=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(docs, tokenizer_file(PIECES))
    return encoded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

# SimHash, suffix arrays and tokenizer ids are beyond SQL; the tests hold the
# result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # each stage runs once, on what the one before it wrote
            docs = checkpointed(docs)
    return docs
