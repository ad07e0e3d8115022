"""Documents to packed training sequences: filter, deduplicate, decontaminate, redact, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes every stage as a table in the shared checkpoint folder and
reads it again, so that a lost executor never sends the work back over several stages; a table
goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from seqloom.llm.queries import tokenizer_files
from seqloom.session import read_table, remove_shared, write_shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    pieces = packing.pack(docs, **tokenizer_files())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Bayesian joins, overlaps of retrieved passages and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = write_shared(stage(spark, docs, sf_dir))
        docs = spark.read.schema(docs.schema).parquet(path)
        if last is not None:
            remove_shared(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
