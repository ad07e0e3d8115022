"""FASTA and FASTQ records through Spark's text reader, so any path that Spark reads works."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq_id long, name string, seq string"


def _numbered(records: DataFrame, limit: int | None) -> DataFrame:
    found = records.select(F.monotonically_increasing_id().alias("seq_id"), "name", "seq")
    return found if limit is None else found.orderBy("seq_id").limit(limit)


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame | None:
    """What lies between separators, from files that are split; None for a path that doesn't exist."""
    try:
        return spark.read.option("lineSep", separator).text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        logging.getLogger(__name__).warning("no such file: %s", path)
        return None


def read_fasta(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``seq_id, name, seq`` of each record; ``limit`` takes the first ones.

    Files are split at record starts, so a large file is read by many tasks.  A path that doesn't exist
    gives an empty result and a warning.
    """
    text = _chunks(spark, path, "\n>")
    if text is None:
        return spark.createDataFrame([], SCHEMA)
    record = F.regexp_replace("value", "^>", "")
    parts = text.select(F.split(record, "\r?\n", 2).alias("p")).where(F.length(F.trim(F.col("p")[0])) > 0)
    body = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "")
    return _numbered(parts.select(F.substring_index(F.trim(F.col("p")[0]), " ", 1).alias("name"), body.alias("seq")), limit)


def read_fastq(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``seq_id, name, seq`` of FASTQ records of four lines; ``limit`` takes the first ones.

    Files are split where a line starts with ``@``, so a large one is read by many tasks.  Such a line is a
    record's first, or a quality line, which alone follows its separator: what has no third line with ``+`` is no record.
    """
    text = _chunks(spark, path, "\n@")
    if text is None:
        return spark.createDataFrame([], SCHEMA)
    parts = text.select(F.split("value", "\r?\n").alias("p")).where(F.get("p", F.lit(2)).startswith("+"))
    name = F.substring_index(F.trim(F.regexp_replace(F.get("p", F.lit(0)), "^@", "")), " ", 1)
    return _numbered(parts.select(name.alias("name"), F.trim(F.get("p", F.lit(1))).alias("seq")), limit)


def write_fasta(sequences: DataFrame, path: str) -> None:
    """Records ``name, seq`` as FASTA text files."""
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_fastq(sequences: DataFrame, path: str, quality: str = "I") -> None:
    """Records ``name, seq`` as FASTQ text files, with one quality for all letters."""
    lines = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit(quality), F.length("seq")))
    sequences.select(lines.alias("value")).write.text(path)
