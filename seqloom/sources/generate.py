"""Deterministic random sequences and the report's JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.stats import RESULTS


def random_sequences(spark: SparkSession, n: int, length: int, seed: int = 0, letters: str = "ACTG") -> DataFrame:
    """``seq_id, seq``: ``n`` sequences of uniform letters, the same for one seed on any cluster."""
    pool = F.array(*[F.lit(c) for c in letters])

    def letter(j):
        return F.element_at(pool, (F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(len(letters))) + 1).cast("int"))

    places = F.sequence(F.lit(0), F.lit(length - 1)) if length else F.array().cast("array<int>")
    return spark.range(n).select(F.col("id").alias("seq_id"), F.array_join(F.transform(places, letter), "").alias("seq"))


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Timing records from JSON: lines of records or of arrays; ``multi_line`` for one array over many lines."""
    return spark.read.schema(RESULTS).option("multiLine", multi_line).json(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
