"""Density, count moments and the report over timing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of timing records, as the report reads and the harness writes them.
RESULTS = "experiment string, name string, n long, k long, w long, time double"


def counts_per_sequence(sketched: DataFrame, sequences: DataFrame) -> DataFrame:
    """``sequences`` with ``n_sampled``; sequences without a sampled position have 0."""
    counts = sketched.groupBy("seq_id").agg(F.count("*").alias("n_sampled"))
    return sequences.join(counts, "seq_id", "left").withColumn("n_sampled", F.coalesce("n_sampled", F.lit(0)).cast("long"))


def density(counted: DataFrame, by: list[str]) -> DataFrame:
    """Sampled positions, bases and their ratio per group; null for no bases."""
    sums = counted.groupBy(*by).agg(F.sum("n_sampled").cast("long").alias("n_sampled"), F.sum(F.length("seq")).cast("long").alias("n_bases"))
    return sums.withColumn("density", F.when(F.col("n_bases") > 0, F.col("n_sampled") / F.col("n_bases")))


def count_moments(counted: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population variance and standard deviation of the count per sequence."""
    return counted.groupBy(*by).agg(
        F.count("*").alias("n_sequences"),
        F.avg("n_sampled").alias("mean"),
        F.var_pop("n_sampled").alias("variance"),
        F.stddev_pop("n_sampled").alias("std_dev"),
    )


def ns_per_element(seconds: Column, n: Column) -> Column:
    return seconds * 1e9 / n


def report_rows(results: DataFrame, experiment: str | None = None) -> DataFrame:
    """Timing records with the flag ``canonical`` taken out of their names."""
    flagged = results.withColumn("canonical", F.col("name").contains("canonical ")).withColumn(
        "name", F.replace("name", F.lit("canonical "), F.lit(""))
    )
    return flagged if experiment is None else flagged.where(F.col("experiment") == experiment)


def median_pivot(rows: DataFrame, index: str, columns: list[str], value: str, order: str | None = None) -> DataFrame:
    """Median of ``value`` per ``index`` (rows) and combination of ``columns``.

    ``order`` is a column whose least value puts rows in first-seen order (as ``first_seen``).
    """
    heads = rows.withColumn("_head", F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))
    names = [r[0] for r in heads.select("_head").distinct().orderBy("_head").collect()]
    table = heads.groupBy(index).pivot("_head", names).agg(F.median(value))
    if order is None:
        return table
    seen = rows.groupBy(index).agg(F.min(order).alias("first_seen"))
    return table.join(seen, index)


def median_lines(rows: DataFrame) -> DataFrame:
    """Median time per line of the plot."""
    return rows.groupBy("name", "k", "w", "canonical").agg(F.median("time").alias("time"))


def as_org_table(table: DataFrame) -> str:
    """A small result as an org-mode table (a report; it is collected)."""
    rows = [table.columns, *([("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for v in r] for r in table.collect())]
    lines = ["| " + " | ".join(map(str, r)) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "+".join("---" for _ in table.columns) + "|", *lines[1:]])


def as_latex(table: DataFrame) -> str:
    """A small result as a LaTeX tabular (a report; it is collected)."""
    rows = [table.columns, *([("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for v in r] for r in table.collect())]
    body = " \\\\\n".join(" & ".join(map(str, r)) for r in rows)
    return "\\begin{tabular}{" + "l" * len(table.columns) + "}\n" + body + " \\\\\n\\end{tabular}"
