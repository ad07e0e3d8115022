"""Operators on streams of positions that are already rows: dedup, islands and syncmer filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import checkpointed


def numbered(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``row`` (0-based place in its key) and ``size`` (rows of the key), without one task per key.

    Rows are sorted by range, so a hot key lies in many partitions; each partition numbers its own, and
    an offset per key and partition (a small table) makes the numbers run through.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *partition, *order).sortWithinPartitions(*partition, *order)
    kept = checkpointed(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = kept.groupBy(*partition, "_p").agg(F.count("*").alias("_c"))
    key = Window.partitionBy(*partition)
    before = F.sum("_c").over(key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition)],
        F.col("_p").alias("_q"),
        F.coalesce(before, F.lit(0)).alias("_o"),
        F.sum("_c").over(key).alias("size"),
    )
    local = F.row_number().over(Window.partitionBy(*partition, "_p").orderBy("_i")).cast("long") - 1
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(partition)] + [F.col("_p") == F.col("_q")]
    joined = kept.withColumn("_local", local).join(offsets, on)
    return joined.withColumn("row", F.col("_local") + F.col("_o")).select(*df.columns, "row", "size")


def _fresh(df: DataFrame, partition: list[str], order: list[str], value: str, spread: int | None) -> DataFrame:
    """Rows whose value differs from the row before, with ``_row`` and, if spread, ``_size``."""
    if spread is None:
        along = Window.partitionBy(*partition).orderBy(*order)
        row = F.row_number().over(along).cast("long") - 1
        new = (F.col("_row") == 0) | ~F.col("_same")
        return df.withColumn("_row", row).withColumn("_same", F.col(value).eqNullSafe(F.lag(value).over(along))).where(new).drop("_same")
    rows = numbered(df, partition, order).withColumnsRenamed({"row": "_row", "size": "_size"})
    # Each chunk also gets the last row of the one before.
    own = F.floor(F.col("_row") / spread)
    last = (F.col("_row") % spread == spread - 1) & (F.col("_row") < F.col("_size") - 1)
    dealt = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    before = F.lag(value).over(Window.partitionBy(*partition, "_chunk").orderBy("_row"))
    judged = dealt.withColumn("_same", F.col(value).eqNullSafe(before)).where(F.col("_own") == F.col("_chunk"))
    return judged.where((F.col("_row") == 0) | ~F.col("_same")).drop("_own", "_chunk", "_same")


def adjacent_dedup(df: DataFrame, partition: list[str], order: list[str], value: str, skip: Column | None = None, spread: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before.

    Not a DISTINCT: a value may come back later.  Rows where ``skip`` holds are left out, but still
    separate the rows around them.  ``spread`` deals each key out in chunks of so many rows, for keys too hot for one task.
    """
    kept = _fresh(df, partition, order, value, spread).select(df.columns)
    return kept if skip is None else kept.where(~skip)


def adjacent_dedup_with_index(df: DataFrame, partition: list[str], order: list[str], value: str, spread: int | None = None) -> DataFrame:
    """The same with ``index``, the 0-based place of the first row of each run."""
    return _fresh(df, partition, order, value, spread).select(*df.columns, F.col("_row").alias("index"))


def islands(df: DataFrame, partition: list[str], order: list[str], value: str, spread: int | None = None) -> DataFrame:
    """``index`` and ``n`` (rows) of each run of equal values."""
    if spread is None:
        along = Window.partitionBy(*partition).orderBy("index")
        counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*partition)))
        firsts = adjacent_dedup_with_index(counted, partition, order, value)
        return firsts.withColumn("n", F.coalesce(F.lead("index").over(along), F.col("_n")) - F.col("index")).drop("_n")
    firsts = _fresh(df, partition, order, value, spread).select(*df.columns, F.col("_row").alias("index"), F.col("_size").alias("_n"))
    runs = checkpointed(numbered(firsts, partition, ["index"]))
    after = runs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition)], (F.col("row") - 1).alias("_r"), F.col("index").alias("_next"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(partition)] + [F.col("row") == F.col("_r")]
    found = runs.join(after, on, "left").withColumn("n", F.coalesce("_next", "_n") - F.col("index"))
    return found.select(*df.columns, "index", "n")


def filter_syncmers(windows: DataFrame, w: int, kind: str = "closed") -> DataFrame:
    """Rows ``win, pos`` whose position is the first or last of ``w`` (closed), or the middle (open)."""
    if kind == "open":
        if w % 2 == 0:
            raise ValueError("open syncmers need an odd w")
        return windows.where(F.col("pos") == F.col("win") + w // 2)
    if kind != "closed":
        raise ValueError("kind is closed or open")
    return windows.where((F.col("pos") == F.col("win")) | (F.col("pos") == F.col("win") + w - 1))


def collected(sketched: DataFrame) -> DataFrame:
    """``seq_id, positions``: one ordered array per sequence."""
    pairs = sketched.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("ord", "pos"))).alias("p"))
    return pairs.select("seq_id", F.col("p.pos").alias("positions"))
