"""Sliding minima over any ordered column, and the jumping variant of minimizers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.encode import CODES
from seqloom.functions.hashers import Hasher
from seqloom.operators.streams import adjacent_dedup, numbered
from seqloom.plans import arrays, kernel
from seqloom.session import ship

#: Up to this width a frame is aggregated directly; wider ones come from block minima.
DIRECT = 32


def _spread_min(df: DataFrame, partition: list[str], order: list[str], value: str, w: int, ties: str, partial: bool, spread: int) -> DataFrame:
    """Chunks of ``spread`` rows per key; a chunk also holds the ``w - 1`` rows that its windows reach over."""
    rows = numbered(df, partition, order)
    own = F.floor(F.col("row") / spread)
    reach = F.floor((F.col("row") + (w - 1) * (1 if partial else -1)) / spread)
    chunks = F.explode(F.sequence(F.least(own, F.greatest(reach, F.lit(0))), F.greatest(own, reach)))
    dealt = rows.withColumn("_chunk", chunks).withColumn("_own", own == F.col("_chunk"))
    found = _minima(dealt, [*partition, "_chunk"], value, w, ties, partial).where("_own")
    if not partial:
        found = found.where(F.col("row") <= F.col("size") - w)
    return found.drop("_chunk", "_own", "size")


def _minima(rows: DataFrame, partition: list[str], value: str, w: int, ties: str, partial: bool) -> DataFrame:
    """``min_value`` and ``min_row`` for rows with ``row``, whole windows or not."""
    sign = 1 if ties == "left" else -1
    key = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (F.col("row") * sign).alias("r")))
    if w <= DIRECT:
        by_row = Window.partitionBy(*partition).orderBy("row")
        frame = by_row.rowsBetween(1 - w, 0) if partial else by_row.rowsBetween(0, w - 1)
        found = rows.withColumn("_m", F.min(key).over(frame))
    else:
        found = _by_blocks(rows.withColumn("_k", key), partition, w, partial)
    return found.withColumn("min_value", F.col("_m.v")).withColumn("min_row", F.col("_m.r") * sign).drop("_m", "_k")


def sliding_min(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    value: str,
    w: int,
    ties: str = "left",
    partial: bool = False,
    spread: int | None = None,
) -> DataFrame:
    """``df`` with ``row`` (0-based), ``min_value`` and ``min_row`` of a window of ``w`` rows.

    The window starts at the row; rows without a complete one are left out.  With ``partial`` it ends at
    the row instead, and the first ``w - 1`` windows are shorter.  ``ties`` picks the left or right one
    of equal values.  Null values never win; a window of nulls has a null minimum.  ``spread`` deals each
    key out in chunks of so many rows, for keys too hot for one task.
    """
    if w < 1 or ties not in ("left", "right") or (spread is not None and spread < 1):
        raise ValueError("needs w >= 1, ties left or right, and spread >= 1")
    if spread is not None:
        return _spread_min(df, partition, order, value, w, ties, partial, spread)
    along = Window.partitionBy(*partition).orderBy(*order)
    rows = df.withColumn("row", F.row_number().over(along).cast("long") - 1)
    found = _minima(rows, partition, value, w, ties, partial)
    if not partial:
        found = found.withColumn("_n", F.count("*").over(Window.partitionBy(*partition))).where(F.col("row") <= F.col("_n") - w).drop("_n")
    return found


def hashed_minimizers(df: DataFrame, k: int, w: int, hash: Callable[[Column], Column]) -> DataFrame:
    """``seq_id, ord, pos``: leftmost minimizers under any hash of the k-mer string that is a Column expression."""
    if k < 1 or w < 1:
        raise ValueError("needs k >= 1 and w >= 1")
    try:
        return _hashed_by_pieces(df, k, w, hash)
    except AnalysisException as e:
        if e.getCondition() != "UNSUPPORTED_FEATURE.LAMBDA_FUNCTION_WITH_PYTHON_UDF":
            raise
    return _hashed_by_rows(df, k, w, hash)


def _hashed_by_pieces(df: DataFrame, k: int, w: int, hash: Callable[[Column], Column]) -> DataFrame:
    """Array expressions over pieces of each sequence, without a shuffle."""
    length, kind = k + w - 1, df.schema["seq"].dataType
    narrow = F.octet_length("seq") == F.length("seq")

    def positions(piece: Column, narrow: Column, start: Column) -> Column:
        # Substrings of bytes don't read the letters before them.
        def kmer(i: Column) -> Column:
            return F.when(narrow, F.substring(piece, i + 1, F.lit(k)).cast(kind)).otherwise(F.substring(piece.cast(kind), i + 1, F.lit(k)))

        last = F.when(narrow, F.length(piece)).otherwise(F.length(piece.cast(kind))) - k
        return arrays.let(F.transform(F.sequence(F.lit(0), last), lambda i: hash(kmer(i))), lambda hashes: sampled(hashes, start))

    def sampled(hashes: Column, start: Column) -> Column:
        # Places of hashes are compared by their hashes; that of a null is null, and never wins.
        def left(a: Column, b: Column) -> Column:
            return F.coalesce(F.when(F.get(hashes, b) < F.get(hashes, a), b).otherwise(a), b)

        places = F.transform(hashes, lambda h, i: F.when(h.isNotNull(), i))
        complete = F.slice(arrays.extremes(places, w, left), 1, F.size(hashes) - w + 1)
        return F.transform(arrays.fresh(complete, start, lambda x: x), lambda x: x + arrays.before(start))

    def pieces(narrow: Column) -> Column:
        return F.flatten(F.transform(arrays.starts(F.length("seq"), length), lambda a: arrays.let(arrays.cut(F.col("seq"), narrow, a, length), lambda p: positions(p, narrow, a))))

    rows = df.where(F.length("seq") >= length).select("seq_id", F.posexplode(arrays.let(narrow, pieces)).alias("ord", "pos"))
    return rows.select("seq_id", F.col("ord").cast("long"), F.col("pos").cast("long"))


def _hashed_by_rows(df: DataFrame, k: int, w: int, hash: Callable[[Column], Column]) -> DataFrame:
    """The same with a row per k-mer, for hashes that no array expression can hold (Python functions)."""
    kmers = F.transform(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.col("seq").substr(i + 1, F.lit(k)))
    rows = df.where(F.length("seq") >= k + w - 1).select("seq_id", F.posexplode(kmers).alias("i", "kmer"))
    windows = sliding_min(rows.select("seq_id", "i", hash(F.col("kmer")).alias("h")), ["seq_id"], ["i"], "h", w)
    fresh = adjacent_dedup(windows.select("seq_id", "row", F.col("min_row").alias("pos")), ["seq_id"], ["row"], "pos")
    number = F.row_number().over(Window.partitionBy("seq_id").orderBy("row")).cast("long") - 1
    return fresh.select("seq_id", number.alias("ord"), "pos")


def _by_blocks(rows: DataFrame, partition: list[str], w: int, partial: bool) -> DataFrame:
    """Constant work per row: a window is the end of one block of ``w`` rows and the start of the next.

    Blocks are aligned to ``row``, so a chunk may begin inside one: its first block is just shorter.
    """
    blocked = rows.withColumn("_b", F.floor(F.col("row") / w))
    block = Window.partitionBy(*partition, "_b")
    both = blocked.withColumns(
        {
            "_pre": F.min("_k").over(block.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)),
            "_suf": F.min("_k").over(block.orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    by_row = Window.partitionBy(*partition).orderBy("row")
    if partial:
        start: Column = F.lag("_suf", w - 1).over(by_row)
        least = F.least(F.col("_pre"), start)
    else:
        least = F.least(F.col("_suf"), F.lead("_pre", w - 1).over(by_row))
    return both.withColumn("_m", least).drop("_b", "_pre", "_suf")


def jumping_minimizers(df: DataFrame, k: int, w: int, hash: Hasher) -> DataFrame:
    """``seq_id, ord, pos``: after a sampled position the search starts right behind it.

    Each step takes the leftmost minimum of the next ``w`` k-mers, while more than ``w`` are left; the
    last ``w`` k-mers give one more position unless it is the last one already.  Sequences with fewer than
    ``w`` k-mers give none.
    """
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, starts, lengths = kernel.letters_of(batch.column(1))
            rows: list[int] = []
            ords: list[int] = []
            found: list[int] = []
            for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                raw = data[a : a + n]
                letters = CODES[raw] if hash.alphabet == "dna" else raw
                if n < k + w - 1:
                    continue
                if hash.alphabet == "dna" and (letters > 3).any():
                    raise ValueError("a letter is no base")
                least = kernel.leftmost(hash.order(letters), w).tolist()
                picked, at, last = [], 0, len(least) - 1
                while at < last:
                    picked.append(least[at])
                    at = least[at] + 1
                if not picked or picked[-1] != least[last]:
                    picked.append(least[last])
                rows += [i] * len(picked)
                ords += range(len(picked))
                found += picked
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(ords, pa.int64()), pa.array(found, pa.int64())], names=["seq_id", "ord", "pos"])

    kind = df.schema["seq_id"].dataType.simpleString()
    return df.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, ord long, pos long")


def naive_minimizers(letters: np.ndarray, k: int, w: int, hash: Hasher) -> list[int]:
    """The definition, for tests: leftmost minimum of every window, repeats left out."""
    order = hash.order(letters).tolist()
    found: list[int] = []
    for i in range(len(order) - w + 1):
        p = min(range(i, i + w), key=lambda j: order[j])
        if not found or found[-1] != p:
            found.append(p)
    return found
