"""Quality rules with adaptive thresholds, with DataFrame expressions only.

Every document gets fixed base rules and a verdict against thresholds learned from its
own language and source: mergeable quantile sketches (``percentile_approx``) give the
quartiles of three ratios per (lang, source), and a document is rejected when a ratio lies
further than ``FENCE`` times the quartile distance outside its group's quartiles.  The
distance has a least width per ratio, so that a group of near-identical documents does not
reject ordinary variation.  Ratios are integers (per mille or per cent), which keeps
sketched quartiles the same whatever order partial sketches merge in.

Thresholds come from all documents; the sketches are computed map-side and only one small
row per group and partition is shuffled, so a hot source costs nothing extra.  The threshold
table is joined back by broadcast while it has at most ``BROADCAST_GROUPS`` rows (checked
by a count), and by an ordinary join beyond that, where adaptive execution splits
hot groups.  Repeated words are found inside each row by sorting 64-bit hashes of its
3-word windows, so no text or word is ever shuffled.

Defined cases: a null text has no words (and fails the base rule); null languages and
sources are groups of their own; repeated rows are judged alike; an empty table gives no rows.  Other
columns pass through whatever their names are: a row travels as one struct beside the columns that are
made here.  Where one has the name of a result column, ``judge`` gives the result; ``keep_good`` gives
every column of the documents as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import checkpointed

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 3
SKETCH_ACCURACY = 10_000
BROADCAST_GROUPS = 100_000

#: ratio -> (least width of the quartile distance, whether low values are rejected too)
RATIOS = {"symbols_pm": (10, False), "dup_lines_pm": (150, False), "word_len_pc": (50, True)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*BASE, *RATIOS, "base_failed", "kept")


def _cheap(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that need no look at word windows."""
    text = F.coalesce("text", F.lit(""))
    with_words = docs.withColumn("_words", F.array_remove(F.split(text, BLANK + "+"), ""))
    with_lines = with_words.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return with_lines.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, BLANK + "+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_lines")


def _per(part: Column, whole: Column, scale: int) -> Column:
    """``scale * part / whole`` as an integer, rounded down."""
    return F.floor(part * scale / F.greatest(whole, F.lit(1)))


def _with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "symbols_pm": _per(F.col("n_symbols"), F.col("word_chars"), 1000),
            "dup_lines_pm": _per(F.col("n_dup_lines"), F.col("_n_lines"), 1000),
            "word_len_pc": _per(F.col("word_chars"), F.col("n_words"), 100),
        }
    )


def _repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in 3-word windows that occur twice or more."""
    hashed = df.withColumn(
        "_grams",
        F.sort_array(
            F.transform(
                F.slice("_words", F.lit(3), F.greatest(F.size("_words") - 2, F.lit(0))),
                lambda x, i: F.struct(
                    F.xxhash64(F.get("_words", i), F.get("_words", i + 1), x).alias("h"), i.alias("i")
                ),
            )
        ),
    )
    twice = F.filter(
        "_grams",
        lambda g, j: (g["h"] == F.get("_grams", j + 1)["h"]) | (g["h"] == F.get("_grams", j - 1)["h"]),
    )
    placed = hashed.withColumn("_at", F.sort_array(F.transform(twice, lambda g: g["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n")
        ),
        lambda acc: acc["n"],
    )
    return placed.withColumn("n_repeat_words", covered).drop("_grams", "_at")


def thresholds(docs: DataFrame) -> DataFrame:
    """``lang, source`` and, per ratio, the lowest and highest value that stays."""
    measured = _with_ratios(_cheap(docs.select("text", "lang", "source")))
    sketched = measured.groupBy("lang", "source").agg(
        *[F.percentile_approx(r, [0.25, 0.75], SKETCH_ACCURACY).alias(r) for r in RATIOS]
    )
    bounds = []
    for r, (least, low) in RATIOS.items():
        width = F.greatest(F.col(r)[1] - F.col(r)[0], F.lit(least)) * FENCE
        bounds.append((F.col(r)[1] + width).alias(f"_max_{r}"))
        if low:
            bounds.append((F.col(r)[0] - width).alias(f"_min_{r}"))
    return sketched.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *bounds)


def _named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _judged(docs: DataFrame) -> DataFrame:
    """The results, and each row of ``docs`` as the struct ``doc``."""
    limits = checkpointed(thresholds(docs))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    row = F.struct(*[F.col(_named(c)).alias(c) for c in docs.columns])
    joined = docs.select(row.alias("doc"), "text", "lang", "source").join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    measured = _repeats(_with_ratios(_cheap(joined)))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    inside = F.lit(True)
    for r, (_, low) in RATIOS.items():
        inside = inside & (F.col(r) <= F.col(f"_max_{r}"))
        if low:
            inside = inside & (F.col(r) >= F.col(f"_min_{r}"))
    # Always true, but not deterministic: a filter on the verdict must not be pushed below the
    # steps above, where their expressions would be copied into one another.
    barrier = F.spark_partition_id() >= 0
    judged = measured.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & inside & barrier)
    return judged.select("doc", *RESULTS)


def _row(docs: DataFrame) -> list[Column]:
    return [F.col("doc").getField(c).alias(c) for c in docs.columns]


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, the three ratios, ``base_failed`` and ``kept``."""
    own = [x for c, x in zip(docs.columns, _row(docs), strict=True) if c.lower() not in RESULTS]
    return _judged(docs).select(*own, *RESULTS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs`` and no others."""
    return _judged(docs).where("kept").select(_row(docs))
