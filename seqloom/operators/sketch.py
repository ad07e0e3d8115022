"""The builder: what to sample from sequences, checked before anything runs.

Input is a DataFrame with ``seq_id`` and ``seq`` (other columns are ignored); one row is one sequence and
windows never span rows.  Null sequences and those shorter than a window give no rows.

    minimizers(21, 11, canonical=True).super_kmers().with_values().run(df)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.hashers import Hasher, nt_hash
from seqloom.operators.streams import numbered
from seqloom.plans import kernel, relational
from seqloom.plans.kernel import Spec
from seqloom.session import checkpointed, ship

MAX_W = 1 << 15


@dataclass(frozen=True)
class Sketch:
    """An immutable description; every method returns a new one."""

    k: int
    w: int
    select: str
    canonical: bool = False
    hash: Hasher | None = None
    want_super_kmers: bool = False
    want_values: bool = False
    want_skip: bool = False
    want_strings: bool = False

    def __post_init__(self) -> None:
        if self.k < 1 or not 0 < self.w < MAX_W:
            raise ValueError(f"needs k >= 1 and 0 < w < {MAX_W}")
        if self.canonical and self.length % 2 == 0:
            raise ValueError("canonical windows need an odd length k + w - 1")
        if self.select == "open" and self.w % 2 == 0:
            raise ValueError("open syncmers need an odd w")
        if self.hash is not None and self.hash.k != self.k:
            raise ValueError("the hasher has another k")
        if self.canonical and self.hash is not None and not self.hash.canonical:
            raise ValueError("canonical sampling needs a canonical hasher")
        if self.want_super_kmers and self.select not in ("minimizer",):
            raise ValueError("super-k-mers belong to minimizers")
        if self.want_strings and not self.want_super_kmers:
            raise ValueError("strings are those of super-k-mers")
        if self.want_skip and (not self.canonical or self.want_super_kmers):
            raise ValueError("skipping ambiguous windows is for canonical sampling without super-k-mers")
        if self.want_values and (self.value_length > 63 or (self.hash and self.hash.alphabet != "dna")):
            raise ValueError("values are for DNA, up to 63 bases")

    @property
    def length(self) -> int:
        return self.k + self.w - 1

    @property
    def value_length(self) -> int:
        return self.length if self.select in ("closed", "open") else self.k

    def hasher(self, hash: Hasher | Callable[[np.ndarray, int], np.ndarray]) -> Sketch:
        """Another hash: a ``Hasher``, or a function of letters and k to one 32-bit number per k-mer."""
        if self.want_super_kmers:
            raise ValueError("choose the hasher before super_kmers()")
        if not isinstance(hash, Hasher):
            hash = Hasher("custom", self.k, self.canonical, direct=hash)
        return replace(self, hash=hash)

    def super_kmers(self) -> Sketch:
        """Adds ``sk_start`` and ``sk_end``: the letters covered by windows that share a minimizer."""
        return replace(self, want_super_kmers=True)

    def with_strings(self) -> Sketch:
        """Adds ``super_kmer``, the letters from ``sk_start`` to ``sk_end``; arrow strategy only."""
        return replace(self, want_strings=True)

    def with_values(self) -> Sketch:
        """Adds ``value``: 2 bits a base; long up to 31 bases, else decimal(38,0)."""
        return replace(self, want_values=True)

    def skip_ambiguous(self) -> Sketch:
        """Leaves out windows with a letter that is no base."""
        return replace(self, want_skip=True)

    def spec(self) -> Spec:
        return Spec(
            k=self.k,
            w=self.w,
            hasher=self.hash or nt_hash(self.k, self.canonical),
            select=self.select,
            canonical=self.canonical,
            skip_ambiguous=self.want_skip,
            super_kmers=self.want_super_kmers,
            value_length=self.value_length if self.want_values else 0,
        )

    def columns(self) -> list[str]:
        base = ["win", "pos"] if self.select == "window" else ["ord", "pos"]
        return base + ["sk_start", "sk_end"] * self.want_super_kmers + ["value"] * self.want_values + ["super_kmer"] * self.want_strings

    def schema(self, df: DataFrame) -> str:
        value = "long" if self.value_length <= 31 else "decimal(38,0)"
        kinds = [f"{c} { {'value': value, 'super_kmer': 'string'}.get(c, 'long') }" for c in self.columns()]
        return ", ".join([f"seq_id {df.schema['seq_id'].dataType.simpleString()}", *kinds])

    def run(self, df: DataFrame, strategy: str = "arrow", spread: int | None = None) -> DataFrame:
        """``seq_id``, the order or window, ``pos`` and the columns asked for.

        ``strategy`` is "arrow" (numpy over Arrow batches, no shuffle) or "sql" (window functions).
        ``spread`` deals each sequence out in overlapping chunks of so many windows, for few but very
        long sequences; only then is the output shuffled, to number its rows.
        """
        ship(df.sparkSession)
        sequences = df.select("seq_id", "seq")
        if self.want_strings and (strategy != "arrow" or spread is not None):
            raise ValueError("strings need the arrow strategy and whole sequences; see super_kmer_strings")
        if strategy == "sql":
            return relational.sketch(sequences, self.spec())
        if strategy != "arrow":
            raise ValueError("strategy is arrow or sql")
        spec, columns = self.spec(), self.columns()
        if spread is not None:
            return self._run_spread(sequences, spread)

        def run(batches):
            return kernel.run_batches(batches, spec, columns)

        return sequences.mapInArrow(run, self.schema(df))

    def run_arrays(self, df: DataFrame) -> DataFrame:
        """``seq_id`` and an array per column asked for: one row per sequence, empty arrays included.

        The cheapest form where positions outnumber what a row costs: a row per position is not made.
        """
        if self.want_strings:
            raise ValueError("strings come as rows")
        ship(df.sparkSession)
        spec, columns = self.spec(), [c for c in self.columns() if c != "ord"]
        value = "long" if self.value_length <= 31 else "decimal(38,0)"
        kinds = [f"{c} array<{value if c == 'value' else 'bigint'}>" for c in columns]
        schema = ", ".join([f"seq_id {df.schema['seq_id'].dataType.simpleString()}", *kinds])

        def run(batches):
            return kernel.run_array_batches(batches, spec, columns)

        return df.select("seq_id", "seq").mapInArrow(run, schema)

    def _run_spread(self, sequences: DataFrame, size: int) -> DataFrame:
        """Each chunk owns ``size`` windows and reads one more on the left, to see repeats."""
        spec = replace(self.spec(), super_kmers=False)
        own = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq") - self.length, F.lit(0)).cast("long"), F.lit(size).cast("long")))
        chunks = sequences.where(F.length("seq") >= self.length).select("seq_id", "seq", own.alias("own"))
        left = F.when(F.col("own") > 0, 1).otherwise(0)
        cut = F.substring("seq", (F.col("own") - left + 1).cast("int"), F.lit(size + self.length - 1) + left)
        id_type = sequences.schema["seq_id"].dataType.simpleString()
        pieces = chunks.select(F.struct("seq_id", "own", F.length("seq").alias("n")).alias("seq_id"), cut.alias("seq"))
        pieces = pieces.repartition(max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
        columns = ["win", "pos"] + ["value"] * self.want_values
        value = "long" if self.value_length <= 31 else "decimal(38,0)"

        def run(batches):
            return kernel.run_batches(batches, replace(spec, select="window" if spec.select == "minimizer" else spec.select), columns)

        schema = f"seq_id struct<seq_id: {id_type}, own: bigint, n: int>, win long, pos long" + f", value {value}" * self.want_values
        found = pieces.mapInArrow(run, schema)
        shift = F.col("seq_id.own") - F.when(F.col("seq_id.own") > 0, 1).otherwise(0)
        placed = found.select(
            F.col("seq_id.seq_id").alias("seq_id"),
            F.col("seq_id.own").alias("own"),
            F.col("seq_id.n").cast("long").alias("n"),
            (F.col("win") + shift).alias("win"),
            (F.col("pos") + shift).alias("pos"),
            *["value"] * self.want_values,
        )
        chunk = Window.partitionBy("seq_id", "own").orderBy("win")
        if self.select == "minimizer":
            before = F.lag("pos").over(chunk)
            placed = placed.withColumn("_b", before).where((F.col("win") >= F.col("own")) & (F.col("_b").isNull() | (F.col("_b") != F.col("pos"))))
        else:
            placed = placed.where(F.col("win") >= F.col("own"))
        # Rows of one sequence are numbered by range, not in one task; a super-k-mer meets the next one's start by number.
        found = numbered(placed, ["seq_id"], ["win"]).withColumnRenamed("row", "ord")
        if self.want_super_kmers:
            found = checkpointed(found)
            after = found.select(F.col("seq_id").alias("_id"), (F.col("ord") - 1).alias("_ord"), (F.col("win") + self.length - 1).alias("_end"))
            found = found.join(after, F.col("seq_id").eqNullSafe(F.col("_id")) & (F.col("ord") == F.col("_ord")), "left")
            found = found.withColumn("sk_start", F.col("win")).withColumn("sk_end", F.coalesce("_end", "n"))
        return found.select("seq_id", *self.columns())


def minimizers(k: int, w: int, canonical: bool = False) -> Sketch:
    """The position of the smallest k-mer hash of each window of ``w`` k-mers, repeats left out."""
    return Sketch(k, w, "minimizer", canonical)


def canonical_minimizers(k: int, w: int) -> Sketch:
    return Sketch(k, w, "minimizer", True)


def window_minimizers(k: int, w: int, canonical: bool = False) -> Sketch:
    """The position of every window, repeats included."""
    return Sketch(k, w, "window", canonical)


def closed_syncmers(k: int, w: int, canonical: bool = False) -> Sketch:
    """Windows whose smallest k-mer is their first or last; ``pos`` is the window's start."""
    return Sketch(k, w, "closed", canonical)


def open_syncmers(k: int, w: int, canonical: bool = False) -> Sketch:
    """Windows whose smallest k-mer is the middle one."""
    return Sketch(k, w, "open", canonical)


#: Extension: the plain name means the closed kind.
syncmers = closed_syncmers


def minimizer_positions(df: DataFrame, k: int, w: int) -> DataFrame:
    return minimizers(k, w).run(df)


def canonical_minimizer_positions(df: DataFrame, k: int, w: int) -> DataFrame:
    return minimizers(k, w, canonical=True).run(df)


def one_minimizer(df: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """``seq_id, pos``: each whole sequence as one window; null if it has no k-mer."""
    hash = nt_hash(k, canonical)
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        from seqloom.functions.encode import CODES

        for batch in batches:
            data, starts, lengths = kernel.letters_of(batch.column(1))
            found = []
            for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                letters = CODES[data[a : a + n]]
                if n < k:
                    found.append(None)
                    continue
                if (letters > 3).any():
                    raise ValueError("a letter is no base")
                order = hash.order(letters)
                left = int(order.argmin())
                right = n - k - int(order[::-1].argmin())
                found.append(left if not canonical or 2 * int((letters & 2 > 0).sum()) > n else right)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["seq_id", "pos"])

    kind = df.schema["seq_id"].dataType.simpleString()
    return df.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, pos long")


def kmer_hashes(df: DataFrame, hash: Hasher) -> DataFrame:
    """``seq_id, pos, h`` of every k-mer; 64-bit hashes as signed longs with the same bits."""
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        from seqloom.functions.encode import CODES

        for batch in batches:
            data, starts, lengths = kernel.letters_of(batch.column(1))
            for at in range(0, len(batch), 256):
                some = slice(at, min(at + 256, len(batch)))
                lo, hi = int(starts[some][0]), int(starts[some][-1] + lengths[some][-1])
                letters = CODES[data[lo:hi]] if hash.alphabet == "dna" else data[lo:hi]
                if hash.alphabet == "dna" and (letters > 3).any():
                    raise ValueError("a letter is no base")
                h = hash.hashes(letters)
                owner = np.repeat(np.arange(some.start, some.stop), lengths[some])[: len(h)]
                place = np.arange(len(h)) + lo - starts[owner]
                ok = place + hash.k <= lengths[owner]
                arrays = [batch.column(0).take(pa.array(owner[ok])), pa.array(place[ok], pa.int64()), pa.array(h[ok].astype(np.int64))]
                yield pa.record_batch(arrays, names=["seq_id", "pos", "h"])

    kind = df.schema["seq_id"].dataType.simpleString()
    return df.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, pos long, h long")


def super_kmer_strings(sketched: DataFrame, sequences: DataFrame) -> DataFrame:
    """``seq_id, ord, super_kmer`` for rows with ``sk_start`` and ``sk_end``."""
    joined = sketched.join(sequences.select("seq_id", "seq"), "seq_id")
    text: Column = F.substring(F.col("seq"), (F.col("sk_start") + 1).cast("int"), (F.col("sk_end") - F.col("sk_start")).cast("int"))
    return joined.select("seq_id", "ord", text.alias("super_kmer"))


def kmer_flags_and_digits(df: DataFrame, k: int, digits: bool) -> DataFrame:
    """``seq_id, pos`` of every k-mer, with ``ambiguous``, or with ``digits, canonical`` as base-4 digits of its value."""
    ship(df.sparkSession)
    step = 1 << 14

    def run(batches):
        import pyarrow as pa

        from seqloom.functions.encode import CODES

        for batch in batches:
            for at, text in enumerate(batch.column(1)):
                seq = (text.as_py() or "").upper()
                if len(seq) < k:
                    continue
                if digits:
                    ahead = seq.translate(str.maketrans("ACTG", "0123"))
                    back, other = ahead[::-1], seq.translate(str.maketrans("ACTG", "2301"))
                else:
                    letters = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
                    odd = np.concatenate([[0], np.cumsum(CODES[letters] > 3)])
                for lo in range(0, len(seq) - k + 1, step):
                    hi = min(lo + step, len(seq) - k + 1)
                    owner = batch.column(0).take(pa.array(np.full(hi - lo, at)))
                    arrays, names = [owner, pa.array(np.arange(lo, hi), pa.int64())], ["seq_id", "pos"]
                    if digits:
                        own = [back[len(seq) - i - k : len(seq) - i] for i in range(lo, hi)]
                        arrays += [pa.array(own), pa.array([min(x, other[i : i + k]) for i, x in enumerate(own, lo)])]
                        names += ["digits", "canonical"]
                    else:
                        arrays.append(pa.array(odd[lo + k : hi + k] > odd[lo:hi]))
                        names.append("ambiguous")
                    yield pa.record_batch(arrays, names=names)

    kind = df.schema["seq_id"].dataType.simpleString()
    columns = "digits string, canonical string" if digits else "ambiguous boolean"
    return df.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, pos long, {columns}")
