"""The relational strategy: the same results from window functions alone.

One row per base.  Rolling hashes are differences of one running XOR, strand and ambiguity counts
differences of running sums, and the sampled position is a minimum over a ROWS frame.  The
frame costs O(w) per row, so this suits small windows, plain SQL engines and cross-checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqloom.functions import encode
from seqloom.functions.hashers import Hasher
from seqloom.plans.kernel import Spec

MASK = 0xFFFFFFFF


def by_position() -> WindowSpec:
    return Window.partitionBy("seq_id").orderBy("pos")


def _shift(name: str, x: Column, r: Column | int) -> Column:
    return F.call_function(name, x, (F.lit(r) if isinstance(r, int) else r).cast("int"))


def rotl32(x: Column, r: Column) -> Column:
    """A 32-bit number in a long, rotated left by 0 to 31."""
    return _shift("shiftleft", x, r).bitwiseAND(MASK).bitwiseOR(_shift("shiftright", x, F.lit(32) - r))


def rotr32(x: Column, r: Column) -> Column:
    return rotl32(x, F.pmod(F.lit(32) - r, F.lit(32)))


def bases(sequences: DataFrame, alphabet: str = "dna") -> DataFrame:
    """``seq_id, n, pos, letter, amb``: letters are codes of DNA or bytes of UTF-8 text."""
    if alphabet == "dna":
        letters = F.split(F.upper("seq"), "")
        exploded = sequences.select("seq_id", F.length("seq").cast("long").alias("n"), F.posexplode(letters).alias("pos", "c")).where("c <> ''")
        return exploded.select(
            "seq_id",
            "n",
            F.col("pos").cast("long"),
            encode.base_code(F.col("c")).alias("letter"),
            (~F.col("c").isin("A", "C", "G", "T")).cast("long").alias("amb"),
        )
    digits = F.hex(F.col("seq").cast("binary"))
    pairs = F.split(digits, "(?<=\\G..)")
    exploded = sequences.select("seq_id", (F.length(digits) / 2).cast("long").alias("n"), F.posexplode(pairs).alias("pos", "c")).where("c <> ''")
    return exploded.select("seq_id", "n", F.col("pos").cast("long"), F.conv("c", 16, 10).cast("long").alias("letter"), F.lit(0).cast("long").alias("amb"))


def _terms(hasher: Hasher, letter: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t).cast("long") for t in hasher.terms]), (letter + 1).cast("int"))


def _antilex(letter: str, k: int, backwards: bool) -> Column:
    """The k-mer starting at this row, or its reverse complement, in anti-lexicographic order."""
    total = F.lit(0).cast("long")
    for j in range(min(k, 16)):
        code = F.lead(letter, k - 1 - j if backwards else j).over(by_position()) if (k - 1 - j if backwards else j) else F.col(letter)
        code = code.bitwiseXOR(2) if backwards else code
        total = total + _shift("shiftleft", (F.lit(3) - code) if j == 0 else code, 30 - 2 * j)
    return total


def kmers(rows: DataFrame, hasher: Hasher) -> DataFrame:
    """``bases`` rows with the hash ``h`` of the k-mer that starts there; null where none does."""
    k = hasher.k
    if hasher.name == "antilex":
        h = _antilex("letter", k, False)
        if hasher.canonical:
            h = (h + _antilex("letter", k, True)).bitwiseAND(MASK)
        return rows.withColumn("h", F.when(F.col("pos") <= F.col("n") - k, h))
    if hasher.bits != 32 or not hasher.terms:
        raise ValueError(f"hash {hasher.name} has no relational form; use the arrow strategy")
    turn = F.pmod(F.col("pos") * hasher.rotation, F.lit(32))
    other = F.col("letter").bitwiseXOR(2) if hasher.alphabet == "dna" else F.col("letter")
    scans = {"_p": F.bit_xor(rotr32(_terms(hasher, F.col("letter")), turn)).over(by_position().rowsBetween(Window.unboundedPreceding, 0))}
    if hasher.canonical:
        scans["_q"] = F.bit_xor(rotl32(_terms(hasher, other), turn)).over(by_position().rowsBetween(Window.unboundedPreceding, 0))
    scanned = rows.withColumns(scans)

    def part(scan: str) -> Column:
        return F.lead(scan, k - 1).over(by_position()).bitwiseXOR(F.lag(scan, 1, 0).over(by_position())) if k > 1 else F.col(scan).bitwiseXOR(F.lag(scan, 1, 0).over(by_position()))

    parts = scanned.withColumns({s: part(s) for s in scans})
    h = rotl32(F.col("_p"), F.pmod((F.col("pos") + k - 1) * hasher.rotation, F.lit(32)))
    if hasher.canonical:
        h = (h + rotr32(F.col("_q"), turn)).bitwiseAND(MASK)
    return parts.withColumn("h", h).drop(*scans)


def window_positions(sequences: DataFrame, spec: Spec) -> DataFrame:
    """``seq_id, n, win, pos, strand, n_amb`` for every complete window."""
    w, length = spec.w, spec.length
    rows = kmers(bases(sequences, spec.hasher.alphabet), spec.hasher)
    order = _shift("shiftright", F.col("h"), 16) if spec.hasher.top16 else F.col("h")
    frame, wide = by_position().rowsBetween(0, w - 1), by_position().rowsBetween(0, length - 1)
    low = F.min(_shift("shiftleft", order, 32) + F.col("pos")).over(frame)
    high = F.max(_shift("shiftleft", F.lit(MASK if not spec.hasher.top16 else 0xFFFF) - order, 31 if not spec.hasher.top16 else 32) + F.col("pos")).over(frame)
    found = rows.withColumns(
        {
            "_l": low.bitwiseAND(MASK),
            "_r": high.bitwiseAND(MASK if spec.hasher.top16 else MASK >> 1),
            "strand": (2 * F.sum((F.col("letter").bitwiseAND(2) > 0).cast("long")).over(wide) > length),
            "n_amb": F.sum("amb").over(wide),
        }
    ).where(F.col("pos") <= F.col("n") - length)
    if spec.canonical:
        chosen = F.when(F.col("strand"), F.col("_l")).otherwise(F.col("_r"))
    else:
        chosen = F.col("_r") if spec.rightmost else F.col("_l")
    return found.select("seq_id", "n", F.col("pos").alias("win"), chosen.alias("pos"), "strand", "n_amb")


def sketch(sequences: DataFrame, spec: Spec) -> DataFrame:
    """The same columns as the vectorised strategy."""
    found = window_positions(sequences, spec)
    if spec.skip_ambiguous:
        found = found.where("n_amb = 0")
    elif spec.hasher.alphabet == "dna":
        found = found.withColumn("pos", F.when(F.col("n_amb") == 0, F.col("pos")).otherwise(F.raise_error(F.lit("a letter is no base; use skip_ambiguous")).cast("long")))
    along = Window.partitionBy("seq_id").orderBy("win")
    if spec.select == "minimizer":
        before = F.lag("pos").over(along)
        found = found.withColumn("_new", before.isNull() | (before != F.col("pos"))).where("_new")
    elif spec.select == "closed":
        found = found.where((F.col("pos") == F.col("win")) | (F.col("pos") == F.col("win") + spec.w - 1)).withColumn("pos", F.col("win"))
    elif spec.select == "open":
        found = found.where(F.col("pos") == F.col("win") + spec.w // 2).withColumn("pos", F.col("win"))
    found = found.withColumn("ord", F.row_number().over(along).cast("long") - 1)
    columns = ["seq_id", "win", "pos"] if spec.select == "window" else ["seq_id", "ord", "pos"]
    if spec.super_kmers:
        found = found.withColumn("sk_start", F.col("win")).withColumn(
            "sk_end", F.coalesce(F.lead("win").over(along) + spec.length - 1, F.col("n"))
        )
        columns += ["sk_start", "sk_end"]
    if spec.value_length:
        kmer = F.substring(F.col("seq"), (F.col("pos") + 1).cast("int"), F.lit(spec.value_length))
        value = encode.canonical_value(kmer, spec.value_length) if spec.canonical else encode.kmer_value(kmer, spec.value_length)
        found = found.join(sequences.select("seq_id", "seq"), "seq_id").withColumn("value", value)
        columns.append("value")
    return found.select(columns)
