"""Registered queries and, under the same names, DuckDB SQL with the same result.

Sequences are the DNA letters of each document's text (``seq_id`` is ``doc_id``), over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import oracle
from seqloom.functions import encode, hashers
from seqloom.operators import sketch as S
from seqloom.operators import sliding, stats, streams
from seqloom.session import parallel, read_table, shared_path
from seqloom.sources import fasta, generate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def sequences(spark: SparkSession, sf_dir: str, keep_n: bool = False) -> DataFrame:
    """The DNA projection of the documents, with their language."""
    docs = parallel(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return docs.select(F.col("doc_id").alias("seq_id"), encode.dna_only(F.coalesce("text", F.lit("")), keep_n).alias("seq"), "lang")


def ascii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E]", "").alias("seq"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def sketched(name: str, built: S.Sketch, sql: str, strategy: str = "arrow", keep_n: bool = False, source=None, spread=None) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = source(spark, sf_dir) if source else sequences(spark, sf_dir, keep_n)
        found = built.run(data, strategy=strategy, spread=spread)
        if dict(found.dtypes).get("value", "").startswith("decimal"):
            found = found.withColumn("value", F.col("value").cast("string"))
        return found


SUPER = "seq_id, ord, pos, sk_start, sk_end"

# Minimizers, per window and without repeats; super-k-mers; values.
sketched("fwd_minimizers", S.minimizers(21, 11), oracle.sketch())
sketched("fwd_minimizers_sql", S.minimizers(5, 7), oracle.sketch(k=5, w=7), strategy="sql")
sketched("fwd_minimizers_spread", S.minimizers(19, 19).super_kmers(), oracle.sketch(SUPER, k=19, w=19), spread=500)
sketched("fwd_window_minimizers", S.window_minimizers(21, 11), oracle.sketch(kind="window"))
sketched("canonical_minimizers", S.canonical_minimizers(21, 11), oracle.sketch(canonical=True))
sketched("canonical_minimizers_sql", S.canonical_minimizers(5, 7), oracle.sketch(k=5, w=7, canonical=True), strategy="sql")
sketched("canonical_window_minimizers", S.window_minimizers(5, 7, canonical=True), oracle.sketch(k=5, w=7, kind="window", canonical=True))
sketched(
    "canonical_hash_forward",
    S.minimizers(21, 11).hasher(hashers.nt_hash(21, canonical=True)),
    oracle.sketch(canonical=True).replace("CASE WHEN strand THEN l ELSE r END", "l"),
)
sketched("fwd_super_kmers", S.minimizers(21, 11).super_kmers(), oracle.sketch(SUPER))
sketched("canonical_super_kmers", S.canonical_minimizers(19, 19).super_kmers(), oracle.sketch(SUPER, k=19, w=19, canonical=True))
sketched("fwd_values", S.minimizers(21, 11).with_values(), oracle.sketch(value_length=21))
sketched("canonical_values", S.canonical_minimizers(5, 7).with_values(), oracle.sketch(k=5, w=7, canonical=True, value_length=5))
sketched("canonical_values_sql", S.canonical_minimizers(5, 7).with_values(), oracle.sketch(k=5, w=7, canonical=True, value_length=5), strategy="sql")
sketched("wide_values", S.canonical_minimizers(41, 11).with_values(), oracle.sketch(k=41, w=11, canonical=True, value_length=41))

# Syncmers.
sketched("closed_syncmers", S.closed_syncmers(21, 11), oracle.sketch(kind="closed"))
sketched("open_syncmers", S.open_syncmers(21, 11), oracle.sketch(kind="open"))
sketched("canonical_closed_syncmers", S.closed_syncmers(21, 11, canonical=True), oracle.sketch(kind="closed", canonical=True))
sketched("canonical_open_syncmers", S.open_syncmers(21, 11, canonical=True), oracle.sketch(kind="open", canonical=True))
sketched("closed_syncmer_values", S.closed_syncmers(9, 7).with_values(), oracle.sketch(k=9, w=7, kind="closed", value_length=15))
sketched(
    "canonical_open_syncmer_values",
    S.open_syncmers(21, 11, canonical=True).with_values(),
    oracle.sketch(kind="open", canonical=True, value_length=31),
)
sketched("closed_syncmers_sql", S.closed_syncmers(5, 7, canonical=True), oracle.sketch(k=5, w=7, kind="closed", canonical=True), strategy="sql")
sketched("open_syncmers_sql", S.open_syncmers(5, 7), oracle.sketch(k=5, w=7, kind="open"), strategy="sql")

# Ambiguous windows left out.
for _name, _built, _kind in (
    ("skip_ambiguous_minimizers", S.canonical_minimizers(3, 3), "minimizer"),
    ("skip_ambiguous_closed_syncmers", S.closed_syncmers(3, 3, canonical=True), "closed"),
    ("skip_ambiguous_open_syncmers", S.open_syncmers(3, 3, canonical=True), "open"),
):
    sketched(_name, _built.skip_ambiguous(), oracle.sketch(k=3, w=3, kind=_kind, canonical=True, skip=True), keep_n=True)
sketched(
    "skip_ambiguous_minimizers_sql",
    S.canonical_minimizers(3, 3).skip_ambiguous(),
    oracle.sketch(k=3, w=3, canonical=True, skip=True),
    strategy="sql",
    keep_n=True,
)

# Other hashes.
sketched(
    "mul_minimizers_text",
    S.minimizers(9, 11).hasher(hashers.mul_hash(9)),
    oracle.sketch(k=9, w=11, hash="mul_text", source=oracle.ASCII_TEXT, alphabet="text"),
    source=ascii_text,
)
sketched(
    "mul_canonical_text",
    S.canonical_minimizers(9, 11).hasher(hashers.mul_hash(9, canonical=True)),
    oracle.sketch(k=9, w=11, canonical=True, hash="mul_text", source=oracle.ASCII_TEXT, alphabet="text"),
    source=ascii_text,
)
sketched(
    "mul_canonical_minimizers",
    S.canonical_minimizers(21, 11).hasher(hashers.mul_hash(21, canonical=True, alphabet="dna")),
    oracle.sketch(canonical=True, hash="mul"),
)
sketched(
    "mul_minimizers_sql", S.minimizers(5, 7).hasher(hashers.mul_hash(5, alphabet="dna")), oracle.sketch(k=5, w=7, hash="mul"), strategy="sql"
)
sketched("antilex_minimizers", S.minimizers(21, 11).hasher(hashers.antilex_hash(21)), oracle.sketch(hash="antilex"))
sketched(
    "antilex_canonical_minimizers",
    S.canonical_minimizers(9, 7).hasher(hashers.antilex_hash(9, canonical=True)),
    oracle.sketch(k=9, w=7, canonical=True, hash="antilex"),
)
sketched(
    "antilex_minimizers_sql",
    S.canonical_minimizers(5, 7).hasher(hashers.antilex_hash(5, canonical=True)),
    oracle.sketch(k=5, w=7, canonical=True, hash="antilex"),
    strategy="sql",
)
sketched("seeded_minimizers", S.minimizers(21, 11).hasher(hashers.nt_hash(21, seed=42)), oracle.sketch(seed=42))
sketched("nthash64_minimizers", S.minimizers(21, 11).hasher(hashers.nt_hash64(21)), oracle.sketch(hash="nt64", alphabet="text"))
sketched("mulhash64_minimizers", S.minimizers(21, 11).hasher(hashers.mul_hash64(21)), oracle.sketch(hash="mul64", alphabet="text"))
sketched("fxpacked_minimizers", S.minimizers(15, 11).hasher(hashers.fx_packed_hash(15)), oracle.sketch(k=15, w=11, hash="fx"))


def _first_letters(letters: np.ndarray, k: int) -> np.ndarray:
    """A user's hash: the first base of the k-mer in the highest bits."""
    return letters[: len(letters) - k + 1].astype(np.uint32) << np.uint32(30)


sketched(
    "custom_hash_minimizers",
    S.minimizers(5, 7).hasher(_first_letters),
    "WITH " + ",\n".join([oracle.dna(), oracle.bases(), "kmers AS (SELECT *, letter << 30 AS h FROM bases)", oracle.windows(5, 7), oracle.select("minimizer", 5, 7)]) + "\nSELECT seq_id, ord, pos FROM picked",
)


@query("super_kmer_strings", oracle.sketch("seq_id, ord, substr(seq, sk_start + 1, sk_end - sk_start) AS super_kmer", k=5, w=7, canonical=True).replace("FROM picked", "FROM picked JOIN seqs USING (seq_id)"))
def super_kmer_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.canonical_minimizers(5, 7).super_kmers().with_strings().run(sequences(spark, sf_dir))
    return found.select("seq_id", "ord", "super_kmer")


for _name, _hash, _sql in (
    ("kmer_hashes_fwd", hashers.nt_hash(21), ("nt", 21, False)),
    ("kmer_hashes_canonical", hashers.nt_hash(21, canonical=True), ("nt", 21, True)),
):

    @query(_name, f"WITH {oracle.dna()},\n{oracle.bases()},\n{oracle.kmers(*_sql)}\nSELECT seq_id, pos, CAST(h AS BIGINT) AS h FROM kmers WHERE pos <= n - 21")
    def kmer_hashes(spark: SparkSession, sf_dir: str, hash: hashers.Hasher = _hash) -> DataFrame:
        return S.kmer_hashes(sequences(spark, sf_dir), hash)


@query("window_strand", f"WITH {oracle.dna()},\n{oracle.bases()},\n{oracle.kmers('nt', 5)},\n{oracle.windows(5, 7)}\nSELECT seq_id, win, strand FROM chosen")
def window_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.plans import relational

    return relational.window_positions(sequences(spark, sf_dir), S.minimizers(5, 7).spec()).select("seq_id", "win", "strand")


@query("ambiguous_windows", f"WITH {oracle.dna(keep_n=True)},\n{oracle.bases()},\n{oracle.kmers('nt', 3)},\n{oracle.windows(3, 3)}\nSELECT seq_id, count(*) AS n_windows, CAST(sum(CAST(n_amb > 0 AS INT)) AS BIGINT) AS n_ambiguous FROM chosen GROUP BY seq_id")
def ambiguous_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.plans import relational

    found = relational.window_positions(sequences(spark, sf_dir, keep_n=True), S.minimizers(3, 3).spec())
    return found.groupBy("seq_id").agg(F.count("*").alias("n_windows"), F.sum((F.col("n_amb") > 0).cast("long")).alias("n_ambiguous"))


@query("one_minimizer", f"WITH {oracle.dna()},\n{oracle.bases()},\n{oracle.kmers('nt', 21)},\nbest AS (SELECT seq_id, min(((h >> 16) << 32) + pos) & {oracle.M32} AS pos FROM kmers WHERE pos <= n - 21 GROUP BY seq_id)\nSELECT seq_id, CAST(best.pos AS BIGINT) AS pos FROM seqs LEFT JOIN best USING (seq_id)")
def one_minimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.one_minimizer(sequences(spark, sf_dir), 21)


@query("revcomp", f"WITH {oracle.dna()} SELECT seq_id, translate(reverse(seq), 'ACGT', 'TGCA') AS seq FROM seqs")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("seq_id", encode.reverse_complement(F.col("seq")).alias("seq"))


@query("sequence_slices", f"WITH {oracle.dna()} SELECT seq_id, substr(seq, 4, 40) AS seq, translate(substr(seq, 4, 40), 'GT', 'TG') AS swapped FROM seqs")
def sequence_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sequences(spark, sf_dir).select("seq_id", encode.slice_bases(F.col("seq"), 3, 43).alias("seq"))
    return cut.withColumn("swapped", encode.swap_gt(F.col("seq")))


@query("base_codes", f"WITH {oracle.dna()},\n{oracle.bases()}\nSELECT seq_id, pos, letter AS code FROM bases")
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.plans import relational

    return relational.bases(sequences(spark, sf_dir)).select("seq_id", "pos", F.col("letter").alias("code"))


EVENTS_SQL = """
WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row,
  count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT *, min({{'v': value, 'r': {sign}row}}) OVER (PARTITION BY user_id ORDER BY row ROWS BETWEEN {frame}) AS m FROM e)
SELECT event_id, user_id, row, m.v AS min_value, {sign}m.r AS min_row FROM m {where}
"""


def _events(name: str, w: int, ties: str, partial: bool, spread: int | None = None) -> None:
    frame = f"{w - 1} PRECEDING AND CURRENT ROW" if partial else f"CURRENT ROW AND {w - 1} FOLLOWING"
    sql = EVENTS_SQL.format(sign="" if ties == "left" else "-", frame=frame, where="" if partial else f"WHERE row <= n - {w}")

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
        found = sliding.sliding_min(events, ["user_id"], ["ts", "event_id"], "value", w, ties, partial, spread)
        return found.select("event_id", "user_id", "row", "min_value", "min_row")


_events("sliding_min_events", 4, "left", False)
_events("sliding_min_rightmost", 4, "right", False)
_events("sliding_min_partial", 5, "right", True)
_events("sliding_min_wide", 40, "left", True)
_events("sliding_min_spread", 6, "left", False, spread=20)
_events("sliding_min_spread_partial", 35, "right", True, spread=16)


@query("column_hash_minimizers", "WITH " + ",\n".join([oracle.dna(), """kmers AS (
  SELECT seq_id, length(seq) AS n, unnest(range(length(seq) - 4)) AS pos, unnest(list_transform(range(length(seq) - 4), lambda i: md5(substr(seq, CAST(i + 1 AS INTEGER), 5)))) AS h
  FROM seqs WHERE length(seq) >= 11),
found AS (SELECT seq_id, n, pos AS win, min({'h': h, 'p': pos}) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS m FROM kmers),
chosen AS (SELECT seq_id, n, win, m.p AS pos FROM found WHERE win <= n - 11)""", oracle.select("minimizer", 5, 7)]) + "\nSELECT seq_id, ord, pos FROM picked")
def column_hash_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.hashed_minimizers(sequences(spark, sf_dir), 5, 7, F.md5)


@query("xxhash64_minimizers")
def xxhash64_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers by a 64-bit hash that doesn't roll, compared as signed numbers; SQL has no such hash."""
    return sliding.hashed_minimizers(sequences(spark, sf_dir), 21, 11, F.xxhash64)


DIGITS = "translate(reverse({s}), 'ACTG', '0123')"


def _at_every_position(k: int) -> str:
    return f"p AS (SELECT seq_id, pos, substr(seq, CAST(pos + 1 AS INTEGER), {k}) AS k FROM (SELECT seq_id, seq, unnest(range(length(seq) - {k - 1})) AS pos FROM seqs WHERE length(seq) >= {k}))"


@query("ambiguous_kmers", f"WITH {oracle.dna(keep_n=True)}, {_at_every_position(21)} SELECT seq_id, pos, regexp_matches(k, '[^ACGTacgt]') AS ambiguous FROM p")
def ambiguous_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kmer_flags_and_digits(sequences(spark, sf_dir, keep_n=True), 21, False)


@query("value_digits", f"""WITH {oracle.dna()}, {_at_every_position(64)}
SELECT seq_id, pos, {DIGITS.format(s='k')} AS digits, least({DIGITS.format(s='k')}, {DIGITS.format(s="translate(reverse(k), 'ACGT', 'TGCA')")}) AS canonical FROM p""")
def value_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kmer_flags_and_digits(sequences(spark, sf_dir), 64, True)


@query("jumping_minimizers", "WITH RECURSIVE " + ",\n".join([oracle.dna(), oracle.bases(), oracle.kmers("nt", 5), oracle.windows(5, 7)]) + """,
jumps AS (
  SELECT seq_id, n, pos FROM chosen WHERE win = 0 AND n - 11 > 0
  UNION ALL SELECT c.seq_id, c.n, c.pos FROM jumps j JOIN chosen c ON c.seq_id = j.seq_id AND c.win = j.pos + 1 AND j.pos + 1 < j.n - 11),
both_ AS (SELECT seq_id, pos FROM jumps UNION SELECT seq_id, pos FROM chosen WHERE win = n - 11)
SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS ord, pos FROM both_""")
def jumping_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.jumping_minimizers(sequences(spark, sf_dir), 5, 7, hashers.nt_hash(5))


RUNS_SQL = """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index,
  count(*) OVER (PARTITION BY user_id) AS total FROM events),
f AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY index) <> event_type, true) AS fresh FROM e)
SELECT user_id, event_type, index, coalesce(lead(index) OVER (PARTITION BY user_id ORDER BY index), total) - index AS n FROM f WHERE fresh
"""


for _name, _spread in (("event_runs", None), ("event_runs_spread", 16)):

    @query(_name, RUNS_SQL)
    def event_runs(spark: SparkSession, sf_dir: str, spread: int | None = _spread) -> DataFrame:
        events = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
        return streams.islands(events, ["user_id"], ["ts", "event_id"], "event_type", spread).select("user_id", "event_type", "index", "n")


COLLECTED_SQL = oracle.sketch("seq_id, pos, ord")


@query("collected_positions", f"SELECT seq_id, string_agg(pos, ',' ORDER BY ord) AS positions FROM ({COLLECTED_SQL}) GROUP BY seq_id")
def collected_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.collected(S.minimizers(21, 11).run(sequences(spark, sf_dir)))
    return found.select("seq_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("minimizer_positions", oracle.sketch())
def minimizer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minimizer_positions(sequences(spark, sf_dir), 21, 11)


@query("canonical_minimizer_positions", oracle.sketch(canonical=True))
def canonical_minimizer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.canonical_minimizer_positions(sequences(spark, sf_dir), 21, 11)


RECORDS_SQL = f"WITH {oracle.dna()} SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM seqs"


@query("fasta_records", RECORDS_SQL)
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA and read back."""
    path = shared_path(spark)
    fasta.write_fasta(sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), "seq"), path)
    return fasta.read_fasta(spark, path).select("name", "seq")


@query("fastq_records", RECORDS_SQL)
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTQ, with the quality that looks like a record's start, and read back."""
    path = shared_path(spark)
    fasta.write_fastq(sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), "seq"), path, quality="@")
    return fasta.read_fastq(spark, path).select("name", "seq")


@query("json_results", "SELECT l_linestatus AS experiment, l_returnflag AS name, CAST(l_orderkey AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS k, CAST(l_partkey AS BIGINT) AS w, CAST(l_tax AS DOUBLE) AS time FROM lineitem")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing records written as JSON and read back."""
    path = shared_path(spark)
    names = {"l_linestatus": "experiment", "l_returnflag": "name", "l_orderkey": "n", "l_linenumber": "k", "l_partkey": "w", "l_tax": "time"}
    generate.write_results(read_table(spark, sf_dir, "lineitem").select(*[F.col(a).alias(b) for a, b in names.items()]), path)
    return generate.read_results(spark, path)


@query("random_sequence_shapes", "SELECT * FROM (VALUES ('dna', 300, 100, 100, 0, 300, 4), ('text', 300, 100, 100, 0, 300, 95)) AS t(kind, n, least, most, n_foreign, n_distinct, n_letters)")
def random_sequence_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for random sequences whatever the generator: lengths, letters, no repeats."""
    found = None
    for kind, letters in (("dna", "ACTG"), ("text", "".join(map(chr, range(32, 127))))):
        rows = generate.random_sequences(spark, 300, 100, seed=7, letters=letters)
        foreign = F.length(F.translate("seq", letters, ""))
        used = F.size(F.array_distinct(F.flatten(F.collect_list(F.split("seq", "")))))
        shape = rows.agg(
            F.lit(kind).alias("kind"),
            F.count("*").cast("int").alias("n"),
            F.min(F.length("seq")).alias("least"),
            F.max(F.length("seq")).alias("most"),
            F.max(foreign).alias("n_foreign"),
            F.countDistinct("seq").cast("int").alias("n_distinct"),
            used.alias("n_letters"),
        )
        found = shape if found is None else found.union(shape)
    return found


@query("syncmers_from_windows", oracle.sketch(k=5, w=7, kind="open", columns="seq_id, pos AS win"))
def syncmers_from_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.filter_syncmers(S.window_minimizers(5, 7).run(sequences(spark, sf_dir)), 7, "open").select("seq_id", "win")


COUNTED = "WITH " + oracle.sketch().removeprefix("WITH ").rsplit("SELECT", 1)[0].rstrip() + """,
counted AS (SELECT d.lang, s.seq, (SELECT count(*) FROM picked p WHERE p.seq_id = s.seq_id) AS x FROM seqs s JOIN documents d ON d.doc_id = s.seq_id)
"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = sequences(spark, sf_dir)
    return stats.counts_per_sequence(S.minimizers(21, 11).run(data), data)


@query("density_by_lang", COUNTED + "SELECT lang, CAST(sum(x) AS BIGINT) AS n_sampled, CAST(sum(length(seq)) AS BIGINT) AS n_bases, sum(x) / sum(length(seq)) AS density FROM counted GROUP BY lang")
def density_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.density(_counted(spark, sf_dir), ["lang"])


@query("count_moments_by_lang", COUNTED + "SELECT lang, count(*) AS n_sequences, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS std_dev FROM counted GROUP BY lang")
def count_moments_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.count_moments(_counted(spark, sf_dir), ["lang"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "std_dev")})


POSITIONS_SQL = oracle.sketch().rsplit("SELECT", 1)[0] + """SELECT seq_id, count(p.pos) AS n,
  coalesce(string_agg(p.pos, ',' ORDER BY p.pos), '') AS positions FROM seqs LEFT JOIN picked p USING (seq_id) GROUP BY seq_id"""


@query("position_arrays", POSITIONS_SQL)
def position_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.minimizers(21, 11).run_arrays(sequences(spark, sf_dir))
    return found.select("seq_id", F.size("pos").cast("long").alias("n"), F.array_join(F.col("pos").cast("array<string>"), ",").alias("positions"))


@query("position_checksum", oracle.sketch("CAST(sum(pos) AS BIGINT) AS checksum, count(*) AS n"))
def position_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.minimizers(21, 11).run(sequences(spark, sf_dir))
    return found.agg(F.sum("pos").alias("checksum"), F.count("*").alias("n"))


@query("median_pivot", """
SELECT l_returnflag, median(l_quantity) FILTER (l_linestatus = 'F') AS "F", median(l_quantity) FILTER (l_linestatus = 'O') AS "O",
  min(l_orderkey) AS first_seen FROM lineitem GROUP BY l_returnflag""")
def median_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    return stats.median_pivot(rows, "l_returnflag", ["l_linestatus"], "l_quantity", order="l_orderkey")


RESULTS_SQL = """
WITH r AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'canonical ' ELSE '' END || l_returnflag AS name, l_linenumber AS k, l_tax AS time,
  l_quantity AS n FROM lineitem),
s AS (SELECT contains(name, 'canonical ') AS canonical, replace(name, 'canonical ', '') AS name, k, time * 1e9 / n AS ns FROM r)
SELECT name, k, canonical, round(median(ns), 3) AS ns FROM s GROUP BY ALL
"""


@query("report_medians", RESULTS_SQL)
def report_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "canonical ").otherwise(""), "l_returnflag")
    results = lines.select(name.alias("name"), F.col("l_linenumber").alias("k"), F.col("l_tax").alias("time"), F.col("l_quantity").alias("n"))
    rows = stats.report_rows(results).withColumn("ns", stats.ns_per_element(F.col("time"), F.col("n")))
    return rows.groupBy("name", "k", "canonical").agg(F.round(F.median("ns"), 3).alias("ns"))


@query("random_sequences")
def random_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per length of random sequences: the simulation behind the variance report."""
    runs = [S.minimizers(5, 7).run(generate.random_sequences(spark, 200, n, seed=n)).withColumn("length", F.lit(n)) for n in (50, 100, 200)]
    rows = runs[0].union(runs[1]).union(runs[2])
    counts = rows.groupBy("length", "seq_id").agg(F.count("*").alias("n_sampled"))
    return stats.count_moments(counts, ["length"])
