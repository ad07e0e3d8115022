import random

import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.functions import encode
from seqloom.functions.hashers import nt_hash
from seqloom.operators import sketch as S
from seqloom.operators import sliding, stats, streams


def stream(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v int")


def test_adjacent_dedup(spark):
    rng = random.Random(11)
    values = [rng.choice([1, 1, 1, 2, 3]) for _ in range(200)]
    starts = [i for i, v in enumerate(values) if i == 0 or values[i - 1] != v]
    df = stream(spark, values)
    assert [(r["i"], r["v"]) for r in streams.adjacent_dedup(df, ["g"], ["i"], "v").orderBy("i").collect()] == [(i, values[i]) for i in starts]
    rows = streams.adjacent_dedup_with_index(df, ["g"], ["i"], "v").orderBy("i").collect()
    assert [r["index"] for r in rows] == starts
    kept = streams.adjacent_dedup(df, ["g"], ["i"], "v", F.col("v") == 2).orderBy("i").collect()
    assert [r["i"] for r in kept] == [i for i in starts if values[i] != 2]
    assert streams.adjacent_dedup(df.limit(0), ["g"], ["i"], "v").count() == 0


@pytest.mark.parametrize("kind,places", [("closed", {0, 6}), ("open", {3})])
def test_filter_syncmers(spark, kind, places):
    rng = random.Random(12)
    rows = [(i, i + rng.randrange(7)) for i in range(300)]
    df = spark.createDataFrame(rows, "win long, pos long")
    assert sorted(r["win"] for r in streams.filter_syncmers(df, 7, kind).collect()) == [i for i, p in rows if p - i in places]


@pytest.mark.parametrize("w", [1, 3, 33, 50])
@pytest.mark.parametrize("ties", ["left", "right"])
@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("spread", [None, 9])
def test_sliding_min(spark, w, ties, partial, spread):
    rng = random.Random(w)
    rows = [(g, i, rng.choice([None, 1, 2, 3])) for g in (1, 2) for i in range(70 if g == 1 else 20)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    got = {(r["g"], r["row"]): (r["min_value"], r["min_row"]) for r in sliding.sliding_min(df, ["g"], ["i"], "v", w, ties, partial, spread).collect()}
    want = {}
    for g in (1, 2):
        v = [x[2] for x in rows if x[0] == g]
        for i in range(len(v)):
            at = range(max(0, i - w + 1), i + 1) if partial else range(i, i + w)
            if not partial and i + w > len(v):
                continue
            known = [(v[j], j if ties == "left" else -j) for j in at if v[j] is not None]
            best = min(known, default=(None, None))
            want[g, i] = (best[0], best[1] if ties == "left" or best[1] is None else -best[1])
    assert got == want


def test_numbered(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i) for i in range(300)]
    rng.shuffle(rows)
    got = sliding.numbered(spark.createDataFrame(rows, "g int, i int"), ["g"], ["i"]).collect()
    for g in (None, 1, 2):
        own = sorted(i for k, i in rows if k == g)
        assert sorted((r["row"], r["i"]) for r in got if r["g"] == g) == list(enumerate(own))
        assert {r["size"] for r in got if r["g"] == g} == {len(own)}


def test_jumping(spark, lists):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (0, 10, 11, 12, 60, 200)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    got = lists(sliding.jumping_minimizers(df, 5, 7, nt_hash(5)))
    assert set(got) == {2, 3, 4, 5}
    for i, found in got.items():
        order = nt_hash(5).order(encode.CODES[list(seqs[i].encode())]).tolist()
        want, start = [], 0
        while start < len(order) - 7:
            p = min(range(start, start + 7), key=lambda j: order[j])
            want.append(p)
            start = p + 1
        p = min(range(len(order) - 7, len(order)), key=lambda j: order[j])
        assert found == (want if want and want[-1] == p else [*want, p])


def test_collected_and_density(spark):
    df = spark.createDataFrame([(1, "ACGTGCTCAGAGACTCAG", "a"), (2, "ACG", "a"), (3, "", "b")], "seq_id long, seq string, lang string")
    found = S.minimizers(5, 7).run(df)
    assert [r["positions"] for r in streams.collected(found).collect()] == [[4, 5, 8, 13]]
    counted = stats.counts_per_sequence(found, df)
    rows = {r["lang"]: r for r in stats.density(counted, ["lang"]).collect()}
    assert rows["a"]["n_sampled"] == 4 and rows["a"]["n_bases"] == 21 and rows["b"]["density"] is None
    moments = {r["lang"]: r for r in stats.count_moments(counted, ["lang"]).collect()}
    assert moments["a"]["mean"] == 2 and moments["a"]["variance"] == 4 and moments["a"]["std_dev"] == 2


def test_report(spark, tmp_path):
    rows = [("external", f"{c}x", 10, 5, w, t) for c in ("", "canonical ") for w in (3, 5) for t in (1.0, 2.0, 6.0)]
    df = spark.createDataFrame(rows, stats.RESULTS)
    from seqloom.sources.generate import read_results, write_results

    write_results(df, str(tmp_path / "r"))
    back = stats.report_rows(read_results(spark, str(tmp_path / "r")), "external")
    assert back.where("canonical").count() == 6 and {r["name"] for r in back.collect()} == {"x"}
    table = stats.median_pivot(back, "name", ["w", "k", "canonical"], "time")
    assert table.columns == ["name", "3_5_false", "3_5_true", "5_5_false", "5_5_true"] and table.first()[1] == 2.0
    assert stats.median_lines(back).count() == 4
    assert "| x | 2.00 |" in stats.as_org_table(table) and "tabular" in stats.as_latex(table)


def test_scalar_encodings(spark):
    row = spark.createDataFrame([("CACGT",)], "s string").select(
        encode.kmer_value(F.col("s"), 5).alias("v"),
        encode.canonical_value(F.col("s"), 5).alias("c"),
        encode.reverse_complement(F.col("s")).alias("r"),
        encode.swap_gt(F.col("s")).alias("g"),
        encode.is_ambiguous(F.lit("ACN")).alias("a"),
        encode.slice_bases(F.col("s"), 1, 3).alias("x"),
    ).first()
    assert (row["v"], row["r"], row["g"], row["a"], row["x"]) == (0b10_11_01_00_01, "ACGTG", "CACTG", True, "AC")
    assert row["c"] == min(row["v"], 0b11_10_11_01_00)
    for n in (31, 32, 40, 63):
        s = ("ACTTG" * 13)[:n]
        got = spark.createDataFrame([(s,)], "s string").select(encode.kmer_value(F.col("s"), n).cast("string")).first()[0]
        assert int(got) == sum("ACTG".index(c) << 2 * j for j, c in enumerate(s))


def test_every_kmer_is_flagged_and_has_digits(spark):
    import random

    from seqloom.functions import encode
    from seqloom.operators import sketch
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ACGT" * 9 + "N", k=n))) for i, n in enumerate((0, 20, 21, 63, 64, 300))] + [(6, None)]
    flags = {(r[0], r[1]): r[2] for r in sketch.kmer_flags_and_digits(spark.createDataFrame(rows, "seq_id long, seq string"), 21, False).collect()}
    assert flags == {(i, p): "N" in s[p : p + 21] for i, s in rows if s for p in range(len(s) - 20)} and any(flags[5, p] for p in range(21, 280))
    rows = [(i, s.replace("N", "A") if s else s) for i, s in rows]
    got = {(r[0], r[1]): (r[2], r[3]) for r in sketch.kmer_flags_and_digits(spark.createDataFrame(rows, "seq_id long, seq string"), 64, True).collect()}
    kmers = [(i, p, s[p : p + 64]) for i, s in rows if s for p in range(len(s) - 63)]
    column = F.col("k")
    want = spark.createDataFrame(kmers, "i long, p long, k string").select("i", "p", encode.value_digits(column), encode.value_digits(column, True))
    assert got == {(r[0], r[1]): (r[2], r[3]) for r in want.collect()} and len(got) == 238


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_spread_runs_are_the_plain_ones(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([1, 1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(4)
    key = lambda r: str(tuple(r))
    for op in (streams.adjacent_dedup, streams.adjacent_dedup_with_index, streams.islands):
        assert sorted(op(df, ["g"], ["i"], "v", spread=size).collect(), key=key) == sorted(op(df, ["g"], ["i"], "v").collect(), key=key)
    skipped = [sorted(streams.adjacent_dedup(df, ["g"], ["i"], "v", F.col("v") == 2, spread=s).collect(), key=key) for s in (None, size)]
    assert skipped[0] == skipped[1]


def test_public_names():
    import seqloom

    assert seqloom.minimizers is S.minimizers and all(getattr(seqloom, n) is not None for n in seqloom.__all__)
    with pytest.raises(AttributeError):
        seqloom.no_such_name  # noqa: B018


def test_column_hash_is_the_hash_of_each_kmer(spark):
    def signed(kmer):
        h = xxhash.xxh64_intdigest(kmer.encode(), seed=42)
        return h - (1 << 64) if h >> 63 else h

    rng = random.Random(11)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (0, 10, 11, 12, 60, 300)] + ["A" * 40]
    k, w = 5, 7
    want = set()
    for i, s in enumerate(seqs):
        h = [signed(s[j : j + k]) for j in range(len(s) - k + 1)]
        best = [min(range(j, j + w), key=lambda x: (h[x], x)) for j in range(len(h) - w + 1)]
        want |= {(i, n, p) for n, p in enumerate(p for j, p in enumerate(best) if not j or best[j - 1] != p)}
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    got = sliding.hashed_minimizers(df, k, w, F.xxhash64).select("seq_id", "ord", "pos").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_column_hash_takes_sequences_in_pieces(spark):
    rng = random.Random(12)
    sizes = (0, 10, 11, 12, 60, 1033, 1034, 1035, 1036, 2058, 2059, 3000)
    seqs = [*("".join(rng.choices("ACGT", k=n)) for n in sizes), "A" * 2500, "".join(rng.choices("ACGTé😀", k=2500)), None]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    for hash in (F.xxhash64, F.md5, lambda c: F.when(F.xxhash64(c) % 3 > 0, F.xxhash64(c) % 5)):
        found = sliding.hashed_minimizers(df, 5, 7, hash)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, sliding._hashed_by_rows(df, 5, 7, hash).collect()), key=str)
    python = F.udf(lambda kmer: kmer[::-1])
    assert sorted(sliding.hashed_minimizers(df, 5, 7, python).collect()) == sorted(sliding.hashed_minimizers(df, 5, 7, F.reverse).collect())


def test_column_hash_shuffles_and_sorts_nothing(spark):
    df = spark.range(3).select(F.col("id").alias("seq_id"), F.repeat(F.lit("ACGT"), 20).alias("seq"))
    for hash in (F.xxhash64, F.md5):
        plan = sliding.hashed_minimizers(df, 5, 7, hash)._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Exchange", "Sort", "Window"))
