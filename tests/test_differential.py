"""Strategies against each other and against the definition, on seeded random sequences."""

import random

import numpy as np
import pytest

from seqloom.functions.encode import CODES
from seqloom.functions.hashers import antilex_hash, fx_packed_hash, mul_hash, mul_hash64, nt_hash, nt_hash64
from seqloom.operators import sketch as S
from seqloom.operators.sliding import naive_minimizers
from seqloom.plans import kernel
from seqloom.plans.kernel import Spec

SIZES = (1, 2, 3, 4, 5, 8, 31, 33, 64)


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def positions(seq, spec, column="pos"):
    raw = np.frombuffer(seq.encode(), np.uint8)
    parts = [np.asarray(o[column]) for o in kernel.sketch(raw, np.array([0]), np.array([len(raw)]), spec)]
    return np.concatenate(parts).tolist() if parts else []


@pytest.mark.parametrize("make", [nt_hash, lambda k: mul_hash(k, alphabet="dna"), antilex_hash, nt_hash64, mul_hash64])
def test_kernel_is_naive(make):
    rng = random.Random(1)
    for k in SIZES:
        for w in SIZES:
            hash = make(k)
            for n in (0, 1, k + w - 2, k + w - 1, k + w, rng.randrange(100, 600)):
                seq = dna(rng, max(n, 0))
                raw = np.frombuffer(seq.encode(), np.uint8)
                letters = CODES[raw] if hash.alphabet == "dna" else raw
                assert positions(seq, Spec(k, w, hash)) == naive_minimizers(letters, k, w, hash)


def test_fx_packed_is_naive():
    rng = random.Random(2)
    for k in (1, 5, 16):
        seq = dna(rng, 300)
        h = fx_packed_hash(k)
        assert positions(seq, Spec(k, 7, h)) == naive_minimizers(CODES[np.frombuffer(seq.encode(), np.uint8)], k, 7, h)


@pytest.mark.parametrize("make", [nt_hash, lambda k, canonical: mul_hash(k, canonical, alphabet="dna"), antilex_hash])
def test_strand_symmetry(make):
    rng = random.Random(3)
    for k, w in ((5, 7), (1, 3), (21, 11), (31, 5), (6, 4), (33, 9)):
        for _ in range(5):
            seq = dna(rng, rng.randrange(k + w, 400))
            other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
            spec = Spec(k, w, make(k, True), canonical=True, value_length=k)
            a, b = positions(seq, spec), positions(other, spec)
            assert [len(seq) - k - p for p in b[::-1]] == a
            assert positions(seq, spec, "value") == positions(other, spec, "value")[::-1]
            sync = Spec(k, w, make(k, True), "closed", True)
            a, b = positions(seq, sync), positions(other, sync)
            assert [len(seq) - k - w + 1 - p for p in b[::-1]] == a


def test_case_and_batches():
    rng = random.Random(4)
    seqs = [dna(rng, rng.choice([0, 3, 11, 50, 300])) for _ in range(200)]
    spec = Spec(5, 7, nt_hash(5, True), canonical=True, super_kmers=True)
    assert positions(seqs[4].lower(), spec) == positions(seqs[4], spec)
    data = np.frombuffer("".join(seqs).encode(), np.uint8)
    lengths = np.array([len(s) for s in seqs])
    together = {}
    for out in kernel.sketch(data, np.cumsum(lengths) - lengths, lengths, spec):
        for row, *values in zip(out["row"].tolist(), out["ord"].tolist(), out["pos"].tolist(), out["sk_end"].tolist(), strict=True):
            together.setdefault(row, []).append(tuple(values))
    for i, s in enumerate(seqs):
        alone = list(zip(positions(s, spec, "ord"), positions(s, spec), positions(s, spec, "sk_end"), strict=True))
        assert together.get(i, []) == alone


@pytest.mark.parametrize("select", ["minimizer", "closed", "open", "window"])
def test_pieces_are_whole(monkeypatch, select):
    rng = random.Random(5)
    seq = dna(rng, 3000)
    spec = Spec(5, 7, nt_hash(5, True), select, True, super_kmers=select == "minimizer", value_length=5)
    columns = ("ord", "win", "pos", "value") + (("sk_end",) if select == "minimizer" else ())
    whole = [positions(seq, spec, c) for c in columns]
    monkeypatch.setattr(kernel, "PIECE", 100)
    assert [positions(seq, spec, c) for c in columns] == whole


def test_wide_values():
    seq = "ACGTTGCAAC" * 8
    spec = Spec(40, 3, nt_hash(40), value_length=40)
    raw = CODES[np.frombuffer(seq.encode(), np.uint8)].tolist()
    for p, v in zip(positions(seq, spec), positions(seq, spec, "value"), strict=True):
        assert v[0] | v[1] << 64 == sum(raw[p + j] << 2 * j for j in range(40))
    wide = np.array([[3, 0], [1 << 63, 1], [(1 << 64) - 1, (1 << 62) - 1]], np.uint64)
    assert [int(x) for x in kernel.arrow_value(wide, 63).to_pylist()] == [3, 3 << 63, (1 << 126) - 1]


@pytest.mark.parametrize("k,w", [(1, 1), (2, 8), (5, 7), (21, 11)])
def test_sql_is_arrow(spark, k, w):
    rng = random.Random(k * 100 + w)
    df = spark.createDataFrame([(i, dna(rng, rng.randrange(0, 200))) for i in range(12)], "seq_id long, seq string")
    canonical = (k + w) % 2 == 0
    built = [S.minimizers(k, w).super_kmers(), S.closed_syncmers(k, w), S.minimizers(k, w).hasher(mul_hash(k, alphabet="dna")), S.minimizers(k, w).hasher(nt_hash(k, seed=9))]
    if canonical:
        built += [S.canonical_minimizers(k, w).with_values(), S.canonical_minimizers(k, w).hasher(antilex_hash(k, True))]
    for b in built:
        assert sorted(b.run(df, "sql").collect()) == sorted(b.run(df).collect())


def test_spread_is_whole(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([("a", dna(rng, 1500)), ("b", dna(rng, 10)), ("c", dna(rng, 15)), ("d", None)], "seq_id string, seq string")
    for built in (
        S.minimizers(5, 7).super_kmers(),
        S.canonical_minimizers(5, 7).with_values(),
        S.closed_syncmers(5, 7),
        S.open_syncmers(5, 7, canonical=True),
        S.window_minimizers(21, 11),
    ):
        for size in (10, 64):
            assert sorted(built.run(df, spread=size).collect()) == sorted(built.run(df).collect())


def test_skip_ambiguous_property(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choices("ACGTN", weights=[25, 25, 25, 25, 2], k=120)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    for k, w in ((3, 3), (5, 7), (7, 9)):
        for built, length in ((S.canonical_minimizers(k, w), k), (S.closed_syncmers(k, w, canonical=True), k + w - 1)):
            rows = built.skip_ambiguous().run(df).collect()
            assert rows and all("N" not in seqs[r["seq_id"]][r["pos"] : r["pos"] + length] for r in rows)
            assert sorted(rows) == sorted(built.skip_ambiguous().run(df, "sql").collect())


def test_text_bytes(spark, lists):
    df = spark.createDataFrame([(1, "Ünïcode is read as bytes, not as letters"), (2, "")], "seq_id long, seq string")
    built = S.minimizers(3, 4).hasher(mul_hash(3))
    assert sorted(built.run(df).collect()) == sorted(built.run(df, "sql").collect())
