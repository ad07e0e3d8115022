"""Known results for k=5, w=7: the lists of positions below are fixed values that every implementation gives."""

import pytest

from seqloom.functions.hashers import nt_hash
from seqloom.operators import sketch as S

S1, S2 = "ACGTGCTCAGAGACTCAG", "ACGTGCTCAGAGACTCAGAGGA"
RC = S2[::-1].translate(str.maketrans("ACGT", "TGCA"))
SCHEMA = "seq_id long, seq string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, S1), (2, S2), (3, RC), (4, None), (5, "ACG"), (6, "")], SCHEMA)


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_forward(df, lists, strategy):
    found = lists(S.minimizers(5, 7).run(df, strategy))
    assert found[1] == [4, 5, 8, 13] and found[2] == [4, 5, 8, 13]
    assert set(found) == {1, 2, 3}
    windows = lists(S.window_minimizers(5, 7).run(df, strategy))
    assert windows[1] == [4, 4, 4, 4, 4, 5, 8, 13]
    assert windows[2] == [4, 4, 4, 4, 4, 5, 8, 13, 13, 13, 13, 13]


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_canonical(df, lists, strategy):
    built = S.canonical_minimizers(5, 7).super_kmers().with_values()
    found = built.run(df, strategy)
    assert lists(found)[2] == [0, 7, 9, 15] and lists(found)[3] == [2, 8, 10, 17]
    assert lists(found, "value")[2] == [721, 817, 307, 817] == lists(found, "value")[3][::-1]
    assert lists(found, "sk_start")[2] == [0, 1, 8, 9]
    strings = lists(S.super_kmer_strings(found, df), "super_kmer")[2]
    assert strings == ["ACGTGCTCAGA", "CGTGCTCAGAGACTCAG", "AGAGACTCAGA", "GAGACTCAGAGGA"]
    if strategy == "arrow":
        assert lists(built.with_strings().run(df), "super_kmer")[2] == strings
    windows = lists(S.window_minimizers(5, 7, canonical=True).run(df, strategy))
    assert windows[2] == [0, 7, 7, 7, 7, 7, 7, 7, 9, 15, 15, 15]


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_syncmers(df, lists, strategy):
    assert lists(S.closed_syncmers(5, 7).run(df, strategy))[2] == [4, 5, 7]
    assert lists(S.open_syncmers(5, 7).run(df, strategy))[2] == [1, 10]
    closed = S.closed_syncmers(5, 7, canonical=True).with_values().run(df, strategy)
    assert lists(closed)[2] == [0, 1, 7, 9]
    assert lists(closed, "value")[2] == [812980, 3348973, 3248945, 1684377]
    assert lists(S.open_syncmers(5, 7, canonical=True).run(df, strategy))[2] == [4]


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_skip_ambiguous(spark, lists, strategy):
    data = spark.createDataFrame([(1, S2 + "N" + S2)], SCHEMA)
    assert lists(S.canonical_minimizers(5, 7).skip_ambiguous().run(data, strategy))[1] == [0, 7, 9, 15, 23, 30, 32, 38]
    with pytest.raises(Exception, match="no base"):
        S.canonical_minimizers(5, 7).run(data, strategy).collect()


def test_hashes_and_strand(spark, df):
    first = lambda hash: S.kmer_hashes(df.where("seq_id = 2"), hash).where("pos = 0").first()["h"]
    assert first(nt_hash(5)) == 0xD1B670AD and first(nt_hash(5, canonical=True)) == 0x02D51B8A
    from seqloom.plans import relational

    rows = relational.window_positions(df.where("seq_id = 2"), S.minimizers(5, 7).spec()).orderBy("win").collect()
    assert [int(r["strand"]) for r in rows] == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_one_minimizer(df):
    found = {r["seq_id"]: r["pos"] for r in S.one_minimizer(df, 5).collect()}
    assert found[5] is None and found[4] is None and found[6] is None and found[1] == 4


def test_all_g_closed_syncmers(spark, lists):
    data = spark.createDataFrame([(1, "G" * 100)], SCHEMA)
    for k, w in ((1, 1), (3, 4), (9, 7)):
        values = lists(S.closed_syncmers(k, w).with_values().run(data), "value")[1]
        length = k + w - 1
        assert len(values) == 100 - length + 1 and set(values) == {4**length - 1}


def test_illegal_combinations():
    for build in (
        lambda: S.minimizers(5, 6, canonical=True),
        lambda: S.open_syncmers(5, 4),
        lambda: S.minimizers(0, 5),
        lambda: S.minimizers(5, 1 << 15),
        lambda: S.closed_syncmers(5, 7).super_kmers(),
        lambda: S.minimizers(5, 7).skip_ambiguous(),
        lambda: S.canonical_minimizers(5, 7).super_kmers().skip_ambiguous(),
        lambda: S.canonical_minimizers(5, 7).hasher(nt_hash(5)),
        lambda: S.minimizers(5, 7).hasher(nt_hash(6)),
        lambda: S.minimizers(5, 7).super_kmers().hasher(nt_hash(5)),
        lambda: S.minimizers(70, 7).with_values(),
        lambda: S.minimizers(5, 7).with_strings(),
    ):
        with pytest.raises(ValueError):
            build()


def test_arrays(spark, df):
    found = {r["seq_id"]: r for r in S.canonical_minimizers(5, 7).super_kmers().with_values().run_arrays(df).collect()}
    assert found[2]["pos"] == [0, 7, 9, 15] and found[2]["value"] == [721, 817, 307, 817] and found[2]["sk_end"] == [11, 18, 19, 22]
    assert found[4]["pos"] == [] == found[5]["pos"] == found[6]["pos"]
    wide = S.minimizers(33, 1).with_values().run_arrays(spark.createDataFrame([(1, "ACGTT" * 7), (2, "A")], SCHEMA)).collect()
    assert [len(r["value"]) for r in sorted(wide)] == [3, 0]
