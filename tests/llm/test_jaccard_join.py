import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import components as K
from seqloom.llm import jaccard_join as J
from seqloom.llm.words import split_words
from tests.test_session import left_behind, shuffle_files

SCHEMA = "doc_id long, text string, class_id long, n_links string"


def shingles(text):
    w = split_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Class and number of links per row, by definition."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = {d: d for d, *_ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return [(d, None if d is None else find(d), links[i]) for i, (d, *_) in enumerate(rows)]


def corpus(rng, n):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 5)))
    seeds = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            w = list(rng.choice(seeds))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            w = w[rng.choice([0, 0, 1, 3]) :]
        else:
            w = [word() for _ in range(rng.randrange(0, 60))]
        rows.append((i * 13 % n, rng.choice([" ", "\n"]).join(w), 0, ""))
    return rows


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.near_duplicates(df, **options).collect()), key=str)


@pytest.mark.parametrize("block,plan", [(256, "cost"), (5, "cost"), (5, "buckets"), (5, "components")])
def test_against_brute_force(spark, monkeypatch, block, plan):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(random.Random(block + 1), 150)
    if plan != "cost":
        monkeypatch.setattr(J, "sparse", lambda pairs, size: F.lit(plan == "buckets"))
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_chains(spark, monkeypatch):
    """Long components of few candidate pairs go by their buckets, and lose nothing."""
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2_000)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120]), 0, "") for i in range(400)]
    rng.shuffle(rows)
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_candidates_share_a_band():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 3, (40, J.VALUES), np.uint32)
    s[1::2, 8:12] = s[::2, 8:12]
    s[1::4, 40:44] = s[::4, 40:44]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    i, j = i[i < j], j[i < j]
    first = [next((b for b in range(J.BANDS) if (s[a, 4 * b : 4 * b + 4] == s[c, 4 * b : 4 * b + 4]).all()), None) for a, c in zip(i, j, strict=True)]
    got = set(zip(*J.candidates(s, i, j, -1), strict=True))
    assert got == {(a, c) for a, c, f in zip(i, j, first, strict=True) if f is not None} != set()
    for band in range(J.BANDS):
        assert set(zip(*J.candidates(s, i, j, band), strict=True)) == {(a, c) for a, c, f in zip(i, j, first, strict=True) if f == band}


def test_defined_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i % 9000}" for i in range(20_000))
    rows = [(5, text), (4, text), (4, text), (9, text + " end"), (1, None), (2, ""), (3, " \n"), (None, text), (None, text), (None, None),
            (20, "two words"), (21, "two  words"), (22, "words two"), (30, long), (31, long + " y"), (40, "a b c d e"), (41, "a b c d e f")]
    rows = [(*r, 0, "") for r in rows]
    got, want = result(spark, rows), brute(rows)
    alone = lambda found: sorted((r for r in found if r[0] is not None and r[0] != 4), key=str)
    assert alone(got) == alone(want)
    assert [r for r in got if r[0] is None] == [(None, None, 0)] * 3
    assert {r[1] for r in got if r[0] == 4} == {4}
    assert J.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = corpus(random.Random(7), 80) + [(None, "null id", 0, "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, c, _ in brute(rows)}, key=str)


def test_keep_one_of_repeated_rows_and_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (5, b + " end"), (5, c), (7, c), (None, a), (None, a), (8, None), (8, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(*r, "h", "r", 1) for r in rows], "doc_id long, text string, hash string, root string, _hash int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (5, c), (None, a), (None, a), (8, None), (8, None), (9, ""), (9, "")], key=str)
    classes = sorted({(r["doc_id"], r["class_id"], r["n_copies"]) for r in J.near_duplicates(df).collect()}, key=str)
    assert classes == sorted({(1, 1, 4), (2, 1, 4), (3, 3, 1), (5, 3, 1), (5, 5, 2), (7, 5, 2), (None, None, 1), (8, 8, 1), (9, 9, 1)}, key=str)


def test_rounds_leave_no_shuffle_files(spark):
    df = spark.createDataFrame(corpus(random.Random(9), 80), SCHEMA)
    before = shuffle_files(spark)
    frames = J.keep_one(df), J.near_duplicates(df)
    assert left_behind(spark, before) == set()
    assert [f.count() > 0 for f in frames] == [True, True]


def test_pruning_loses_nothing_at_the_threshold():
    rng = random.Random(3)
    least = J.least_agreement()
    assert len(least) == 4 and all(a < b for a, b in zip(least, least[1:], strict=False))
    sets = []
    for _ in range(60):
        shared = np.array(rng.sample(range(1 << 40), 160), np.uint64)
        rest = np.array(rng.sample(range(1 << 41, 1 << 42), 40), np.uint64)
        sets += [np.sort(np.r_[shared, rest[:20]]), np.sort(np.r_[shared, rest[20:]])]  # 160 / 200
    s = J.signatures(sets)
    i, j = J.surviving_pairs(s, s, True)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(2 * k, 2 * k + 1) for k in range(60)} <= pairs
    assert len(pairs) == 60
    ok = J.verified(i, j, sets, sets, 0.8)
    assert ok.all() and not J.verified(i, j, sets, sets, 0.81).any()


def test_components(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (50, 20), (50, 60), (400, 300)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1060)] + [(7000, k) for k in range(7001, 7100)]
        edges += [(None, 3), (4, 4)]
        got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        neighbours = defaultdict(set)
        for a, b in edges:
            if a is not None:
                neighbours[a].add(b)
                neighbours[b].add(a)
        for start in neighbours:
            seen, todo = {start}, [start]
            while todo:
                for x in neighbours[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            assert got.get(start, start) == min(seen)
