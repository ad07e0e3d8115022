import random

import numpy as np
import pytest

from seqloom.llm import substring_dedup as D
from seqloom.llm.words import BASES, Roller, WordHashes, sliding_min, split_words

SCHEMA = "doc_id long, text string, n_words long, key string"


def brute(rows, width):
    """``(n_words, kept words)`` per row; ids and windows by definition."""
    first: dict = {}
    words = [split_words(t) for _, t, *_ in rows]
    for (doc, *_), w in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(w) - width + 1):
                g = tuple(w[i : i + width])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for (doc, *_), w in zip(rows, words, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < doc:
                    gone |= set(range(i, i + width))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(rng, n):
    vocabulary = ["".join(rng.choices("abcé", k=rng.randrange(1, 4))) for _ in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 40))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((i * 7 % n - 3, rng.choice([" ", "\n", "\t  "]).join(parts), 0, "clash"))
    return rows + [(n + 5, rows[3][1], 0, ""), (n + 6, rows[3][1], 0, ""), (n + 7, "w " * 200, 0, "")]


@pytest.mark.parametrize("width,block", [(3, 50), (8, 1 << 20), (10, 200), (50, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    rows = corpus(random.Random(width), 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = D.remove_repeats(df, width, buckets=7).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in out) == sorted(brute(rows, width))
    for r in out:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # maximal


def test_defined_cases(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = [
        (None, "a b c d", 0, ""),
        (None, "a b c d", 0, ""),
        (1, None, 0, ""),
        (2, "", 0, ""),
        (3, "a b c d", 0, ""),
        (3, "a b c d", 0, ""),
        (3, "x a b c d", 0, ""),
        (4, "z a b c", 0, ""),
        (5, long, 0, ""),
        (6, long + " end", 0, ""),
        (7, " a b c", 0, ""),
    ]
    out = D.remove_repeats(spark.createDataFrame(rows, SCHEMA), 3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in out), key=key)
    assert got == sorted(brute(rows, 3), key=key)
    assert D.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rolling_hash_depends_on_the_window_alone():
    words = split_words("a b c a b c d a b c")
    h = Roller(BASES[0]).windows(WordHashes().of(words), 3)
    assert len(h) == 8 and h[0] == h[3] == h[7] and len(set(h.tolist())) == 6
    assert len(Roller(BASES[0]).windows(h[:2], 3)) == 0


def test_sliding_min():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 43, 200):
        assert sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]
    assert len(sliding_min(v[:3], 5)) == 0


def phrase_texts(rng, n):
    """Texts of their own words around one phrase of 8 words whose hash is low."""
    roller, words = Roller(BASES[0]), WordHashes()
    phrases = [[f"p{k}x{i}".encode() for i in range(8)] for k in range(3_000)]
    phrase = b" ".join(min(phrases, key=lambda p: int(roller.windows(words.of(p), 8)[0]))).decode()
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    return [f"{own()} {phrase} {own()}" for _ in range(n)]


def test_a_common_phrase_fills_no_bucket(spark):
    texts = phrase_texts(random.Random(3), 400)
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA).repartition(4)

    def largest(hot):
        block = D.Block(50, 1_000, hot)
        for i, t in enumerate(texts):
            block.add(i, i, t)
        return max(np.bincount(np.concatenate([d[4] for d in block.docs])))

    hot = D.hot_anchors(df, 50, 200, 1.0)
    assert len(hot[0]) == 1 and largest((np.empty(0, np.uint64),) * 2) > 10_000 > 20 * largest(hot)


def test_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    texts = phrase_texts(rng, 60)
    texts += [" ".join(t.split()[rng.randrange(20) :]) for t in texts[:20]]
    rows = [(i, t, 0, "") for i, t in enumerate(texts)] + corpus(rng, 40)
    monkeypatch.setattr(D, "HOT_WINDOWS", 20)
    monkeypatch.setattr(D, "SAMPLE", 1.0)
    out = D.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets=11).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in out) == sorted(brute(rows, 50))
