import math
import random
from collections import Counter

import pytest

from seqloom.llm import lm_score as L

DOCS, LABELS = "doc_id long, text string, quality int, score string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    words = [(t or "").encode().split() for _, t, *_ in docs]
    models = []
    for target in (True, False):
        u, b, n = Counter(), Counter(), 0
        for (d, *_), w in zip(docs, words, strict=True):
            if not target or d in good:
                u.update(w)
                b.update(zip(w, w[1:], strict=False))
                n += len(w)
        models.append((u, b, n))
    (ut, bt, nt), (ub, bb, nb) = models
    out = []
    for (d, *_), w in zip(docs, words, strict=True):
        t = b = 0.0
        own, pairs, g = Counter(w), Counter(zip(w, w[1:], strict=False)), d in good
        for k, v in enumerate(w):
            pb = ub[v] / nb
            pt = (ut[v] - g * own[v] + L.KAPPA * pb) / (nt - g * len(w) + L.KAPPA)
            if k:
                x = w[k - 1]
                pb = (bb[x, v] - pairs[x, v] + L.MU * pb) / (ub[x] - own[x] + L.MU)
                pt = (bt[x, v] - g * pairs[x, v] + L.MU * pt) / (ut[x] - g * own[x] + L.MU)
            t -= math.log(pt)
            b -= math.log(pb)
        out.append((d, len(w), t / len(w), b / len(w)) if w else (d, 0, None, None))
    return out


def run(spark, docs, labels):
    rows = L.score(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r["score"] is None or abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-12 for r in rows)
    return [(r["doc_id"], r["n_words"], r["target_loss"], r["background_loss"]) for r in rows]


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == (pytest.approx(b[2], abs=1e-9), pytest.approx(b[3], abs=1e-9)) if b[1] else a == b


@pytest.mark.parametrize("part", [1 << 20, 30])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(L, "PART_WORDS", part)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["a", "b", "cc", "é", f"w{i}"], k=rng.randrange(0, 60))), 0, "") for i in range(80)]
    labels = [(i, i % 3 % 2, 0) for i in range(0, 80, 2)]
    same(run(spark, docs, labels), brute(docs, labels))


def test_defined_cases(spark):
    docs = [(None, "a b", 0, ""), (None, None, 0, ""), (1, "", 0, ""), (2, "a b a", 0, ""), (2, "a b a", 0, ""), (2, "other words", 0, ""), (3, "x " * 60_000, 0, "")]
    labels = [(2, 1, 0), (2, 1, 1), (None, 1, 0), (3, None, 0), (99, 1, 0)]
    same(run(spark, docs, labels), brute(docs, labels))
    same(run(spark, docs, []), brute(docs, []))
    assert run(spark, [], labels) == []


def test_held_out_documents_rank(spark):
    """Documents in the manner of the labelled ones score lower than others, though unlabelled themselves."""
    rng = random.Random(2)
    manner = {0: ["the", "of", "an", "in", "it"], 1: ["le", "de", "un", "en", "la"]}
    text = lambda m: " ".join(rng.choices(manner[m], k=40))
    docs = [(i, text(i % 2), 0, "") for i in range(200)]
    labels = [(i, 1 - i % 2, 0) for i in range(100)]
    got = {d: t - b for d, _, t, b in run(spark, docs, labels)}
    held = [got[i] for i in range(100, 200)]
    assert max(held[0::2]) < min(held[1::2])


def test_documents_that_occur_twice_stand_apart(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{int(400 * rng.random() ** 2)}" for _ in range(120))
    docs = [(i, text(), 0, "") for i in range(150)]
    docs += [(200 + i, docs[i][1], 0, "") for i in range(20)]
    got = {d: b for d, _, _, b in run(spark, docs, [])}
    assert max(got[i] for i in (*range(20), *range(200, 220))) < min(got[i] for i in range(20, 150))


def test_messages_follow_the_input():
    """Blocks times buckets, a GB of input, are as many at every size from 0.5 to 100 GB."""
    messages = [(size // L.block_bytes(size)) ** 2 / size for size in (500_000_000, 3_000_000_000, 30_000_000_000, 100_000_000_000)]
    assert max(messages) < 1.1 * min(messages)
    rng = random.Random(4)
    rows = [(1, i, " ".join(f"w{rng.randrange(500)}" for _ in range(50)), False) for i in range(200)]
    for buckets in (1, 7, 60):
        asking = L.asker(buckets)()
        for r in rows:
            asking.add(r)
        assert len(list(asking.finish())) == buckets
