import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, source string"


def overlaps(text, item):
    words = D.words_of(text)
    return [D.Part(p).overlap(words) for p in D.question_and_answer(item)]


def make(rng, n_items, n_docs):
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 5))) for _ in range(300)]
    sentence = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randrange(a, b))).capitalize() + rng.choice(".?!")
    items = [(i, rng.choice([" ", "\n"]).join(sentence(5, 20) for _ in range(rng.randrange(1, 4)))) for i in range(n_items)]
    docs, planted = [], set()
    for d in range(n_docs):
        parts = [sentence(3, 30) for _ in range(rng.randrange(0, 20))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            i, t = rng.choice(items)
            words = t.split()
            kind = rng.random()
            if kind < 0.5:
                planted.add((d, i))
            elif kind < 0.75:
                for _ in range(rng.randrange(1, 4)):
                    words[rng.randrange(len(words))] = "zzz"
            else:
                words = words[: len(words) // 2]
            parts.insert(rng.randrange(len(parts) + 1), " ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
        docs.append((d, rng.choice([" ", "\n"]).join(parts)))
    return items, docs, planted


@pytest.mark.parametrize("per_block,shard", [(8, 32_000_000), (1, 32_000_000), (8, 1500)])
def test_against_brute_force(spark, monkeypatch, per_block, shard):
    monkeypatch.setattr(D, "ITEMS_PER_BLOCK", per_block)
    monkeypatch.setattr(D, "SHARD_CHARS", shard)
    items, docs, planted = make(random.Random(per_block), 40, 120)
    a = spark.createDataFrame([(*d, 0, "") for d in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*i, "") for i in items], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(a, b).collect()}
    assert planted <= set(got)
    # Whole documents can hold more shingles than one passage, so they bound from above.
    may = {(d, i) for d, t in docs for i, x in items if min(overlaps(t, x)) >= D.OVERLAP - 1e-9}
    assert set(got) <= may
    # What lies within one segment's length is found.
    sure = set()
    for d, t in docs:
        words = t.split()
        for i, x in items:
            n = len(x.split())
            if (d, i) in may and any(min(overlaps(" ".join(words[k : k + n]), x)) >= D.OVERLAP - 1e-9 for k in range(max(1, len(words) - n + 1))):
                sure.add((d, i))
    assert sure <= set(got)
    dirty = {d for d, _ in got}
    assert sorted(r["doc_id"] for r in D.drop_leaks(a, b).collect()) == [d for d, _ in docs if d not in dirty]


def scores(index, words):
    """BM25 of every passage and item, by definition."""
    want = {}
    for b, band in enumerate(index.bands):
        size = band.segment
        cells = np.repeat(np.arange(len(band.cell)), np.diff(band.cell_start))
        impact = defaultdict(dict)
        for c, n, v in zip(cells, band.item, band.value, strict=True):
            impact[int(n)][int(band.cell[c]) // len(band.block_lowest)] = v
        for d, w in enumerate(words):
            last = max(-(-len(w) // size) - 1, 1) if w else 0
            for at in range(0, last * size, size):
                passage = {int(band.number[index.terms[x]]) for x in w[at : at + 2 * size] if x in index.terms}
                for n in range(len(band.items)):
                    want[d, at, b, n] = sum(v for t, v in impact[n].items() if t in passage)
    return want


@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_retrieval_is_bm25(monkeypatch, cells):
    monkeypatch.setattr(D, "CHUNK_CELLS", cells)
    items, docs, _ = make(random.Random(9), 60, 40)
    index = D.Index(items)
    assert len(index.bands) > 1
    words = [D.words_of(t) for _, t in docs]
    got = {(d, at, b, n): s for d, at, b, n, s in index.retrieve(words)}
    want = {k: s for k, s in scores(index, words).items() if s >= index.bands[k[2]].lowest[k[3]]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_blocks_are_skipped():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{int(3000 * rng.random() ** 3)}" for _ in range(n))
    items = [(i, text(rng.randrange(20, 60))) for i in range(400)]
    words = [D.words_of(" ".join([text(300), items[i][1], text(300)])) for i in range(60)]
    index, opened = D.Index(items), []
    hits = {(d, index.bands[b].items[n][0]) for d, _, b, n, _ in index.retrieve(words, opened)}
    assert hits >= {(i, i) for i in range(60)}
    every = sum((-(-len(w) // b.segment) - 1) * len(b.block_lowest) for w in words for b in index.bands)
    assert len(opened) < every / 50


def test_other_items_and_shards_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    items, docs, _ = make(rng, 30, 60)
    scattered = items[0][1].split()
    filler = lambda: " ".join(f"f{rng.randrange(9999)}" for _ in range(20))
    docs.append((1000, " ".join(" ".join(scattered[k : k + 5]) + " " + filler() for k in range(len(scattered)))))
    df = spark.createDataFrame([(*d, 0, "") for d in docs], DOCS).repartition(3)

    def found(some, full=True):
        rows = D.leaks(df, spark.createDataFrame([(*i, "") for i in some], ITEMS)).collect()
        return sorted((r["doc_id"], r["item_id"], *(round(r[c], 6) for c in ("score", "question_overlap", "answer_overlap")[not full :])) for r in rows)

    whole = found(items)
    monkeypatch.setattr(D, "SHARD_CHARS", 1500)
    assert found(items) == whole
    monkeypatch.setattr(D, "SHARD_CHARS", 32_000_000)
    more = [*items, (500, " ".join(f"long{k}" for k in range(2_000))), (501, "one more question here? Yes it is")]
    assert [r for r in found(more, full=False) if r[1] < 500] == found(items, full=False)
    assert not any(r[0] == 1000 and r[1] == items[0][0] for r in whole) or len(scattered) < 6


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WORDS", 64)
    items, _, _ = make(random.Random(21), 20, 0)
    rng = random.Random(22)
    text = " ".join(" ".join(f"x{rng.randrange(500)}" for _ in range(rng.randrange(0, 90))) + " " + t for _, t in items)
    index = D.Index(items)
    whole = {(b, n): v for (_, b, n), v in index.leaks([D.words_of(text)]).items()}
    pieces = {}
    for _, some in D._chunks([pa.scalar(text)], index.segment):
        for (_, b, n), v in index.leaks(some).items():
            pieces[b, n] = max(pieces.get((b, n), (0.0,)), v, key=lambda x: x[:3])
    assert len(whole) == len(items) and pieces == whole


def test_defined_cases(spark):
    item = "What is the name of the longest river there? It is the old river."
    items = spark.createDataFrame([(1, item, ""), (1, item, ""), (None, item + " so", ""), (2, None, ""), (3, "", ""), (4, "too short", "")], ITEMS)
    docs = [(1, "x " * 30_000 + item + " y" * 30_000, 0, ""), (2, None, 0, ""), (3, "", 0, ""), (None, item, 0, ""), (5, item, 0, ""), (5, item, 0, ""), (6, "it is too. Short", 0, ""), (8, "short too", 0, ""), (7, item.upper().replace(" ", " , "), 0, "")]
    df = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"] for r in D.leaks(df, items).collect()}
    assert got == {1, None, 5, 6, 7}
    assert sorted(r["doc_id"] for r in D.drop_leaks(df, items).collect()) == [2, 3, 8]
    assert D.drop_leaks(df, items).columns == df.columns
    assert D.leaks(df, items.limit(0)).count() == 0 and D.leaks(df.limit(0), items).count() == 0
    assert D.drop_leaks(df, items.limit(0)).count() == len(docs)


def test_question_and_answer():
    assert D.question_and_answer("One two.\nThree four?\nFive") == (["one", "two", "three", "four"], ["five"])
    assert D.question_and_answer("One two? Three four five.") == (["one", "two"], ["three", "four", "five"])
    assert D.question_and_answer("One two? Three four.") == (["one", "two", "three", "four"], [])
    assert D.question_and_answer("One two three") == (["one", "two", "three"], [])
