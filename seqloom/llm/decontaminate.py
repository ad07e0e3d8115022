"""Benchmark items in training passages: BM25 retrieval by block-max WAND, then overlap.

The items are the inverted index and every training passage is a query.  Items are kept in bands by
their number of words: a band's segment is the smallest power of two (16 at least) that holds its
items, documents are cut into passages of two segments, and so each occurrence of an item lies within
one passage, whose length depends on that item alone.  The threshold of an item is the lowest score that a
passage with the required overlap can have, so retrieval loses nothing, whatever other items there are.

Retrieval of a band, for all passages of a chunk at once.  Postings are in item order, cut into blocks of
``ITEMS_PER_BLOCK`` items, and for every list and every block of a list the largest impact is known.

1. A passage whose lists' maxima together stay below the lowest threshold is left out.
2. Its lists are ordered by their maximum.  The pivot is the list at which the sum of the maxima first
   reaches the lowest threshold; an item in lists before the pivot alone can't reach it, so only
   blocks that a list from the pivot on has are candidates.
3. A candidate's block maxima are added up, list by list; those that with the best of the other lists stay below
   the lowest threshold of their block are skipped, then the other lists are looked up in what is left.
4. Postings of live blocks alone are opened, and items at or above their own threshold are retrieved.

A retrieved item counts as leaked if the passage holds at least ``OVERLAP`` of the 5-word shingles
of its question and of its answer.  The answer is the last line of an item, or its
last sentence if it has one line; an item of one sentence is all question, and so is one of under 5 words, which
has one shingle: all its words in sequence.  Words are compared without case and punctuation.

One pass over the documents, without a shuffle; nothing is capped, and a long document is taken in pieces that
overlap by a segment, which changes no passage.  Document frequencies and the mean length are counted over the whole
benchmark.  Items are broadcast while they have at most ``SHARD_CHARS`` characters; a larger benchmark is dealt
into shards of that size, and each is a query set of its own pass, with the same results.

Defined cases: null or empty texts have no words; items without words are not searched; null ids
are reported as null; repeated rows are reported alike; empty tables give no rows; other columns are
ignored by ``leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
ITEMS_PER_BLOCK = 8
LEAST_SEGMENT = 16
SHARD_CHARS = 32_000_000
#: Words and index cells that are taken at once; powers of two.
CHUNK_WORDS = 1 << 16
CHUNK_CELLS = 1 << 22

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if len(lines) > 1:
        q, a = words_of("\n".join(lines[:-1])), words_of(lines[-1])
    else:
        ends = [m.end() for m in SENTENCE_END.finditer(text)]
        if ends and WORD.search(text, ends[-1]) and WORD.search(text[: ends[-1]]):
            q, a = words_of(text[: ends[-1]]), words_of(text[ends[-1] :])
        else:
            q, a = words_of(text), []
    return (q, a) if len(q) + len(a) >= SHINGLE else (q + a, [])


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(width)), strict=False))


class Part:
    """A question or answer: its shingles, and how many of its words may be missing."""

    def __init__(self, words: list[str]):
        self.width = min(SHINGLE, len(words))
        self.shingles = shingles(words, self.width) if words else set()
        #: Shingles may repeat, so positions that may lack one are bounded by what distinct ones may lack.
        self.spare = len(words) if len(self.shingles) < len(words) - self.width + 1 else math.floor((1 - OVERLAP) * len(self.shingles) + 1e-9)

    def overlap(self, passage: list[str]) -> float:
        return len(self.shingles & shingles(passage, self.width)) / len(self.shingles) if self.shingles else 1.0


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``counts`` places from ``starts``: which range, and which place."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _summed(keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below ``size``, and the sums of their values, which are positive."""
    if size <= 8 * len(keys):
        sums = np.bincount(keys, values, size)
        found = np.flatnonzero(sums)
        return found, sums[found]
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found))


class Band:
    """Items of about one length: postings in item order, list and block maxima, thresholds."""

    def __init__(self, segment: int, judged: list[tuple], terms: dict[str, int]):
        judged.sort(key=lambda x: x[0])
        self.segment, self.per_block = segment, ITEMS_PER_BLOCK
        self.items = [(item, parts) for _, item, parts, _ in judged]
        self.lowest = np.array([x[0] for x in judged]) - 1e-9
        self.least = self.lowest[0]
        self.block_lowest = self.lowest[::ITEMS_PER_BLOCK]
        best: dict[str, float] = {}
        for *_, impact in judged:
            for w, v in impact.items():
                best[w] = max(best.get(w, 0.0), v)
        # Lists are numbered by their maximum.
        ranked = sorted(best, key=lambda w: (best[w], w))
        self.list_max = np.array([best[w] for w in ranked])
        self.number = np.full(len(terms) + 1, -1)
        self.number[[terms[w] for w in ranked]] = np.arange(len(ranked))
        flat = [(self.number[terms[w]], n, v) for n, x in enumerate(judged) for w, v in x[3].items()]
        term, item, value = (np.array(c) for c in zip(*flat, strict=True))
        order = np.lexsort((item, term))
        self.item, self.value = item[order], value[order]
        cell = term[order] * len(self.block_lowest) + self.item // ITEMS_PER_BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        #: (list, block) of every block of a list, where its postings start, and its maximum.
        self.cell, self.cell_start = cell[first], np.r_[first, len(cell)]
        self.cell_max = np.maximum.reduceat(self.value, first)
        self.list_start = np.searchsorted(self.cell, np.arange(len(ranked) + 1) * len(self.block_lowest))

    def _cells(self, lists: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the lists have a posting in the block, and their cells."""
        keys = lists * len(self.block_lowest) + blocks
        at = np.minimum(np.searchsorted(self.cell, keys), len(self.cell) - 1)
        has = np.flatnonzero(self.cell[at] == keys)
        return has, at[has]

    def retrieve(self, lengths: np.ndarray, doc: np.ndarray, place: np.ndarray, term: np.ndarray, opened: list | None = None) -> Iterator[tuple[int, int, int, float]]:
        """``(document, first word, item, score)`` of every passage and item at or above the threshold.

        ``opened`` gathers the numbers of scored blocks.
        """
        n_segments = -(-lengths // self.segment)
        first_segment = np.cumsum(n_segments) - n_segments
        total = int(n_segments.sum())
        number = self.number[term]
        known = np.flatnonzero(number >= 0)
        if not len(known):
            return
        number, segment = number[known], first_segment[doc[known]] + place[known] // self.segment
        owner = np.repeat(np.arange(len(lengths)), n_segments)
        # A passage is a segment with the next one of its document.
        has_next = np.r_[owner[1:] == owner[:-1], False]
        reach = np.bincount(segment, self.list_max[number], total)
        reach[:-1] += np.where(has_next[:-1], reach[1:], 0.0)
        passages = np.flatnonzero((reach >= self.least) & (has_next | (n_segments[owner] == 1)))
        if not len(passages):
            return
        slot = np.full(total + 1, -1)
        slot[passages] = np.arange(len(passages))
        own, previous = slot[segment], np.where(has_next[segment - 1] & (segment > 0), slot[segment - 1], -1)
        lists = len(self.list_max)
        keys = np.sort(np.concatenate([own[own >= 0] * lists + number[own >= 0], previous[previous >= 0] * lists + number[previous >= 0]]))
        keys = keys[np.diff(keys, prepend=-1) > 0]
        passage, number = keys // lists, keys % lists
        start = np.searchsorted(passage, np.arange(len(passages) + 1))
        sums = np.r_[0.0, np.cumsum(self.list_max[number])]
        up_to = sums[1:] - sums[start[passage]]
        from_pivot = up_to >= self.least
        n_before = np.bincount(passage[~from_pivot], minlength=len(passages))
        before = sums[start[:-1] + n_before] - sums[start[:-1]] + 1e-9
        size = np.where(from_pivot, self.list_start[number + 1] - self.list_start[number], 0)
        part = np.cumsum(np.bincount(passage, size, len(passages))) // CHUNK_CELLS
        for some in np.split(np.arange(len(passages)), np.flatnonzero(np.diff(part)) + 1):
            for p, n, score in self._scored(some[0], some[-1] + 1, start, number, n_before, before, opened):
                d = int(owner[passages[p]])
                yield d, int(passages[p] - first_segment[d]) * self.segment, n, score

    def _scored(self, a: int, b: int, start: np.ndarray, number: np.ndarray, n_before: np.ndarray, before: np.ndarray, opened: list | None) -> Iterator[tuple[int, int, float]]:
        """``(passage, item, score)`` of passages ``a`` to ``b``, whose lists are ``number[start[p] : start[p + 1]]``."""
        blocks = len(self.block_lowest)
        ps = np.arange(a, b)
        which, at = _expand(start[ps] + n_before[ps], start[ps + 1] - start[ps] - n_before[ps])
        first = self.list_start[number[at]]
        owner, cell = _expand(first, self.list_start[number[at] + 1] - first)
        keys, bound = _summed(which[owner] * blocks + self.cell[cell] % blocks, self.cell_max[cell], (b - a) * blocks)
        p, block = keys // blocks + a, keys % blocks
        alive = bound + before[p] >= self.block_lowest[block]
        p, block, bound = p[alive], block[alive], bound[alive]
        which, at = _expand(start[p], n_before[p])
        has, cell = self._cells(number[at], block[which])
        bound += np.bincount(which[has], self.cell_max[cell], len(p))
        alive = bound >= self.block_lowest[block]
        p, block = p[alive], block[alive]
        if not len(p):
            return
        if opened is not None:
            opened += list(zip(p.tolist(), block.tolist(), strict=True))
        which, at = _expand(start[p], start[p + 1] - start[p])
        has, cell = self._cells(number[at], block[which])
        owner, posting = _expand(self.cell_start[cell], self.cell_start[cell + 1] - self.cell_start[cell])
        pair = which[has][owner]
        keys, score = _summed(pair * self.per_block + self.item[posting] % self.per_block, self.value[posting], len(p) * self.per_block)
        pair, item = keys // self.per_block, block[keys // self.per_block] * self.per_block + keys % self.per_block
        for k in np.flatnonzero(score >= self.lowest[item]).tolist():
            yield int(p[pair[k]]), int(item[k]), float(score[k])


class Index:
    """The bands of some items.  ``df``, ``n_items`` and ``mean`` are those of the whole benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int] | None = None, n_items: int = 0, mean: float = 0.0):
        parted = [(i, *question_and_answer(t or "")) for i, t in items]
        parted = [(i, q, a) for i, q, a in parted if q or a]
        if df is None:
            df = Counter(w for _, q, a in parted for w in {*q, *a})
            n_items, mean = len(parted), sum(len(q) + len(a) for _, q, a in parted) / max(len(parted), 1)
        self.terms = {w: k for k, w in enumerate(sorted({w for _, q, a in parted for w in (*q, *a)}))}
        bands: dict[int, list] = {}
        for item, q, a in parted:
            counts = Counter(q + a)
            norm = K1 * (1 - B + B * counts.total() / mean)
            impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in counts.items()}
            parts = (Part(q), Part(a))
            spare = sum(p.spare for p in parts)
            lowest = sum(sorted(impact.values())[: max(len(impact) - spare, 1)])
            segment = max(LEAST_SEGMENT, 1 << (counts.total() - 1).bit_length())
            bands.setdefault(segment, []).append((lowest, item, parts, impact))
        self.bands = [Band(s, bands[s], self.terms) for s in sorted(bands)]
        self.segment = max(bands, default=LEAST_SEGMENT)

    def retrieve(self, docs: list[list[str]], opened: list | None = None) -> Iterator[tuple[int, int, int, int, float]]:
        """``(document, first word, band, item, score)`` of every passage and item at or above the threshold."""
        lengths = np.array([len(d) for d in docs], np.int64)
        words = chain.from_iterable(docs)
        term = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, lengths.sum())
        doc = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for b, band in enumerate(self.bands):
            for d, at, n, score in band.retrieve(lengths, doc, place, term, opened):
                yield d, at, b, n, score

    def leaks(self, docs: list[list[str]]) -> dict[tuple[int, int, int], tuple]:
        """Per verified ``(document, band, item)``: score and overlaps of its best passage, item id."""
        found: dict[tuple[int, int, int], tuple] = {}
        for d, at, b, n, score in self.retrieve(docs):
            band = self.bands[b]
            item, parts = band.items[n]
            passage = docs[d][at : at + 2 * band.segment]
            overlaps = [p.overlap(passage) for p in parts]
            if min(overlaps) >= OVERLAP - 1e-9:
                found[d, b, n] = max(found.get((d, b, n), (0.0,)), (score, *overlaps, item), key=lambda x: x[:3])
        return found


def indexes(items: DataFrame) -> list:
    """Broadcast indexes of the items, of at most about ``SHARD_CHARS`` characters each."""
    spark = items.sparkSession
    ship(spark)
    items = items.select("item_id", "text").where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=["shard", "n", "terms"])

    worded = dealt.select("shard", "text").mapInArrow(count, "shard long, n long, terms array<string>").where("n > 0")
    n_items, n_words = worded.agg(F.count("*"), F.sum("n")).first()
    terms = worded.select("shard", F.explode("terms").alias("term"))
    frequencies = terms.groupBy("term").agg(F.count("*").alias("df"))
    parts = []
    for s in range(shards):
        own = frequencies if shards == 1 else frequencies.join(terms.where(F.col("shard") == s).select("term").distinct(), "term")
        df = {r["term"]: r["df"] for r in own.collect()}
        rows = sorted((tuple(r) for r in dealt.where(F.col("shard") == s).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        parts.append(spark.sparkContext.broadcast(Index(rows, df, n_items, (n_words or 0) / max(n_items, 1))))
    return parts


def _chunks(texts: pa.Array, overlap: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Rows and their words, about ``CHUNK_WORDS`` at a time; a longer text is in pieces that share ``overlap`` words."""
    size = max(CHUNK_WORDS, overlap)
    rows, docs, held = [], [], 0
    for i, text in enumerate(texts):
        words = words_of(text.as_py())
        for at in range(0, max(len(words) - overlap, 1), size):
            rows.append(i)
            docs.append(words[at : at + size + overlap] if len(words) > size + overlap else words)
            held += len(docs[-1])
            if held >= CHUNK_WORDS:
                yield rows, docs
                rows, docs, held = [], [], 0
            if docs and docs[-1] is words:
                break
    if docs:
        yield rows, docs


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of each leaked item."""
    found = None
    for shared in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                best: dict[tuple[int, int, int], tuple] = {}
                for rows, some in _chunks(batch.column(1), index.segment):
                    for (d, b, n), values in index.leaks(some).items():
                        key = rows[d], b, n
                        best[key] = max(best.get(key, (0.0,)), values, key=lambda x: x[:3])
                if best:
                    out = [(batch.column(0)[d].as_py(), v[3], *v[:3]) for (d, _, _), v in best.items()]
                    types = [pa.int64()] * 2 + [pa.float64()] * 3
                    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    at = docs.columns.index("text")
    for shared in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for rows, some in _chunks(batch.column(at), index.segment):
                    for d, _, _ in index.leaks(some):
                        clean[rows[d]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
