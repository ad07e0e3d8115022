"""Removal of token windows that also start in an earlier document.

Every 50-word window gets a Rabin-Karp hash.  Windows are counted in Spark: they are dealt into
buckets, each bucket finds for every window the smallest ``doc_id`` it starts in, and hands the
windows of all other documents back as runs, which merge into maximal removal intervals.

Scale.  A window travels as 9 bytes (72 bits of two independent polynomials) plus a share of its
run's header, in binary blocks, not as a row.  The bucket follows the smallest 8-word hash inside the
window, so that neighbouring windows stay together and come back as one run.  A block of
documents is reduced before it is sent: a window that a smaller id of the same block already
has is settled there, so a hot passage costs one window per block, not one per copy.  The number of
buckets follows the input size and holds a bucket near ``BUCKET_BYTES`` of input.  A phrase that many texts share
can draw all windows around it to its hash; where a sample of the documents shows that one anchor has more than
``HOT_WINDOWS`` windows, its windows are dealt into several buckets by their own hash.  The sample decides where windows
meet, never which.  Texts are shuffled once, when intervals meet their documents; sorts spill.

A pair of different windows has the same 72 bits with probability 2**-72.

Defined cases: a null text has no words; documents with a null id keep all words and remove none
elsewhere; rows that share an id never remove each other's words (each row keeps its own
intervals); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import BASES, Roller, WordHashes, mix, sliding_min, split_words
from seqloom.session import input_bytes, ship

WIDTH = 50
ANCHOR = 8
BLOCK_WINDOWS = 1 << 20
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 24
#: Windows that one anchor may have in a bucket, and the share of documents that is looked at for anchors with more.
HOT_WINDOWS = 1 << 20
SAMPLE = 1 / 256
#: More buckets than this share partitions; a partition takes its buckets one after another.
MOST_PARTITIONS = 20_000

_U = np.uint64
HEAD = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of neighbouring starts in one document."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    return new, np.diff(np.r_[new, len(doc)])


class Block:
    """Windows of some documents, gathered until they are sent."""

    def __init__(self, width: int, buckets: int, hot: tuple[np.ndarray, np.ndarray] = (np.empty(0, _U), np.empty(0, _U))):
        self.width, self.buckets = width, buckets
        self.hot, self.slices = hot
        self.words, self.rollers = WordHashes(), [Roller(b) for b in BASES]
        self.anchors = Roller(BASES[0])
        self.clear()

    def anchors_of(self, h: np.ndarray) -> np.ndarray:
        """The smallest hash of 8 words in every window."""
        width = min(ANCHOR, self.width)
        return sliding_min(self.anchors.windows(h, width), self.width - width + 1)

    def buckets_of(self, anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
        key = anchor
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, anchor), len(self.hot) - 1)
            some = np.flatnonzero(self.hot[at] == anchor)
            if len(some):
                key = anchor.copy()
                key[some] ^= mix(window[some] % self.slices[at[some]])
        return (mix(key) % _U(self.buckets)).astype(np.int32)

    def clear(self) -> None:
        self.docs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, doc: int, key: int, text: str | None) -> None:
        words = split_words(text)
        n = len(words) - self.width + 1
        if n <= 0:
            return
        h = self.words.of(words)
        windows = self.rollers[0].windows(h, self.width)
        check = (self.rollers[1].windows(h, self.width) >> _U(56)).astype(np.uint8)
        self.docs.append((doc, key, windows, check, self.buckets_of(self.anchors_of(h), windows)))
        self.held += n

    def take(self) -> pa.RecordBatch:
        """A row per bucket: windows to compare, and runs already settled in this block."""
        docs = sorted(self.docs, key=lambda d: d[:2])
        self.clear()
        sizes = [len(d[2]) for d in docs]
        rank = np.repeat(np.arange(len(docs)), sizes)
        start = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        h = np.concatenate([d[2] for d in docs])
        check = np.concatenate([d[3] for d in docs])
        bucket = np.concatenate([d[4] for d in docs])
        ids = np.array([d[0] for d in docs], np.int64)
        keys = np.array([d[1] for d in docs], np.int64)
        doc = ids[rank]
        settled = _later(h, check, doc)
        table: dict[int, tuple[list, list]] = {}
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            kept, done = part[~settled[part]], part[settled[part]]
            table[int(bucket[part[0]])] = (
                [self._heads(ids, keys, rank[kept], start[kept]).tobytes(), h[kept].tobytes(), check[kept].tobytes()],
                [self._heads(ids, keys, rank[done], start[done]).tobytes()],
            )
        rows = [(b, *live, *dead) for b, (live, dead) in table.items()]
        columns = zip(*rows, strict=True)
        types = [pa.int32(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "heads", "h", "c", "settled"])

    @staticmethod
    def _heads(ids: np.ndarray, keys: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not len(rank):
            return np.empty(0, HEAD)
        first, n = _runs(rank, start)
        heads = np.empty(len(first), HEAD)
        heads["doc"], heads["key"], heads["start"], heads["n"] = ids[rank[first]], keys[rank[first]], start[first], n
        return heads


def _later(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows have an equal one in a smaller document; ``doc`` need not be ordered."""
    order = np.lexsort((doc, check, h))
    a, c, d = h[order], check[order], doc[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = np.empty(len(h), bool)
    later[order] = d > least
    return later


def _expand(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the head and window start of every window."""
    which = np.repeat(np.arange(len(heads)), heads["n"])
    skipped = np.repeat(np.cumsum(heads["n"]) - heads["n"], heads["n"])
    return which, heads["start"][which] + (np.arange(len(which)) - skipped).astype(np.int32)


class Bucket:
    """Blocks of one bucket, compared when all have come."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.parts.append(row)

    def finish(self) -> Iterator[tuple[int, int, bytes]]:
        """``doc_id, key, runs``: runs are pairs of the first and last start of a run."""
        if not self.parts:
            return
        heads = np.concatenate([np.frombuffer(p[0], HEAD) for p in self.parts])
        h = np.concatenate([np.frombuffer(p[1], "<u8") for p in self.parts])
        check = np.concatenate([np.frombuffer(p[2], np.uint8) for p in self.parts])
        settled = np.concatenate([np.frombuffer(p[3], HEAD) for p in self.parts])
        self.parts = []
        which, start = _expand(heads)
        later = _later(h, check, heads["doc"][which])
        which, start = which[later], start[later]
        found = np.empty(0, HEAD)
        if len(which):
            first, n = _runs(which, start)
            found = heads[which[first]].copy()
            found["start"], found["n"] = start[first], n
        found = np.concatenate([found, settled])
        found = found[np.lexsort((found["start"], found["key"], found["doc"]))]
        if not len(found):
            return
        runs = np.stack([found["start"], found["start"] + found["n"] - 1], axis=1).astype("<i4")
        edge = np.flatnonzero(np.r_[True, (np.diff(found["doc"]) != 0) | (np.diff(found["key"]) != 0)])
        for a, b in zip(edge, [*edge[1:], len(found)], strict=True):
            yield int(found["doc"][a]), int(found["key"][a]), runs[a:b].tobytes()


def by_group(batches: Iterator[pa.RecordBatch], group: type) -> Iterator[tuple]:
    """What a ``group`` object makes of each run of rows with one value in the first column."""
    current, at = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or row[0] != at:
                if current is not None:
                    yield from current.finish()
                current, at = group(), row[0]
            current.add(row[1:])
    if current is not None:
        yield from current.finish()


def hot_anchors(docs: DataFrame, width: int, limit: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with more than about ``limit`` windows, sorted, and into how many slices to deal them.

    There are fewer of them than windows over ``limit``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(width, 1)
        for batch in batches:
            hashes = [block.words.of(w) for w in (split_words(t.as_py()) for t in batch.column(0)) if len(w) >= width]
            if hashes:
                anchors, n = np.unique(np.concatenate([block.anchors_of(h) for h in hashes]), return_counts=True)
                yield pa.record_batch([pa.array(anchors.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])

    sampled = docs.where("doc_id IS NOT NULL").select("text").sample(share, seed=1)
    counted = sampled.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > limit * share).collect()
    anchors = np.array([r["anchor"] for r in rows], np.int64).view(_U)
    slices = np.array([r["n"] / share // limit + 1 for r in rows], _U)
    order = np.argsort(anchors)
    return anchors[order], slices[order]


def repeated_runs(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """``doc_id, key, runs`` of windows that also start in a smaller document."""
    ship(docs.sparkSession)
    if buckets is None:
        buckets = max(LEAST_BUCKETS, input_bytes(docs) // BUCKET_BYTES)
    hot = hot_anchors(docs, width, HOT_WINDOWS, SAMPLE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(width, buckets, hot)
        for batch in batches:
            for doc, key, text in zip(*batch.columns, strict=True):
                block.add(doc.as_py(), key.as_py(), text.as_py())
                if block.held >= BLOCK_WINDOWS:
                    yield block.take()
        if block.held:
            yield block.take()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ["doc_id", "key", "runs"]
        types = [pa.int64(), pa.int64(), pa.binary()]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for row in by_group(batches, Bucket):
            rows.append(row)
            if len(rows) >= 20_000:
                yield out()
                rows = []
        if rows:
            yield out()

    sent = (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("key"), "text")
        .mapInArrow(send, "bucket int, heads binary, h binary, c binary, settled binary")
    )
    parts = min(buckets, MOST_PARTITIONS)
    dealt = sent.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, "doc_id long, key long, runs binary")


def intervals(n_words: int, runs: list[bytes], width: int) -> np.ndarray:
    """Maximal intervals of words covered by the windows in ``runs``, as pairs."""
    edges = np.zeros(n_words + 1, np.int64)
    pairs = np.concatenate([np.frombuffer(r, "<i4") for r in runs]).reshape(-1, 2)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 1] + width, -1)
    covered = np.cumsum(edges[:-1]) > 0
    steps = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1)


def remove_repeats(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_words, removed, kept_text``; ``removed`` has maximal word intervals."""
    docs = docs.select("doc_id", "text")
    runs = repeated_runs(docs, width, buckets).groupBy("doc_id", "key").agg(F.collect_list("runs").alias("runs"))
    keyed = docs.withColumn("key", F.xxhash64("text"))
    joined = keyed.join(runs, ["doc_id", "key"], "left").select("doc_id", "text", "runs")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = split_words(text.as_py())
                counts.append(len(words))
                gone = []
                if found.is_valid:
                    kept, last = [], 0
                    for a, b in intervals(len(words), found.as_py(), width).tolist():
                        gone.append({"start": a, "end": b})
                        kept += words[last:a]
                        last = b
                    words = kept + words[last:]
                removed.append(gone)
                texts.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(texts, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, removed array<struct<start: bigint, end: bigint>>, kept_text string")


def digests(cleaned: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
