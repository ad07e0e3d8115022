"""Cross-entropy difference of documents under matched bigram models.

The target model is counted on documents labelled good, the background model on all documents;
both are interpolated bigram models of one order, one smoothing and one vocabulary, the words of
the corpus.  A document is scored by what the others teach: its own counts are taken out of the models' (the target's if
it is labelled good).  With counts ``c`` and totals ``N`` of a model without them::

    background  p(v) = c(v) / N, with its own counts      p(v|u) = (c(uv) + MU p(v)) / (c(u) + MU)
    target      p(v) = (c(v) + KAPPA pb(v)) / (N + KAPPA), and p(v|u) as above

A word without one before it has ``p(v)``.  The score of a document is the mean over its words of
``log pb - log pt``, in nats: the lower, the closer to the target.

Scale.  Models are as large as the corpus, so nobody holds one.  Documents are dealt once into blocks by
a hash of their id.  A block asks for the counts of its distinct words and bigrams (sorted 64-bit
hashes, delta-coded, one binary per bucket) and sends along how often it has them itself; a bucket
adds up all blocks' counts and answers each block in the order it asked; the block then scores
its documents, a part at a time.  A hot word is one entry per block.  Labels meet documents in the same exchange.

Blocks and buckets grow with the root of the input (``block_bytes``), so that there are in proportion to the input as many
messages from a block to a bucket.  From ``MOST_BLOCK_BYTES`` on, at about 200 GB, blocks stay as large, which
bounds memory, and messages get smaller as there are more of them; ``MOST_BLOCK_BYTES`` is to follow the memory of large clusters.

Defined cases: a null text or one without words has 0 words and null losses; null labels and ids
in ``labels`` are ignored; rows with a null id are never labelled; documents that share an id share its
label; without any target document the target model equals the background's words; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.substring_dedup import MOST_PARTITIONS, by_group
from seqloom.llm.words import BASES, WordHashes, mix, split_words
from seqloom.session import input_bytes, ship

KAPPA, MU = 1000.0, 5.0
#: Block sizes: the least, the most, and the bytes whose product with the input is the square of the size.
LEAST_BLOCK_BYTES, MOST_BLOCK_BYTES, ROOT_BYTES = 2 << 20, 64 << 20, 20_000
LEAST_BLOCKS, LEAST_BUCKETS = 12, 48
#: Words of a block that are scored at once.
PART_WORDS = 1 << 20

_U = np.uint64


def block_bytes(size: int) -> int:
    """Bytes of input per block, and per bucket."""
    return min(max(math.isqrt(size * ROOT_BYTES), LEAST_BLOCK_BYTES), MOST_BLOCK_BYTES)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one binary.  Bytes of one rank lie together, so that the zeros of small numbers compress away."""
    raw = np.array([len(a) for a in arrays], "<u4").tobytes()
    raw += b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return b"z" + zstandard.compress(raw, 1) if len(raw) > 200 else b"r" + raw


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.decompress(blob[1:]) if blob[:1] == b"z" else blob[1:]
    at, found = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<u4", len(kinds)).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return found


class Texts:
    """Documents of a block as word and bigram hashes."""

    def __init__(self, rows: list[tuple], words: WordHashes):
        good = {r[0] for r in rows if r[2]}
        self.ids = [r[0] for r in rows if not r[2]]
        hashes = [words.of(split_words(r[1])) for r in rows if not r[2]]
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.word = np.concatenate([np.empty(0, _U), *hashes])
        first = np.zeros(len(self.word), bool)
        first[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True
        self.first = first
        previous = np.r_[self.word[:1], self.word[:-1]]
        self.pair = mix(previous * _U(BASES[0]) + self.word)[~first]
        target = np.repeat(np.array([i in good and i is not None for i in self.ids], bool), self.lengths)
        self.target, self.pair_target = target, target[~first]

    def distinct(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For words and bigrams: distinct hashes, where each occurrence is among them, counts."""
        found = []
        for h, target in ((self.word, self.target), (self.pair, self.pair_target)):
            values, at = np.unique(h, return_inverse=True)
            found.append((values, at, np.bincount(at[target], minlength=len(values)), np.bincount(at, minlength=len(values))))
        return found


def _splits(values: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted hashes fall into buckets by their high bits; edges of the buckets."""
    width = ((1 << 64) - 1) // buckets
    return np.searchsorted(values, np.arange(1, buckets, dtype=_U) * _U(width))


def asker(buckets: int) -> type:
    words = WordHashes()

    class Asking:
        def __init__(self) -> None:
            self.rows: list[tuple] = []

        def add(self, row: tuple) -> None:
            self.block = row[0]
            self.rows.append(row[1:])

        def finish(self) -> Iterator[tuple]:
            kinds = []
            for values, _, target, every in Texts(self.rows, words).distinct():
                edges = _splits(values, buckets)
                parts = [np.split(x, edges) for x in (values, target.astype("<u4"), every.astype("<u4"))]
                kinds.append(list(zip(*parts, strict=True)))
            for b, (word, pair) in enumerate(zip(*kinds, strict=True)):
                if len(word[0]) or len(pair[0]):
                    yield b, self.block, _pack([x for v, t, n in (word, pair) for x in (np.diff(v, prepend=_U(0)), t, n)])

    return Asking


class Answering:
    """One bucket: adds up the counts of all blocks and answers each."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.rows.append(row)

    def finish(self) -> Iterator[tuple]:
        asked = [_unpack(r[2], ["<u8", "<u4", "<u4"] * 2) for r in self.rows]
        answers: list[list[np.ndarray]] = [[] for _ in self.rows]
        for kind in (0, 3):
            hashes = [np.cumsum(a[kind], dtype=_U) for a in asked]
            ends = np.cumsum([len(h) for h in hashes])[:-1]
            values, at = np.unique(np.concatenate(hashes), return_inverse=True)
            for column in (kind + 1, kind + 2):
                total = np.bincount(at, np.concatenate([a[column] for a in asked]), len(values)).astype("<i8")
                for answer, part in zip(answers, np.split(total[at], ends), strict=True):
                    answer.append(part)
        for row, answer in zip(self.rows, answers, strict=True):
            yield row[1], row[0], _pack(answer)


def _own(doc: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each occurrence of ``at`` in a document, how often the document has it."""
    _, which, n = np.unique(doc * size + at, return_inverse=True, return_counts=True)
    return n[which]


def score_block(rows: list[tuple], answers: list[tuple], target_words: int, all_words: int, words: WordHashes) -> list[tuple]:
    """``doc_id, n_words, target_loss, background_loss, score`` of the documents of a block."""
    texts = Texts(rows, words)
    parts = [_unpack(blob, ["<i8"] * 4) for _, blob in sorted(answers, key=lambda a: a[0])]

    def counts(column: int) -> np.ndarray:
        return np.concatenate([np.empty(0, "<i8"), *(p[column] for p in parts)])

    (_, every_word, _, _), (_, every_pair, _, _) = texts.distinct()
    word_target, word_all, pair_target, pair_all = map(counts, range(4))
    ends = np.cumsum(texts.lengths)
    pair_before = np.cumsum(~texts.first) - ~texts.first
    found: list[tuple] = []
    part = (ends - texts.lengths) // PART_WORDS
    for docs in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(part)) + 1) if len(ends) else []:
        lengths = texts.lengths[docs]
        n = int(lengths.sum())
        if not n:
            found += [(texts.ids[d], 0, None, None, None) for d in docs]
            continue
        at = int(ends[docs[0]] - lengths[0])
        here = slice(at, at + n)
        word_at, first, good = every_word[here], texts.first[here], texts.target[here]
        follows = np.flatnonzero(~first)
        pair_at = every_pair[pair_before[at] : pair_before[at] + len(follows)]
        doc = np.repeat(np.arange(len(docs)), lengths)
        own_word, own_pair = _own(doc, word_at, len(word_all)), _own(doc[follows], pair_at, len(pair_all))
        base = word_all[word_at] / max(all_words, 1)
        c = word_target[word_at] - own_word * good
        p = (c + KAPPA * base) / (target_words - lengths[doc] * good + KAPPA)
        target = p.copy()
        target[follows] = (pair_target[pair_at] - own_pair * good[follows] + MU * p[follows]) / (c[follows - 1] + MU)
        c = word_all[word_at] - own_word
        background = base.copy()
        background[follows] = (pair_all[pair_at] - own_pair + MU * base[follows]) / (c[follows - 1] + MU)
        losses, end = (-np.log(target), -np.log(background)), 0
        for d, size in zip(docs.tolist(), lengths.tolist(), strict=True):
            end += size
            if size:
                t, b = (float(x[end - size : end].mean()) for x in losses)
                found.append((texts.ids[d], size, t, b, t - b))
            else:
                found.append((texts.ids[d], 0, None, None, None))
    return found


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _through(group: type, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in by_group(batches, group):
            rows.append(row)
            if len(rows) >= 256:
                yield _batch(rows, names, types)
                rows = []
        if rows:
            yield _batch(rows, names, types)

    return run


SCORED = ["doc_id", "n_words", "target_loss", "background_loss", "score"]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score``; ``labels`` has doc_id, quality."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    size = input_bytes(docs)
    blocks, buckets = max(LEAST_BLOCKS, size // block_bytes(size)), max(LEAST_BUCKETS, size // block_bytes(size))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    counted = docs.select("doc_id", n_words.cast("long").alias("n"))
    totals = counted.join(good.withColumn("good", F.lit(True)), "doc_id", "left").agg(
        F.sum(F.when(F.col("good"), F.col("n"))).alias("target"), F.sum("n").alias("all")
    )
    target_words, all_words = (x or 0 for x in totals.first())

    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).cast("int")
    both = docs.withColumn("good", F.lit(False)).union(good.select("doc_id", F.lit(None).cast("string"), F.lit(True)))
    # By hash, so that the texts need no other exchange to meet their answers.
    dealt = both.select(block.alias("block"), "doc_id", "text", "good").repartition(min(blocks, MOST_PARTITIONS), "block")

    asking = dealt.sortWithinPartitions("block").select("block", F.col("block").alias("own"), "doc_id", "text", "good")
    types = [pa.int32(), pa.int32(), pa.binary()]
    asked = asking.mapInArrow(_through(asker(buckets), ["bucket", "block", "blob"], types), "bucket int, block int, blob binary")
    parts = min(buckets, MOST_PARTITIONS)
    queued = asked.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").select("bucket", F.col("bucket").alias("own"), "block", "blob")
    answered = queued.mapInArrow(_through(Answering, ["block", "bucket", "blob"], types), "block int, bucket int, blob binary")

    words = WordHashes()

    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = list(zip(*(texts[c].to_pylist() for c in ("doc_id", "text", "good")), strict=True))
        given = list(zip(*(answers[c].to_pylist() for c in ("bucket", "blob")), strict=True))
        found = score_block(rows, given, target_words, all_words, words)
        types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
        columns = zip(*found, strict=True) if found else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCORED)

    schema = "doc_id long, n_words long, target_loss double, background_loss double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(meet, schema)
