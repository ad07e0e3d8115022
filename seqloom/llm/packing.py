"""Bounded-space online packing of token ids into sequences.

Each partition keeps at most ``open_windows`` partly filled windows.  A document that is longer
than a window first fills whole windows; what remains goes into the open window that
it fills best.  If none has room, a new one is opened; if all places are taken, the fullest
is topped up with the front of the remainder and emitted, and the rest is placed again.
At the end the leftovers of a partition are merged, fullest first: they are cut into
full sequences, and the last rest into sequences whose lengths are powers of two.  So no
sequence is padded at all, one pass without a shuffle does it, and memory is bounded by the
open windows and one batch, whatever the input.

Defined cases: a null or empty text is the end id alone; null and repeated ids are packed like any
others (sequence ids come from the partition, not from documents); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame

from seqloom.session import ship

WINDOW = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: White space of so many characters in a row is beyond the stack of the faster library.
LONG_SPACE = 100_000
#: Rows are handed on when they hold so many ids.
FLUSH_IDS = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def has_long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in re.finditer(r"\s{2,}", text))


@functools.cache
def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None):
    """A function from a text to its ids in ``vocabulary`` (a file of the tokenizers library).

    With ``ranks`` and ``pattern``, the same vocabulary as byte-pair ranks, texts without
    special tokens and without very long white space go through the faster tiktoken.  It gives the same ids:

    * Both cut a text by the same pattern, and put every code point into the same class of it.
    * Both join the neighbours of lowest rank first, the leftmost of equals.  One joins any neighbours
      that make a token, the other only the pair listed for it.  Say they differ first where neighbours
      A', B' make a token whose pair is A, B.  Nothing was joined across the ends of A'B', so the steps inside were
      those of the token's bytes alone; these end in that token, by its only pair, so A'B' is that pair.

    The tests check what this rests on: equal tables, each token listed once and after its parts, every
    token's bytes giving that token, and the class of every code point.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if ranks is None:
        return slow
    import tiktoken

    with open(ranks, "rb") as f:
        merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merged, special_tokens={})

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special) or has_long_space(text):
            return slow(text)
        return np.array(quick.encode_ordinary(text), dtype="<u4")

    return fast


class Packer:
    """Places ids into windows; finished pieces gather in ``rows``."""

    def __init__(self, first_sequence: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.places, self.sequence = window, open_windows, first_sequence
        self.open: list[tuple[int, list]] = []  # (free ids, pieces)
        self.rows: list[tuple] = []
        self.held = 0

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.held += offset
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.emit([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        while at < total:
            left = total - at
            fit = min((i for i, w in enumerate(self.open) if w[0] >= left), key=lambda i: self.open[i][0], default=None)
            if fit is None and len(self.open) < self.places:
                self.open.append((self.window, []))
                fit = len(self.open) - 1
            if fit is None:
                fit = min(range(len(self.open)), key=lambda i: self.open[i][0])
                left = self.open[fit][0]
            free, pieces = self.open[fit]
            pieces.append((doc, at, ids[at : at + left].copy(), total))
            at += left
            if free == left:
                self.emit(pieces)
                del self.open[fit]
            else:
                self.open[fit] = (free - left, pieces)

    def finish(self) -> None:
        """Merges the leftovers into full sequences and a rest in powers of two."""
        pieces = [p for _, window in sorted(self.open, key=lambda w: w[0]) for p in window]
        self.open = []
        rest = sum(len(p[2]) for p in pieces)
        while rest:
            want = self.window if rest >= self.window else 1 << (rest.bit_length() - 1)
            rest -= want
            taken = []
            while want:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > want:
                    pieces.insert(0, (doc, start + want, ids[want:], total))
                    ids = ids[:want]
                taken.append((doc, start, ids, total))
                want -= len(ids)
            self.emit(taken)

    def take(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit ids.  The vocabulary files are sent to the workers, which need not have them.
    """
    ship(docs.sparkSession)
    sent = []
    for path in (vocabulary, ranks):
        if path is not None:
            docs.sparkSession.sparkContext.addFile(str(path))
        sent.append(path and os.path.basename(str(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(name and SparkFiles.get(name) for name in sent), pattern)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc.as_py(), np.append(encode(text.as_py() or ""), np.array([end_id], "<u4")))
                if packer.held >= FLUSH_IDS:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
