"""The vectorised strategy: numpy over Arrow batches of whole sequences.

Short sequences of a batch are laid end to end and handled together; windows that would span two
of them are masked.  A long sequence is taken in overlapping pieces of ``PIECE`` windows, so temporary
memory is bounded whatever its length.  Sliding minima come from block-wise prefix and
suffix minima: constant work per letter for any window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from seqloom.functions.encode import codes
from seqloom.functions.hashers import BLOCK, Hasher

PIECE = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_HIGH16, _LOW16 = np.uint32(0xFFFF0000), np.uint32(0xFFFF)
_PLACE = np.arange(1 << 16, dtype=np.uint32)


@dataclass(frozen=True)
class Spec:
    """What to compute: windows of ``w`` k-mers and how they are selected."""

    k: int
    w: int
    hasher: Hasher
    select: str = "minimizer"  # or "window", "closed", "open"
    canonical: bool = False
    skip_ambiguous: bool = False
    super_kmers: bool = False
    value_length: int = 0  # letters of a value; 0: none
    rightmost: bool = False

    @property
    def length(self) -> int:
        return self.k + self.w - 1


def sliding_extreme(keys: np.ndarray, w: int, largest: bool = False) -> np.ndarray:
    """Minimum (or maximum) of every ``w`` neighbours, by doubling the width."""
    if len(keys) < w:
        return keys[:0]
    best, size = np.maximum if largest else np.minimum, 1
    while 2 * size <= w:
        keys = best(keys[:-size], keys[size:])
        size *= 2
    rest = w - size
    return best(keys[:-rest], keys[rest:]) if rest else keys


def leftmost(order: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of every ``w`` neighbours."""
    keys = (order.astype(np.uint64) << np.uint64(32)) | np.arange(len(order), dtype=np.uint64)
    return (sliding_extreme(keys, w) & _LOW).astype(np.int64)


def rightmost(order: np.ndarray, w: int) -> np.ndarray:
    """Index of the rightmost minimum of every ``w`` neighbours."""
    keys = ((_LOW - order.astype(np.uint64)) << np.uint64(32)) | np.arange(len(order), dtype=np.uint64)
    return (sliding_extreme(keys, w, largest=True) & _LOW).astype(np.int64)


def window_sums(flags: np.ndarray, length: int) -> np.ndarray:
    """Sums of every ``length`` neighbours (of at most 3 each), put together from doubled widths."""
    n = len(flags) - length + 1
    part = flags.astype(np.uint16 if 3 * length < 1 << 16 else np.uint32)
    if n <= 0:
        return part[:0]
    total, at, size, left = None, 0, 1, length
    while left:
        if left & 1:
            total = part[at : at + n] if total is None else total + part[at : at + n]
            at += size
        left >>= 1
        if left:
            part = part[:-size] + part[size:]
            size *= 2
    return total


def windows(letters: np.ndarray, spec: Spec) -> np.ndarray:
    """Chosen position of every window, in blocks that fit a core's caches.

    Of hashes whose upper 16 bits count, hash and place in the block make one 32-bit key.
    """
    n = len(letters) - spec.length + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    chosen = np.empty(n, np.uint32)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        part = letters[a : b + spec.length - 1]
        left = right = None
        if spec.hasher.top16:
            h = spec.hasher.hashes(part)
            if spec.canonical or not spec.rightmost:
                left = sliding_extreme((h & _HIGH16) | _PLACE[: len(h)], spec.w) & _LOW16
            if spec.canonical or spec.rightmost:
                right = sliding_extreme((~h & _HIGH16) | _PLACE[: len(h)], spec.w, largest=True) & _LOW16
        else:
            order = spec.hasher.order(part)
            left = leftmost(order, spec.w) if spec.canonical or not spec.rightmost else None
            right = rightmost(order, spec.w) if spec.canonical or spec.rightmost else None
        if spec.canonical:
            strand = window_sums(part & 2, spec.length) > spec.length
            best = np.where(strand, left, right)
        else:
            best = right if spec.rightmost else left
        np.add(best, a, out=chosen[a:b], casting="unsafe")
    return chosen


def values(letters: np.ndarray, positions: np.ndarray, length: int, canonical: bool) -> np.ndarray:
    """2 bits a letter, the first lowest; canonical: the smaller of both strands.  Over 31 letters: rows of the low and high 64 bits."""

    def words(step: int, flip: int) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(len(positions), np.uint64), np.zeros(len(positions), np.uint64)]
        for j in range(length):
            at = positions + (j if step > 0 else length - 1 - j)
            found[j // 32] |= (letters[at].astype(np.uint64) ^ np.uint64(flip)) << np.uint64(2 * (j % 32))
        return found[1], found[0]

    high, low = words(1, 0)
    if canonical:
        other_high, other_low = words(-1, 2)
        smaller = (other_high < high) | ((other_high == high) & (other_low < low))
        high, low = np.where(smaller, other_high, high), np.where(smaller, other_low, low)
    if length <= 31:
        return low.astype(np.int64)
    return np.stack([low, high], axis=1)


def _pieces(lengths: np.ndarray, spec: Spec) -> Iterator[tuple[int, int, int]]:
    """``(first sequence, last sequence + 1, -1)`` groups, or ``(sequence, offset, end)`` pieces."""
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if n > PIECE + spec.length:
            if first < i:
                yield first, i, -1
            for offset in range(0, n - spec.length + 1, PIECE):
                yield i, offset, min(n, offset + PIECE + spec.length - 1)
            first, held = i + 1, 0
        else:
            held += n
            if held >= PIECE:
                yield first, i + 1, -1
                first, held = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths), -1


def sketch(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, spec: Spec) -> Iterator[dict[str, np.ndarray | list]]:
    """Columns ``row, ord, pos`` (and what the spec asks for) of sequences laid end to end in ``data``."""
    carry: dict[int, tuple[int, int]] = {}  # sequence -> (rows so far, last position), of one taken in pieces
    pending = None
    for a, b, end in _pieces(lengths, spec):
        if end < 0:
            lo, hi, offset = int(starts[a]), int(starts[b - 1] + lengths[b - 1]), 0
            sizes = lengths[a:b]
        else:
            lo, hi, offset = int(starts[a]) + b, int(starts[a]) + end, b
            sizes = np.array([end - b])
        raw = data[lo:hi]
        if spec.hasher.alphabet == "dna":
            letters = codes(raw)
            ambiguous = letters > 3 if len(letters) and letters.max() > 3 else None
            if ambiguous is not None:
                if not spec.skip_ambiguous:
                    raise ValueError("a letter is no base; use skip_ambiguous")
                letters = np.where(ambiguous, raw >> 1 & 3, letters)
        else:
            letters, ambiguous = raw, None
        chosen = windows(letters, spec)
        n_windows = len(chosen)
        begins = np.cumsum(sizes) - sizes
        # The last windows before each sequence's end would span two sequences.
        valid = np.ones(n_windows, bool)
        for stop in np.cumsum(sizes).tolist():
            valid[max(stop - spec.length + 1, 0) : stop] = False
        if ambiguous is not None:
            valid &= window_sums(ambiguous, spec.length)[:n_windows] == 0
        known, last = carry.get(a, (0, -1)) if end >= 0 else (0, -1)
        if spec.select == "minimizer":
            # A window after an invalid one never repeats the one before that.
            fresh = np.ones(n_windows, bool)
            np.not_equal(chosen[1:], chosen[:-1], out=fresh[1:])
            fresh[1:] |= ~valid[:-1]
            if end >= 0 and n_windows:
                fresh[0] = int(chosen[0]) + offset != last
                last = int(chosen[-1]) + offset if valid[-1] else -1
            keep = valid & fresh
        elif spec.select == "window":
            keep = valid
        else:
            ahead = chosen - np.arange(n_windows, dtype=np.uint32)
            keep = valid & ((ahead == spec.w // 2) if spec.select == "open" else (ahead == 0) | (ahead == spec.w - 1))
        win = np.flatnonzero(keep)
        sampled = win if spec.select in ("closed", "open") else chosen[win].astype(np.int64)
        # Rows come in the order of their sequences: where each sequence's rows start says whose they are.
        cuts = np.searchsorted(win, begins)
        counts = np.diff(cuts, append=len(win))
        begin = np.repeat(begins - offset, counts)
        own = np.repeat(np.arange(len(sizes)), counts)
        out: dict[str, np.ndarray | list] = {
            "row": own + a,
            "ord": np.arange(len(win)) - np.repeat(cuts - known, counts),
            "win": win - begin,
            "pos": sampled - begin,
        }
        if end >= 0:
            carry = {a: (known + len(own), last)}
        if spec.value_length:
            out["value"] = values(letters, sampled, spec.value_length, spec.canonical)
        if spec.super_kmers:
            out["sk_end"] = np.r_[out["win"][1:] + spec.length - 1, 0] if len(own) else out["win"]
            closing = np.diff(own, append=-1) != 0
            out["sk_end"] = np.where(closing, lengths[out["row"]], out["sk_end"])
            if pending is not None and len(own):
                if end >= 0 and pending["row"][-1] == a:
                    pending["sk_end"][-1] = out["win"][0] + spec.length - 1
                yield pending
                pending = None
            elif pending is not None:
                continue
            pending = out
        else:
            yield out
    if pending is not None:
        yield pending


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string or binary column; a null has length 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return letters_of(column.fill_null(""))
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], lengths


def arrow_value(found: np.ndarray, length: int) -> pa.Array:
    """Values as an Arrow array; wide ones are 128-bit integers already, up to 63 letters within 38 digits."""
    if length <= 31:
        return pa.array(found, pa.int64())
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(found), [None, pa.py_buffer(np.ascontiguousarray(found, "<u8"))])


def strings_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The pieces ``data[start : start + length]`` as an array of strings."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    buffers = [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(data[at])]
    return pa.Array.from_buffers(pa.large_string(), len(lengths), buffers).cast(pa.string())


def run_batches(batches: Iterator[pa.RecordBatch], spec: Spec, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``seq_id`` and the wanted columns for batches of ``seq_id, seq``."""
    for batch in batches:
        if not len(batch):
            continue
        data, starts, lengths = letters_of(batch.column(1))
        for out in sketch(data, starts, lengths, spec):
            arrays = [batch.column(0).take(pa.array(out["row"]))]
            for c in columns:
                source = "win" if c == "sk_start" else c
                if c == "super_kmer":
                    arrays.append(strings_of(data, starts[out["row"]] + out["win"], out["sk_end"] - out["win"]))
                    continue
                arrays.append(arrow_value(out["value"], spec.value_length) if c == "value" else pa.array(out[source], pa.int64()))
            yield pa.record_batch(arrays, names=["seq_id", *columns])


def run_array_batches(batches: Iterator[pa.RecordBatch], spec: Spec, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per sequence, with an array for each wanted column."""
    for batch in batches:
        if not len(batch):
            continue
        data, starts, lengths = letters_of(batch.column(1))
        parts = list(sketch(data, starts, lengths, spec))
        rows = np.concatenate([np.empty(0, np.int64), *(p["row"] for p in parts)])
        offsets = np.zeros(len(batch) + 1, np.int32)
        np.cumsum(np.bincount(rows, minlength=len(batch)), out=offsets[1:])
        arrays = [batch.column(0)]
        for c in columns:
            source = "win" if c == "sk_start" else c
            if c == "value" and spec.value_length > 31:
                flat = arrow_value(np.concatenate([np.empty((0, 2), np.uint64), *(p["value"] for p in parts)]), spec.value_length)
            else:
                flat = pa.array(np.concatenate([np.empty(0, np.int64), *(p[source] for p in parts)]), pa.int64())
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
        yield pa.record_batch(arrays, names=["seq_id", *columns])
