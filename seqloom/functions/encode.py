"""Bases, complements and ambiguity as Column expressions and lookup tables.

DNA letters have the codes A=0, C=1, T=2, G=3, upper or lower case; ``code ^ 2`` is the
complement, and bit 2 of a code marks T and G.  Any other letter is ambiguous.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACTG"
#: Code of each byte, 255 where the byte is no DNA letter.
CODES = np.full(256, 255, np.uint8)
for _code, _letter in enumerate(LETTERS):
    CODES[ord(_letter)] = CODES[ord(_letter.lower())] = _code


def codes(raw: np.ndarray) -> np.ndarray:
    """The codes of an array of bytes."""
    return np.frombuffer(raw.tobytes().translate(CODES.tobytes()), np.uint8)


def dna_only(text: Column, keep_n: bool = False) -> Column:
    """The DNA letters of a text, upper case; with ``keep_n`` also N."""
    return F.upper(F.regexp_replace(text, "[^ACGTNacgtn]" if keep_n else "[^ACGTacgt]", ""))


def base_code(letter: Column) -> Column:
    """0 to 3 of a DNA letter (the bits that its ASCII value has for it)."""
    return F.shiftright(F.ascii(letter), 1).bitwiseAND(3).cast("long")


def is_ambiguous(sequence: Column) -> Column:
    """Whether a sequence or k-mer holds a letter that is no base."""
    return sequence.rlike("[^ACGTacgt]")


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), "ACGTacgt", "TGCAtgca")


def swap_gt(sequence: Column) -> Column:
    """Letters G and T exchanged, so that byte order becomes code order."""
    return F.translate(sequence, "GTgt", "TGtg")


def slice_bases(sequence: Column, start: int | Column, end: int | Column) -> Column:
    """Bases ``start`` (0-based) up to ``end``, exclusive."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(sequence, start + 1, F.greatest(end - start, F.lit(0)))


def kmer_value(kmer: Column, length: int) -> Column:
    """2 bits a base, the first base lowest; long up to 31 bases, else decimal(38,0) up to 63."""
    digits = F.translate(F.reverse(F.upper(kmer)), LETTERS, "0123")
    if length <= 31:
        return F.conv(digits, 4, 10).cast("long")
    if length > 63:
        raise ValueError("values of more than 63 bases exceed decimal(38,0); compare digit strings instead")
    # Three parts of 21 bases (42 bits); their weighted sum fits 38 digits.
    total = F.lit(0).cast("decimal(38,0)")
    for part in range(-(-length // 21)):
        end = length - 21 * part
        start = max(end - 21, 0)
        number = F.conv(F.substring(digits, start + 1, end - start), 4, 10).cast("decimal(13,0)")
        total = (total + number * F.lit(str(4 ** (21 * part))).cast("decimal(26,0)")).cast("decimal(38,0)")
    return total


def canonical_value(kmer: Column, length: int) -> Column:
    """The smaller of the values of a k-mer and of its reverse complement."""
    return F.least(kmer_value(kmer, length), kmer_value(reverse_complement(kmer), length))


def value_digits(kmer: Column, canonical: bool = False) -> Column:
    """The value of a k-mer of any length as base-4 digits, highest first.

    Strings of one length compare as their values do, so the smaller one is the canonical one.
    """
    def digits(c: Column) -> Column:
        return F.translate(F.reverse(F.upper(c)), LETTERS, "0123")

    return F.least(digits(kmer), digits(reverse_complement(kmer))) if canonical else digits(kmer)
