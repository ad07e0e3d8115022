"""Hashes of all k-mers of a sequence, vectorised over numpy arrays of letters.

A hasher maps letters (codes 0..3 for DNA, bytes for text) to one unsigned number per k-mer.
Rolling hashes are XORs of rotated per-letter terms; they come from one running XOR::

    P(i) = XOR over j < i of rotr(term(j), R j)        fwd(i) = rotl(P(i+k) ^ P(i), R (i+k-1))
    Q(i) = XOR over j < i of rotl(term(comp j), R j)   rc(i)  = rotr(Q(i+k) ^ Q(i), R i)

A canonical hash adds the two strands' hashes modulo the word size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Terms of the 32-bit rolling hash for the codes A, C, T, G, and its rotation.
NT32 = (0x95C60474, 0x62A02B4C, 0x82572324, 0x4BE24456)
NT32_ROTATION = 7
# Terms of the 64-bit rolling hash for A, C, G, T; N is 0 and any other byte 1.
NT64 = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456, "N": 0}
# Multipliers of the multiplicative hashes and of the packed one.
MUL64 = 0x517CC1B727220A95
MUL32 = MUL64 & 0xFFFFFFFF
FX32 = 1234565323

SEED_STEP, CODE_STEP = 0x9E3779B1, 0x85EBCA6B


def seed_mask(seed: int, code: int) -> int:
    """What a seed adds (by XOR) to the 32-bit term of a letter; nothing for seed 0."""
    return (seed * SEED_STEP + code * CODE_STEP) & 0xFFFFFFFF if seed else 0


#: Letters handled at once: small enough for the caches of a core.
BLOCK = 1 << 15


@functools.cache
def _tables(terms: tuple[int, ...], rotation: int, bits: int, alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place modulo the word size and each letter: its term turned for P, its complement's for Q."""
    kind, mask = np.uint32 if bits == 32 else np.uint64, (1 << bits) - 1

    def rotl(x: int, r: int) -> int:
        return (x << r % bits | x >> (bits - r % bits)) & mask

    other = [terms[c ^ 2] for c in range(4)] if alphabet == "dna" else terms
    forward = [rotl(t, -rotation * j) for j in range(bits) for t in terms]
    backward = [rotl(t, rotation * j) for j in range(bits) for t in other]
    return np.array(forward, kind), np.array(backward, kind)


@functools.lru_cache(64)
def _grown(kind: str, letters: int, rotation: int, bits: int, size: int) -> tuple[np.ndarray, ...]:
    if kind == "offsets":
        return (np.resize(np.arange(bits) * letters, size),)
    word = np.uint32 if bits == 32 else np.uint64
    left = np.resize(np.arange(bits) * rotation % bits, size)
    return left.astype(word), ((bits - left) % bits).astype(word)


def _offsets(letters: int, rotation: int, bits: int, n: int) -> np.ndarray:
    """Where the table row of each place starts."""
    return _grown("offsets", letters, rotation, bits, 1 << n.bit_length())[0][:n]


def _turns(rotation: int, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each place is turned left, and right."""
    return _grown("turns", 0, rotation, bits, 1 << n.bit_length())


def _turned(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``x`` rotated left by ``left``, which with ``right`` makes a whole turn (or both are 0)."""
    y = x << left
    x >>= right
    y |= x
    return y


@dataclass(frozen=True)
class Hasher:
    """A rolling hash by per-letter terms, or a hash of its own by ``direct``.

    ``terms`` has 4 entries (by code) for DNA, 256 for bytes.  ``top16`` says that only the upper
    16 of 32 bits are compared.
    """

    name: str
    k: int
    canonical: bool = False
    seed: int = 0
    alphabet: str = "dna"
    bits: int = 32
    rotation: int = NT32_ROTATION
    terms: tuple[int, ...] = ()
    top16: bool = True
    direct: Callable[[np.ndarray, int], np.ndarray] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be at least 1")

    def complement(self, letters: np.ndarray) -> np.ndarray:
        """The other strand's letters; text has no complement and is only read backwards."""
        return letters ^ 2 if self.alphabet == "dna" else letters

    def hashes(self, letters: np.ndarray) -> np.ndarray:
        """One hash per k-mer, unsigned."""
        n, k = len(letters) - self.k + 1, self.k
        kind = np.uint32 if self.bits == 32 else np.uint64
        if n <= 0:
            return np.empty(0, kind)
        if self.direct is not None:
            forward = self.direct(letters, k)
            if not self.canonical:
                return forward
            backward = self.direct(self.complement(letters)[::-1], k)[::-1]
            return forward + backward
        if n > 2 * BLOCK:
            return np.concatenate([self.hashes(letters[a : min(a + BLOCK, n) + k - 1]) for a in range(0, n, BLOCK)])
        index = letters + _offsets(len(self.terms), self.rotation, self.bits, len(letters))
        scan = np.zeros(len(letters) + 1, kind)
        tables = _tables(self.terms, self.rotation, self.bits, self.alphabet)
        np.bitwise_xor.accumulate(tables[0][index], out=scan[1:])
        left, right = _turns(self.rotation, self.bits, n + k)
        forward = _turned(scan[k:] ^ scan[:-k], left[k - 1 : k - 1 + n], right[k - 1 : k - 1 + n])
        if not self.canonical:
            return forward
        np.bitwise_xor.accumulate(tables[1][index], out=scan[1:])
        backward = _turned(scan[k:] ^ scan[:-k], right[:n], left[:n])
        backward += forward
        return backward

    def order(self, letters: np.ndarray) -> np.ndarray:
        """Numbers below 2**32 that compare as the hashes do."""
        h = self.hashes(letters)
        if self.top16:
            return h >> np.uint32(16)
        return h if self.bits == 32 else np.unique(h, return_inverse=True)[1].astype(np.uint32)


def nt_hash(k: int, canonical: bool = False, seed: int = 0) -> Hasher:
    """The default: 32-bit rolling hash of DNA."""
    terms = tuple(t ^ seed_mask(seed, c) for c, t in enumerate(NT32))
    return Hasher("nt", k, canonical, seed, terms=terms)


def mul_hash(k: int, canonical: bool = False, seed: int = 0, alphabet: str = "text") -> Hasher:
    """Multiplicative rolling hash of any bytes; DNA codes stand for their letters' bytes.

    Defined here: the term of a byte is ``byte * MUL32 mod 2**32``, XORed with the seed's mask.
    """
    letters = [ord(c) for c in "ACTG"] if alphabet == "dna" else range(256)
    terms = tuple((b * MUL32 & 0xFFFFFFFF) ^ seed_mask(seed, b) for b in letters)
    return Hasher("mul", k, canonical, seed, alphabet=alphabet, terms=terms)


def antilex_hash(k: int, canonical: bool = False) -> Hasher:
    """Anti-lexicographic order of DNA.

    Defined here: the first base counts ``3 - code``, then codes in reading order, 2 bits each,
    from the highest bits down, over the first 16 bases.
    """

    def direct(letters: np.ndarray, k: int) -> np.ndarray:
        n = len(letters) - k + 1
        h = np.zeros(n, np.uint32)
        for j in range(min(k, 16)):
            code = letters[j : j + n].astype(np.uint32)
            h |= (np.uint32(3) - code if j == 0 else code) << np.uint32(30 - 2 * j)
        return h

    return Hasher("antilex", k, canonical, direct=direct)


def nt_hash64(k: int) -> Hasher:
    """64-bit rolling hash with rotation 1 over bytes, compared in full."""
    terms = [1] * 256
    for letter, t in NT64.items():
        terms[ord(letter)] = t
    return Hasher("nt64", k, alphabet="text", bits=64, rotation=1, terms=tuple(terms), top16=False)


def mul_hash64(k: int) -> Hasher:
    """64-bit multiplicative rolling hash with rotation 1 over bytes, compared in full."""
    terms = tuple(b * MUL64 & (1 << 64) - 1 for b in range(256))
    return Hasher("mul64", k, alphabet="text", bits=64, rotation=1, terms=terms, top16=False)


def fx_packed_hash(k: int) -> Hasher:
    """The packed k-mer (last base lowest) times a constant, modulo 2**32, compared in full."""
    if k > 16:
        raise ValueError("a packed 32-bit hash needs k <= 16")

    def direct(letters: np.ndarray, k: int) -> np.ndarray:
        n = len(letters) - k + 1
        h = np.zeros(n, np.uint32)
        for j in range(k):
            h = (h << np.uint32(2)) | letters[j : j + n]
        return h * np.uint32(FX32)

    return Hasher("fx", k, top16=False, direct=direct)


def custom_hash(k: int, function: Callable[[np.ndarray, int], np.ndarray], canonical: bool = False, alphabet: str = "dna") -> Hasher:
    """A user's hash: ``function(letters, k)`` gives an unsigned 32-bit number per k-mer."""
    return Hasher("custom", k, canonical, alphabet=alphabet, direct=function)
