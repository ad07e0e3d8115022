"""Sequence sketching (minimizers, syncmers, super-k-mers) as Spark DataFrame operators.

The names in ``__all__`` are loaded when first used, so that workers import only what they run.
"""

import importlib

_PUBLIC = {
    "seqloom.operators.sketch": (
        "Sketch minimizers canonical_minimizers window_minimizers closed_syncmers open_syncmers syncmers minimizer_positions"
        " canonical_minimizer_positions one_minimizer kmer_hashes super_kmer_strings"
    ),
    "seqloom.operators.sliding": "sliding_min hashed_minimizers jumping_minimizers",
    "seqloom.operators.streams": "adjacent_dedup adjacent_dedup_with_index islands filter_syncmers collected numbered",
    "seqloom.functions.hashers": "nt_hash mul_hash antilex_hash nt_hash64 mul_hash64 fx_packed_hash",
    "seqloom.functions.encode": "dna_only reverse_complement slice_bases value_digits is_ambiguous",
    "seqloom.sources.fasta": "read_fasta read_fastq write_fasta write_fastq",
    "seqloom.sources.generate": "random_sequences",
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)
