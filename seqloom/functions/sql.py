"""SQL surface: scalar functions that return arrays, and table functions for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from seqloom.functions.encode import CODES
from seqloom.functions.hashers import nt_hash
from seqloom.plans import kernel
from seqloom.plans.kernel import Spec
from seqloom.session import ship


def _positions(seq: str | None, k: int, w: int, canonical: bool, select: str) -> np.ndarray:
    raw = np.frombuffer((seq or "").encode(), np.uint8)
    if canonical and (k + w) % 2:
        raise ValueError("canonical windows need an odd length k + w - 1")
    if (CODES[raw] > 3).any():
        raise ValueError("a letter is no base")
    spec = Spec(k, w, nt_hash(k, canonical), select, canonical)
    parts = [out["pos"] for out in kernel.sketch(raw, np.array([0]), np.array([len(raw)]), spec)]
    return np.concatenate([np.empty(0, np.int64), *parts])


def _array_function(select: str):
    @pandas_udf("array<bigint>")
    def positions(seq: pd.Series, k: pd.Series, w: pd.Series, canonical: pd.Series) -> pd.Series:
        rows = zip(seq, k, w, canonical, strict=True)
        return pd.Series([None if s is None else _positions(s, int(a), int(b), bool(c), select) for s, a, b, c in rows])

    return positions


def register(spark: SparkSession) -> None:
    """``minimizer_positions``, ``closed_syncmer_positions``, ``open_syncmer_positions`` (seq, k, w, canonical)
    as scalar functions, ``minimizers(seq, k, w, canonical)`` as a table function, and ``revcomp(seq)``."""
    ship(spark)
    for name, select in (("minimizer", "minimizer"), ("closed_syncmer", "closed"), ("open_syncmer", "open")):
        spark.udf.register(f"{name}_positions", _array_function(select))

    @udtf(returnType="ord bigint, pos bigint, sk_start bigint")
    class Minimizers:
        def eval(self, seq: str, k: int, w: int, canonical: bool) -> Iterator[tuple[int, int, int]]:
            if seq is None:
                return
            raw = np.frombuffer(seq.encode(), np.uint8)
            spec = Spec(k, w, nt_hash(k, canonical), "minimizer", canonical)
            for out in kernel.sketch(raw, np.array([0]), np.array([len(raw)]), spec):
                yield from zip(out["ord"].tolist(), out["pos"].tolist(), out["win"].tolist(), strict=True)

    spark.udtf.register("minimizers", Minimizers)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGTacgt', 'TGCAtgca')")


