"""Hashed character n-grams of the letters of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII other than letters becomes a space; bytes of other code points count as letters.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_POWERS, _FINAL = np.cumprod(np.full(32, 0x01000193, dtype=np.uint32), dtype=np.uint32), np.uint32(0x9E3779B1)
#: Characters hashed at once.
CHUNK = 1 << 20


def letters(text: str | None) -> np.ndarray:
    """The text in lower case with a space at either end and one between the words, as code points."""
    words = (text or "").lower().encode().translate(_LETTERS).split()
    return np.frombuffer(f" {b' '.join(words).decode()} ".encode("utf-32-le"), dtype="<u4") if words else np.zeros(0, dtype=np.uint32)


def grams(data: np.ndarray, sizes: range, bits: int) -> Iterator[np.ndarray]:
    """Hashes (below 2^bits) of all n-grams of `data`, for each n of `sizes` from 1 on or above; long data comes in pieces."""
    for lo in range(0, max(1, len(data) - sizes[0] + 1), CHUNK):
        part = data[lo : lo + CHUNK + sizes[-1] - 1].astype(np.uint32)
        own = part + np.uint32(1)
        total = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, sizes[-1] + 1):
            m = min(CHUNK, len(part) - n + 1)
            if m <= 0:
                break
            total = total[: len(part) - n + 1] + own[n - 1 :] * _POWERS[n - 1]
            if n in sizes:
                h = total[:m] + np.uint32(n)
                h = (h ^ (h >> np.uint32(15))) * _FINAL
                yield (h ^ (h >> np.uint32(13))) * _FINAL >> np.uint32(32 - bits)


def counted(data: np.ndarray, sizes: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a text's n-grams and how often each occurs."""
    found = list(grams(data, sizes, bits)) if len(data) else []
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def summed(vectors: DataFrame, fan: int = 64) -> np.ndarray | None:
    """The sum of `vectors` (part long, v binary of int64), added up as a tree of fan-in `fan`; the driver gets one row."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), dtype="<i8") for v in table.column("v"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    most = max(2, vectors.rdd.getNumPartitions())
    while most > 1:
        vectors = vectors.withColumn("part", F.expr(f"part div {fan}")).groupBy("part").applyInArrow(add, "part long, v binary")
        most = -(-most // fan)
    row = vectors.first()
    return np.frombuffer(row.v, dtype="<i8") if row else None
