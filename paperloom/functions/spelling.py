"""Edit distance of spelling correction: optimal string alignment, in which swapping neighbours costs one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def osa(a: str, b: str, most: int | None = None) -> int:
    """The distance of ``a`` and ``b``, or ``most + 1`` where it is greater than ``most``."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if most is not None and min(row) > most and min(before) > most:
            return most + 1
    return row[-1] if most is None else min(row[-1], most + 1)


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    text = "".join(w.ljust(width, chr(pad)) for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(words), width)


def osa_many(a: list[str], b: list[str], step: int = 4096) -> np.ndarray:
    """The distances of ``a[i]`` and ``b[i]``, a cell of all tables at once. Pairs go by length, so that a long word pads few others."""
    out = np.zeros(len(a), np.int32)
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    order = np.argsort(np.maximum(n, m), kind="stable")
    for i in range(0, len(a), step):
        at = order[i : i + step]
        high, wide = int(n[at].max()), int(m[at].max())
        # two fillers that equal nothing, not even each other
        x, y = _codes([a[j] for j in at], max(1, high), 0xFFFE).T, _codes([b[j] for j in at], max(1, wide), 0xFFFF).T
        d = np.zeros((high + 1, wide + 1, len(at)), np.int32)
        d[:, 0] = np.arange(high + 1)[:, None]
        d[0] = np.arange(wide + 1)[:, None]
        for r in range(1, high + 1):
            for c in range(1, wide + 1):
                best = np.minimum(np.minimum(d[r - 1, c], d[r, c - 1]) + 1, d[r - 1, c - 1] + (x[r - 1] != y[c - 1]))
                if r > 1 and c > 1:
                    swap = (x[r - 1] == y[c - 2]) & (x[r - 2] == y[c - 1])
                    best = np.where(swap, np.minimum(best, d[r - 2, c - 2] + 1), best)
                d[r, c] = best
        out[at] = d[n[at], m[at], np.arange(len(at))]
    return out


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([None] * len(a), dtype="Int32")
    out[ok] = osa_many(a[ok].tolist(), b[ok].tolist())
    return out


def deletions(word: str, most: int) -> set[str]:
    """``word`` with up to ``most`` letters left out, itself included."""
    found = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found
