"""Labelled rows to learn from, and small models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def sample(rows: DataFrame, key: str, most: int, salt: int = 5) -> DataFrame:
    """About most rows at most, chosen by a hash of key; all rows where there are fewer."""
    n = rows.count()
    steps = 1 << 40
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(steps)) < steps * most // n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of a bounded sample of the labelled documents for which learn holds.

    Rows without a label are left out; of labels that contradict each other the
    larger counts.  Rows equal in doc_id and text count once, always.  A doc_id that
    many rows repeat is then sampled again by its texts, so that `most` bounds the
    rows.  The result is a written table.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    chosen = F.broadcast(staged(sample(marks, "doc_id", most), "labels"))  # of bounded size
    found = staged(docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id", "text"]), "labelled")
    n = found.count()
    if n > most:  # ids repeat
        steps = 1 << 40
        found = staged(found.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(steps)) < steps * most // n), "labelled")
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (constant first) by Newton steps; a fair coin without rows, smoothed odds where all labels agree."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    if not len(y):
        return w
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return w
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
