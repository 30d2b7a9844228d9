"""Training folds and bounded samples of labelled rows, and logistic calibration; used by both classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, folds: int):
    """crc32 of the doc_id as text, modulo the number of folds; -1 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1)).cast("int")


def sample(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` training rows of each class, ``(doc_id, label)``, in the order of a hash of the doc_id.

    Only rows outside the held-out fold with a doc_id and a label of 0 or 1 count; a doc_id that is
    labelled more than once counts once, with its larger label. Also the class sizes in the fold.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    picked = [rows.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    return picked[0].union(picked[1]), sizes


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one the constant, of a ridge logistic regression by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
