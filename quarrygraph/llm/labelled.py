"""What the classifiers that learn from the labels table share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import sampled
from .common import checkpoint, crc_mod

HELD_OUT = 5
#: The bound of a label's training texts, in bytes together: all that a driver holds of them follows from it.
SAMPLE_BYTES = 16 << 20
#: Rows that are drawn for each row that may teach, so that others take the place of texts beyond the bound.
SPARE = 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(label, text bytes, k) of about ``per_label`` labelled documents of each label, and how many labels there are.

    Only ids whose crc32 as text modulo 5 is not 0 teach.  Ids with contradicting
    or null labels teach nothing; rows repeated in full teach once.  Rows are drawn by the hash of their id, and in this order
    they are taken until there are ``per_label`` of them, or their texts come to SAMPLE_BYTES; long texts are
    taken like others, and only one that is itself longer than that bound gives its place to the next.  What is
    drawn is bounded (0 and 1 are the labels that count), so it is broadcast and no text is shuffled to be drawn.
    """
    one = labels.filter(F.col(label).isNotNull() & (crc_mod(id_col, HELD_OUT) != 0)).groupBy(id_col).agg(F.min(label).alias("label"), F.max(label).alias("hi")).filter("label = hi and label in (0, 1)").drop("hi")
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    drawn = sampled(one, "label", id_col, SPARE * per_label)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col).select(F.col("label").cast("int").alias("label"), text.alias("text"), F.xxhash64(F.lit("sample"), id_col).alias("k"), F.xxhash64(text).alias("th"))
    order = Window.partitionBy("label").orderBy(F.pmod("k", F.lit(1 << 30)), "k", "th")
    sizes = rows.select("label", "k", "th", F.octet_length("text").cast("long").alias("size")).distinct().filter(F.col("size") <= SAMPLE_BYTES)
    sizes = sizes.select("label", "k", "th", F.row_number().over(order).alias("n"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    taken = checkpoint(sizes.filter((F.col("n") <= per_label) & (F.col("bytes") <= SAMPLE_BYTES)).select("k", "th"))
    rows = rows.join(F.broadcast(taken), ["k", "th"]).dropDuplicates(["k", "th"])
    return rows.select("label", F.col("text").cast("binary").alias("text"), "k"), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a weighted logistic regression, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    weight = weight / max(weight.sum(), 1e-9)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-4 and loss(w - t * d) > now:
            t /= 2
        if t <= 1e-4:
            break
        w = w - t * d
        if now - (now := loss(w)) < 1e-10:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
