"""Bounded samples of labelled rows, and linear models that are fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lowest(rows: DataFrame, group: str, n: int, *more: str) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash ``h`` (ties by the columns ``more``).

    Counts of ranges of the hash say up to which range rows are needed, so that about ``n`` rows of a group meet in one
    task, however many it has.
    """
    ranged = rows.withColumn("range", F.shiftright("h", 52))
    tally = ranged.groupBy(group, "range").agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy(group).orderBy("range")) - F.col("count")
    last = tally.withColumn("before", before).where(F.col("before") < n).groupBy(group).agg(F.max("range").alias("last"))  # one row a group
    few = ranged.join(F.broadcast(last), group).where("range <= last").drop("range", "last")
    return few.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy("h", *more))).where(F.col("i") <= n).drop("i")


def sample(labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and label (0 or 1) of at most ``per_class`` rows of each class, those of the smallest hashed id.

    Rows with a null in either column are left out; an id with several labels counts with its largest.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return lowest(known.withColumn("h", F.xxhash64("doc_id")), "label", per_class, "doc_id").select("doc_id", "label")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Coefficients (the last is the intercept) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = np.maximum(weight * p * (1 - p), 1e-9)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
