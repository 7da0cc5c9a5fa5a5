"""Sums of vectors by group, without a row for each number of each vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.shared import ship


def vector_sums(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, total (an array) and n: the sum of each group's vectors, place by place, and how many rows it has.

    Tasks add up their own rows first, so that a group sends one vector a batch, whatever its size. Nulls add nothing;
    shorter vectors add to the first places.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, part in batch.groupby(key, dropna=False):
                lists = [np.asarray(v, float) for v in part[vector] if v is not None]
                total = np.zeros(max(map(len, lists), default=0))
                for v in lists:
                    total[: len(v)] += np.nan_to_num(v)
                out.append((None if pd.isna(name) else name, total, len(part)))
            yield pd.DataFrame(out, columns=[key, "total", "n"])

    sums = rows.select(key, vector).mapInPandas(added, f"`{key}` {kind}, total array<double>, n long")
    counts = sums.groupBy(key).agg(F.sum("n").alias("n"))
    places = sums.select(key, F.posexplode("total").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    totals = places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total"))  # as many as a vector has places
    other = counts.withColumnRenamed(key, "_key")
    return totals.join(other, F.col(key).eqNullSafe(F.col("_key"))).select(key, "total", "n")
