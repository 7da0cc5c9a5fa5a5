"""Models that a user brings, and language profiles of character trigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import text_of
from feedloom.shared import ship


def apply_model(df: DataFrame, column: str, output: str, fn: Callable) -> DataFrame:
    """``df`` without ``column`` and with what ``fn`` makes of a batch of its values; ``output`` is "name type"."""
    name, kept = output.split(" ", 1)[0], [c for c in df.columns if c != column]

    def run(batches):
        for batch in batches:
            out = batch[kept].copy()
            out[name] = pd.Series(fn(batch[column].tolist()), index=batch.index)
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), output])
    return df.mapInPandas(run, schema)


def _letters(text: str):
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text_of(F.col(text))), r"[^\p{L}]+", " "), F.lit(" "))


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, each as a number of 63 bits, and how often each occurs."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True) if len(c) > 2 else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spelled(values: np.ndarray) -> list[str]:
    return [chr(v >> 42) + chr((v >> 21) & 0x1FFFFF) + chr(v & 0x1FFFFF) for v in values.tolist()]


def _numbered(trigrams: list[str]) -> np.ndarray:
    return np.array([(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in trigrams], np.int64)


def learn_profiles(df: DataFrame, lang: str, text: str, most: int = 300) -> DataFrame:
    """lang, trigram, weight: log shares of the commonest trigrams of each language. Tasks count the trigrams of
    their texts; what they send is one row for each language and trigram that they met."""
    ship(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                found = [_trigrams(x) for x in part["text"]]
                values, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": name, "trigram": _spelled(values), "n": np.bincount(place, weights=np.concatenate([n for _, n in found]), minlength=len(values)).astype(np.int64)})

    counts = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _letters(text).alias("text")).mapInPandas(count, "lang string, trigram string, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "trigram"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return counts.withColumn("total", total).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "trigram", F.log(F.col("n") / F.col("total")).alias("weight"))


def detect_language(df: DataFrame, profiles: DataFrame, key: str, text: str, floor: float = -12.0, most: int = 1_000_000) -> DataFrame:
    """key, code, confidence: the language whose profile fits a text's trigrams best, ("en", 0) for a text without any.

    The profiles (a few hundred rows a language, ``most`` at most) are a broadcast table of weights; each text is looked up
    in it where it is, so nothing is shuffled.
    """
    ship(df.sparkSession)
    rows = profiles.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"profiles have more than {most} rows")
    numbers = _numbered(rows["trigram"].tolist())
    langs, known = sorted(rows["lang"].unique()), np.unique(numbers)
    table = np.zeros((len(known) + 1, len(langs)))  # the last row: trigrams that no profile has
    table[np.searchsorted(known, numbers), [langs.index(x) for x in rows["lang"]]] = rows["weight"].to_numpy(float) - floor
    shared = df.sparkSession.sparkContext.broadcast((langs, known, table))
    kind = df.schema[key].dataType.simpleString()

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, known, table = shared.value
        for batch in batches:
            codes, sure = [], []
            for body in batch["text"]:
                found, n = _trigrams(body)
                if not len(found) or not langs:
                    codes.append("en")
                    sure.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                score = n @ table[np.where(known[at] == found, at, len(known))] / n.sum()
                p = np.exp(score)
                codes.append(langs[int(np.argmax(score))])
                sure.append(float(p.max() / p.sum()))
            yield pd.DataFrame({key: batch[key], "code": codes, "confidence": sure})

    return df.select(key, _letters(text).alias("text")).mapInPandas(detect, f"`{key}` {kind}, code string, confidence double")
