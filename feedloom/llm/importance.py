"""Quality by importance resampling.

Two generative models of hashed n-grams are counted: the target (texts labelled good) and the raw corpus (all texts).
A text's log importance weight is the sum over its n-grams of log p_target - log p_raw. A sum grows with the length of
a text, so the level that stands for "as good as not" is learned too: the mean log ratio that tells the labelled texts
apart best, times the number of n-grams, is taken off (it is the log weight of a text of that length at the cut). Texts
are drawn without replacement by the Gumbel top-k trick: the k largest of what is left + Gumbel noise, with noise that
is a hash of the id, so a repeated task draws the same. k is the number of texts above the cut. The noise decides among
texts that few n-grams speak for or against, as it should; many n-grams outweigh it.

The n-grams are single words and pairs, single word shapes and pairs, and whether a word repeats the one before, each
in hash buckets of their own. The target model and the cut are fitted on a bounded sample (``PER_CLASS`` labelled rows
of each class); the raw model counts every n-gram of every text.

Edge cases: a null, empty or blank text has no n-grams and is rejected; without labels of both classes nothing is
rejected but texts without n-grams; rows that tie at the k-th place are all kept; equal rows get equal results; an
empty table gives an empty table; a very long text is scored whole, part by part; other columns are not read, whatever
their names. Where ids repeat, the learning sample holds at most four rows for each of its ids on average.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.arrow import KEY, PieceCache, held, row_key, slices
from feedloom.llm.labelled import sample
from feedloom.shared import ship, written

PER_CLASS, PRIOR = 8000, 0.5
#: Characters whose n-grams are counted together.
CHARS = 600_000
WORD_BITS, SHAPE_BITS = 16, 12
SIZE = 2 * (1 << WORD_BITS) + 2 * (1 << SHAPE_BITS) + 2
_tokens = regex.compile(r"\w+|[^\w\s]+").findall


def _shape(token: str) -> str:
    """Kinds of characters of a token, runs shortened; punctuation as it is."""
    if token.isalpha():
        if token.islower():
            return "a"
        if token.isupper():
            return "AA" if len(token) > 1 else "A"
        if token[0].isupper() and token[1:].islower():
            return "Aa"
    if not (token[0].isalnum() or token[0] == "_"):
        return token
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isnumeric() else "x" for c in token)
    return _runs(r"\1", shape)


_runs = regex.compile(r"(.)\1+").sub


def _codes(piece: str) -> bytes:
    """Word and shape hash of each token of a piece."""
    out: list[int] = []
    for token in _tokens(piece):
        out += (xxhash.xxh32_intdigest(token.lower()), xxhash.xxh32_intdigest(_shape(token), 1))
    return np.array(out, "<u4").tobytes()


def _cache() -> PieceCache:
    return held("n-grams", lambda: PieceCache(lambda pieces: [_codes(x) for x in pieces]))


def _pairs(x: np.ndarray, bits: int) -> np.ndarray:
    mixed = (x[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each n-gram of a batch of texts."""
    words, shapes = 1 << WORD_BITS, 1 << SHAPE_BITS
    found = _cache().run(texts)
    codes = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2)
    owner = np.repeat(np.arange(len(texts)), [len(x) // 8 for x in found])
    word, shape = codes[:, 0], codes[:, 1]
    inside = owner[1:] == owner[:-1]  # pairs within a text
    second = owner[1:][inside]
    buckets = [
        (word >> np.uint32(32 - WORD_BITS)).astype(np.int64),
        _pairs(word, WORD_BITS)[inside] + words,
        (shape >> np.uint32(32 - SHAPE_BITS)).astype(np.int64) + 2 * words,
        _pairs(shape, SHAPE_BITS)[inside] + 2 * words + shapes,
        (word[1:] == word[:-1])[inside].astype(np.int64) + 2 * words + 2 * shapes,
    ]
    return np.concatenate([owner, second, owner, second, second]), np.concatenate(buckets)


def models(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in the good texts and in all texts of rows (text, label)."""

    def run(batches):
        good, raw = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in slices(texts, CHARS):
                owner, bucket = ngrams(texts[some])
                target = np.array([x == 1 for x in labels[some]], bool)
                raw += np.bincount(bucket, minlength=SIZE)
                good += np.bincount(bucket[target[owner]], minlength=SIZE)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(good[used]), pa.array(raw[used])], ["bucket", "good", "raw"])

    found = rows.mapInArrow(run, "bucket int, good long, raw long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).toPandas()  # at most SIZE rows
    good, raw = np.zeros(SIZE), np.zeros(SIZE)
    good[found["bucket"]], raw[found["bucket"]] = found["good"], found["raw"]
    return good, raw


def log_ratio(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, within each of the five kinds of n-gram."""
    out, at = np.zeros(SIZE), 0
    for size in (1 << WORD_BITS, 1 << WORD_BITS, 1 << SHAPE_BITS, 1 << SHAPE_BITS, 2):
        part = slice(at, at + size)
        g, r = good[part], raw[part]
        p = r / max(r.sum(), 1)
        out[part] = np.log((g + PRIOR * p * size + 1e-9) / (g.sum() + PRIOR * size)) - np.log((r + PRIOR * p * size + 1e-9) / (r.sum() + PRIOR * size))
        at += size
    return out


def cut_between(good: np.ndarray, bad: np.ndarray) -> float:
    """The value that parts two samples with the fewest wrong rows (classes weighted alike); the middle of the gap."""
    values = np.concatenate([good, bad])
    side = np.concatenate([np.full(len(good), 1 / len(good)), np.full(len(bad), -1 / len(bad))])
    order = np.argsort(values, kind="stable")
    v, wrong = values[order], np.cumsum(side[order])  # good rows below the cut less bad rows below it
    wrong[:-1][v[:-1] == v[1:]] = np.inf
    best = int(np.argmin(wrong[:-1]))
    return float((v[best] + v[best + 1]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value: the range is cut into bins, the bin that holds it is cut again, until few are left."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    inside = keys
    while True:
        n = inside.count() if high > low else 0
        if high <= low or n <= 2000:
            if high <= low:
                return float(low)
            return sorted((row[0] for row in inside.select(column).collect()), reverse=True)[k - 1]
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        tally = inside.groupBy(place.alias("i")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("i")).collect()
        for row in tally:
            if k <= row.n:
                low, high = row.low, row.high
                inside = keys.where(F.col(column).between(low, high))
                break
            k -= row.n


def resample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, row, row2, n_ngrams, importance, gumbel_key and kept of every row; row and row2 are hashes of id and text."""
    spark = df.sparkSession
    ship(spark)
    chosen = sample(labels, label, per_class)
    rows = df.select(F.col(doc_id).alias("doc_id"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id", "left")
    good, raw = models(rows.select("text", "label"))
    ratio = spark.sparkContext.broadcast(log_ratio(good, raw) if good.any() else np.zeros(SIZE))  # SIZE numbers: 1 MB

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for some in slices(texts, CHARS):
                owner, bucket = ngrams(texts[some])
                part = batch.slice(some.start, some.stop - some.start)
                n = np.bincount(owner, minlength=part.num_rows)
                mean = np.bincount(owner, weights=ratio.value[bucket], minlength=part.num_rows) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*part.select([0, 1, 2, 4]).columns, pa.array(n), pa.array(mean, mask=n == 0)], ["doc_id", *KEY, "label", "n_ngrams", "mean"])

    scored = rows.select("doc_id", *KEY, "text", "label").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, row2 long, label int, n_ngrams long, mean double")
    uniform = (F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = written(scored.select("doc_id", *KEY, "label", "n_ngrams", "mean", (-F.log(-F.log(uniform))).alias("noise")), "importance")
    known = scored.where("label IS NOT NULL AND mean IS NOT NULL").groupBy("label", "mean").count()
    known = known.orderBy(F.xxhash64("label", "mean"), "mean", "label").limit(4 * per_class).toPandas()  # bounded also where ids repeat
    parts = [known.loc[known["label"] == x, "mean"].to_numpy() for x in (1, 0)]
    both = bool(len(parts[0]) and len(parts[1]))
    cut = cut_between(*parts) if both else 0.0
    drawn = scored.select("doc_id", *KEY, "n_ngrams", "mean", (F.col("mean") * F.col("n_ngrams")).alias("importance"), ((F.col("mean") - cut) * F.col("n_ngrams") + F.col("noise")).alias("gumbel_key"))
    usable = drawn.where("mean IS NOT NULL")
    least = float("-inf")
    if both:
        k = usable.where(F.col("mean") >= cut).count()
        least = kth_largest(usable.select("gumbel_key"), "gumbel_key", k) if k else float("inf")
    kept = F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))
    return drawn.select("doc_id", *KEY, "n_ngrams", "importance", "gumbel_key", kept.alias("kept"))
