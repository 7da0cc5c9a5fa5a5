"""Structured Streaming jobs. Each takes a stream and gives a stream; run() drives one to its end and returns the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions.text import content_hash, words
from feedloom.operators import health
from feedloom.operators.compare import rarity_of_counts
from feedloom.operators.ledger import ALPHA, LEASE_TTL_S, MAX_WEIGHT, PRIOR, SEQ_SKEW
from feedloom.operators.match import triage_stage
from feedloom.shared import shared_dir, ship
from feedloom.streaming import state

EPOCH, EPOCH_MS = "1 hour", 3_600_000
#: The state store that keeps maps and timers; its files are part of the checkpoint.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, folder: str, name: str, size: int | None = None) -> DataFrame:
    """A table of a folder, a file or a folder of files, as a stream: a file in each micro-batch, or files of ``size`` bytes together."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    limit = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", 1)
    return spark.readStream.schema(schema).option(*limit).parquet(f"{folder}/{name}.parquet*")


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table of the shared folder."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{top}/rows").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{top}/rows")


def run_batches(df: DataFrame, each: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Run a batch job over each micro-batch of a stream and return all rows. A batch that is run again after a failure
    writes the same folder anew, so its rows count once."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    columns = StructType.fromDDL(schema).names
    spark.createDataFrame([], schema).write.parquet(f"{top}/rows/batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        each(batch).select(*columns).write.mode("overwrite").parquet(f"{top}/rows/batch={n}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{top}/rows").drop("batch")


def epoch_points(ledger: DataFrame, late: str = "2 hours") -> DataFrame:
    """epoch_start, worker, points: closed when the watermark, two epochs behind, has passed."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", EPOCH), "worker").agg(F.sum("points").alias("points")).select(F.col("window.start").alias("epoch_start"), "worker", "points")


def weight_window(ledger: DataFrame, k: int, late: str = "2 hours") -> DataFrame:
    """window_end, worker, points over the last ``k`` epochs, one row for each epoch that a window ends with."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", f"{k} hours", EPOCH), "worker").agg(F.sum("points").alias("points")).select(F.col("window.end").alias("window_end"), "worker", "points")


def dedup_recent(rows: DataFrame, key: str, ttl: int = 300, late: str = "10 minutes") -> DataFrame:
    """key and ts of the first row of each key; rows of the key less than ``ttl`` seconds after it count with it, and the
    next one is a first row again. Inside a batch rows count in the order of their times; a row that is ``late`` is dropped."""
    ship(rows.sparkSession)
    given = rows.withWatermark("ts", late).select(F.col(key).cast("long").alias("key"), "ts", F.unix_micros("ts").alias("us"))
    return given.groupBy("key").transformWithStateInPandas(state.Once(ttl), "key long, us long", "append", "eventTime").select(F.col("key").alias(key), F.timestamp_micros("us").alias("ts"))


def accept_broadcasts(messages: DataFrame, late: str = "2 hours", idle: int = 2 * SEQ_SKEW + 4) -> DataFrame:
    """sender, epoch, seq, arrival of messages (those and ts) that are in bounds and newer than the sender's last.

    A sender leaves the state after ``idle`` epochs: what it may send by then has a number above any that it sent before,
    since numbers stay within ``SEQ_SKEW`` of the epoch and older rows are late.
    """
    ship(messages.sparkSession)
    rows = messages.withWatermark("ts", late).select("sender", "ts", "epoch", "seq", "arrival", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("sender").transformWithStateInPandas(state.Newest(SEQ_SKEW, idle * EPOCH_MS), "sender long, epoch long, seq long, arrival long", "append", "eventTime")


def reputation(observations: DataFrame, alpha: float = ALPHA, prior: float = PRIOR, settle: int = 2, late_days: int = 7) -> DataFrame:
    """target, epoch, reputation, n, late: a row for each epoch of a target when it is closed.

    An epoch closes for all targets ``settle`` epochs after its end in the time of the rows (ts) of any target, by a timer.
    Until then the state keeps its observations: those in bounds (score 0 to 1, weight above 0 and up to 10), and of each
    article and sender the lowest score, then the larger weight, as the batch form does. Observations of a closed epoch
    are dropped and counted, for ``late_days`` days.
    """
    ship(observations.sparkSession)
    behind = late_days * 24 * EPOCH_MS
    rows = observations.withWatermark("ts", f"{late_days} days").select("target", "ts", "epoch", "article_id", "sender", F.col("score").cast("double").alias("score"), F.col("weight").cast("double").alias("weight"))
    return rows.groupBy("target").transformWithStateInPandas(state.Reputation(alpha, prior, MAX_WEIGHT, EPOCH_MS, settle * EPOCH_MS, behind), "target long, epoch long, reputation double, n long, late long", "append", "eventTime")


def leases(transitions: DataFrame, ttl: int = LEASE_TTL_S, late: str = "10 minutes") -> DataFrame:
    """item, worker, opened_us of leases that no completion closed in time; a new dispatch starts the time anew.

    transitions: item, worker, ts, what (open or done). A lease times out when a later transition of its item shows that its
    time of ``ttl`` seconds is over, or else by a timer, when the watermark, ``late`` behind the newest transition of all
    items, passes its end. An item without an open lease keeps no state.
    """
    ship(transitions.sparkSession)
    rows = transitions.withWatermark("ts", late).select("item", "worker", "ts", F.unix_micros("ts").alias("ts_us"), "what")
    return rows.groupBy("item").transformWithStateInPandas(state.Leases(ttl), "item long, worker long, opened_us long", "append", "eventTime")


def triage(articles: DataFrame, matches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """article_id, label, reason_code, confidence, content_hash, word_count of arriving articles: the triage stage over each
    micro-batch, with the gazetteer's matches that ``matches`` finds for it, and the proof of read."""

    def each(batch: DataFrame) -> DataFrame:
        proof = batch.select("article_id", content_hash(F.col("title"), F.col("body")).alias("content_hash"), F.size(words(F.col("body"))).cast("long").alias("word_count"))
        return triage_stage(batch, matches(batch)).join(proof, "article_id")

    return run_batches(articles, each, "article_id long, label string, reason_code string, confidence double, content_hash string, word_count long")


def worker_health(events: DataFrame, late: str = "2 hours", idle_days: int = 7) -> DataFrame:
    """A worker's state after each batch of its events (worker, ts, ts_s, seq, kind, value); one that is idle for
    ``idle_days`` days is forgotten."""
    ship(events.sparkSession)
    rows = events.withWatermark("ts", late).select("worker", "ts", "ts_s", "seq", "kind", F.col("value").cast("double").alias("value"), F.unix_millis("ts").alias("ms"))
    return rows.groupBy("worker").transformWithStateInPandas(state.Health(idle_days * 24 * EPOCH_MS), f"worker long, {health.STATE}", "append", "eventTime")


def running_rarity(reference: DataFrame, fields: list[str], least: int = 200) -> DataFrame:
    """field, label, weight, total after each micro-batch: the batch form's weights of the records so far (total), none
    before there are ``least``. The state is one count for each field and label, added up before the shuffle."""
    spark = reference.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = reference.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields])).alias("x")).select("x.*")
    schema = "field string, label string, weight double, total long"
    spark.createDataFrame([], schema).write.parquet(f"{top}/rows/batch=-1")

    def put(counts: DataFrame, n: int) -> None:
        rarity_of_counts(counts, least).write.mode("overwrite").parquet(f"{top}/rows/batch={n}")

    counts = rows.groupBy("field", "label").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{top}/rows")
