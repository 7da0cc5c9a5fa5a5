"""Health of workers as an ordered fold over their events: window, streaks, cooldowns, parking, batch size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.scores import emission_gate
from feedloom.shared import ship

# Ladders and limits of a worker's health.
BACKOFF = [30, 60, 120, 300, 600]
SEND_FAILURES, CHRONIC, FAITH_FLOOR, FAITH_STREAK, FAIL_STREAK, PARK = 10, 5, 0.5, 10, 10, (60, 600)
WINDOW_START, WINDOW_CAP, WINDOW_FLOOR, GROW, SHRINK, LATE_S = 4.0, 32.0, 1.0, 1.0, 0.5, 540.0
SIZE_START, SIZE_UP, SIZE_DOWN, SIZE_LEAST, SIZE_MOST = 12.0, 2.0, 0.75, 4.0, 24.0
FIELDS = ["window", "timeouts", "sends", "level", "until", "faiths", "fails", "park_level", "parked_until", "size"]
STATE = "window double, timeouts double, sends double, level double, until double, faiths double, fails double, park_level double, parked_until double, size double"


def fresh() -> dict[str, float]:
    return dict(zip(FIELDS, (WINDOW_START, 0, 0, 0, 0, 0, 0, 0, 0, SIZE_START), strict=True))


def batch_size(s: dict[str, float]) -> int:
    return int(max(SIZE_LEAST, min(SIZE_MOST, s["size"])))


def step(s: dict[str, float], ts: float, kind: str, value: float | None) -> str | None:
    """Take one event into the state; parked or unparked if that is what it did. The state's size holds its new batch size."""

    def cool() -> None:
        s["level"] = min(s["level"] + 1, len(BACKOFF))
        s["until"] = ts + BACKOFF[int(s["level"]) - 1]

    def shrink() -> None:
        s["size"] = max(SIZE_LEAST, s["size"] * SIZE_DOWN)

    def park() -> str:
        s["park_level"] = min(s["park_level"] + 1, len(PARK))
        s["parked_until"] = ts + PARK[int(s["park_level"]) - 1]
        shrink()
        return "parked"

    if kind == "valid":
        s["timeouts"] = 0
        if value is not None and value <= LATE_S:
            s["window"] = min(WINDOW_CAP, s["window"] + GROW / max(s["window"], 1e-9))
            s["size"] = min(SIZE_MOST, s["size"] + SIZE_UP)
    elif kind == "invalid":
        s["timeouts"] = 0
        s["window"] = max(WINDOW_FLOOR, s["window"] * SHRINK)
        shrink()
    elif kind == "timeout":
        s["window"] = max(WINDOW_FLOOR, s["window"] * SHRINK)
        shrink()
        s["timeouts"] += 1
        if s["timeouts"] >= CHRONIC:
            s["timeouts"] = 0
            cool()
    elif kind == "ack_fail":
        s["sends"] += 1
        if s["sends"] >= SEND_FAILURES:
            cool()
    elif kind == "ack":
        s["sends"] = s["level"] = s["until"] = 0
    elif kind == "pass":
        s["fails"] = 0
    elif kind == "fail":
        s["fails"] += 1
        if s["fails"] >= FAIL_STREAK:
            s["fails"] = 0
            return park()
    elif kind == "faith" and value is not None:
        if value >= FAITH_FLOOR:
            was = s["parked_until"] > 0
            s["faiths"] = s["park_level"] = s["parked_until"] = 0
            return "unparked" if was else None
        s["faiths"] += 1
        if s["faiths"] >= FAITH_STREAK:
            s["faiths"] = 0
            return park()
    return None


def _folded(events: DataFrame, out: str, emit) -> DataFrame:
    """Fold each worker's events (worker, ts_s, seq, kind, value) in order; a task holds one state and one Arrow batch."""
    ship(events.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, state, rows = None, fresh(), []
        for batch in batches:
            for w, ts, kind, value in zip(batch["worker"], batch["ts_s"], batch["kind"], batch["value"], strict=True):
                if w != worker:
                    rows += emit(worker, state, None, None, 0) if worker is not None else []
                    worker, state = w, fresh()
                before = batch_size(state)
                what = step(state, float(ts), kind, None if pd.isna(value) else float(value))
                rows += emit(worker, state, ts, what, before)
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if worker is not None:
            rows += emit(worker, state, None, None, 0)
        yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in out.split(", ")]
    return events.select("worker", "ts_s", "seq", "kind", "value").repartition("worker").sortWithinPartitions("worker", "ts_s", "seq").drop("seq").mapInPandas(run, out)


def worker_health(events: DataFrame) -> DataFrame:
    """worker and its state after all events."""
    return _folded(events, f"worker long, {STATE}", lambda w, s, ts, what, before: [(w, *(s[f] for f in FIELDS))] if ts is None else [])


def health_sessions(events: DataFrame, most: int = 2000) -> DataFrame:
    """worker, ts_s, what, size_before, size_after: the newest ``most`` times that a worker was parked or unparked, or that
    its batch size changed (batch_size_changed); a parking that changes the size gives both rows."""

    def log(w, s, ts, what, before) -> list:
        after = batch_size(s) if ts is not None else before
        sized = [(w, ts, "batch_size_changed", before, after)] if after != before else []
        return sized + ([(w, ts, what, None, None)] if what else [])

    rows = _folded(events, "worker long, ts_s long, what string, size_before long, size_after long", log)
    return rows.orderBy(F.desc("ts_s"), "worker", "what", "size_before", "size_after").limit(most)


def parked_spans(sessions: DataFrame) -> DataFrame:
    """worker, start_s, end_s: from a parking to the next event that ended it (null: still parked)."""
    order = Window.partitionBy("worker").orderBy("ts_s", "what")
    rows = sessions.where("what <> 'batch_size_changed'").withColumn("before", F.lag("what").over(order)).withColumn("end_s", F.min(F.when(F.col("what") == "unparked", F.col("ts_s"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return rows.where((F.col("what") == "parked") & (F.coalesce("before", F.lit("unparked")) == "unparked")).select("worker", F.col("ts_s").alias("start_s"), "end_s")


def worker_status(health: DataFrame, live: DataFrame, nodes: DataFrame, as_of: int, inflight: DataFrame | None = None, latency: DataFrame | None = None, reputation: DataFrame | None = None) -> DataFrame:
    """One row for each worker known to health or alive, with defaults for what isn't known.

    Besides uid, alive, window and cooldown: batches in flight (worker, inflight), streaks of timeouts, failed sends, failed
    validations and unfaithful answers, the level of parking, the batch size, the median latency (worker, median) and the
    multiplier of the emission gate (worker, reputation); these three are null or 0 where their tables aren't given.
    """
    known = nodes.groupBy("worker").agg(F.min("uid").alias("uid"))
    rows = health.join(live.where("alive").select("worker", "alive"), "worker", "full_outer").join(known, "worker", "left")
    for table, name in ((inflight, "inflight"), (latency, "median"), (reputation, "reputation")):
        rows = rows.join(table.select("worker", name), "worker", "left") if table is not None else rows.withColumn(name, F.lit(None).cast("double"))
    left = F.greatest(F.coalesce("until", F.lit(0.0)), F.coalesce("parked_until", F.lit(0.0))) - as_of
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    return rows.select(
        "worker",
        F.coalesce("uid", F.lit(-1)).alias("uid"),
        F.coalesce("alive", F.lit(False)).alias("alive"),
        F.coalesce("window", F.lit(WINDOW_START)).alias("window"),
        count("inflight").alias("inflight"),
        F.coalesce("timeouts", F.lit(0.0)).alias("timeouts"),
        count("sends").alias("failed_sends"),
        count("fails").alias("failed_validations"),
        count("faiths").alias("unfaithful"),
        count("park_level").alias("park_level"),
        F.floor(F.least(F.greatest(F.coalesce("size", F.lit(SIZE_START)), F.lit(SIZE_LEAST)), F.lit(SIZE_MOST))).cast("long").alias("batch_size"),
        F.greatest(F.lit(0.0), left).alias("cooldown_left"),
        (left > 0).alias("on_cooldown"),
        F.round("median", 2).alias("median_latency"),
        F.round(emission_gate(F.col("reputation")), 3).alias("gate"),
    )
