"""Points, penalties, peer broadcasts, reputation and weights; lifecycle of work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.scores import emission_gate
from feedloom.shared import small

# Bounds and prices of the ledger.
BLOCK_LENGTH, SEQ_SKEW, POINT_CAP, PENALTY_CAP = 100, 100, 5000, 500
ALPHA, PRIOR, MAX_WEIGHT = 0.03, 0.5, 10.0
LEASE_TTL_S, PRUNE_AGE_S, PRUNE_CAP, LIVE_TTL_S = 900, 3600, 2000, 120
CANARY_AGE_S, CANARY_EXPOSURES = 6 * 3600, 30
LATENCIES = 10_000


def epoch_of(block: Column) -> Column:
    return F.floor(block / BLOCK_LENGTH).cast("long")


def epoch_sums(ledger: DataFrame, value: str = "points") -> DataFrame:
    """epoch, worker and the sum of ``value``."""
    return ledger.groupBy("epoch", "worker").agg(F.sum(value).cast("long").alias(value))


def window_totals(sums: DataFrame, held: DataFrame, start: int, end: int, value: str = "points") -> DataFrame:
    """worker, total over the epochs from ``start`` to ``end`` and how many of these epochs are held, rows or not."""
    present = held.where(F.col("epoch").between(start, end)).agg(F.countDistinct("epoch").alias("present"))  # one row
    return sums.where(F.col("epoch").between(start, end)).groupBy("worker").agg(F.sum(value).cast("long").alias("total")).crossJoin(F.broadcast(present))


def accepted_broadcasts(messages: DataFrame, cap: int = POINT_CAP, retention: int | None = None) -> DataFrame:
    """sender, epoch, seq, points of the messages that count, by the rules of arrival.

    A message is refused when its sequence number is too far from its epoch (that leaves no trace) or not above the
    sender's last one. Entries outside 1..cap are dropped; a message without entries left still uses up its number.
    A later message for the same epoch replaces an earlier one.
    """
    sane = messages.where(F.abs(F.col("seq") - F.col("epoch")) <= SEQ_SKEW)
    before = F.max("seq").over(Window.partitionBy("sender").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    fresh = sane.withColumn("before", F.coalesce(before, F.lit(-1))).where(F.col("seq") > F.col("before")).drop("before")
    clean = fresh.withColumn("points", F.map_filter("points", lambda _, v: (v > 0) & (v <= cap))).where(F.size("points") > 0)
    last = clean.withColumn("i", F.row_number().over(Window.partitionBy("sender", "epoch").orderBy(F.desc("arrival")))).where("i = 1").drop("i")
    if retention is not None:
        newest = last.select("epoch").distinct().orderBy(F.desc("epoch")).limit(retention)
        last = last.join(F.broadcast(newest), "epoch", "left_semi")
    return last.select("sender", "epoch", "seq", "points")


def peer_pool(accepted: DataFrame, start: int, end: int) -> DataFrame:
    """uid, total points over senders and epochs, and the number of senders."""
    rows = accepted.where(F.col("epoch").between(start, end)).select("sender", F.explode("points").alias("uid", "points"))
    return rows.groupBy("uid").agg(F.sum("points").cast("long").alias("points"), F.countDistinct("sender").alias("senders"))


def rekey_filter(totals: DataFrame, nodes: DataFrame, start_block: int) -> DataFrame:
    """Totals without uids that were registered in or after the window; unknown uids stay."""
    return totals.join(small(nodes.where(F.col("block_at_registration") >= start_block).select("uid").distinct()), "uid", "left_anti")


def worker_dim_join(ledger: DataFrame, nodes: DataFrame, blocked: list | None = None) -> DataFrame:
    """Ledger rows with the worker's uid; workers that aren't registered or are blocked are dropped."""
    known = nodes.groupBy("worker").agg(F.min("uid").alias("uid"))
    rows = ledger.join(small(known), "worker")
    return rows.where(~F.col("worker").isin(blocked)) if blocked else rows


def settled_rewards(local: DataFrame, peers: DataFrame, penalties: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """uid, points, penalties and reward of the pooled window.

    Without reputation a reward is the points if they exceed the penalties, else 0. With it, it is the points times the
    gate, rounded half to even, and penalties don't matter; the gate is applied once, to the pooled total.
    """
    pooled = local.select("uid", "points").unionByName(peers.select("uid", "points")).groupBy("uid").agg(F.sum("points").cast("long").alias("points"))
    lost = penalties.groupBy("uid").agg(F.sum("penalties").cast("long").alias("penalties"))
    rows = pooled.join(lost, "uid", "left").withColumn("penalties", F.coalesce("penalties", F.lit(0)))
    if reputation is None:
        return rows.withColumn("reward", F.when(F.col("points") > F.col("penalties"), F.col("points")).otherwise(0))
    gated = rows.join(reputation.select("uid", "reputation"), "uid", "left")
    return gated.withColumn("reward", F.bround(emission_gate(F.coalesce("reputation", F.lit(PRIOR))) * F.col("points"), 0).cast("long")).drop("reputation")


def weights(rewards: DataFrame, blocks: int, alpha_per_point: float, alpha_per_block: float, min_percent: float, burn_uid: int = 0) -> DataFrame:
    """uid and weight: the share of the window's emission that its points need, at least a rate for each point, scaled
    down to 100 % together; the burn uid gets what is left. Rewards are one row a registered worker."""
    percent = F.greatest(F.col("reward") / alpha_per_point / (alpha_per_block * blocks) * 100, F.col("reward") * BLOCK_LENGTH / blocks * min_percent)
    rows = rewards.select("uid", percent.alias("percent"))
    total = rows.agg(F.coalesce(F.sum("percent"), F.lit(0.0)).alias("total"))  # one row
    scaled = rows.crossJoin(F.broadcast(total)).select("uid", (F.col("percent") * F.when(F.col("total") > 100, 100 / F.col("total")).otherwise(1.0) / 100).alias("weight"))
    burn = total.select(F.lit(burn_uid).cast("long").alias("uid"), (1 - F.least(F.col("total"), F.lit(100.0)) / 100).alias("weight"))
    return scaled.where(F.col("uid") != burn_uid).union(burn)


def deduplicated_observations(observations: DataFrame) -> DataFrame:
    """Observations in bounds; of those with the same epoch, target, article and sender the lowest score (then the larger weight)."""
    sane = observations.where("score BETWEEN 0 AND 1 AND weight > 0 AND weight <= 10")
    order = Window.partitionBy("epoch", "target", "article_id", "sender").orderBy("score", F.desc("weight"))
    return sane.withColumn("i", F.row_number().over(order)).where("i = 1").drop("i")


def reputation_replay(observations: DataFrame, prior: float = PRIOR, alpha: float = ALPHA) -> DataFrame:
    """target, reputation, n, gate: the moving average over observations in order of epoch, article and sender.

    In closed form, so that no target's history has to sit in one array: with step a = min(1, alpha w) the result is
    prior * prod(1 - a) + sum(a * score * prod of the later (1 - a)); the products are exponentials of window sums.
    """
    rows = deduplicated_observations(observations).withColumn("a", F.least(F.lit(1.0), alpha * F.col("weight")))
    after = Window.partitionBy("target").orderBy(F.desc("epoch"), F.desc("article_id"), F.desc("sender"))
    later = F.coalesce(F.sum(F.log1p(-F.col("a"))).over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    found = rows.withColumn("later", later).groupBy("target").agg((prior * F.exp(F.sum(F.log1p(-F.col("a")))) + F.sum(F.col("a") * F.col("score") * F.exp("later"))).alias("reputation"), F.count("*").alias("n"))
    return found.withColumn("gate", emission_gate(F.col("reputation")))


def commit_votes(votes: DataFrame) -> DataFrame:
    """uid, yes, no, validators and the share of yes."""
    good = F.col("score") > 0
    return votes.groupBy("uid").agg(F.count_if(good).alias("yes"), F.count_if(~good).alias("no"), F.countDistinct("validator").alias("validators"), F.avg(good.cast("double")).alias("weight"))


def new_commits(commits: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Commits after the block that was last seen of their validator (0 if none)."""
    return commits.join(small(last_seen), "validator", "left").where(F.col("block") > F.coalesce("last_block", F.lit(0))).drop("last_block")


def publish_snapshot(points: DataFrame, penalties: DataFrame, nodes: DataFrame, epoch: int) -> DataFrame:
    """uid, points, penalties of an epoch for registered workers; one row each, the two maps of a broadcast as columns."""
    p = worker_dim_join(points.where(F.col("epoch") == epoch), nodes).groupBy("uid").agg(F.sum("points").cast("long").alias("points"))
    q = worker_dim_join(penalties.where(F.col("epoch") == epoch), nodes).groupBy("uid").agg(F.sum("penalties").cast("long").alias("penalties"))
    return p.join(q, "uid", "full_outer").select("uid", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("penalties", F.lit(0)).alias("penalties"))


def window_k(block: Column, k: int, previous: int, active_block: int | None) -> Column:
    """The window in force at a block; without an activation block the previous one."""
    return F.lit(previous) if active_block is None else F.when(block >= active_block, k).otherwise(previous)


def retained(ledger: DataFrame, largest_k: int) -> DataFrame:
    """Rows of the newest max(10, largest_k + 5) epochs; epochs are few, rows are many."""
    newest = ledger.select("epoch").distinct().orderBy(F.desc("epoch")).limit(max(10, largest_k + 5))
    return ledger.join(F.broadcast(newest), "epoch", "left_semi")


def lease_timeouts(items: DataFrame, as_of: int, ttl: int = LEASE_TTL_S) -> DataFrame:
    """Items in processing for longer than ``ttl`` seconds."""
    return items.where((F.col("status") == "Processing") & (F.lit(as_of) - F.col("start_s") > ttl))


def timeout_penalties(items: DataFrame, as_of: int, split: bool = False, ttl: int = LEASE_TTL_S) -> DataFrame:
    """worker and penalties: one for each item that timed out, or with ``split`` one capacity signal a worker."""
    late = lease_timeouts(items, as_of, ttl).where("worker IS NOT NULL").groupBy("worker").agg(F.count("*").alias("items"))
    return late.select("worker", "items", (F.lit(0) if split else F.col("items")).cast("long").alias("penalties"), F.lit(1 if split else 0).alias("signals"))


def prune_items(items: DataFrame, as_of: int, max_age: int = PRUNE_AGE_S, cap: int = PRUNE_CAP) -> DataFrame:
    """Items that aren't submitted and, if unprocessed, not too old or undated; the newest ``cap`` of them."""
    age = F.coalesce("added_s", "start_s")
    stale = (F.col("status") == "Unprocessed") & (age.isNull() | (F.lit(as_of) - age > max_age))
    return items.where(~F.col("submitted") & ~stale).orderBy(age.desc_nulls_last(), "item_id").limit(cap)


def inflight_batches(items: DataFrame, default_size: int = 12) -> DataFrame:
    """worker and the number of batches that its items in processing make up, by the size they were sent in."""
    sizes = items.where("status = 'Processing'").groupBy("worker", F.coalesce("batch_size", F.lit(default_size)).alias("size")).agg(F.count("*").alias("n"))
    return sizes.groupBy("worker").agg(F.sum(F.ceil(F.col("n") / F.col("size"))).cast("long").alias("batches"))


def ingest_new(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """Items with new ones added; known ids keep their lifecycle and only fill a missing worker."""
    fill = incoming.select("item_id", F.col("worker").alias("new_worker"))
    kept = items.join(fill, "item_id", "left").select(*[F.coalesce("worker", "new_worker").alias("worker") if c == "worker" else F.col(c) for c in items.columns])
    return kept.unionByName(incoming.join(items.select("item_id"), "item_id", "left_anti"), allowMissingColumns=True)


def purge(state: DataFrame, epoch: int, senders: list) -> DataFrame:
    """State without epochs up to ``epoch`` and without some senders."""
    return state.where((F.col("epoch") > epoch) & ~F.col("sender").isin(senders))


def prune_departed(state: DataFrame, active: DataFrame) -> DataFrame:
    return state.join(small(active.select("worker").distinct()), "worker", "left_semi")


def liveness(heartbeats: DataFrame, as_of: int, ttl: int = LIVE_TTL_S) -> DataFrame:
    """worker, last_seen, alive."""
    return heartbeats.groupBy("worker").agg(F.max("ts_s").alias("last_seen")).withColumn("alive", F.lit(as_of) - F.col("last_seen") <= ttl)


def canary_alive(entries: DataFrame, exposures: DataFrame, as_of: int) -> DataFrame:
    """article_id, kind of canaries younger than six hours and exposed fewer than thirty times; the first entry counts."""
    first = entries.groupBy("article_id").agg(F.min_by(F.struct("kind", "added_s"), "added_s").alias("e"))
    seen = exposures.groupBy("article_id").agg(F.count("*").alias("n"))
    return first.join(seen, "article_id", "left").where((F.lit(as_of) - F.col("e.added_s") < CANARY_AGE_S) & (F.coalesce("n", F.lit(0)) < CANARY_EXPOSURES)).select("article_id", F.col("e.kind").alias("kind"))


def validator_allowlist(nodes: DataFrame, threshold: float, manual: list[int]) -> DataFrame:
    """uid of nodes with a permit and enough stake, and of those listed by hand."""
    own = nodes.where(F.col("permit") & (F.col("stake") >= threshold)).select("uid")
    listed = nodes.sparkSession.createDataFrame([(x,) for x in manual], "uid long")
    return own.union(listed).distinct()


def cycle_metrics(events: DataFrame) -> DataFrame:
    """One row of counts, rates and latency percentiles (the value at place int(q n) of the sorted latencies) over a cycle's events."""
    kind = F.col("kind")
    n = lambda k: F.count_if(kind == k)
    base = events.agg(
        n("dispatch").alias("dispatched"), n("valid").alias("valid"), n("timeout").alias("timeouts"), n("ack").alias("acks"), n("ack_fail").alias("ack_fails"),
        F.countDistinct(F.when(kind.isin("valid", "invalid"), F.col("worker"))).alias("scored"),
    )
    # Of the first LATENCIES latencies, so that the sorted list is bounded.
    first = events.where(kind == "ack").orderBy("event_id").limit(LATENCIES).agg(F.array_sort(F.collect_list("value")).alias("v"))
    place = lambda q: F.get("v", F.least(F.size("v") - 1, F.floor(q * F.size("v")).cast("int")))
    base = base.crossJoin(F.broadcast(first.select(place(0.5).alias("p50"), place(0.95).alias("p95"))))
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(100.0 * a / b)
    return base.select("*", rate(F.col("valid"), F.col("dispatched")).alias("completion"), rate(F.col("ack_fails"), F.col("acks") + F.col("ack_fails")).alias("ack_fail_rate"), rate(F.col("timeouts"), F.col("dispatched")).alias("timeout_rate"))


def rolling_latency(events: DataFrame, n: int = 20) -> DataFrame:
    """worker, ts, median of the last ``n`` latencies."""
    last = Window.partitionBy("worker").orderBy("ts_s", "event_id").rowsBetween(-(n - 1), 0)
    return events.select("worker", "event_id", F.array_sort(F.collect_list("value").over(last)).alias("v")).select(
        "worker", "event_id", ((F.get("v", F.floor((F.size("v") - 1) / 2).cast("int")) + F.get("v", F.floor(F.size("v") / 2).cast("int"))) / 2).alias("median")
    )
