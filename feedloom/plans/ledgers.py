"""Queries of the ledger, reputation, weights and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import ledger as L
from feedloom.plans.inputs import Plans

P = Plans()
#: The window of the queries, relative to the newest epoch of the data.
SPAN = "(SELECT max(epoch) - 30 FROM ledger) AND (SELECT max(epoch) - 2 FROM ledger)"


def _span(led):
    top = led.agg(F.max("epoch")).first()[0] or 0
    return top - 30, top - 2


def _points(led):
    return led.where("event_type = 'purchase'").select("epoch", "worker", "points")


def _penalties(led):
    return led.where("event_type = 'error'").select("epoch", "worker", F.lit(1).alias("penalties"))


P.add("a15_epoch_rewards", lambda led: L.epoch_sums(_points(led)), "SELECT epoch, worker, sum(points)::BIGINT AS points FROM ledger WHERE event_type = 'purchase' GROUP BY ALL", "ledger")
P.add("a15_epoch_penalties", lambda led: L.epoch_sums(_penalties(led), "penalties"), "SELECT epoch, worker, count(*) AS penalties FROM ledger WHERE event_type = 'error' GROUP BY ALL", "ledger")
P.add("a16_window_totals", lambda led: L.window_totals(L.epoch_sums(_points(led)), led.select("epoch").distinct(), *_span(led)), f"SELECT worker, sum(points)::BIGINT AS total, (SELECT count(DISTINCT epoch) FROM ledger WHERE epoch BETWEEN {SPAN}) AS present FROM ledger WHERE event_type = 'purchase' AND epoch BETWEEN {SPAN} GROUP BY worker", "ledger")


def _broadcasts(led):
    """A message for each (sender, epoch, seq): some late, some out of order, some out of bounds."""
    rows = led.where("event_type IN ('purchase', 'view')").select((F.col("worker") % 11).alias("sender"), "epoch", (F.col("epoch") + F.when(F.col("event_id") % 17 == 0, 500).when(F.col("event_id") % 5 == 0, -1).otherwise(0)).alias("seq"), "event_id", "worker", (F.col("points") - F.when(F.col("event_id") % 4 == 0, 100).otherwise(0)).alias("points"))
    return rows.select("sender", "epoch", "seq", F.col("event_id").alias("arrival"), F.create_map("worker", "points").alias("points"))


_MSG = """m AS (SELECT worker % 11 AS sender, epoch, epoch + CASE WHEN event_id % 17 = 0 THEN 500 WHEN event_id % 5 = 0 THEN -1 ELSE 0 END AS seq, event_id AS arrival, worker AS uid, points - CASE WHEN event_id % 4 = 0 THEN 100 ELSE 0 END AS points FROM ledger WHERE event_type IN ('purchase', 'view')),
s AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY sender ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM m WHERE abs(seq - epoch) <= 100),
acc AS (SELECT sender, epoch, seq, uid, points FROM s WHERE seq > before AND points BETWEEN 1 AND 5000 QUALIFY row_number() OVER (PARTITION BY sender, epoch ORDER BY arrival DESC) = 1)"""
P.add("w10_accepted_broadcasts", lambda led: L.accepted_broadcasts(_broadcasts(led)).select("sender", "epoch", "seq", F.explode("points").alias("uid", "points")), f"WITH {_MSG} SELECT * FROM acc", "ledger")
P.add("w14_retained_broadcasts", lambda led: L.accepted_broadcasts(_broadcasts(led), retention=10).select("sender", "epoch", "seq"), f"WITH {_MSG} SELECT sender, epoch, seq FROM acc WHERE epoch IN (SELECT DISTINCT epoch FROM acc ORDER BY epoch DESC LIMIT 10)", "ledger")
P.add("w14_retained_ledger", lambda led: L.retained(L.epoch_sums(_points(led)), 24), "SELECT epoch, worker, sum(points)::BIGINT AS points FROM ledger WHERE event_type = 'purchase' AND epoch IN (SELECT DISTINCT epoch FROM ledger WHERE event_type = 'purchase' ORDER BY epoch DESC LIMIT 29) GROUP BY ALL", "ledger")
P.add("w14_window_k", lambda led: led.select("event_id", L.window_k(F.col("event_id"), 12, 4, 500).alias("k"), L.window_k(F.col("event_id"), 12, 4, None).alias("held")), "SELECT event_id, CASE WHEN event_id >= 500 THEN 12 ELSE 4 END AS k, 4 AS held FROM ledger", "ledger")
_POOL = f"pool AS (SELECT uid, sum(points)::BIGINT AS points, count(DISTINCT sender) AS senders FROM acc WHERE epoch BETWEEN {SPAN} GROUP BY uid)"
_pool = lambda led: L.peer_pool(L.accepted_broadcasts(_broadcasts(led)), *_span(led))
P.add("a17_peer_pool", _pool, f"WITH {_MSG}, {_POOL} SELECT * FROM pool", "ledger")
P.add("j15_rekey_filter", lambda led, n: L.rekey_filter(_pool(led), n, 40_000), f"WITH {_MSG}, {_POOL} SELECT * FROM pool WHERE uid NOT IN (SELECT uid FROM nodes WHERE block_at_registration >= 40000)", "ledger", "nodes")
P.add("j14_worker_dim", lambda led, n: L.worker_dim_join(L.epoch_sums(_points(led)), n, [5, 7]), "SELECT epoch, l.worker, points, uid FROM (SELECT epoch, worker, sum(points)::BIGINT AS points FROM ledger WHERE event_type = 'purchase' GROUP BY ALL) l JOIN (SELECT worker, min(uid) AS uid FROM nodes GROUP BY worker) n ON n.worker = l.worker WHERE l.worker NOT IN (5, 7)", "ledger", "nodes")


def _local(led, n, frame, value):
    start, end = _span(led)
    return L.worker_dim_join(frame.where(F.col("epoch").between(start, end)), n).groupBy("uid").agg(F.sum(value).cast("long").alias(value))


def _settled(led, n, gated=False):
    peers = L.rekey_filter(_pool(led), n, 40_000)
    reputation = None
    if gated:
        reputation = n.select("uid", (F.lit(0.5) + (F.col("uid") % 20) / 100).alias("reputation"))
    return L.settled_rewards(_local(led, n, _points(led), "points"), peers, _local(led, n, _penalties(led), "penalties"), reputation)


_SET = f"""{_MSG}, {_POOL}, dim AS (SELECT worker, min(uid) AS uid FROM nodes GROUP BY worker), loc AS (SELECT uid, points FROM ledger JOIN dim USING (worker) WHERE event_type = 'purchase' AND epoch BETWEEN {SPAN}),
lost AS (SELECT uid, count(*) AS penalties FROM ledger JOIN dim USING (worker) WHERE event_type = 'error' AND epoch BETWEEN {SPAN} GROUP BY uid),
tot AS (SELECT uid, sum(points)::BIGINT AS points FROM (SELECT * FROM loc UNION ALL SELECT uid, points FROM pool WHERE uid NOT IN (SELECT uid FROM nodes WHERE block_at_registration >= 40000)) GROUP BY uid),
settled AS (SELECT uid, points, coalesce(penalties, 0) AS penalties, CASE WHEN points > coalesce(penalties, 0) THEN points ELSE 0 END AS reward FROM tot LEFT JOIN lost USING (uid))"""
P.add("a18_settled_rewards", lambda led, n: _settled(led, n), f"WITH {_SET} SELECT * FROM settled", "ledger", "nodes")
P.add("a18_gated_rewards", lambda led, n: _settled(led, n, True), f"WITH {_SET} SELECT s.uid, points, penalties, round_even(points / (1 + exp(-100.0 * (coalesce(0.5 + (n.uid % 20) / 100, 0.5) - 0.59))), 0)::BIGINT AS reward FROM settled s LEFT JOIN nodes n ON n.uid = s.uid", "ledger", "nodes")
P.add("a19_weights", lambda led, n: L.weights(_settled(led, n), 2900, 500.0, 0.02, 0.001), f"WITH {_SET}, p AS (SELECT uid, greatest(reward / 500.0 / (0.02 * 2900) * 100, reward * 100 / 2900 * 0.001) AS percent FROM settled), t AS (SELECT coalesce(sum(percent), 0) AS total FROM p) SELECT uid, percent * CASE WHEN total > 100 THEN 100 / total ELSE 1.0 END / 100 AS weight FROM p, t WHERE uid <> 0 UNION ALL SELECT 0, 1 - least(total, 100.0) / 100 FROM t", "ledger", "nodes")


def _observations(led):
    return led.where("event_type = 'view'").select("epoch", (F.col("worker") % 7).alias("sender"), F.col("worker").alias("target"), (F.col("event_id") % 40).alias("article_id"), (F.col("event_id") % 23 / 21).alias("score"), (F.col("event_id") % 5 / 2).alias("weight"))


P.add("w09_reputation", lambda led: L.reputation_replay(_observations(led)), """WITH o AS (SELECT epoch, worker % 7 AS sender, worker AS target, event_id % 40 AS article_id, event_id % 23 / 21 AS score, event_id % 5 / 2 AS weight FROM ledger WHERE event_type = 'view'),
d AS (SELECT *, least(1.0, 0.03 * weight) AS a FROM o WHERE score BETWEEN 0 AND 1 AND weight > 0 AND weight <= 10 QUALIFY row_number() OVER (PARTITION BY epoch, target, article_id, sender ORDER BY score, weight DESC) = 1),
r AS (SELECT target, list_reduce(list_prepend({'s': 0.5::DOUBLE, 'a': 1.0::DOUBLE}, list({'s': score::DOUBLE, 'a': a::DOUBLE} ORDER BY epoch, article_id, sender)), lambda x, y: {'s': x.s * (1 - y.a) + y.a * y.s, 'a': 1.0::DOUBLE}).s AS reputation, count(*) AS n FROM d GROUP BY target)
SELECT *, 1 / (1 + exp(-100.0 * (reputation - 0.59))) AS gate FROM r""", "ledger")
P.add("a21_commit_votes", lambda led: L.commit_votes(led.select(F.col("worker").alias("uid"), (F.col("event_id") % 6).alias("validator"), (F.col("event_id") % 3 - 1).alias("score"))), "SELECT worker AS uid, count(*) FILTER (event_id % 3 > 1) AS yes, count(*) FILTER (event_id % 3 <= 1) AS no, count(DISTINCT event_id % 6) AS validators, avg((event_id % 3 > 1)::INT) AS weight FROM ledger GROUP BY worker", "ledger")
P.add("w13_new_commits", lambda led: L.new_commits(led.select((F.col("worker")).alias("validator"), F.col("event_id").alias("block")), led.where("worker % 2 = 0").groupBy(F.col("worker").alias("validator")).agg((F.max("event_id") - 50).alias("last_block"))), "SELECT l.worker AS validator, event_id AS block FROM ledger l LEFT JOIN (SELECT worker, max(event_id) - 50 AS b FROM ledger WHERE worker % 2 = 0 GROUP BY worker) s ON s.worker = l.worker WHERE event_id > coalesce(b, 0)", "ledger")
P.add("a31_publish_snapshot", lambda led, n: L.publish_snapshot(_points(led), _penalties(led), n, _span(led)[1] + 1), "WITH dim AS (SELECT worker, min(uid) AS uid FROM nodes GROUP BY worker), e AS (SELECT uid, event_type, points FROM ledger JOIN dim USING (worker) WHERE epoch = (SELECT max(epoch) - 1 FROM ledger) AND event_type IN ('purchase', 'error')) SELECT uid, coalesce(sum(points) FILTER (event_type = 'purchase'), 0)::BIGINT AS points, count(*) FILTER (event_type = 'error') AS penalties FROM e GROUP BY uid", "ledger", "nodes")

AS_OF = 1_000_000


def _items(led):
    i = F.col("event_id")
    return led.select(i.alias("item_id"), F.get(F.array(F.lit("Unprocessed"), F.lit("Processing"), F.lit("Processed")), (i % 3).cast("int")).alias("status"), F.when(i % 7 != 0, AS_OF - i * 37 % 5000).alias("start_s"), F.when(i % 4 != 0, AS_OF - i * 53 % 7000).alias("added_s"), F.when(i % 5 != 0, F.col("worker")).alias("worker"), F.when(i % 6 != 0, i % 4 + 2).alias("batch_size"), (i % 8 == 0).alias("submitted"))


_IT = f"""items AS (SELECT event_id AS item_id, (['Unprocessed', 'Processing', 'Processed'])[event_id % 3 + 1] AS status, CASE WHEN event_id % 7 <> 0 THEN {AS_OF} - event_id * 37 % 5000 END AS start_s, CASE WHEN event_id % 4 <> 0 THEN {AS_OF} - event_id * 53 % 7000 END AS added_s,
 CASE WHEN event_id % 5 <> 0 THEN worker END AS worker, CASE WHEN event_id % 6 <> 0 THEN event_id % 4 + 2 END AS batch_size, event_id % 8 = 0 AS submitted FROM ledger)"""
P.add("f14_lease_timeouts", lambda led: L.lease_timeouts(_items(led), AS_OF).select("item_id", "worker"), f"WITH {_IT} SELECT item_id, worker FROM items WHERE status = 'Processing' AND {AS_OF} - start_s > 900", "ledger")
P.add("a30_timeout_penalties", lambda led: L.timeout_penalties(_items(led), AS_OF), f"WITH {_IT} SELECT worker, count(*) AS items, count(*) AS penalties, 0 AS signals FROM items WHERE status = 'Processing' AND {AS_OF} - start_s > 900 AND worker IS NOT NULL GROUP BY worker", "ledger")
P.add("k03_prune_items", lambda led: L.prune_items(_items(led), AS_OF, cap=200).select("item_id"), f"WITH {_IT} SELECT item_id FROM items WHERE NOT submitted AND NOT (status = 'Unprocessed' AND (coalesce(added_s, start_s) IS NULL OR {AS_OF} - coalesce(added_s, start_s) > 3600)) ORDER BY coalesce(added_s, start_s) DESC NULLS LAST, item_id LIMIT 200", "ledger")
P.add("a22_inflight_batches", lambda led: L.inflight_batches(_items(led)), f"WITH {_IT}, s AS (SELECT worker, coalesce(batch_size, 12) AS size, count(*) AS n FROM items WHERE status = 'Processing' GROUP BY ALL) SELECT worker, sum(ceil(n / size))::BIGINT AS batches FROM s GROUP BY worker", "ledger")
P.add("u01_ingest_new", lambda led: L.ingest_new(_items(led).where("item_id % 2 = 0").select("item_id", "status", "worker"), led.select(F.col("event_id").alias("item_id"), F.lit("Unprocessed").alias("status"), (F.col("worker") + 100).alias("worker")).where("item_id % 3 <> 1")), f"WITH {_IT}, n AS (SELECT event_id AS item_id, worker + 100 AS worker FROM ledger WHERE event_id % 3 <> 1) SELECT i.item_id, status, coalesce(i.worker, n.worker) AS worker FROM items i LEFT JOIN n USING (item_id) WHERE i.item_id % 2 = 0 UNION ALL SELECT item_id, 'Unprocessed', worker FROM n WHERE item_id % 2 <> 0", "ledger")
P.add("u03_purge", lambda led: L.purge(_broadcasts(led), _span(led)[0], [3, 4]).select("sender", "epoch", "arrival"), f"WITH {_MSG} SELECT sender, epoch, arrival FROM m WHERE epoch > (SELECT max(epoch) - 30 FROM ledger) AND sender NOT IN (3, 4)", "ledger")
P.add("u04_prune_departed", lambda led, n: L.prune_departed(L.epoch_sums(_points(led)), n), "SELECT epoch, worker, sum(points)::BIGINT AS points FROM ledger WHERE event_type = 'purchase' AND worker IN (SELECT worker FROM nodes) GROUP BY ALL", "ledger", "nodes")
P.add("f16_liveness", lambda led: L.liveness(led.select("worker", (F.col("epoch") * 3600).alias("ts_s")), 1_704_100_000, 30 * 86_400), f"SELECT worker, max(epoch * 3600) AS last_seen, 1704100000 - max(epoch * 3600) <= {30 * 86_400} AS alive FROM ledger GROUP BY worker", "ledger")
P.add("f15_canary_alive", lambda led: L.canary_alive(led.where("event_type = 'signup'").select((F.col("event_id") % 50).alias("article_id"), F.when(F.col("event_id") % 2 == 0, "pos").otherwise("neg").alias("kind"), (F.col("event_id") * 9).alias("added_s")), led.where("event_type = 'click'").select((F.col("event_id") % 60).alias("article_id")), 22_000), "WITH e AS (SELECT event_id % 50 AS article_id, arg_min(CASE WHEN event_id % 2 = 0 THEN 'pos' ELSE 'neg' END, event_id) AS kind, min(event_id * 9) AS added_s FROM ledger WHERE event_type = 'signup' GROUP BY 1), x AS (SELECT event_id % 60 AS article_id, count(*) AS n FROM ledger WHERE event_type = 'click' GROUP BY 1) SELECT article_id, kind FROM e LEFT JOIN x USING (article_id) WHERE 22000 - added_s < 21600 AND coalesce(n, 0) < 30", "ledger")
P.add("f18_validator_allowlist", lambda n: L.validator_allowlist(n, 3000.0, [1, 2, 999]), "SELECT uid FROM nodes WHERE permit AND stake >= 3000 UNION SELECT unnest([1, 2, 999])", "nodes")
P.add("w12_rolling_latency", lambda led: L.rolling_latency(led.where("event_type = 'click'").select("worker", "event_id", (F.col("epoch") * 3600).alias("ts_s"), "value")), "SELECT worker, event_id, median(value) OVER (PARTITION BY worker ORDER BY epoch, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS median FROM ledger WHERE event_type = 'click'", "ledger")
_KIND = "CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'ack' WHEN 'view' THEN 'dispatch' ELSE 'ack_fail' END"
P.add("a23_cycle_metrics", lambda led: L.cycle_metrics(led.selectExpr("event_id", "worker", f"{_KIND} AS kind", "value")), f"""WITH e AS (SELECT event_id, worker, {_KIND} AS kind, value FROM ledger), l AS (SELECT list(value ORDER BY value) AS v FROM (SELECT value FROM e WHERE kind = 'ack' ORDER BY event_id LIMIT 10000)), b AS (SELECT count(*) FILTER (kind = 'dispatch') AS dispatched, count(*) FILTER (kind = 'valid') AS valid, count(*) FILTER (kind = 'timeout') AS timeouts, count(*) FILTER (kind = 'ack') AS acks, count(*) FILTER (kind = 'ack_fail') AS ack_fails, count(DISTINCT worker) FILTER (kind IN ('valid', 'invalid')) AS scored FROM e)
SELECT * EXCLUDE v, v[least(len(v) - 1, floor(0.5 * len(v))::INT) + 1] AS p50, v[least(len(v) - 1, floor(0.95 * len(v))::INT) + 1] AS p95, CASE WHEN dispatched = 0 THEN 0.0 ELSE 100.0 * valid / dispatched END::DOUBLE AS completion, CASE WHEN acks + ack_fails = 0 THEN 0.0 ELSE 100.0 * ack_fails / (acks + ack_fails) END::DOUBLE AS ack_fail_rate, CASE WHEN dispatched = 0 THEN 0.0 ELSE 100.0 * timeouts / dispatched END::DOUBLE AS timeout_rate FROM b, l""", "ledger")
P.add("a15_large_ledger", lambda li, o: li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) / 7).alias("epoch"), F.col("o_custkey").alias("worker")).agg(F.sum(F.col("l_quantity").cast("long")).alias("points"), F.count("*").alias("rows")), "SELECT floor(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 7)::BIGINT AS epoch, o_custkey AS worker, sum(l_quantity::BIGINT)::BIGINT AS points, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL", "lineitem", "orders")
