"""Queries of sources, logs, worker health and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import health as H
from feedloom.operators import ledger as L
from feedloom.operators import logs as G
from feedloom.plans import matching
from feedloom.plans.inputs import VIEWS, Plans, cte, spelled, table
from feedloom.shared import shared_dir
from feedloom.sources import feeds as R
from feedloom.streaming import jobs as J

P = Plans()


def _stored(df: DataFrame, form: str) -> str:
    """Rows that Spark derives from the tables, as files that a source then reads."""
    path = f"{shared_dir(df.sparkSession)}/{form}-{uuid.uuid4().hex}"
    getattr(df.write, form)(path)
    return path


def _articles(a: DataFrame) -> DataFrame:
    path = _stored(a.select(F.col("article_id").alias("id"), "title", F.col("body").alias("content"), "source", F.when(F.col("article_id") % 3 == 0, '{"assets": [{"ticker": "ABC"}]}').when(F.col("article_id") % 3 == 1, '{"assets": [').alias("analysisData")), "json")
    return R.read_articles(a.sparkSession, path)


P.add("s01_read_articles", lambda a: _articles(a).select("id", "title", F.length("content").alias("n"), "source", "analysis_data"), """SELECT article_id AS id, title, length(body) AS n, source, CASE article_id % 3 WHEN 0 THEN '{"assets": [{"ticker": "ABC"}]}' WHEN 1 THEN '{"assets": [' END AS analysis_data FROM articles""", "articles")
P.add("s04_parse_analysis", lambda a: R.parse_analysis(_articles(a), "analysis_data").select("id", F.get("analysis.assets", F.lit(0))["ticker"].alias("ticker"), "discrepancy"), "SELECT article_id AS id, CASE WHEN article_id % 3 = 0 THEN 'ABC' END AS ticker, CASE WHEN article_id % 3 = 1 THEN 'invalid_analysis_data' END AS discrepancy FROM articles", "articles")


def _posts(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = p.select(F.col("post_id").alias("id"), "text", F.col("likes").alias("likeCount"), F.col("replies").alias("replyCount"), F.struct((F.col("post_id") % 50).alias("id"), F.concat(F.lit("u"), (F.col("post_id") % 50).cast("string")).alias("username"), (F.col("post_id") % 50 * 10).alias("followersCount")).alias("author"))
    return R.read_posts(p.sparkSession, _stored(raw, "json"))


P.add("s02_read_posts", lambda p: _posts(p)[0].select("id", "author_id", "like_count", "reply_count", "quote_count"), "SELECT post_id AS id, post_id % 50 AS author_id, likes AS like_count, coalesce(replies, 0) AS reply_count, 0 AS quote_count FROM posts", "posts")
P.add("s02_read_authors", lambda p: _posts(p)[1], "SELECT DISTINCT post_id % 50 AS id, 'u' || post_id % 50 AS username, post_id % 50 * 10 AS followers_count FROM posts", "posts")
P.add("s03_read_messages", lambda c: R.read_messages(c.sparkSession, _stored(c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("groupId"), F.col("role").alias("sender"), F.col("text").alias("content")), "json")).select("id", "group_id", "sender", F.length("content").alias("n"), "reply_to_id"), "SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS group_id, role AS sender, length(text) AS n, NULL AS reply_to_id FROM conversations", "conversations")
P.add("s08_read_commitments", lambda led: R.read_commitments(led.select((F.col("worker") % 5).alias("validator"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"scores": {"'), F.col("worker").cast("string"), F.lit('": 1, "207": 0}}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"miner_uid": '), F.col("worker").cast("string"), F.lit(', "score": 0.5}'))).otherwise("bad").alias("data"))).groupBy("validator", "uid", "score").agg(F.count("*").alias("n")),
      "SELECT validator, uid, score, count(*) AS n FROM (SELECT worker % 5 AS validator, CASE WHEN event_id % 3 = 0 THEN worker ELSE worker END AS uid, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS score FROM ledger WHERE event_id % 3 < 2 UNION ALL SELECT worker % 5, 207, 0.0 FROM ledger WHERE event_id % 3 = 0) GROUP BY ALL", "ledger")
P.add("s09_stored_analyses", lambda a: R.read_stored_analyses(a.select(F.col("article_id").alias("id"), F.col("body").alias("content"), F.col("published_s").alias("published")), a.where("article_id % 2 = 0").select(F.col("article_id").alias("id"), "lang"), 200, 50).select("id", "lang"), "SELECT article_id AS id, lang FROM articles WHERE length(body) > 200 AND article_id % 2 = 0 ORDER BY published_s DESC, id LIMIT 50", "articles")


def _completed(led: DataFrame) -> DataFrame:
    path = f"{shared_dir(led.sparkSession)}/completed-{uuid.uuid4().hex}"
    rows = led.select("event_id", "epoch", F.when(F.col("event_id") % 2 == 0, "Processed").otherwise("Processing").alias("status"), (F.col("event_id") % 6 == 0).alias("submitted"))
    R.write_completed(rows, path)
    R.write_completed(rows.where("event_id % 5 <> 0").limit(0), path)  # writing nothing replaces nothing
    return led.sparkSession.read.parquet(path).select("event_id", F.col("epoch").cast("long").alias("epoch"))


P.add("s10_write_completed", _completed, "SELECT event_id, epoch FROM ledger WHERE event_id % 2 = 0 AND event_id % 6 <> 0", "ledger")


def _state(led: DataFrame) -> DataFrame:
    path = f"{shared_dir(led.sparkSession)}/state-{uuid.uuid4().hex}"
    schema = "worker long, points long, epoch long"
    empty = R.read_state(led.sparkSession, path, schema)
    R.write_state(empty.union(L.epoch_sums(led.where("event_type = 'purchase'")).select("worker", "points", "epoch")), path)
    return R.read_state(led.sparkSession, path, schema)


P.add("s11_state", _state, "SELECT worker, sum(points)::BIGINT AS points, epoch FROM ledger WHERE event_type = 'purchase' GROUP BY ALL", "ledger")
VIEWS["log_text"] = """
SELECT event_id, concat(CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('2024-01-0', event_id % 3 + 1, ' 10:00:00.', 100 + event_id % 900, ' ') END, CASE event_id % 8 WHEN 0 THEN 'Received TweetBatch' WHEN 1 THEN 'Batch ACCEPTED' WHEN 2 THEN concat('Batch REJECTED failed_fields=[''content_type'', ''f', event_id % 5, ''']')
  WHEN 3 THEN concat('Failed fields: sentiment (miner=neutral vs validator=v', event_id % 4, '), impact (miner=None vs validator=high)') WHEN 4 THEN concat('Batch validation passed for miner worker', 10000 + worker, 'z.. ok') WHEN 5 THEN concat('Batch validation failed for miner worker', 10000 + worker, 'z.. no')
  WHEN 6 THEN 'Miner classification: subnet_id=1, sentiment=neutral, content_type=other, tech=none, market=other, impact=none' ELSE 'request timeout after 10; sampling 3 from batch' END) AS line FROM {ledger}"""
_LOGS = r"logs AS (SELECT strptime(substr(line, 1, 23), '%Y-%m-%d %H:%M:%S.%g') AS ts, line FROM log_text WHERE regexp_matches(line, '^\d{4}-') AND substr(line, 1, 10) >= '2024-01-02')"


def _log(t: DataFrame) -> DataFrame:
    coloured = t.select(F.concat(F.when(F.col("event_id") % 2 == 0, "\x1b[32m").otherwise(""), "line").alias("value"))
    return R.read_worker_log(t.sparkSession, _stored(coloured, "text"), "2024-01-02")


P.add("s07_read_worker_log", lambda t: _log(t).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "line"), f"WITH {_LOGS} SELECT strftime(ts, '%Y-%m-%d') AS day, line FROM logs", "log_text")
P.add("a24_log_stats", lambda t: G.log_stats(_log(t)), f"WITH {_LOGS}, s AS (SELECT count(*) FILTER (contains(lower(line), 'received tweetbatch')) AS received, count(*) FILTER (contains(lower(line), 'batch accepted')) AS accepted, count(*) FILTER (contains(lower(line), 'batch rejected')) AS rejected, count(*) FILTER (contains(line, 'request timeout after')) AS timeouts, count(*) FILTER (contains(line, 'sampling')) AS sampled, count(*) FILTER (contains(line, 'sentiment=neutral, content_type=other')) AS lazy FROM logs) SELECT *, CASE WHEN accepted + rejected > 0 THEN 100.0 * accepted / (accepted + rejected) ELSE 0.0 END::DOUBLE AS accept_rate FROM s", "log_text")
P.add("a24_field_failures", lambda t: G.field_failures(_log(t)), rf"WITH {_LOGS}, f AS (SELECT unnest(string_split(replace(regexp_extract(line, 'failed_fields=\[''([^]]+)''\]', 1), '''', ''), ',')) AS f FROM logs WHERE contains(line, 'failed_fields')) SELECT trim(f) AS field, count(*) AS n FROM f GROUP BY 1", "log_text")
P.add("k05_mismatch_patterns", lambda t: G.mismatch_patterns(_log(t)), rf"WITH {_LOGS}, m AS (SELECT unnest(regexp_extract_all(line, '\w+ \(miner=[^ ]+ vs validator=[^)]+\)')) AS m FROM logs WHERE contains(line, 'Failed fields: ')) SELECT lower(regexp_extract(m, '^(\w+)', 1)) AS field, lower(regexp_extract(m, 'miner=([^ ]+)', 1)) AS submitted, lower(regexp_extract(m, 'validator=([^)]+)', 1)) AS reference, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, field, submitted, reference LIMIT 15", "log_text")
_WC = r"wc AS (SELECT substr(regexp_extract(line, 'for miner (\w{12})', 1), 1, 12) AS worker, count(*) FILTER (contains(line, 'passed')) AS accepted, count(*) FILTER (contains(line, 'failed for')) AS rejected FROM logs WHERE contains(line, 'for miner') GROUP BY 1)"
P.add("a24_worker_counts", lambda t: G.worker_counts(_log(t)), f"WITH {_LOGS}, {_WC} SELECT * FROM wc", "log_text")
P.add("a25_worker_report", lambda t: G.worker_report(_log(t), "worker100"), f"WITH {_LOGS}, {_WC} SELECT *, 100.0 * accepted / (accepted + rejected) AS rate, CASE WHEN accepted = 0 THEN 'always_rejected' WHEN accepted < rejected THEN 'mostly_rejected' ELSE 'mostly_accepted' END AS band FROM wc WHERE starts_with(worker, 'worker100')", "log_text")
#: A log with both forms of failure lines, by worker.
_PAD = lambda x: f"lpad(CAST(CAST(floor({x}) AS BIGINT) AS STRING), 2, '0')"
VIEWS["worker_log"] = f"""
SELECT event_id, worker, kind, logged, concat(logged, CASE WHEN kind < 2 THEN concat(' Batch validation passed for miner ', worker, '.. ok') WHEN kind IN (2, 4) THEN concat(' Batch validation failed for miner ', worker, '.. no')
  WHEN kind = 3 THEN concat(' Mismatch for ', worker, ': sentiment(m=neutral|v=v', event_id % 4, '), f', event_id % 3, '(m=low|v=high) | preview=text ', event_id)
  ELSE concat(' Rejection detail ', worker, translate(concat(' failed_fields=[~impact~, ~f', event_id % 5, '~]'), '~', chr(39)), CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(' preview=text ', event_id) END) END) AS line
FROM (SELECT event_id, concat('worker', 10000 + event_id % 7, 'z') AS worker, CAST(floor(event_id / 7) AS BIGINT) % 6 AS kind, concat('2024-01-0', 2 + event_id % 2, ' ', {_PAD('event_id / 3600 % 24')}, ':', {_PAD('event_id / 60 % 60')}, ':', {_PAD('event_id % 60')}, '.', 100 + event_id % 900) AS logged FROM {{ledger}}) AS x"""
_OWN = """own AS (SELECT strptime(logged, '%Y-%m-%d %H:%M:%S.%g') AS ts, line, CASE WHEN kind < 2 THEN 'passed' WHEN kind IN (2, 4) THEN 'failed' WHEN kind = 3 THEN 'mismatch' ELSE 'detail' END AS what,
 CASE kind WHEN 3 THEN ['sentiment', 'f' || event_id % 3] WHEN 5 THEN ['impact', 'f' || event_id % 5] ELSE [] END AS fields, CASE WHEN kind = 3 OR (kind = 5 AND event_id % 4 <> 0) THEN 'text ' || event_id ELSE '' END AS preview FROM worker_log WHERE worker = 'worker10003z')"""
P.add("a25_worker_fields", lambda t: G.worker_fields(_log(t), "worker10003"), f"WITH {_OWN}, f AS (SELECT unnest(fields) AS field FROM own) SELECT field, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM f) AS share FROM f GROUP BY field", "worker_log")
P.add("a25_worker_mismatches", lambda t: G.worker_mismatches(_log(t), "worker10003"), f"WITH {_OWN}, f AS (SELECT unnest(regexp_extract_all(line, '\\w+\\(m=[^|]+\\|v=[^)]+\\)')) AS m FROM own WHERE what = 'mismatch') SELECT regexp_extract(m, '^(\\w+)', 1) AS field, regexp_extract(m, 'm=([^|]+)', 1) AS submitted, regexp_extract(m, 'v=([^)]+)', 1) AS reference, count(*) AS n FROM f GROUP BY ALL", "worker_log")
P.add("a25_worker_recent", lambda t: G.worker_recent(_log(t), "worker10003").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")), f"""WITH {_OWN}, b AS (SELECT *, lag(what) OVER w AS bw, lag(ts) OVER w AS bt FROM own WHERE what <> 'detail' OR preview <> '' WINDOW w AS (PARTITION BY what = 'passed' ORDER BY ts, line)),
f AS (SELECT 'failed' AS what, CASE WHEN bw = 'failed' THEN bt ELSE ts END AS ts, fields, preview FROM b WHERE what = 'mismatch' OR (what = 'detail' AND bw = 'failed') UNION ALL SELECT what, ts, fields, '' FROM b WHERE what = 'passed')
SELECT what, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, fields, preview, row_number() OVER (PARTITION BY what ORDER BY ts DESC, preview, fields) AS rank FROM f QUALIFY rank <= CASE what WHEN 'failed' THEN 10 ELSE 5 END""", "worker_log")
_KINDS = "CASE event_id % 9 WHEN 0 THEN 'valid' WHEN 1 THEN 'timeout' WHEN 2 THEN 'timeout' WHEN 3 THEN 'ack_fail' WHEN 4 THEN 'faith' WHEN 5 THEN 'fail' WHEN 6 THEN 'invalid' WHEN 7 THEN 'faith' ELSE 'fail' END"


def _health_events(led: DataFrame) -> DataFrame:
    return led.selectExpr("worker % 9 AS worker", "epoch * 3600 + event_id % 3600 AS ts_s", "event_id AS seq", f"{_KINDS} AS kind", "CASE WHEN event_id % 9 = 0 THEN value ELSE 0.3 END AS value")


P.add("x06_worker_health", lambda led: H.worker_health(_health_events(led)), None, "ledger")
P.add("x07_health_sessions", lambda led: H.health_sessions(_health_events(led)), None, "ledger")
P.add("x07_parked_spans", lambda led: H.parked_spans(H.health_sessions(_health_events(led))), None, "ledger")
P.add("j18_worker_status", lambda led, n: _status(led, n), None, "ledger", "nodes")


def _status(led: DataFrame, nodes: DataFrame) -> DataFrame:
    latency = L.rolling_latency(led.select("worker", "event_id", (F.col("epoch") * 3600).alias("ts_s"), "value")).groupBy("worker").agg(F.max_by("median", "event_id").alias("median"))
    flying = led.where("event_type = 'click'").groupBy("worker").agg(F.count("*").alias("inflight"))
    trust = led.groupBy("worker").agg((F.count_if(F.col("event_type") == "view") / F.count("*")).alias("reputation"))
    live = L.liveness(led.select("worker", (F.col("epoch") * 3600).alias("ts_s")), 1_704_100_000, 30 * 86_400)
    return H.worker_status(H.worker_health(_health_events(led)), live, nodes, 1_704_100_000, flying, latency, trust)


P.add("a12_merkle_root", lambda led: _merkle(led), None, "ledger")


def _merkle(led: DataFrame) -> DataFrame:
    from feedloom.operators.attest import merkle_roots

    rows = led.select((F.col("worker") % 5).alias("validator"), "epoch", F.lit("article").alias("resource_type"), F.col("event_id").cast("string").alias("resource_id"), F.concat(F.lit("w"), F.col("worker").cast("string")).alias("worker"), F.lit("valid").alias("verdict"), F.col("event_type").alias("categorical_key"), F.round("value", 6).alias("points"))
    return merkle_roots(rows)


# -- streams

#: Bytes of a micro-batch: the files of a table don't lie in the order of their rows' times, so they come together.
AT_ONCE = 1_000_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stream(spark, sf_dir, "events", AT_ONCE).withColumn("ts", F.col("ts").cast("timestamp"))


P.queries["x01_stream_epoch_points"] = lambda spark, d: J.run(J.epoch_points(_events(spark, d).where("event_type = 'purchase'").select("ts", (F.col("user_id") % 97).alias("worker"), F.round(F.abs("value")).cast("long").alias("points"))))
P.sql["x01_stream_epoch_points"] = "WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS epoch_start, user_id % 97 AS worker, round(abs(value))::BIGINT AS points, ts FROM events WHERE event_type = 'purchase') SELECT epoch_start, worker, sum(points)::BIGINT AS points FROM e WHERE epoch_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e) GROUP BY ALL"
P.queries["x02_stream_weight_window"] = lambda spark, d: J.run(J.weight_window(_events(spark, d).where("event_type = 'purchase'").select("ts", (F.col("user_id") % 7).alias("worker"), F.round(F.abs("value")).cast("long").alias("points")), 4))
P.sql["x02_stream_weight_window"] = "WITH e AS (SELECT ts, user_id % 7 AS worker, round(abs(value))::BIGINT AS points FROM events WHERE event_type = 'purchase'), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR * k AS window_end, worker, points FROM e, (VALUES (1), (2), (3), (4)) t(k)) SELECT window_end, worker, sum(points)::BIGINT AS points FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e) GROUP BY ALL"
P.queries["x03_stream_reputation"] = lambda spark, d: J.run(
    J.reputation(_events(spark, d).where("event_type = 'view'").select("ts", (F.col("user_id") % 97).alias("target"), F.floor(F.unix_timestamp("ts") / 3600).alias("epoch"), (F.col("event_id") % 40).alias("article_id"), (F.col("event_id") % 3).alias("sender"), (F.col("event_id") % 21 / 20).alias("score"), (F.col("event_id") % 5 / 2).alias("weight")))
)
P.sql["x03_stream_reputation"] = """WITH o AS (SELECT ts, user_id % 97 AS target, floor(epoch(ts) / 3600)::BIGINT AS epoch, event_id % 40 AS article_id, event_id % 3 AS sender, event_id % 21 / 20 AS score, event_id % 5 / 2 AS weight FROM events WHERE event_type = 'view'),
w AS (SELECT epoch_ms(max(ts)) AS newest FROM o),
s AS (SELECT o.*, least(1.0, 0.03 * weight) AS a FROM o, w WHERE weight > 0 AND (epoch + 3) * 3600000 <= newest QUALIFY row_number() OVER (PARTITION BY target, epoch, article_id, sender ORDER BY score, weight DESC) = 1),
l AS (SELECT target, list({'e': epoch, 's': score::DOUBLE, 'a': a::DOUBLE} ORDER BY epoch, article_id, sender) AS l FROM s GROUP BY target),
k AS (SELECT DISTINCT target, epoch FROM s), f AS (SELECT k.target, k.epoch, list_filter(l, lambda x: x.e <= k.epoch) AS l FROM k JOIN l USING (target))
SELECT target, epoch, list_reduce(list_prepend({'e': 0::BIGINT, 's': 0.5::DOUBLE, 'a': 1.0::DOUBLE}, l), lambda x, y: {'e': y.e, 's': x.s * (1 - y.a) + y.a * y.s, 'a': 1.0::DOUBLE}).s AS reputation, len(l) AS n, 0 AS late FROM f"""
P.queries["x04_stream_accept_broadcasts"] = lambda spark, d: J.run(J.accept_broadcasts(_events(spark, d).select("ts", (F.col("user_id") % 11).alias("sender"), F.floor(F.unix_timestamp("ts") / 3600).alias("epoch"), (F.floor(F.unix_timestamp("ts") / 3600) + F.when(F.col("event_id") % 17 == 0, 500).otherwise(0)).alias("seq"), F.col("event_id").alias("arrival"))))
P.sql["x04_stream_accept_broadcasts"] = "WITH m AS (SELECT user_id % 11 AS sender, floor(epoch(ts) / 3600)::BIGINT AS epoch, event_id AS arrival FROM events WHERE event_id % 17 <> 0), s AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY sender ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM m) SELECT sender, epoch, epoch AS seq, arrival FROM s WHERE epoch > b"
P.queries["x05_stream_leases"] = lambda spark, d: J.run(J.leases(_events(spark, d).select((F.col("user_id") % 300).alias("item"), (F.col("event_id") % 9).alias("worker"), "ts", F.when(F.col("event_type") == "click", "open").otherwise("done").alias("what")), 3600))
P.sql["x05_stream_leases"] = "WITH e AS (SELECT user_id % 300 AS item, event_id % 9 AS worker, epoch_us(ts) AS us, event_type FROM events), n AS (SELECT *, lead(us) OVER (PARTITION BY item ORDER BY us) AS nxt FROM e), w AS (SELECT epoch_ms(max(ts)) - 600000 AS ms FROM events) SELECT item, worker, us AS opened_us FROM n, w WHERE event_type = 'click' AND (nxt - us > 3600000000 OR (nxt IS NULL AND (us + 3600000000) // 1000 + 1 < ms))"
P.queries["x06_stream_worker_health"] = lambda spark, d: J.run(J.worker_health(_events(spark, d).selectExpr("ts", "user_id % 97 % 9 AS worker", "floor(unix_timestamp(ts) / 3600) * 3600 + event_id % 3600 AS ts_s", "event_id AS seq", f"{_KINDS} AS kind", "CASE WHEN event_id % 9 = 0 THEN value ELSE 0.3 END AS value")))
P.queries["x08_dedup_recent"] = lambda spark, d: J.run(J.dedup_recent(_events(spark, d).select("ts", (F.col("user_id") * 10 + F.length("event_type")).alias("key")), "key", 300))
P.sql["x08_dedup_recent"] = """WITH k AS (SELECT user_id * 10 + length(event_type) AS key, list([epoch_us(ts)] ORDER BY ts) AS l FROM events GROUP BY 1)
SELECT key, make_timestamp(unnest(list_reduce(l, lambda kept, x: CASE WHEN x[1] - kept[len(kept)] >= 300000000 THEN list_append(kept, x[1]) ELSE kept END))) AS ts FROM k"""


def _running_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights after the last micro-batch that gave any."""
    rows = J.running_rarity(J.stream(spark, sf_dir, "documents", AT_ONCE), ["lang", "source"])
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).select("field", "label", F.round("weight", 6).alias("weight"), "total")


P.queries["a10_running_rarity"] = _running_rarity
P.sql["a10_running_rarity"] = "WITH c AS (SELECT 'lang' AS field, lang AS label, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source), t AS (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM c) SELECT field, label, round(-log2(greatest(0.01, n / total)), 6) AS weight, total::BIGINT AS total FROM t WHERE total >= 200"


def _stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles as they arrive, with the gazetteer's tables as they are."""
    arriving = spark.sql(spelled("articles", "spark"), documents=J.stream(spark, sf_dir, "documents", AT_ONCE))
    dims = [table(spark, sf_dir, name) for name in ("gazetteer", "word_freq", "common_words")]
    return J.triage(arriving, lambda batch: matching.asset_matches(batch, *dims))


P.queries["x09_stream_triage"] = _stream_triage
P.sql["x09_stream_triage"] = rf"WITH {cte('articles')}, f AS ({matching.P.sql['f01_triage_stage']}) SELECT f.*, sha256(trim(regexp_replace(lower(concat(title, ' ', substr(body, 1, 500))), '\s+', ' ', 'g'))) AS content_hash, len(regexp_extract_all(body, '\S+')) AS word_count FROM f JOIN articles USING (article_id)"
