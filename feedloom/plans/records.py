"""Queries of analysis records, attestations, message groups and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.operators import match as M
from feedloom.operators import records as R
from feedloom.plans.inputs import Plans
from feedloom.plans.matching import _messages
from feedloom.shared import shared_dir
from feedloom.sources import feeds

P = Plans()


def _economic(p):
    point = lambda k: F.struct(F.get(F.array(F.lit("cpi"), F.lit("odd"), F.lit("gdp")), ((F.col("i") + k) % 3).cast("int")).alias("kind"), (F.col("i") + k).cast("double").alias("actual"), F.when(F.col("j") % 2 == 0, F.col("j").cast("double")).alias("expected"), F.lit(1.0).alias("previous"))
    return p.select("article_id", F.posexplode(R.economic_deltas(F.array(*[point(k) for k in range(6)]))).alias("pos", "e")).select("article_id", "pos", "e.*")


P.add("t26_economic_deltas", _economic, "SELECT article_id, k AS pos, CASE (i + k) % 3 WHEN 0 THEN 'cpi' WHEN 1 THEN 'other' ELSE 'gdp' END AS kind, CASE WHEN j % 2 = 0 THEN (i + k - j)::DOUBLE END AS vs_expected, (i + k - 1)::DOUBLE AS vs_previous FROM pairs, (VALUES (0), (1), (2), (3), (4)) t(k)", "pairs")


def _claims(p):
    claim = lambda k: F.struct(F.when((F.col("i") + k) % 4 != 0, F.lit("m")).alias("metric"), F.col("j").cast("double").alias("value"), F.col("sub_text").alias("context"))
    quote = lambda k: F.struct(F.when((F.col("m") + k) % 3 != 0, F.lit("s")).alias("speaker"), F.col("ref_text").alias("text"))
    return p.select("article_id", F.size(R.capped_claims(F.array(*[claim(k) for k in range(12)]), context=20)).alias("claims"), F.get(R.capped_claims(F.array(*[claim(k) for k in range(12)]), context=20), F.lit(0))["context"].alias("context"), F.size(R.capped_quotes(F.array(*[quote(k) for k in range(6)]))).alias("quotes"))


P.add("t27_cap_claims_quotes", _claims, "SELECT article_id, (SELECT count(*) FROM range(10) r(k) WHERE (i + k) % 4 <> 0) AS claims, substr(sub_text, 1, 20) AS context, (SELECT count(*) FROM range(5) r(k) WHERE (m + k) % 3 <> 0) AS quotes FROM pairs", "pairs")


def _canonical(p):
    asset = lambda t, first: F.struct(F.lit(t).alias("ticker"), (F.col("i") % 2 == first).alias("is_primary"), *[F.lit(x).alias(x) for x in ("direction", "short", "medium", "long")])
    return p.select("article_id", R.canonical_article([F.col("i"), F.lit("news"), F.when(F.col("j") > 2, F.lit("2024"))], F.array(asset("XYZ", 0), asset("ABC", 0), asset("Q", 1))).alias("article"), R.canonical_post([F.col("i"), F.lit("x")], F.array(F.lit("Beta"), F.lit("alpha"), F.col("sub_text"))).alias("post"))


P.add("t29_canonical_string", _canonical, "SELECT article_id, i || '|news|' || CASE WHEN j > 2 THEN '2024' ELSE 'none' END || CASE WHEN i % 2 = 0 THEN '|ABC|direction|short|medium|long|XYZ|direction|short|medium|long' ELSE '|Q|direction|short|medium|long' END AS article, i || '|x|' || array_to_string(list_sort(['beta', 'alpha', lower(sub_text)]), '|') AS post FROM pairs", "pairs")
_F = lambda: {"sentiment": F.col("sub_text"), "asset_symbol": F.when(F.col("i") > 2, F.lit("ABC")), "content_type": F.lit("news")}
P.add("t30_categorical_key", lambda p: p.select("article_id", R.categorical_key(list(_F().values())).alias("k"), R.analysis_hash(_F()).alias("h")), r"""SELECT article_id, sub_text || '|' || CASE WHEN i > 2 THEN 'ABC' ELSE '' END || '|news' AS k, sha256('{"asset_symbol":' || CASE WHEN i > 2 THEN '"ABC"' ELSE 'null' END || ',"content_type":"news","sentiment":' || to_json(sub_text) || '}') AS h FROM pairs""", "pairs")
P.add("f09_validate_record", lambda p: R.validate_record(p.select("article_id", (F.col("m") / 9).alias("magnitude"), F.col("sub_text").alias("title"), F.col("i").cast("string").alias("kind")), {"magnitude": (0.0, 1.0)}, {"title": 100}, {"kind": ["0", "1", "2", "3"]}).select("article_id", "is_valid", "invalid_reason"), "WITH r AS (SELECT article_id, CASE WHEN m / 9 > 1 THEN 'magnitude out of range' WHEN length(sub_text) > 100 THEN 'title too long' WHEN i > 3 THEN 'kind unknown' END AS invalid_reason FROM pairs) SELECT article_id, invalid_reason IS NULL AS is_valid, invalid_reason FROM r", "pairs")
_REASONS = "split('classification_mismatch,odd,validation_failed,cloned_embeddings', ',')"
P.add("a14_penalty_detail", lambda p: R.penalty_detail(p.select(F.col("i").alias("worker"), F.col("j").alias("epoch"), F.when(F.col("m") != 3, F.col("article_id").cast("string")).alias("resource_id"), F.expr(f"{_REASONS}[CAST(article_id % 4 AS INT)]").alias("reason"), F.create_map(F.lit("a"), F.col("i") > 3, F.lit("b"), F.col("j") > 2).alias("field_results"), F.substring("sub_text", 1, 10).alias("preview"), F.when(F.col("m") > 5, F.col("m") / 11).alias("composite"), (F.col("i") / 7).alias("agreement"))), f"SELECT i AS worker, j AS epoch, article_id::VARCHAR AS resource_id, {_REASONS}[(article_id % 4 + 1)::INT] AS cause, CASE WHEN i <= 3 AND j <= 2 THEN 'a,b' WHEN i <= 3 THEN 'a' WHEN j <= 2 THEN 'b' END AS failed_fields, substr(sub_text, 1, 10) AS preview, CASE WHEN m > 5 THEN m / 11 ELSE i / 7 END AS score FROM pairs WHERE m <> 3 AND article_id % 4 <> 1", "pairs")
P.add("w11_accepted_attestations", lambda led, n: R.accepted_attestations(led.where("event_type = 'purchase'").select((F.col("worker") % 7).cast("string").alias("sender"), F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("worker") % 7).cast("string")).alias("signer"), (F.col("event_id") % 6 != 1).alias("signature_ok"), "epoch", F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 2 == 0, F.sha2(F.col("event_id").cast("string"), 256)).otherwise("junk").alias("root"), F.create_map("worker", F.col("points") + 0.5).alias("points")), n, ["3"]), """WITH m AS (SELECT worker % 7 AS sender, epoch, event_id AS arrival, CASE WHEN event_id % 2 = 0 THEN sha256(event_id::VARCHAR) ELSE '' END AS root, worker, points + 0.5 AS p FROM ledger WHERE event_type = 'purchase' AND event_id % 5 <> 0 AND event_id % 6 <> 1 AND worker % 7 <> 3),
f AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY sender ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM m) SELECT sender::VARCHAR AS sender, epoch, root, uid, round_even(p, 0)::BIGINT AS points FROM f JOIN (SELECT worker, min(uid) AS uid FROM nodes GROUP BY worker) n ON n.worker = f.worker WHERE epoch > b AND round_even(p, 0) BETWEEN 1 AND 5000""", "ledger", "nodes")


def _groups(c, g):
    messages = _messages(c).join(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("role").alias("sender"), F.concat(F.substring("text", 1, 40), F.when(F.col("turn") % 4 == 0, " nvidia").otherwise("")).alias("content")), "message_id")
    inherited = messages.where("message_id % 10 = 3").select("message_id", F.lit(77).alias("class_id"))
    return R.message_group_class(messages, M.message_context(messages), g.selectExpr("asset_id AS class_id", "kind", "keyword"), inherited)


P.add("j17_message_group_class", _groups, None, "conversations", "gazetteer")
P.add("a28_gazetteer_integrity", lambda g, a, w: R.gazetteer_integrity(g.union(g.sparkSession.createDataFrame([(2, "identifier", "acme corp", 20)], g.schema)), a, w, ["globex"]), "WITH g AS (SELECT * FROM gazetteer_whole UNION ALL SELECT 2, 'identifier', 'acme corp', 20), r AS (SELECT g.*, asset_class FROM g JOIN assets_whole a ON a.asset_id = g.asset_id WHERE kind IN ('identifier', 'alias')) SELECT keyword, 'shared' AS problem FROM r WHERE asset_class = 'equity' GROUP BY keyword HAVING count(DISTINCT asset_id) > 1 UNION SELECT keyword, 'banned' FROM r WHERE keyword = 'globex' UNION SELECT keyword, 'common' FROM r WHERE NOT contains(keyword, ' ') AND keyword IN (SELECT word FROM word_freq WHERE zipf >= 4.0)", "gazetteer_whole", "assets_whole", "word_freq")
_PRED = lambda d, k: d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % k == 0, "xx").otherwise(F.col("lang")).alias("language"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("ABC"))).otherwise(F.array(F.lit("XYZ"), F.concat(F.lit("T"), (F.col("doc_id") % k).cast("string")))).alias("assets"), F.array(F.lit("Acme Corp"), F.concat(F.lit("Firm"), (F.col("doc_id") % k).cast("string"))).alias("entities"), (F.col("doc_id") % 3 - 1).alias("direction"))
P.add("a27_gold_eval", lambda d: R.gold_eval(_PRED(d, 7), d.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.array(F.lit("ABC")).alias("expect_assets"), F.array(F.lit("T1")).alias("forbid_assets"), F.array(F.lit("acme"), F.lit("corp firm1")).alias("forbid_entities"), (F.col("doc_id") % 2).alias("direction"))), "SELECT avg((doc_id % 3 = 0)::INT) AS asset_recall, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 = 1) AS forbidden_found, count(*) + count(*) FILTER (doc_id % 7 = 1) AS entity_leaks, avg((doc_id % 7 <> 0)::INT) FILTER (lang <> '') AS language_accuracy, avg((sign(doc_id % 2) = sign(doc_id % 3 - 1))::INT) AS direction_agreement FROM documents", "documents")
P.add("a26_corpus_compare", lambda d: R.corpus_compare(_PRED(d, 7).withColumn("weak", F.transform("assets", lambda a: (F.col("id") % 2 == 0) & (a != "ABC"))), _PRED(d, 5), ["ABC", "T1", "T2"], 4), """WITH o AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS language, CASE WHEN doc_id % 3 = 0 THEN ['ABC'] ELSE ['XYZ', 'T' || doc_id % 7] END AS assets FROM documents), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS language, CASE WHEN doc_id % 3 = 0 THEN ['ABC'] ELSE ['XYZ', 'T' || doc_id % 5] END AS assets FROM documents),
a AS (SELECT 'language' AS kind, language AS key, 1 AS o, 0 AS n FROM o UNION ALL SELECT 'ticker', unnest(assets), 1, 0 FROM o UNION ALL SELECT 'language', language, 0, 1 FROM n UNION ALL SELECT 'ticker', unnest(assets), 0, 1 FROM n)
SELECT kind, key, sum(o)::BIGINT AS old, sum(n)::BIGINT AS new FROM a GROUP BY ALL UNION ALL SELECT 'mentions', 'all', sum(o)::BIGINT, sum(n)::BIGINT FROM a WHERE kind = 'ticker'
UNION ALL SELECT 'junk', 'all', (SELECT count(*) FROM o, unnest(assets) t(x) WHERE id % 2 = 0 AND x IN ('T1', 'T2')), (SELECT count(*) FROM n, unnest(assets) t(x) WHERE x IN ('ABC', 'T1', 'T2'))
UNION ALL SELECT 'top_old', key, old, new FROM (SELECT key, sum(o)::BIGINT AS old, sum(n)::BIGINT AS new FROM a WHERE kind = 'ticker' GROUP BY key HAVING old > 0 ORDER BY old DESC, key LIMIT 4)
UNION ALL SELECT 'top_new', key, old, new FROM (SELECT key, sum(o)::BIGINT AS old, sum(n)::BIGINT AS new FROM a WHERE kind = 'ticker' GROUP BY key HAVING new > 0 ORDER BY new DESC, key LIMIT 4) UNION ALL SELECT 'relabelled', 'all', 0, (SELECT count(*) FROM o JOIN n USING (id) WHERE o.language <> n.language)""", "documents")


def _dims(a, s):
    """Dimension files that Spark writes as JSON arrays of about 1,000 objects, read as a source."""
    path = f"{shared_dir(a.sparkSession)}/dims-{uuid.uuid4().hex}"
    for name, frame in (("assets", a), ("sectors", s)):
        groups = frame.count() // 1000 + 1
        rows = frame.select(F.struct("*").alias("row")).groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part"))
        rows.agg(F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("part").text(f"{path}/{name}.json")
    found = feeds.load_dims(a.sparkSession, path, ["assets", "sectors"])
    return found["assets"].groupBy("asset_class").agg(F.count("*").alias("n"))


P.add("s05_load_dims", _dims, "SELECT asset_class, count(*) AS n FROM assets_whole GROUP BY asset_class", "assets_whole", "sectors")


def _gold(d):
    path = f"{shared_dir(d.sparkSession)}/gold-{uuid.uuid4().hex}"
    d.select(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), "source").alias("article"), F.struct(F.array("lang").alias("assets_includes")).alias("expect")).write.json(path)
    return feeds.read_gold(d.sparkSession, path).select("id", "source", F.get("expect.assets_includes", F.lit(0)).alias("first"))


P.add("s06_read_gold", _gold, "SELECT doc_id::VARCHAR AS id, source, lang AS first FROM documents", "documents")


def _merkle_check(led):
    from feedloom.operators.attest import merkle_check, merkle_roots

    rows = led.select((F.col("worker") % 5).alias("validator"), "epoch", F.lit("article").alias("resource_type"), F.col("event_id").cast("string").alias("resource_id"), F.concat(F.lit("w"), F.col("worker").cast("string")).alias("worker"), F.lit("valid").alias("verdict"), F.col("event_type").alias("categorical_key"), F.col("value").alias("points"))
    signed = merkle_roots(rows).select("validator", "epoch", F.when(F.col("validator") == 2, "forged").otherwise(F.col("root")).alias("root"))
    return merkle_check(rows, signed, 1.0)


P.add("j16_merkle_check", _merkle_check, "SELECT DISTINCT worker % 5 AS validator, epoch, worker % 5 <> 2 AS ok FROM ledger", "ledger")
