"""Queries of the comparison of analyses. Records are derived from documents, vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import scores as S

from feedloom.operators import compare as C
from feedloom.plans.inputs import VIEWS, Plans

P = Plans()
_NOMINAL = ["none", "alpha", "beta", "gamma"]


def _labels(name: str) -> list[str]:
    ladder = C.ENUMS[name]
    return S.LADDERS[ladder] if ladder else _NOMINAL


def _enum_sql(side: str) -> str:
    """Labels by number; a submission is one step off in some records."""
    out = []
    for k, name in enumerate(C.ENUMS):
        labels, shift = _labels(name), "" if side == "v" else f" + CASE WHEN id % {k + 4} = 1 THEN 1 ELSE 0 END"
        out.append(f"split('{','.join(labels)}', ',')[CAST((id * {k + 3}{shift}) % {len(labels)} AS INT){{base}}] AS {side}_{name}")
    return ", ".join(out)


_RECORD = """SELECT id AS article_id, floor(id / 12) AS batch_id, lang AS v_language, CASE WHEN id % 19 = 0 THEN 'xx' ELSE upper(lang) END AS m_language, id % 9 + 1 AS v_sector_id, CASE WHEN id % 23 = 0 THEN 1 ELSE id % 9 + 1 END AS m_sector_id,
 h AS v_content_hash, CASE WHEN id % 29 = 0 THEN 'x' ELSE h END AS m_content_hash, n AS v_word_count, n AS m_word_count, n % 7 AS v_sentence_count, n % 7 AS m_sentence_count, n AS v_char_count, n + CASE WHEN id % 31 = 0 THEN 1 ELSE 0 END AS m_char_count, id % 3 AS v_ticker_count, id % 3 AS m_ticker_count,
 substr(t, 1, 60) AS v_headline, substr(t, CAST(1 + id % 4 AS INT), 60) AS m_headline, substr(t, 10, 80) AS v_one_liner, substr(t, 12, 80) AS m_one_liner, substr(t, 30, 100) AS v_paragraph, substr(t, 30, 90) AS m_paragraph, substr(t, 1, 40) AS v_event_title, substr(t, 1, CAST(30 + id % 20 AS INT)) AS m_event_title,
 split(substr(t, 1, 50), ' ') AS v_entities, split(substr(t, 4, 50), ' ') AS m_entities, split(substr(t, 20, 50), ' ') AS v_fingerprint, split(substr(t, 20, 60), ' ') AS m_fingerprint, split(substr(t, 40, 30), ' ') AS v_narratives, split(upper(substr(t, 40, 30)), ' ') AS m_narratives,
 split(concat('cpi:', id % 5), ',') AS v_economic, split(concat('cpi:', id % 5, CASE WHEN id % 6 = 0 THEN ',gdp:1' ELSE '' END), ',') AS m_economic, split('ABC>XYZ,XYZ>XAU', ',') AS v_links, split(CASE WHEN id % 37 = 0 THEN 'ABC>XYZ' ELSE 'XYZ>XAU,ABC>XYZ' END, ',') AS m_links,
 e AS v_title_embedding, CASE WHEN id % 41 = 0 THEN NULL WHEN id % 43 = 0 THEN f ELSE e END AS m_title_embedding, e AS v_narrative_embedding, CASE WHEN id % 3 = 0 THEN f ELSE e END AS m_narrative_embedding, id,
 __ENUMS__ FROM __BASE__"""
VIEWS["records_base"] = "SELECT d.doc_id AS id, lang, regexp_replace(lower(coalesce(text, '')), '[^ -~]', '{g}') AS t, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h, a.embedding AS e, b.embedding AS f FROM (SELECT *, doc_id % (SELECT count(*) FROM {embeddings}) AS v, (doc_id + 7) % (SELECT count(*) FROM {embeddings}) AS v7 FROM {documents}) d JOIN {embeddings} a ON a.vec_id = d.v JOIN {embeddings} b ON b.vec_id = d.v7".replace(", '{g}'", ", ''")
_BOTH = _RECORD.replace("__ENUMS__", f"{_enum_sql('v')}, {_enum_sql('m')}")
DUCK = "records AS (" + _BOTH.replace("__BASE__", "(SELECT * REPLACE (regexp_replace(lower(coalesce(text, '')), '[^ -~]', '', 'g') AS t) FROM (SELECT d.doc_id AS id, lang, text, '' AS t, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h, a.embedding AS e, b.embedding AS f FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS v, (doc_id + 7) % (SELECT count(*) FROM embeddings) AS v7 FROM documents) d JOIN embeddings a ON a.vec_id = d.v JOIN embeddings b ON b.vec_id = d.v7))").replace("{base}", " + 1") + ")"



def _asset(ticker: str, via: str, labels: tuple) -> Column:
    pick = lambda i: F.get(F.array(*map(F.lit, S.SENTIMENT)), (i % 7).cast("int"))
    return F.struct(F.lit(ticker).alias("ticker"), F.lit(via).alias("via"), *[pick(c).alias(n) for c, n in zip(labels, ("direction", "short", "medium", "long"), strict=True)])


def _records(base):
    rows = base.sparkSession.sql(_BOTH.replace("__BASE__", "{base_rows}").replace("{base}", ""), base_rows=base)
    i = F.col("id")
    v = F.when(i % 5 == 0, F.array()).otherwise(F.array(_asset("ABC", "keyword", (i, i, i + 1, i + 2)), _asset("XYZ", "model", (i + 3, i, i, i))))
    m = F.when(i % 8 == 0, F.array()).otherwise(F.array(_asset("ABC", "keyword", (i + 1, i, i + 1, i + F.when(i % 4 == 0, 5).otherwise(2))), _asset("NVDA", "model", (i, i, i, i))))
    kind = "array<struct<ticker:string,via:string,direction:string,short:string,medium:string,long:string>>"
    return rows.withColumn("v_assets", v.cast(kind)).withColumn("m_assets", m.cast(kind))


# Agreement of the one common ticker, ABC, by the numbers that its labels come from.
_AG = lambda a, b: f"CASE WHEN abs(({a}) % 7 - ({b}) % 7) <= 1 THEN 1.0 ELSE greatest(0.0, 1 - (abs(({a}) % 7 - ({b}) % 7) - 1) / 5) END"
AGREE = f"agree AS (SELECT article_id, CASE WHEN id % 5 = 0 OR id % 8 = 0 THEN 0 ELSE 1 END AS n_common, CASE WHEN id % 5 = 0 OR id % 8 = 0 THEN 1.0 ELSE ({_AG('id', 'id + 1')} + {_AG('id', 'id')} + {_AG('id + 1', 'id + 1')} + {_AG('id + 2', 'id + CASE WHEN id % 4 = 0 THEN 5 ELSE 2 END')}) / 4 END::DOUBLE AS agreement FROM records)"
_J = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))) END"
_NORM = lambda c: rf"trim(regexp_replace(replace(replace(replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' a ', ' '), ' an ', ' '), ' the ', ' '), '\s+', ' ', 'g'))"


def _lev(n: str) -> str:
    a, b = _NORM(f"m_{n}"), _NORM(f"v_{n}")
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def _enum_score(n: str) -> str:
    if not C.ENUMS[n]:
        return f"(m_{n} = v_{n})::INT"
    ladder = "[" + ", ".join(f"'{x}'" for x in _labels(n)) + "]"
    return f"(1 - abs(list_position({ladder}, m_{n}) - list_position({ladder}, v_{n})) / {len(_labels(n)) - 1})"


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]))"
PARTS = f"""parts AS (SELECT article_id, batch_id, id, ({' + '.join(_enum_score(n) for n in C.ENUMS)}) / 17 AS enums, CASE WHEN id % 5 = 0 AND id % 8 = 0 THEN 1.0 WHEN id % 5 = 0 OR id % 8 = 0 THEN 0.0 ELSE 1 / 3 END AS assets, 0.4 * {_lev('headline')} + 0.3 * {_lev('one_liner')} + 0.3 * {_lev('paragraph')} AS summary,
 {_J('list_transform(m_entities, lambda x: lower(x))', 'list_transform(v_entities, lambda x: lower(x))')} AS entities, {_J('m_economic', 'v_economic')} AS economic, 0.5 * {_lev('event_title')} + 0.5 * {_J('m_fingerprint', 'v_fingerprint')} AS event, {_J('list_transform(m_narratives, lambda x: lower(x))', 'list_transform(v_narratives, lambda x: lower(x))')} AS narrative,
 greatest(0.0, {_DOT('m_narrative_embedding', 'v_narrative_embedding')}) AS embedding FROM records)"""
GATES = f"""gates AS (SELECT article_id, lower(m_language) = 'en' AS ml, m_language IS NOT NULL AND lower(m_language) <> 'en' AS x, CASE WHEN lower(trim(m_language)) = 'en' THEN 'en' ELSE 'non' END = CASE WHEN lower(trim(v_language)) = 'en' THEN 'en' ELSE 'non' END AND m_sector_id = v_sector_id AS tier1,
 m_content_hash = v_content_hash AND m_char_count = v_char_count AS tier2, NOT (id % 5 <> 0 AND id % 8 = 0) AS presence, {_J('m_links', 'v_links')} >= 0.9 AS contagion,
 CASE WHEN m_title_embedding IS NULL THEN 'missing' WHEN {_DOT('m_title_embedding', 'v_title_embedding')} < 0.9 THEN 'mismatch' ELSE 'ok' END AS emb FROM records)"""
SCORED = f"""{DUCK}, {AGREE}, {PARTS}, {GATES}, scored AS (SELECT article_id, batch_id, CASE WHEN NOT tier1 THEN 'tier1' WHEN NOT tier2 THEN 'tier2' WHEN NOT presence THEN 'asset_presence' WHEN n_common > 0 AND agreement < 0.8 THEN 'asset_agreement' WHEN NOT contagion THEN 'contagion' WHEN emb <> 'ok' THEN 'embedding' END AS failed_gate,
 {' + '.join(f'{w} * {n}' for n, w in C.WEIGHTS.items())} AS c FROM parts JOIN gates USING (article_id) JOIN agree USING (article_id)),
verdicts AS (SELECT article_id, batch_id, failed_gate, CASE WHEN failed_gate IS NULL THEN c ELSE 0.0 END::DOUBLE AS composite, failed_gate IS NULL AND c >= 0.7 AS is_valid FROM scored)"""


def _scored(base):
    return C.tier3_composite(_records(base), 64)


P.add("f04_tier1_gate", lambda b: _records(b).select("article_id", C.tier1_gate().alias("ok")), None, "records_base")
P.add("f05_tier2_gate", lambda b: _records(b).select("article_id", C.tier2_gate().alias("ok")), None, "records_base")
P.add("f06_asset_presence", lambda b: _records(b).select("article_id", C.asset_presence_gate().alias("ok")), None, "records_base")
P.add("f07_embedding_gate", lambda b: _records(b).select("article_id", C.embedding_gate(64).alias("status")), None, "records_base")
P.add("f08_contagion_gate", lambda b: _records(b).select("article_id", C.contagion_gate().alias("ok")), None, "records_base")
for name, column, alias in (("f04_tier1_gate", "tier1", "ok"), ("f05_tier2_gate", "tier2", "ok"), ("f06_asset_presence", "presence", "ok"), ("f07_embedding_gate", "emb", "status"), ("f08_contagion_gate", "contagion", "ok")):
    P.sql[name] = f"WITH {DUCK}, {GATES} SELECT article_id, {column} AS {alias} FROM gates"
P.add("j10_asset_agreement", lambda b: C.asset_agreement(_records(b)), None, "records_base")
P.sql["j10_asset_agreement"] = f"WITH {DUCK}, {AGREE} SELECT * FROM agree"
P.add("a07_tier3_parts", lambda b: C.normalised(_records(b)).select("article_id", *[c.alias(n) for n, c in C.tier3_parts().items()]), None, "records_base")
P.sql["a07_tier3_parts"] = f"WITH {DUCK}, {PARTS} SELECT article_id, {', '.join(f'{n}::DOUBLE AS {n}' for n in C.WEIGHTS)} FROM parts"
P.add("a07_tier3_composite", _scored, None, "records_base")
P.sql["a07_tier3_composite"] = f"WITH {SCORED} SELECT article_id, failed_gate, composite, is_valid FROM verdicts"
P.add("a11_batch_verdict", lambda b: C.batch_verdict(_scored(b).withColumn("batch_id", F.floor(F.col("article_id") / 12))), None, "records_base")
P.sql["a11_batch_verdict"] = f"WITH {SCORED} SELECT batch_id::BIGINT AS batch_id, count(*) AS n, count(*) FILTER (is_valid) AS matches, avg(composite) FILTER (is_valid) AS composite, count(*) FILTER (is_valid) / count(*) AS match_rate, bool_and(is_valid) AS valid FROM verdicts GROUP BY batch_id"
_REASON = "CASE WHEN article_id % 5 = 0 THEN 'timeout' WHEN article_id % 24 < 12 THEN 'reference_failed' WHEN article_id % 7 = 0 THEN 'invalid_analysis_data_x' WHEN article_id % 36 < 13 THEN 'clone' ELSE 'capacity' END"
P.add("a13_failure_class", lambda a: C.failure_class(a.selectExpr("batch_id", f"{_REASON} AS reason")), f"WITH r AS (SELECT batch_id, {_REASON} AS reason FROM articles) SELECT batch_id, CASE WHEN bool_or(reason NOT IN ('reference_failed', 'validator_error', 'timeout', 'missing_analysis', 'capacity') AND NOT starts_with(reason, 'invalid_analysis_data')) THEN 'integrity' WHEN bool_and(reason IN ('reference_failed', 'validator_error')) THEN 'validator_side' ELSE 'capacity' END AS class FROM r GROUP BY batch_id", "articles")


def _titles(a):
    sub = a.where("article_id % 2 = 0").select("article_id", "batch_id", F.when(F.col("article_id") % 26 == 0, "other").otherwise(F.concat(F.lit("  "), "title")).alias("title"))
    return C.pair_submissions(sub, a.where("article_id % 10 <> 4").select("article_id", "title")).withColumnRenamed("m_batch_id", "batch_id")


P.add("j09_pair_submissions", lambda a: _titles(a).select("article_id", "batch_id", "has_reference"), "SELECT article_id, batch_id, article_id % 10 <> 4 AS has_reference FROM articles WHERE article_id % 2 = 0", "articles")
P.add("f10_title_content_match", lambda a: C.title_content_match(_titles(a)), "SELECT batch_id, count(*) FILTER (article_id % 10 <> 4 AND article_id % 26 = 0) AS mismatches, bool_or(article_id % 10 <> 4 AND article_id % 26 = 0) AS rejected FROM articles WHERE article_id % 2 = 0 GROUP BY batch_id", "articles")
P.add("f11_summary_agreement", lambda b: C.summary_agreement(b.select(F.col("id").alias("article_id"), F.col("t").alias("m_summary"), F.when(F.col("id") % 9 == 0, "x").otherwise(F.col("t")).alias("v_summary"), F.col("e").alias("m_vector"), F.col("f").alias("v_vector"))), None, "records_base")
_COS = f"{_DOT('e', 'f')} / (sqrt({_DOT('e', 'e')}) * sqrt({_DOT('f', 'f')}))"
P.sql["f11_summary_agreement"] = f"WITH b AS (SELECT d.doc_id AS id, length(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')) AS n, a.embedding AS e, b.embedding AS f FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS v, (doc_id + 7) % (SELECT count(*) FROM embeddings) AS v7 FROM documents) d JOIN embeddings a ON a.vec_id = d.v JOIN embeddings b ON b.vec_id = d.v7), c AS (SELECT id AS article_id, CASE WHEN n >= 3 AND id % 9 <> 0 THEN {_COS} END AS cosine FROM b) SELECT article_id, cosine, cosine < 0.4 AS mismatch FROM c"
P.add("f12_exact_match", lambda p: C.exact_match(p.selectExpr("article_id", "concat('L', i) AS m_sentiment", "concat('l', j) AS v_sentiment", "concat('c', m) AS m_content", "concat('C', m % 8) AS v_content", "article_id % 13 = 0 AS m_missing", "article_id % 17 = 0 AS v_failed"), ["sentiment", "content"]), "SELECT article_id, i = j AS same_sentiment, m = m % 8 AS same_content, CASE WHEN article_id % 13 = 0 THEN 'missing_analysis' WHEN article_id % 17 = 0 THEN 'reference_failed' WHEN i = j AND m = m % 8 THEN 'ok' ELSE 'mismatch' END AS reason FROM pairs", "pairs")
P.add("f13_map_tolerance", lambda p: p.select("article_id", *[c.alias(n) for n, c in C.map_tolerance(F.create_map(F.lit("a"), F.col("i") / 10, F.lit("b"), F.col("j") / 10, F.lit("c"), F.lit(0.01)), F.create_map(F.lit("a"), F.col("j") / 10, F.lit("d"), F.col("m") / 100)).items()]),
      """WITH v AS (SELECT article_id, i / 10 AS sa, j / 10 AS sb, j / 10 AS ra, CASE WHEN m / 100 >= 0.05 THEN m / 100 ELSE 0 END AS rd FROM pairs), d AS (SELECT article_id, k, CASE k WHEN 'a' THEN abs(sa - ra) WHEN 'b' THEN sb ELSE rd END AS x FROM v, (VALUES ('a'), ('b'), ('d')) t(k)), w AS (SELECT article_id, k, x FROM d WHERE x > 0.05)
SELECT v.article_id, count(k) AS n_diffs, coalesce(string_agg(k, ',' ORDER BY x DESC, k), '') AS worst FROM v LEFT JOIN w USING (article_id) GROUP BY v.article_id""", "pairs")
P.add("j11_clone_pairs", lambda v: C.clone_pairs(v.select("batch_id", "pos", F.col("embedding").alias("vector")), above=0.3), f"SELECT a.batch_id, a.pos AS a, b.pos AS b, {_DOT('a.embedding', 'b.embedding')} AS sim FROM vectors a JOIN vectors b ON a.batch_id = b.batch_id AND a.pos < b.pos WHERE sim > 0.3", "vectors")
P.add("j11_clone_pairs_differential", lambda v: C.clone_pairs(v.select("batch_id", "pos", F.col("embedding").alias("vector"), F.slice("embedding", 1, 32).alias("r")), above=0.3, reference="r"), f"SELECT a.batch_id, a.pos AS a, b.pos AS b, {_DOT('a.embedding', 'b.embedding')} AS sim FROM vectors a JOIN vectors b ON a.batch_id = b.batch_id AND a.pos < b.pos WHERE sim > 0.3 AND sim - {_DOT('a.embedding[1:32]', 'b.embedding[1:32]')} >= 0.05", "vectors")
P.add("a10_rarity_weights", lambda d: C.rarity_weights(d.select("lang", "source"), ["lang", "source"]), "WITH c AS (SELECT 'lang' AS field, lang AS label, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source), t AS (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM c) SELECT field, label, -log2(greatest(0.01, n / total)) AS weight FROM t WHERE total >= 200", "documents")
_FAITH = "exp(0.45 * ln(greatest(i / 7, 0.000001)) + 0.40 * ln(greatest(j / 5, 0.000001)) + 0.15 * ln(CASE WHEN m < 8 THEN 0.7 WHEN i % 3 = j % 3 THEN 1.0 WHEN i % 3 = 1 OR j % 3 = 1 THEN 0.7 ELSE 0.5 END))"
_faith = lambda: C.faithfulness(F.col("i") / 7, F.col("j") / 5, F.col("m"), F.col("i") % 3 - 1, F.col("j") % 3 - 1)
P.add("a09_faithfulness", lambda p: p.select("article_id", _faith().alias("f")), f"SELECT article_id, {_FAITH} AS f FROM pairs", "pairs")
P.add("a08_quality_score", lambda p: p.select("article_id", C.quality_score(F.when(F.col("m") % 3 != 0, F.col("i") / 7), F.col("j") / 5, C.mean_present(F.when(F.col("m") % 2 == 0, F.col("m") / 11), F.when(F.col("m") % 5 == 0, F.lit(1.0))), F.lit(0.5), _faith()).alias("q")),
      f"WITH x AS (SELECT *, CASE WHEN m % 2 = 0 AND m % 5 = 0 THEN (m / 11 + 1) / 2 WHEN m % 2 = 0 THEN m / 11 WHEN m % 5 = 0 THEN 1.0 END AS ex FROM pairs) SELECT article_id, greatest(0.0, least(({_FAITH}), (CASE WHEN m % 3 <> 0 THEN 0.45 * i / 7 ELSE 0 END + 0.3 * j / 5 + coalesce(0.15 * ex, 0) + 0.05) / (CASE WHEN m % 3 <> 0 THEN 0.45 ELSE 0 END + 0.4 + CASE WHEN ex IS NULL THEN 0 ELSE 0.15 END))) AS q FROM x", "pairs")
