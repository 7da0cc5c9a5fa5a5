"""Queries of gazetteer matching and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import match as M
from feedloom.plans.inputs import Plans
from feedloom.shared import small

P = Plans()
FIN, MACRO, ECON, ABBR = M.FINANCE, M.MACRO, M.ECONOMIES, M.ABBREVIATIONS

# -- SQL of the steps, to be put together by the queries below
FLAGS = f"""flags AS (SELECT g.*, CASE kind WHEN 'cashtag' THEN false WHEN 'case_sensitive' THEN length(keyword) <= 3 OR c.word IS NOT NULL OR keyword IN ({", ".join(f"'{x}'" for x in M.ACRONYMS)})
  ELSE regexp_matches(keyword, '^\\p{{L}}+$') AND (length(keyword) <= 4 OR coalesce(zipf, 0.0) >= 2.4) END AS ambiguous,
  (regexp_matches(keyword, '^\\p{{L}}+$') AND (c.word IS NOT NULL OR length(keyword) <= 1)) OR keyword IN ({", ".join(f"'{x}'" for x in M.ACRONYMS)}) AS weak
  FROM gazetteer g LEFT JOIN word_freq f ON f.word = lower(keyword) LEFT JOIN common_words c ON c.word = lower(keyword))"""
HITS = rf"""h0 AS (SELECT article_id, asset_id, kind, keyword, CASE kind WHEN 'case_sensitive' THEN title || chr(10) || body ELSE lower(title || chr(10) || body) END AS t, CASE kind WHEN 'case_sensitive' THEN title ELSE lower(title) END AS head,
   CASE kind WHEN 'case_sensitive' THEN '\b' || keyword || '\b()' WHEN 'cashtag' THEN replace(lower(keyword), '$', '\$') || '([^a-z0-9]|$)' ELSE '\b' || lower(keyword) || '\b()' END AS p FROM articles, gazetteer WHERE kind IN ('cashtag', 'case_sensitive') OR length(keyword) >= CASE kind WHEN 'alias' THEN 4 ELSE 3 END),
 h1 AS (SELECT *, string_split(regexp_replace(t, p, chr(1) || '\1', 'g'), chr(1)) AS parts FROM h0 WHERE contains(t, lower(keyword)) OR contains(t, keyword)),
 h2 AS (SELECT article_id, asset_id, kind, keyword, t, regexp_matches(head, p) AS in_title, list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(keyword)) AS starts, length(keyword) AS n FROM h1 WHERE len(parts) > 1),
 hits AS (SELECT article_id, asset_id, kind, keyword, len(starts) AS hits, in_title, len(list_filter(list_transform(starts, lambda s: substr(t, (greatest(s - 100, 0) + 1)::BIGINT, (least(s, 100) + n + 100)::BIGINT)), lambda w: regexp_matches(w, '{FIN}') OR contains(w, '$') OR contains(w, '%'))) > 0 AS context FROM h2)"""
MATCHES = """m0 AS (SELECT h.*, f.ambiguous, f.weak, f.pos, CASE h.kind WHEN 'cashtag' THEN 1 WHEN 'case_sensitive' THEN 2 WHEN 'identifier' THEN 3 ELSE 4 END AS phase,
   CASE h.kind WHEN 'cashtag' THEN 3.0 + 3.0 * in_title::INT WHEN 'case_sensitive' THEN 2.0 + 2.0 * in_title::INT WHEN 'identifier' THEN 1.0 + 0.3 * (hits - 1) + 2.0 * in_title::INT ELSE 0.5 END::DOUBLE AS r FROM hits h JOIN flags f ON f.asset_id = h.asset_id AND f.kind = h.kind AND f.keyword = h.keyword),
 matches AS (SELECT article_id, asset_id, sum(r) AS relevance, arg_min(kind, phase) AS method, CASE min(phase) WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, bool_or(in_title) AS in_title, bool_or(kind = 'cashtag' OR NOT ambiguous) AS strong, list(keyword ORDER BY phase, pos) AS evidence
  FROM m0 GROUP BY article_id, asset_id HAVING bool_or(kind = 'cashtag' OR NOT ambiguous) OR (bool_or(context) AND bool_or(NOT weak)))"""
PRIMARY = r"""nm AS (SELECT asset_id, lower(name) AS name, split_part(lower(name), ' ', 1) AS lead FROM assets), tm AS (SELECT m.* REPLACE (in_title OR regexp_matches(lower(title), '\b' || name || '\b') OR (length(lead) >= 4 AND lead NOT IN (SELECT word FROM common_words) AND regexp_matches(lower(title), '\b' || lead || '\b')) AS in_title) FROM matches m JOIN nm USING (asset_id) JOIN articles USING (article_id)),
 p0 AS (SELECT m.*, a.asset_class, a.symbol, a.asset_class IN ('index', 'forex') AS macro FROM tm m JOIN assets a USING (asset_id)), p1 AS (SELECT *, NOT macro OR NOT bool_or(NOT macro) OVER (PARTITION BY article_id) AS eligible FROM p0),
 p2 AS (SELECT *, row_number() OVER w AS i, lead(relevance) OVER w AS second, bool_or(eligible AND in_title) OVER (PARTITION BY article_id) AS titled, sum(eligible::INT) OVER (PARTITION BY article_id) AS n FROM p1 WINDOW w AS (PARTITION BY article_id, eligible ORDER BY relevance DESC, symbol)),
 subjects AS (SELECT article_id, asset_id, symbol, relevance, eligible AND CASE WHEN titled THEN in_title ELSE i = 1 AND n <= 3 AND relevance >= 3.0 AND relevance >= 1.5 * coalesce(second, 0.0) END AS is_primary FROM p2)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY relevance DESC, symbol) AS rank FROM subjects)"
DIMS = ("articles", "gazetteer", "word_freq", "common_words", "assets")


def asset_matches(articles: DataFrame, gazetteer: DataFrame, word_freq: DataFrame, common_words: DataFrame) -> DataFrame:
    return M.asset_matches(M.gazetteer_hits(articles, gazetteer), M.keyword_flags(gazetteer, word_freq, common_words))


def _subjects(articles, gazetteer, word_freq, common_words, assets) -> DataFrame:
    found = M.title_subjects(asset_matches(articles, gazetteer, word_freq, common_words), articles, assets, common_words)
    return M.primary_subjects(found, assets)


def _ranked(*dims) -> DataFrame:
    return M.top_assets(_subjects(*dims))


def _doc_assets(*dims) -> DataFrame:
    return _ranked(*dims).select("article_id", "symbol", F.col("rank").alias("asset_pos"))


P.add("j02_keyword_flags", lambda g, w, c: M.keyword_flags(g, w, c), f"WITH {FLAGS.replace('FROM gazetteer g', 'FROM gazetteer_whole g')} SELECT * FROM flags", "gazetteer_whole", "word_freq", "common_words")
P.add("j01_gazetteer_hits", lambda a, g: M.gazetteer_hits(a, g), f"WITH {HITS} SELECT * FROM hits", "articles", "gazetteer")
P.add("a01_asset_matches", lambda a, g, w, c: asset_matches(a, g, w, c), f"WITH {FLAGS}, {HITS}, {MATCHES} SELECT * FROM matches", *DIMS[:4])
P.add("a02_primary_subjects", lambda *d: _subjects(*d[:5]).select("article_id", "asset_id", "symbol", "relevance", "is_primary"), f"WITH {FLAGS}, {HITS}, {MATCHES}, {PRIMARY} SELECT * FROM subjects", *DIMS)
P.add("k02_top_assets", lambda *d: _ranked(*d).where("rank <= 3").select("article_id", "symbol", "rank"), f"WITH {FLAGS}, {HITS}, {MATCHES}, {PRIMARY}, {RANKED} SELECT article_id, symbol, rank FROM ranked WHERE rank <= 3", *DIMS)
P.add("f01_triage_stage", lambda a, g, w, c: M.triage_stage(a, asset_matches(a, g, w, c)), f"""WITH {FLAGS}, {HITS}, {MATCHES}, x AS (SELECT article_id, article_id IN (SELECT article_id FROM matches) AS has, title || chr(10) || substr(body, 1, 4000) AS t FROM articles), y AS (SELECT *, regexp_matches(t, '{MACRO}') AS macro, regexp_matches(t, '{ECON}') OR regexp_matches(t, '{ABBR}') AS economy FROM x)
SELECT article_id, CASE WHEN has OR (macro AND economy) THEN 'relevant' WHEN macro THEN 'borderline' ELSE 'irrelevant' END AS label, CASE WHEN NOT has AND NOT macro THEN 'non_economic' END AS reason_code, CASE WHEN has THEN 0.95 WHEN macro AND economy THEN 0.7 WHEN macro THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM y""", *DIMS[:4])
P.add("j03_sector_hits", lambda a, s: M.sector_hits(a, s), r"""WITH x AS (SELECT article_id, lower(title || chr(10) || body) AS t FROM articles), e AS (SELECT article_id, sector_id, symbol, count(*) AS n FROM x JOIN sectors ON CASE kind WHEN 'cashtag' THEN contains(t, lower(keyword)) ELSE length(keyword) >= 3 AND regexp_matches(t, '\b' || lower(keyword) || '\b') END WHERE sector_id <> 9 GROUP BY ALL)
SELECT article_id, sector_id, symbol, CASE WHEN n > 2 THEN 'high' WHEN n > 1 THEN 'medium' ELSE 'low' END AS confidence, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, sector_id)::INT AS rank FROM e UNION ALL SELECT article_id, 9, 'OTHER', 'low', 1 FROM articles WHERE article_id NOT IN (SELECT article_id FROM e)""", "articles", "sectors")
_REG = "SELECT CASE asset_id WHEN 8 THEN 9 ELSE asset_id END AS class_id, kind, keyword FROM gazetteer"
P.add("j04_top_keyword_class", lambda p, g: M.top_keyword_class(p.select("post_id", F.concat("text", F.when(F.col("post_id") % 3 == 0, " nvidia and $BTC bitcoin").when(F.col("post_id") % 3 == 1, " acme corp ABC").otherwise("")).alias("text")), g.selectExpr("CASE asset_id WHEN 8 THEN 9 ELSE asset_id END AS class_id", "kind", "keyword")),
      rf"""WITH r AS ({_REG}), x AS (SELECT post_id, text || CASE post_id % 3 WHEN 0 THEN ' nvidia and $BTC bitcoin' WHEN 1 THEN ' acme corp ABC' ELSE '' END AS t FROM posts),
e AS (SELECT post_id, class_id, bool_or(kind = 'cashtag') AS tag, count(*) AS n FROM x JOIN r ON CASE kind WHEN 'cashtag' THEN contains(lower(t), lower(keyword)) WHEN 'case_sensitive' THEN regexp_matches(t, '\b' || keyword || '\b') ELSE regexp_matches(lower(t), '\b' || lower(keyword) || '\b') END GROUP BY ALL),
b AS (SELECT *, CASE WHEN tag THEN 1.0 WHEN n > 1 THEN 0.9 ELSE 0.8 END AS score FROM e QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY score DESC, class_id) = 1)
SELECT x.post_id, coalesce(class_id, 0) AS class_id, CASE WHEN score >= 0.9 THEN 'high' ELSE 'low' END AS confidence FROM x LEFT JOIN b USING (post_id)""", "posts", "gazetteer")
_LINKS = f"""{FLAGS}, {HITS}, {MATCHES}, {PRIMARY}, {RANKED}, da AS (SELECT article_id, symbol, rank AS asset_pos FROM ranked WHERE rank <= 20)"""
_MECH = "CASE relationship " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.MECHANISMS.items()) + " ELSE 'correlation' END"
P.add("j05_contagion_links", lambda *d: M.contagion_links(_doc_assets(*d[:5]), d[5]), f"""WITH {_LINKS}, l AS (SELECT article_id, source_ticker, target_ticker, relationship, asset_pos, edge_pos FROM da JOIN edges ON symbol = source_ticker QUALIFY row_number() OVER (PARTITION BY article_id, source_ticker, target_ticker ORDER BY asset_pos, edge_pos) = 1)
SELECT article_id, source_ticker, target_ticker, {_MECH} AS mechanism, 0.7::DOUBLE AS strength, row_number() OVER (PARTITION BY article_id ORDER BY asset_pos, edge_pos, target_ticker) AS rank FROM l QUALIFY rank <= 8""", *DIMS, "edges")
P.add("j06_inferred_impacts", lambda *d: M.inferred_impacts(_doc_assets(*d[:5]), d[5]), f"""WITH {_LINKS}, l AS (SELECT article_id, upper(target_ticker) AS target, relationship, asset_pos, edge_pos FROM da JOIN edges ON symbol = source_ticker WHERE NOT EXISTS (SELECT 1 FROM da o WHERE o.article_id = da.article_id AND upper(o.symbol) = upper(target_ticker)) QUALIFY row_number() OVER (PARTITION BY article_id, target ORDER BY asset_pos, edge_pos) = 1)
SELECT article_id, target, relationship, 0.7::DOUBLE AS confidence, row_number() OVER (PARTITION BY article_id ORDER BY asset_pos, edge_pos, target) AS rank FROM l QUALIFY rank <= 20""", *DIMS, "edges")


def _messages(c: DataFrame) -> DataFrame:
    return c.select(F.col("conv_id").alias("group_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("turn").alias("created"), F.when(F.col("turn") % 3 == 2, F.col("conv_id") * 100 + F.col("turn") - 2).alias("reply_to"))


P.add("j08_message_context", lambda c: M.message_context(_messages(c)), """WITH m AS (SELECT conv_id AS group_id, conv_id * 100 + turn AS message_id, turn AS created, CASE WHEN turn % 3 = 2 THEN conv_id * 100 + turn - 2 END AS reply_to FROM conversations),
b AS (SELECT *, list_filter([lag(message_id, 2) OVER w, lag(message_id, 1) OVER w], lambda x: x IS NOT NULL) AS before FROM m WINDOW w AS (PARTITION BY group_id ORDER BY created, message_id))
SELECT group_id, message_id, CASE WHEN reply_to IS NULL THEN before WHEN reply_to IN (SELECT message_id FROM m) THEN [reply_to] ELSE [] END AS context FROM b""", "conversations")
def _chains(c: DataFrame) -> DataFrame:
    """Messages that reply to the one before, but for each fifth; each third one of these is classified."""
    number, turn = F.col("conv_id") * 1000 + F.col("turn"), F.col("turn")
    return c.select(number.alias("message_id"), F.when(turn % 5 != 0, number - 1).alias("reply_to"), F.when((F.col("conv_id") + turn) % 3 == 0, turn % 7).alias("asset_id"))


P.add(
    "j08_inherited_assets",
    lambda c: M.inherited_assets(_chains(c)),
    """WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 <> 0 THEN conv_id * 1000 + turn - 1 END AS up, CASE WHEN (conv_id + turn) % 3 = 0 THEN turn % 7 END AS asset FROM conversations),
r AS (SELECT m.id, p.id AS at, p.asset, p.up FROM m JOIN m p ON p.id = m.up UNION ALL SELECT r.id, p.id, p.asset, p.up FROM r JOIN m p ON p.id = r.up WHERE r.asset IS NULL)
SELECT m.id AS message_id, r.asset AS inherited_asset, r.at AS inherited_from FROM m LEFT JOIN r ON r.id = m.id AND r.asset IS NOT NULL""",
    "conversations",
)
P.add("u02_merge_tickers", lambda *d: _doc_assets(*d).groupBy("article_id").agg(F.array_sort(F.collect_list("symbol")).alias("own")).select("article_id", M.merge_tickers(F.col("own"), F.array(F.lit("abc"), F.lit("new"), F.lit("NEW"))).alias("tickers")),
      f"WITH {_LINKS}, o AS (SELECT article_id, list(symbol ORDER BY symbol) AS own FROM da GROUP BY article_id) SELECT article_id, list_concat(own, list_filter(['ABC', 'NEW'], lambda t: NOT list_contains(own, t))) AS tickers FROM o", *DIMS)
P.add("t39_gics_of_primary", lambda *d: _primary_sector(*d), f"""WITH {FLAGS}, {HITS}, {MATCHES}, {PRIMARY} SELECT article_id, s.symbol, CASE lower(trim(sector)) WHEN 'technology' THEN 7 WHEN 'energy' THEN 5 WHEN 'materials' THEN 5 WHEN 'finance' THEN 4 ELSE 9 END AS sector_id FROM subjects s JOIN assets a USING (asset_id) WHERE is_primary""", *DIMS)


def _primary_sector(*d) -> DataFrame:
    from feedloom.functions.scores import gics_to_sector

    rows = _subjects(*d[:5]).where("is_primary").select("article_id", "asset_id", "symbol")
    return rows.join(small(d[4].select("asset_id", "sector")), "asset_id").select("article_id", "symbol", gics_to_sector(F.col("sector"))[0].alias("sector_id"))


def _flagship(*d) -> DataFrame:
    """Mentions and primary mentions of each ticker by day, with links to dependents."""
    cleaned = d[0]
    ranked = _ranked(cleaned, *d[1:5])
    links = M.contagion_links(ranked.select("article_id", "symbol", F.col("rank").alias("asset_pos")), d[5]).groupBy("article_id", F.col("source_ticker").alias("symbol")).agg(F.count("*").alias("links"))
    days = cleaned.select("article_id", F.floor(F.col("published_s") / 86400).alias("day"))
    rows = ranked.join(days, "article_id").join(links, ["article_id", "symbol"], "left")
    return rows.groupBy("day", "symbol").agg(F.count("*").alias("mentions"), F.sum(F.col("is_primary").cast("int")).alias("primaries"), F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.round(F.avg("relevance"), 6).alias("relevance"))


P.add("flagship_ticker_days", _flagship, f"""WITH {_LINKS}, l0 AS (SELECT article_id, source_ticker, target_ticker, asset_pos, edge_pos FROM da JOIN edges ON symbol = source_ticker QUALIFY row_number() OVER (PARTITION BY article_id, source_ticker, target_ticker ORDER BY asset_pos, edge_pos) = 1),
l1 AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY asset_pos, edge_pos, target_ticker) <= 8), l AS (SELECT article_id, source_ticker AS symbol, count(*) AS links FROM l1 GROUP BY ALL)
SELECT floor(published_s / 86400)::BIGINT AS day, r.symbol, count(*) AS mentions, sum(is_primary::INT)::BIGINT AS primaries, sum(coalesce(links, 0))::BIGINT AS links, round(avg(relevance), 6) AS relevance FROM ranked r JOIN articles a USING (article_id) LEFT JOIN l ON l.article_id = r.article_id AND l.symbol = r.symbol WHERE rank <= 20 GROUP BY ALL""", *DIMS, "edges")
