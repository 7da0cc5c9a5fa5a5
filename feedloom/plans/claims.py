"""Queries of entities, votes, blocks and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import scores as S
from feedloom.functions import text as T
from feedloom.operators import entities as E
from feedloom.operators import match as M
from feedloom.operators import triage as G
from feedloom.plans.inputs import VIEWS, Plans

P = Plans()
#: Spans anywhere in a text; two of the four of a document may overlap.
VIEWS["candidates"] = """
SELECT doc_id, k AS pos, lang, start, start + 3 + (doc_id + k) % 9 AS "end", substr(body, CAST(start + 1 AS INT), CAST(3 + (doc_id + k) % 9 AS INT)) AS text, concat('m', k % 2) AS model, 'ORG' AS label, (doc_id * 13 + k * 17) % 100 / 100 AS score
FROM (SELECT doc_id, lang, k, coalesce(text, '') AS body, (doc_id * 37 + CAST(floor(k / 2) AS BIGINT) * 101 + k % 2 * 4) % greatest(length(coalesce(text, '')), 1) AS start FROM {documents} CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(k)) AS x"""
VIEWS["stoplist"] = "SELECT * FROM (VALUES ('en', 'the'), ('en', 'and'), ('en', 'today'), ('fr', 'les'), ('de', 'der')) AS t(lang, word)"
#: The sentences of whole texts.
VIEWS["mentions_in"] = """
SELECT doc_id, k AS sent_pos, concat(sentence, CASE (doc_id + k) % 6 WHEN 0 THEN ' ABC fell today' WHEN 1 THEN ' the company plans next year' WHEN 2 THEN ' Globex and ABC guidance' WHEN 3 THEN ' shares of Acme' ELSE '' END) AS text, (doc_id * 7 + k * 5) % 3 - 1 AS vote
FROM {sentences_of_documents}"""
VIEWS["triage_items"] = """
SELECT doc_id AS article_id, CAST(floor(doc_id / 12) AS BIGINT) AS batch_id, doc_id % 12 AS pos, CASE doc_id % 5 WHEN 0 THEN 'relevant' WHEN 1 THEN 'irrelevant' WHEN 2 THEN 'borderline' WHEN 3 THEN 'borderline' ELSE 'irrelevant' END AS claim, doc_id % 17 <> 3 AS well_formed,
 CASE WHEN doc_id % 4 = 0 THEN 'valuable' WHEN doc_id % 4 = 1 THEN 'not_valuable' END AS flag, doc_id % 3 = 0 AS analysed, doc_id % 8 < 5 AS valuable, doc_id % 19 <> 0 AS proof_ok, CASE WHEN doc_id % 13 = 0 THEN 'pos' WHEN doc_id % 13 = 1 THEN 'neg' END AS canary, doc_id % 26 = 0 AS canary_sure,
 doc_id % 7 = 0 AS has_asset, CASE WHEN doc_id % 2 = 0 THEN true END AS verdict, doc_id % 6 = 0 AS stage_irrelevant, length(coalesce(text, '')) AS n FROM {documents}"""


def _cands(df):
    return df.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long")).withColumn("score", F.col("score").cast("double"))


P.add("f02_entity_blocklist", lambda c, s: E.entity_blocklist(_cands(c), s).select("doc_id", "pos", "text"), r"SELECT doc_id, pos, text FROM candidates c WHERE score >= 0.3 AND length(trim(text)) >= 2 AND regexp_matches(text, '\p{L}') AND NOT EXISTS (SELECT 1 FROM stoplist s WHERE s.word = lower(trim(c.text)) AND s.lang IN ('en', c.lang))", "candidates", "stoplist")
P.add("f03_salience_filter", lambda c, d: E.salience_filter(_cands(c).select("doc_id", "pos", "start", "end"), d.where("doc_id % 3 <> 0").select("doc_id", F.lit(0).alias("start"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).alias("end"))), 'SELECT c.doc_id, pos, start, "end" FROM candidates c JOIN documents d ON d.doc_id = c.doc_id WHERE c.doc_id % 3 = 0 OR (start >= 0 AND "end" <= floor(length(coalesce(d.text, \'\')) / 2))', "candidates", "documents")
P.add("w01_ground_entities", lambda c: E.ground_entities(_cands(c)).select("doc_id", "start", "end", "text", "models"), """WITH o AS (SELECT *, CASE WHEN start >= coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, text, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM candidates),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, text, model ROWS UNBOUNDED PRECEDING) AS island FROM o), g AS (SELECT doc_id, island, count(DISTINCT model) AS models, max(score) AS top FROM i GROUP BY ALL)
SELECT doc_id, start, "end", text, models FROM i JOIN g USING (doc_id, island) WHERE top >= CASE WHEN models >= 2 THEN 0.4 ELSE 0.6 END QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY score DESC, "end" - start DESC, text DESC, start DESC) = 1""", "candidates")
P.add("t38_trimmed_candidates", lambda c: c.select("doc_id", "pos", T.entity_text_trim(F.concat(F.lit("Firm"), (F.col("doc_id") % 9).cast("string"), F.lit("-backed "), F.translate("text", "\n", " "))).alias("t")), "SELECT doc_id, pos, 'Firm' || doc_id % 9 AS t FROM candidates", "candidates")


def _resolved(c):
    return _cands(c).select("doc_id", "pos", F.concat(F.lit("Name"), F.when(F.col("pos") % 2 == 0, "x").otherwise("X")).alias("name"), F.when(F.col("doc_id") % 2 == 0, "org").otherwise(F.col("model")).alias("type"), F.col("score").alias("confidence"), F.when((F.col("doc_id") + F.col("pos")) % 3 == 0, "subject").otherwise("mentioned").alias("role"), F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, "bullish").alias("sentiment"))


#: Linked and named candidates; the overrides are the words of the stoplist.
VIEWS["linked"] = """
SELECT doc_id, pos, CASE (doc_id + pos) % 5 WHEN 0 THEN ' The ' WHEN 1 THEN 'Today' ELSE text END AS text, CASE pos WHEN 0 THEN 'ORG' WHEN 1 THEN 'GPE' WHEN 2 THEN 'index' ELSE 'unheard' END AS label, score,
 CASE WHEN (doc_id + pos) % 3 > 0 THEN concat('Q', (doc_id + pos) % 10) END AS qid, CASE WHEN doc_id % 4 > 0 THEN concat('Title ', doc_id % 6) END AS qid_title FROM {candidates}"""
VIEWS["overrides"] = "SELECT word AS surface, concat('The word ', word) AS canonical, 'word' AS type, CASE WHEN word = 'today' THEN 'TDY' END AS ticker FROM {stoplist}"
VIEWS["qids"] = "SELECT concat('Q', r_regionkey) AS qid, CASE WHEN r_regionkey <> 2 THEN r_name END AS qid_name, CASE WHEN r_regionkey <> 3 THEN 'region' END AS qid_type, concat('R', r_regionkey) AS qid_ticker FROM {region}"
_KIND = "CASE label WHEN 'ORG' THEN 'organization' WHEN 'GPE' THEN 'location' WHEN 'index' THEN 'asset' ELSE 'organization' END"
P.add("j13_resolve_entities", lambda c, o, q: M.resolve_entities(c, o, q).drop("label", "score"), f"""WITH j AS (SELECT c.*, surface, canonical, type, ticker, q.qid AS known, qid_name, qid_type, qid_ticker FROM linked c LEFT JOIN overrides ON surface = lower(trim(text)) LEFT JOIN qids q ON q.qid = c.qid)
SELECT doc_id, pos, text, qid, qid_title, CASE WHEN surface IS NOT NULL THEN canonical WHEN known IS NOT NULL THEN coalesce(qid_name, qid_title, text) WHEN qid IS NOT NULL AND qid_title <> '' THEN qid_title ELSE text END AS name, CASE WHEN surface IS NOT NULL THEN type WHEN known IS NOT NULL THEN coalesce(qid_type, 'unknown') ELSE {_KIND} END AS entity_type,
 CASE WHEN surface IS NOT NULL THEN 1.0 WHEN known IS NOT NULL THEN 0.9 WHEN qid IS NOT NULL AND qid_title <> '' THEN 0.7 ELSE score END::DOUBLE AS confidence, CASE WHEN surface IS NOT NULL THEN ticker WHEN known IS NOT NULL THEN qid_ticker END AS resolved_ticker, CASE WHEN surface IS NOT NULL THEN 'override' WHEN known IS NOT NULL THEN 'linked' WHEN qid IS NOT NULL AND qid_title <> '' THEN 'title' ELSE 'label' END AS resolved_by FROM j""", "linked", "overrides", "qids")
P.add("a06_dedup_entities", lambda c: E.dedup_entities(_resolved(c)), """WITH r AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN 'Namex' ELSE 'NameX' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'org' ELSE model END AS type, score::DOUBLE AS confidence, CASE WHEN (doc_id + pos) % 3 = 0 THEN 'subject' ELSE 'mentioned' END AS role, CASE WHEN (doc_id + pos) % 5 = 0 THEN 'bullish' END AS sentiment FROM candidates),
w AS (SELECT doc_id, lower(name) AS key, type, min(pos) AS pos, arg_max(name, (confidence, -pos)) AS name, max(confidence) AS confidence, CASE WHEN bool_or(role = 'subject') THEN 'subject' ELSE 'mentioned' END AS role, max(sentiment) AS sentiment FROM r GROUP BY ALL)
SELECT doc_id, type, name, confidence, role, sentiment, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM w QUALIFY rank <= 15""", "candidates")
P.add(
    "w02_mention_counts",
    lambda a: E.mention_counts(a.select("article_id", F.concat("title", F.lit(" "), "body").alias("text"), F.array(*map(F.lit, ["Acme Corp", "acme", "XY", "corp gained", "bitcoin"])).alias("forms"))).drop("text", "forms"),
    r"""WITH f(form) AS (VALUES ('acme corp'), ('acme'), ('corp gained'), ('bitcoin')),
x AS (SELECT article_id, form, string_split(regexp_replace(lower(title || ' ' || body), '\b' || form || '\b', chr(1), 'g'), chr(1)) AS p FROM articles, f),
s AS (SELECT article_id, length(form) AS n, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda y: length(y))) + (k - 1) * length(form))) AS start FROM x),
i AS (SELECT article_id, start, start >= coalesce(max(start + n) OVER (PARTITION BY article_id ORDER BY start, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM s),
g AS (SELECT article_id, count(*) FILTER (new) AS n, min(start) AS first FROM i GROUP BY article_id)
SELECT article_id, greatest(coalesce(n, 0), 1) AS mention_count, first::BIGINT AS first_offset FROM articles LEFT JOIN g USING (article_id)""",
    "articles",
)
P.add(
    "t08_disclosure_tail",
    lambda a: E.disclosure_tail(a.select("article_id", "body"), [r"photo:", r"shares of", r"disclosure"], "body").select("article_id", F.length("body").alias("n")),
    r"""WITH x AS (SELECT article_id, substr(body, 1, 3000) AS b FROM articles), s AS (SELECT *, string_split(regexp_replace(b, '(?i)(photo:|shares of|disclosure)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM x),
y AS (SELECT *, list_filter(list_transform(range(1, len(p) // 2 + 1), lambda k: list_sum(list_transform(p[1:2 * k - 1], lambda z: length(z)))), lambda z: z >= 0.4 * length(b))[1] AS first FROM s)
SELECT article_id, length(CASE WHEN first IS NULL THEN b ELSE regexp_replace(left(b, first::BIGINT), '\s+$', '') END) AS n FROM y""",
    "articles",
)
P.add(
    "f17_transcript_roster",
    lambda a: E.transcript_roster(a.select("article_id", F.concat("body", F.lit(" Prepared remarks. John Doe of Acme Securities asked."), F.when(F.col("article_id") % 2 == 0, " Acme gained.").otherwise("")).alias("text"), F.array(F.lit("Acme ")).alias("forms"), (F.col("article_id") % 10 == 0).alias("is_primary"))).select("article_id"),
    rf"""WITH x AS (SELECT article_id, body || ' Prepared remarks. John Doe of Acme Securities asked.' || CASE WHEN article_id % 2 = 0 THEN ' Acme gained.' ELSE '' END AS t FROM articles),
s AS (SELECT *, string_split(regexp_replace(t, '(?i)acme ', chr(1), 'g'), chr(1)) AS p FROM x),
y AS (SELECT *, list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda z: length(z))) + k * 5) AS ends FROM s)
SELECT article_id FROM y WHERE article_id % 10 = 0 OR len(list_filter(ends, lambda e: NOT regexp_matches(substr(t, (e + 1)::BIGINT, 40), '(?i){E.DESK}'))) > 0""",
    "articles",
)
P.add("t09_norm_text", lambda a: a.select("article_id", F.sha2(T.norm_text(F.col("body")), 256).alias("h")), r"SELECT article_id, sha256(trim(regexp_replace(nfc_normalize(body), '\s+', ' ', 'g'))) AS h FROM articles", "articles")


def _assets(d):
    each = d.select("doc_id", F.explode(F.array(F.struct(F.lit("ABC").alias("ticker"), F.array(F.lit("ABC"), F.lit("Acme")).alias("forms"), (F.col("doc_id") % 2 == 0).alias("is_primary")), F.struct(F.lit("XYZ").alias("ticker"), F.array(F.lit("Globex"), F.lit("X")).alias("forms"), (F.col("doc_id") % 4 == 0).alias("is_primary")))).alias("a"))
    return each.select("doc_id", "a.*")


def _mentions(m, d):
    return E.mention_sentences(m, _assets(d))


_MEN = r"""assets_in AS (SELECT doc_id, ticker, CASE ticker WHEN 'ABC' THEN doc_id % 2 = 0 ELSE doc_id % 4 = 0 END AS is_primary FROM documents, (VALUES ('ABC'), ('XYZ')) t(ticker)), lone AS (SELECT *, is_primary AND sum(is_primary::INT) OVER (PARTITION BY doc_id) = 1 AS lone FROM assets_in),
men AS (SELECT a.doc_id, ticker, is_primary, sent_pos, text, vote FROM lone a JOIN mentions_in m USING (doc_id) WHERE regexp_matches(text, CASE ticker WHEN 'ABC' THEN '(?i)\b(?:ABC|Acme)\b' ELSE '(?i)\b(?:Globex)\b' END) AND TRUE OR (lone AND regexp_matches(text, '(?i)\b(?:the company|the firm|the group|the business|the maker|the stock|the shares|the share price|shares)\b')) QUALIFY row_number() OVER (PARTITION BY a.doc_id, ticker ORDER BY sent_pos) <= 6)"""
P.add("j07_mention_sentences", _mentions, f"WITH {_MEN} SELECT * FROM men", "mentions_in", "documents")
P.add("a05_article_direction", lambda m: E.article_direction(m), "SELECT doc_id, CASE WHEN sum(vote) > 0 THEN 'bullish' WHEN sum(vote) < 0 THEN 'bearish' ELSE 'neutral' END AS article_direction FROM mentions_in GROUP BY doc_id", "mentions_in")


def _lab(net: str, n: str, agree: str) -> str:
    return f"CASE WHEN {n} <= 0 OR {net} = 0 THEN 'neutral' ELSE (CASE WHEN abs({net}) / {n} >= 0.75 AND {agree} >= 2 THEN 'very_' WHEN abs({net}) / {n} >= 0.4 THEN '' ELSE 'slightly_' END) || (CASE WHEN {net} > 0 THEN 'bullish' ELSE 'bearish' END) END"


_VOTES = f"""dir AS (SELECT doc_id, CASE WHEN sum(vote) > 0 THEN 'bullish' WHEN sum(vote) < 0 THEN 'bearish' ELSE 'neutral' END AS ad FROM mentions_in GROUP BY doc_id), su AS (SELECT doc_id, ticker, count(*) AS n, count(*) FILTER (vote = 1) AS p, count(*) FILTER (vote = -1) AS m, list({{'v': vote, 't': text}} ORDER BY sent_pos) AS l FROM men GROUP BY ALL),
ag AS (SELECT a.doc_id, a.ticker, is_primary, n, p - m AS net, greatest(p, m) AS agree, ad, l FROM assets_in a LEFT JOIN su USING (doc_id, ticker) LEFT JOIN dir ON dir.doc_id = a.doc_id),
cf AS (SELECT *, {_lab('net', 'n', 'agree')} AS label, CASE WHEN net = 0 THEN 0.0 ELSE abs(net) / n END AS mag, agree / n * least(1.0, agree / 4) * (0.7 + 0.3 * CASE WHEN net = 0 THEN 0.0 ELSE abs(net) / n END) AS conf FROM ag),
votes AS (SELECT doc_id, ticker, CASE WHEN n IS NULL OR (is_primary AND conf < 0.15) THEN ad ELSE label END AS direction, CASE WHEN n IS NULL OR (is_primary AND conf < 0.15) THEN 0.4 ELSE mag END::DOUBLE AS magnitude, CASE WHEN n IS NULL THEN 0.3 WHEN is_primary AND conf < 0.15 THEN greatest(conf, 0.3) ELSE conf END::DOUBLE AS confidence, n IS NULL OR (is_primary AND conf < 0.15) AS from_article, CASE WHEN n IS NULL THEN [] WHEN len(list_filter(l, lambda x: x.v = sign(net))) = 0 THEN [l[1].t] ELSE list_transform(list_filter(l, lambda x: x.v = sign(net))[1:3], lambda x: x.t) END AS evidence FROM cf)"""
_votes = lambda m, d: E.aspect_votes(_mentions(m, d), _assets(d), E.article_direction(m))
P.add("a03_aspect_votes", _votes, f"WITH {_MEN}, {_VOTES} SELECT * FROM votes", "mentions_in", "documents")


def _cue(cues) -> str:
    return " + ".join(rf"regexp_matches(text, '(?i)\b{c}\b')::INT" for c in cues)


_SC = "[" + ", ".join(f"'{x}'" for x in S.SENTIMENT) + "]"
_HOR = f"""bk AS (SELECT *, {_cue(S.SHORT_CUES)} AS a, {_cue(S.LONG_CUES)} AS l, {_cue(S.MEDIUM_CUES)} AS d FROM men), bu AS (SELECT doc_id, ticker, vote, CASE WHEN greatest(a, l, d) = 0 THEN 'medium' WHEN l = greatest(a, l, d) THEN 'long' WHEN a = greatest(a, l, d) THEN 'short' ELSE 'medium' END AS b FROM bk),
hs AS (SELECT doc_id, ticker, b, count(*) AS n, count(*) FILTER (vote = 1) AS p, count(*) FILTER (vote = -1) AS m FROM bu GROUP BY ALL), hv AS (SELECT doc_id, ticker, b, {_lab('(p - m)', 'n', 'greatest(p, m)')} AS v FROM hs),
hp AS (SELECT v.doc_id, v.ticker, direction, from_article, max(h.v) FILTER (b = 'short') AS s, max(h.v) FILTER (b = 'medium') AS m, max(h.v) FILTER (b = 'long') AS l FROM votes v LEFT JOIN hv h ON h.doc_id = v.doc_id AND h.ticker = v.ticker GROUP BY ALL),
hd AS (SELECT *, list_position({_SC}, coalesce(m, direction)) - 1 AS spot FROM hp), he AS (SELECT *, ({_SC})[(spot + sign(3 - spot) + 1)::INT] AS decayed FROM hd)"""
P.add("a04_horizon_outlooks", lambda m, d: E.horizon_outlooks(_mentions(m, d), _votes(m, d)), f"WITH {_MEN}, {_VOTES}, {_HOR} SELECT doc_id, ticker, CASE WHEN from_article OR (s IS NULL AND l IS NULL) THEN direction ELSE coalesce(s, decayed) END AS short, CASE WHEN from_article OR (s IS NULL AND l IS NULL) THEN direction ELSE coalesce(m, decayed) END AS medium, CASE WHEN from_article OR (s IS NULL AND l IS NULL) THEN direction ELSE coalesce(l, decayed) END AS long FROM he", "mentions_in", "documents")
STOP = ["the", "of", "and", "to", "in", "that", "is", "de", "la", "el", "der", "die", "und", "le", "les", "que"]
P.add("w03_block_labels", lambda d: E.block_labels(d, STOP).drop("block"), rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS block, unnest(range(len(l))) AS pos FROM b),
w AS (SELECT *, regexp_extract_all(block, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w FROM u), f AS (SELECT doc_id, pos, len(w) AS n, len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP)}))) / len(w) AS stop, least(1.0, 10 * len(regexp_extract_all(block, '[|/\\•·›»>#*=~^]')) / greatest(length(block), 1)) AS sym FROM w),
l AS (SELECT doc_id, pos, CASE WHEN n = 0 THEN 'bad' WHEN n <= 2 THEN CASE WHEN stop > 0 THEN 'near' ELSE 'bad' END WHEN sym > 0.2 THEN 'bad' WHEN stop < 0.15 THEN 'bad' WHEN n >= 8 AND stop >= 0.2 THEN 'good' ELSE 'near' END AS label FROM f),
s AS (SELECT *, last_value(nullif(label, 'near') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(nullif(label, 'near') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM l)
SELECT doc_id, pos, label, label = 'good' OR (label = 'near' AND (coalesce(b = 'good', false) OR coalesce(a = 'good', false) OR (a IS NULL AND b IS NULL))) AS kept FROM s""", "documents")
P.add("w04_block_relevance", lambda v: E.block_relevance(v.select(F.col("batch_id").alias("doc_id"), "pos", F.col("embedding").alias("vector"), F.when(F.col("batch_id") % 2 == 0, F.reverse("embedding")).alias("title_vector"))), """WITH f AS (SELECT batch_id AS doc_id, pos, unnest(embedding)::DOUBLE AS x, unnest(CASE WHEN batch_id % 2 = 0 THEN list_reverse(embedding) ELSE list_transform(embedding, lambda y: NULL::FLOAT) END)::DOUBLE AS t, unnest(range(len(embedding))) AS i FROM vectors),
o AS (SELECT *, (sum(x) OVER w - x) / (count(*) OVER w - 1) AS others FROM f WINDOW w AS (PARTITION BY doc_id, i)), a AS (SELECT doc_id, pos, x, CASE WHEN t IS NULL THEN others ELSE (others + t) / 2 END AS a FROM o), c AS (SELECT doc_id, pos, sum(x * a) / sqrt(sum(x * x) * sum(a * a)) AS cosine FROM a GROUP BY ALL) SELECT *, cosine >= 0.05 AS relevant FROM c""", "vectors")
# -- triage
_LABELLED = "lab AS (SELECT *, CASE WHEN NOT well_formed THEN 'irrelevant' WHEN claim = 'borderline' AND sum((claim = 'borderline' AND well_formed)::INT) OVER (PARTITION BY batch_id ORDER BY pos ROWS UNBOUNDED PRECEDING) > 3 THEN 'irrelevant' ELSE claim END AS label FROM triage_items)"
P.add("w05_triage_labels", lambda i: G.triage_labels(i).select("article_id", "label"), f"WITH {_LABELLED} SELECT article_id, label FROM lab", "triage_items")
_EV = f"""{_LABELLED}, fl AS (SELECT *, label = 'borderline' AND analysed AND flag IS NOT NULL AS fb, canary IS NULL AND proof_ok AS plain FROM lab), op AS (SELECT *, label <> 'relevant' AND NOT (fb AND flag = 'valuable' AND valuable) AND plain AS open_claim FROM fl),
ev AS (SELECT batch_id, article_id, 'hard' AS severity, 'proof_failure' AS code FROM op WHERE NOT proof_ok UNION ALL SELECT batch_id, article_id, 'soft', 'triage_malformed' FROM op WHERE NOT well_formed UNION ALL SELECT batch_id, article_id, 'soft', 'borderline_flag_mismatch' FROM op WHERE fb AND (flag = 'valuable') <> valuable
 UNION ALL SELECT batch_id, article_id, 'soft', 'borderline_unwarranted' FROM op WHERE fb AND flag = 'not_valuable' AND NOT valuable AND stage_irrelevant UNION ALL SELECT batch_id, article_id, 'soft', 'analysis_on_nonrelevant' FROM op WHERE label <> 'relevant' AND canary IS NULL AND NOT (label = 'borderline' AND flag IS NOT NULL) AND analysed
 UNION ALL SELECT batch_id, article_id, CASE WHEN canary_sure THEN 'hard' ELSE 'soft' END, 'canary_pos_missed' FROM op WHERE proof_ok AND canary = 'pos' AND label <> 'relevant' UNION ALL SELECT batch_id, article_id, 'soft', 'canary_neg_flagged' FROM op WHERE proof_ok AND canary = 'neg' AND label = 'relevant'
 UNION ALL SELECT batch_id, article_id, 'hard', 'false_negative_deterministic' FROM op WHERE open_claim AND has_asset)"""
_events = lambda i: G.triage_events(G.triage_labels(i)).where("code <> 'false_negative_llm'")
P.add("w06_triage_events", _events, f"WITH {_EV} SELECT * FROM ev", "triage_items")
P.add(
    "w06_triage_events_sampled",
    lambda i: G.triage_events(G.triage_labels(i)),
    f"""WITH {_EV}, dr AS (SELECT * FROM op WHERE open_claim AND NOT has_asset AND label = 'irrelevant' QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY md5(article_id::VARCHAR), article_id) = 1)
SELECT * FROM ev UNION ALL SELECT batch_id, article_id, 'soft', 'false_negative_llm' FROM dr WHERE verdict""",
    "triage_items",
)
P.add("w07_triage_routing", lambda i: G.triage_routing(G.triage_labels(i), _events(i)), f"""WITH {_EV}, ro AS (SELECT batch_id, article_id, CASE WHEN label = 'relevant' THEN 'relevant' WHEN fb AND flag = 'valuable' THEN 'valuable' WHEN fb THEN 'discard' WHEN label = 'borderline' THEN 'borderline' WHEN plain OR canary = 'neg' THEN 'retire' END AS route FROM op)
SELECT * FROM ro WHERE route IS NOT NULL AND (route IN ('relevant', 'borderline') OR NOT EXISTS (SELECT 1 FROM ev WHERE ev.article_id = ro.article_id AND code <> 'proof_failure'))""", "triage_items")
P.add("w08_observations", lambda i: G.observations(_events(i), i.where("article_id % 4 = 0").select("batch_id", "article_id", (F.col("article_id") % 10 / 10).alias("score"), (F.col("n") > 1000).alias("substantive")), i.groupBy("batch_id").agg(F.min("article_id").alias("first_article"), (F.count("*") >= 12).alias("full_push"))), f"""WITH {_EV}, al AS (SELECT batch_id, article_id, 0.0 AS score, CASE severity WHEN 'hard' THEN 2.0 ELSE 0.4 END AS weight FROM ev UNION ALL SELECT batch_id, article_id, article_id % 10 / 10, CASE WHEN n > 1000 THEN 2.0 ELSE 1.0 END FROM triage_items WHERE article_id % 4 = 0
 UNION ALL SELECT batch_id, min(article_id), 1.0, 1.0 FROM triage_items WHERE batch_id NOT IN (SELECT batch_id FROM ev) GROUP BY batch_id HAVING count(*) >= 12) SELECT batch_id, article_id, min(score)::DOUBLE AS score, max(weight)::DOUBLE AS weight FROM al GROUP BY ALL""", "triage_items")
P.add("a20_pay_split", lambda i: G.pay_split(i.selectExpr("batch_id", "article_id", "article_id % 3 = 0 AS kept", "article_id % 11 = 0 AS false_positive", "article_id % 9 = 3 AS rewarded", "n AS length", "batch_id % 2 = 0 AS full_push"), 3), """WITH d AS (SELECT batch_id, article_id, 0.2 / 3 + CASE WHEN article_id % 3 = 0 AND article_id % 11 <> 0 AND article_id % 9 <> 3 THEN 6 * CASE WHEN n >= 2000 THEN 3 WHEN n >= 500 THEN 2 ELSE 1 END / 3 ELSE 0.0 END AS due FROM triage_items), t AS (SELECT batch_id, greatest(round_even(sum(due)::DOUBLE, 0), CASE WHEN batch_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS payout, sum(due) AS total FROM d GROUP BY batch_id)
SELECT batch_id, article_id, round(due * payout / total, 4)::DOUBLE AS pay, payout::BIGINT AS payout FROM d JOIN t USING (batch_id)""", "triage_items")
P.add("t36_triage_record_check", lambda i: i.select("article_id", G.record_error(F.when(F.col("article_id") % 6 != 0, F.struct(F.when(F.col("article_id") % 5 == 0, "odd").otherwise(F.col("claim")).alias("label"), F.when(F.col("article_id") % 4 != 0, "promo_spam").alias("reason_code"), F.when(F.col("article_id") % 7 == 0, "maybe").alias("flag")))).alias("error")), "SELECT article_id, CASE WHEN article_id % 6 = 0 THEN NULL WHEN article_id % 5 = 0 THEN 'bad_label' WHEN claim = 'irrelevant' AND article_id % 4 = 0 THEN 'missing_reason' WHEN article_id % 7 = 0 THEN 'bad_flag' END AS error FROM triage_items", "triage_items")
P.add("t37_indicates_value", lambda i: i.select("article_id", G.indicates_value(F.col("article_id") % 3, F.col("article_id") % 2, F.when(F.col("article_id") % 12 == 0, "CRYPTO").when(F.col("article_id") % 18 == 0, "SPORT")).alias("v")), "SELECT article_id, article_id % 3 > 0 OR article_id % 2 > 0 OR article_id % 12 = 0 AS v FROM triage_items", "triage_items")
P.add("t35_proof_of_read", lambda a: a.select("article_id", T.content_hash(F.col("title"), F.col("body")).alias("content_hash"), F.size(T.words(F.col("body"))).cast("long").alias("word_count"), (F.when(F.col("article_id") % 3 == 0, "x").otherwise(F.size(T.words(F.col("body"))).cast("string")).try_cast("long") == F.size(T.words(F.col("body")))).alias("verified")), r"SELECT article_id, sha256(trim(regexp_replace(lower(concat(title, ' ', substr(body, 1, 500))), '\s+', ' ', 'g'))) AS content_hash, len(regexp_extract_all(body, '\S+')) AS word_count, CASE WHEN article_id % 3 <> 0 THEN true END AS verified FROM articles", "articles")
