"""Queries of events and narratives."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from feedloom.operators import events as E
from feedloom.plans.inputs import VIEWS, Plans

P = Plans()
VIEWS["event_links"] = """
SELECT a.article_id AS id, concat('e', a.article_id % 60) AS event_id, concat('n', a.article_id % 7) AS slug, published_s, CAST(floor(published_s / 86400) AS BIGINT) AS day, source, CASE a.article_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS sentiment,
 a.article_id % 3 - 1 AS mood, a.article_id % 10 AS impact, concat('x', a.article_id % 5) AS entity, e.embedding AS vector, e.label AS event_type, lower(title) AS title FROM (SELECT *, article_id % (SELECT count(*) FROM {embeddings}) AS v FROM {articles}) a JOIN {embeddings} e ON e.vec_id = a.v"""
#: A narrative for each label of the vectors, with its first vector as centroid.
VIEWS["narrative_dim"] = "SELECT label AS narrative_pos, concat('n', label) AS slug, label % 3 = 0 AS crypto_only, min_by(embedding, vec_id) AS centroid, concat('Name ', label) AS name, label FROM {embeddings} WHERE label IS NOT NULL GROUP BY label"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]))"
_TOP = "(SELECT max(day) FROM event_links)"


def _day(links):
    return links.agg(F.max("day")).first()[0] or 0


P.add("e01_event_fingerprint", lambda e: e.select("id", E.event_fingerprint(F.col("event_type").cast("string"), F.when(F.col("id") % 3 != 0, F.lit("2024-01-02")), F.split("title", " ")).alias("f")), "SELECT id, sha256(event_type || '|' || CASE WHEN id % 3 <> 0 THEN '2024-01-02' ELSE 'none' END || '|' || array_to_string(list_sort(string_split(title, ' '))[1:3], ',')) AS f FROM event_links", "event_links")


def _articles(links):
    return links.select("id", F.sha2(F.concat_ws("|", "event_type", F.substring("title", 1, 30)), 256).alias("fingerprint"), F.md5("title").alias("content_hash"), "event_type", F.col("vector").alias("title_vector"), F.split("title", " ").alias("title_words"))


P.add("e02_cluster_events", lambda e: E.cluster_events(_articles(e)), None, "event_links")
P.add("e03_merge_clusters", lambda e: E.merge_clusters(e.select("id", "event_type", F.col("published_s").alias("first_s"), F.split("title", " ").alias("words"), "vector")), None, "event_links")
P.add(
    "j12_similar_vectors",
    lambda v: E.similar_vectors(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.35).withColumn("sim", F.round("sim", 6)),
    f"WITH v AS (SELECT embedding AS v, min(vec_id) AS id FROM vectors GROUP BY embedding) SELECT a.id AS a, b.id AS b, round({_DOT('a.v', 'b.v')}, 6) AS sim FROM v a JOIN v b ON a.id < b.id WHERE {_DOT('a.v', 'b.v')} > 0.35",
    "vectors",
)
P.add("e02_title_pairs", lambda e: E.title_pairs(e.select("id", F.split("title", " ").alias("words"))), """WITH s AS (SELECT list_sort(list_distinct(string_split(title, ' '))) AS w, min(id) AS id FROM event_links GROUP BY 1) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6""", "event_links")
P.add("e04_event_summary", lambda e: E.event_summary(e), "SELECT event_id, count(*) AS articles, min(published_s) AS first_s, max(published_s) AS last_s, count(*) FILTER (sentiment = 'bullish') AS bullish, count(*) FILTER (sentiment = 'bearish') AS bearish, max(impact) AS impact, list_sort(list(DISTINCT entity)) AS entities FROM event_links GROUP BY event_id", "event_links")
P.add("k01_select_narratives", lambda e, n: E.select_narratives(e.select("id", "vector", (F.col("id") % 2 == 0).alias("has_crypto")), n), f"SELECT id, n.slug, row_number() OVER (PARTITION BY id ORDER BY {_DOT('vector', 'centroid')} DESC, narrative_pos) AS rank FROM event_links e, narrative_dim n WHERE {_DOT('vector', 'centroid')} >= 0.3 AND (NOT crypto_only OR id % 2 = 0) QUALIFY rank <= 3", "event_links", "narrative_dim")
P.add("e05_match_narratives", lambda e, n: E.match_narratives(e.select("id", "vector", F.array("slug").alias("slugs"), F.split("title", " ").alias("keywords")), n.select("slug", "centroid", F.array(F.lit("the"), F.lit("of")).alias("narrative_keywords"))), f"""WITH x AS (SELECT id, n.slug, e.slug = n.slug AS same, {_DOT('vector', 'centroid')} AS sim, len(list_intersect(list_distinct(string_split(title, ' ')), ['the', 'of'])) / len(list_distinct(list_concat(string_split(title, ' '), ['the', 'of']))) AS j FROM event_links e, narrative_dim n),
y AS (SELECT id, slug, CASE WHEN same THEN 'slug' WHEN sim >= 0.55 THEN 'embedding' WHEN j >= 0.5 THEN 'keywords' END AS signal, CASE WHEN same THEN 0.95 WHEN sim >= 0.55 THEN sim ELSE j END::DOUBLE AS score FROM x) SELECT * FROM y WHERE signal IS NOT NULL""", "event_links", "narrative_dim")
P.add("e06_narrative_intensity", lambda e: E.narrative_intensity(e.select("slug", "day", F.col("mood").alias("sentiment"))), "WITH d AS (SELECT slug, day, count(*) AS articles, avg(mood) AS sentiment FROM event_links GROUP BY ALL), s AS (SELECT slug, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY slug) SELECT s.slug, s.day, coalesce(articles, 0) AS articles, sentiment FROM s LEFT JOIN d ON d.slug = s.slug AND d.day = s.day", "event_links")
P.add(
    "e07_narrative_lifecycle",
    lambda e: E.narrative_lifecycle(e, _day(e)),
    f"WITH d AS (SELECT slug, day, day - lag(day) OVER (PARTITION BY slug ORDER BY day) >= 30 AS woke FROM (SELECT DISTINCT slug, day FROM event_links)), w AS (SELECT slug, coalesce(bool_or(woke), false) AS woken FROM d GROUP BY slug), r AS (SELECT slug, count(*) AS articles, {_TOP} - max(day) AS idle_days FROM event_links GROUP BY slug) SELECT r.*, CASE WHEN idle_days >= 30 THEN 'dormant' WHEN idle_days >= 5 THEN 'fading' WHEN articles >= 20 OR woken THEN 'active' ELSE 'emerging' END AS state FROM r JOIN w USING (slug)",
    "event_links",
)


def _thin(links):
    """The articles of narratives by source, of which a few days in a hundred have any, so that they fall silent and wake."""
    return links.select(F.concat_ws("/", "slug", "source").alias("slug"), (F.col("day") * 7).alias("day"))


P.add(
    "e07_narrative_history",
    lambda e: E.narrative_history(_thin(e), 7 * _day(e)),
    """WITH l AS (SELECT concat_ws('/', slug, source) AS slug, day * 7 AS day FROM event_links), t AS (SELECT max(day) AS top FROM l), d AS (SELECT slug, day, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT slug, day, sum(n) OVER w AS articles, lag(day) OVER w AS before, coalesce(lead(day) OVER w, top + 1) AS until FROM d, t WINDOW w AS (PARTITION BY slug ORDER BY day)),
x AS (SELECT *, max(coalesce(day - before >= 30, false)::INT) OVER (PARTITION BY slug ORDER BY day) = 1 AS woken FROM r),
s AS (SELECT slug, day AS from_day, CASE WHEN articles >= 20 OR woken THEN 'active' ELSE 'emerging' END AS state FROM x UNION ALL SELECT slug, day + 5, 'fading' FROM x WHERE until > day + 5 UNION ALL SELECT slug, day + 30, 'dormant' FROM x WHERE until > day + 30)
SELECT slug, from_day, state FROM s QUALIFY coalesce(lag(state) OVER (PARTITION BY slug ORDER BY from_day), '') <> state""",
    "event_links",
)
P.add("e08_narrative_candidates", lambda e: E.narrative_candidates(e.select("id", "source", "day", F.split("title", " ").alias("keywords")), _day(e)), f"WITH k AS (SELECT DISTINCT id, source, unnest(string_split(title, ' ')) AS keyword FROM event_links WHERE day > {_TOP} - 7) SELECT keyword, count(DISTINCT id) AS articles, count(DISTINCT source) AS sources FROM k GROUP BY keyword HAVING count(DISTINCT id) >= 10 AND count(DISTINCT source) >= 3", "event_links")


def _candidate_groups(links, narratives):
    """Candidates with the mean vector of their articles of the last days."""
    as_of = _day(links)
    rows = links.select("id", "source", "day", F.split("title", " ").alias("keywords"), "vector")
    words = rows.where(F.col("day").between(as_of - 6, as_of)).select(F.explode(F.array_distinct("keywords")).alias("keyword"), array_to_vector("vector").alias("v"))
    vectors = words.groupBy("keyword").agg(Summarizer.mean(F.col("v")).alias("v")).select("keyword", vector_to_array("v").alias("vector"))
    found = E.narrative_candidates(rows, as_of).join(vectors, "keyword").withColumn("id", F.conv(F.substring(F.md5("keyword"), 1, 15), 16, 10).cast("long"))
    return found.select("id", "keyword").join(E.candidate_groups(found.select("id", "vector"), narratives.select("slug", "centroid")), "id").drop("id")


P.add("e08_candidate_groups", _candidate_groups, None, "event_links", "narrative_dim")
P.add("e09_centroid_drift", lambda e: E.centroid_drift(e.select("slug", F.col("id").alias("seq"), "vector")), None, "event_links")
P.add("e10_split_candidates", lambda e: E.split_candidates(e.select("slug", "vector")), "WITH s AS (SELECT slug, i, sum(x) AS s, count(*) AS n FROM (SELECT slug, unnest(vector)::DOUBLE AS x, unnest(range(64)) AS i FROM event_links) GROUP BY ALL), q AS (SELECT slug, max(n) AS n, sum(s * s) AS q FROM s GROUP BY slug HAVING max(n) > 1) SELECT slug, n, (q - n) / (n * (n - 1)) AS cohesion FROM q WHERE (q - n) / (n * (n - 1)) < 0.5", "event_links")
P.add("e11_merge_candidates", lambda n: E.merge_candidates(n.select("slug", "centroid"), 0.2), f"WITH p AS (SELECT a.slug AS a, b.slug AS b, {_DOT('a.centroid', 'b.centroid')} / sqrt({_DOT('a.centroid', 'a.centroid')} * {_DOT('b.centroid', 'b.centroid')}) AS sim FROM narrative_dim a JOIN narrative_dim b ON a.slug < b.slug) SELECT * FROM p WHERE sim > 0.2", "narrative_dim")
P.add("e12_narrative_text", lambda n: E.narrative_text(n.select("slug", "name", F.col("label").cast("string").alias("description"), F.array("slug", F.lit("x")).alias("keywords"), F.when(F.col("narrative_pos") % 4 != 0, F.col("centroid")).alias("centroid"), F.when(F.col("narrative_pos") % 5 != 0, "mini").alias("model")), "mini", 64), "SELECT slug, name || '. ' || label || '. ' || slug || ', x' AS text, narrative_pos % 4 = 0 OR narrative_pos % 5 = 0 AS stale FROM narrative_dim", "narrative_dim")
P.add("e13_consensus_read", lambda e: E.consensus_read(e.select((F.col("id") % 40).alias("article_id"), F.explode(F.array(F.struct(F.lit("sentiment").alias("field"), F.col("sentiment").alias("label")), F.struct(F.lit("entity").alias("field"), F.col("entity").alias("label")))).alias("v")).select("article_id", "v.*")), "WITH v AS (SELECT id % 40 AS article_id, 'sentiment' AS field, sentiment AS label FROM event_links UNION ALL SELECT id % 40, 'entity', entity FROM event_links), c AS (SELECT *, count(*) AS n FROM v GROUP BY ALL) SELECT article_id, field, label, n / sum(n) OVER (PARTITION BY article_id, field) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY article_id, field ORDER BY n DESC, label) = 1", "event_links")
P.add("k06_trending_events", lambda e: E.trending_events(e, _day(e), 10), f"WITH r AS (SELECT event_id, count(*) FILTER (day > {_TOP} - 2) AS recent, count(*) FILTER (day BETWEEN {_TOP} - 8 AND {_TOP} - 2) AS earlier FROM event_links GROUP BY event_id) SELECT *, recent / 2 / (earlier / 7 + 1) AS momentum FROM r ORDER BY momentum DESC, event_id LIMIT 10", "event_links")
P.add("a29_feed_stats", lambda e: E.feed_stats(e.where("source IS NOT NULL")), "SELECT source, day, sentiment, count(*) AS articles, grouping(source, day, sentiment) AS level FROM event_links WHERE source IS NOT NULL GROUP BY GROUPING SETS ((source, day, sentiment), (source), (day), (sentiment), ())", "event_links")
P.add("k04_sample_batch", lambda a: a.withColumn("i", F.row_number().over(_w())).where("i <= 3").select("batch_id", "article_id"), "SELECT batch_id, article_id FROM articles QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY md5(article_id::VARCHAR), article_id) <= 3", "articles")


def _w():
    from pyspark.sql import Window

    return Window.partitionBy("batch_id").orderBy(F.md5(F.col("article_id").cast("string")), "article_id")


def _apply_model(v):
    """A user's vectorised model over a column: here the largest component of a vector."""
    from feedloom.operators.models import apply_model

    return apply_model(v.select("vec_id", "embedding"), "embedding", "peak double", _peak)


def _peak(values):
    import numpy as np

    return np.array([max(v) for v in values], float)


P.add("p1_apply_model", _apply_model, "SELECT vec_id, list_max(embedding)::DOUBLE AS peak FROM vectors", "vectors")


def _detect(d):
    from feedloom.operators.models import detect_language, learn_profiles

    return detect_language(d.select("doc_id", "text"), learn_profiles(d.where("lang IS NOT NULL"), "lang", "text"), "doc_id", "text").select("doc_id", "code", F.round("confidence", 6).alias("confidence"))


P.add("p2_detect_language", _detect, None, "documents")
