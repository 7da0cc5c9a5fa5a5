"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

A text becomes an array of words. For every window of a test item the two rarest terms are taken, by their counts in the
training corpus, and the index stores the postings (document, position) of these terms. A posting less the term's offset
in the item is the place where the item would start in the document. The list of a window's rarest term is intersected
with that of its second term: only places that both lists name stay. There the postings of the item's further terms, in
the documents that are left, are intersected the same way, by equality joins on document, position and term; runs of
positions that go on without a gap and are as long as a window are exact phrase matches. No join carries a text, so a
document with very many places costs its postings. :func:`proximity` gives the looser matches from the same index: the
two rarest terms of an item, in its order, within a number of words.

Nothing is cut off: a frequent term has a long list, which is spread over as many tasks as its documents are. What the
test items give is broadcast only after its rows and bytes were counted (see shared.small).

Edge cases: null and empty texts have no words and are never contaminated; an item without words matches nothing; an
item of fewer words than the window is one window; rows with equal ids but different texts stay apart, equal rows get
equal results; an item without an id counts for hits, but is not listed; an empty table of either kind gives no hit;
other columns are not read by contamination, whatever their names, and kept as they are by decontaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.arrow import KEY, except_rows, kept_apart, possible, row_key
from feedloom.shared import discard, small, written

WINDOW = 13
#: Words within which two rare terms of an item count as near each other.
NEAR = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: everything that is not part of a word, after lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct items: number, item_id, their words and the length that a run must have."""
    found = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return found.select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words", F.least(F.size("item_words"), F.lit(WINDOW)).alias("run"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents by a key of id and text, so that rows that share an id stay apart."""
    return docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and its number of occurrences in the corpus (0 included), for the given terms only."""
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rare_terms(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item and, for each of its windows, offset and term of the rarest word (o1, t1) and of the next one (o2, t2; null
    in a window of one word); of equally rare words the first."""
    at = items.select("item", "run", F.posexplode("item_words").alias("offset", "term")).join(small(counts), "term")
    over = Window.partitionBy("item").orderBy("offset").rowsBetween(0, WINDOW - 1)
    window = F.sort_array(F.collect_list(F.struct("n", "offset", "term")).over(over)).alias("window")  # WINDOW words at most
    best = at.select("item", "run", window).where(F.size("window") == F.col("run"))
    one, two = F.get("window", F.lit(0)), F.get("window", F.lit(1))
    return best.select("item", one["offset"].alias("o1"), one["term"].alias("t1"), two["offset"].alias("o2"), two["term"].alias("t2")).distinct()


def rare_pairs(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, a, b: the two rarest different terms of an item in the order of their first places in it."""
    at = items.select("item", F.posexplode("item_words").alias("offset", "term")).groupBy("item", "term").agg(F.min("offset").alias("offset")).join(small(counts), "term")
    two = at.withColumn("i", F.row_number().over(Window.partitionBy("item").orderBy("n", "offset"))).where("i <= 2")
    pair = two.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("offset", "term"))).alias("p")).where(F.size("p") == 2)
    return pair.select("item", F.col("p")[0]["term"].alias("a"), F.col("p")[1]["term"].alias("b"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: term, row, row2, pos."""
    return docs.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term")).join(small(terms), "term").select("term", *KEY, "pos")


def alignments(index: DataFrame, rare: DataFrame) -> DataFrame:
    """row, row2, item, shift: where an item would start in a document, by both rare terms of one of its windows."""

    def places(offset: str, term: str) -> DataFrame:
        return index.join(small(rare.where(F.col(term).isNotNull())), F.col("term") == F.col(term)).select(*KEY, "item", (F.col("pos") - F.col(offset)).alias("shift"), "o1", "o2")

    first, second = places("o1", "t1"), places("o2", "t2")
    both = first.where("o2 IS NOT NULL").join(second, [*KEY, "item", "shift", "o1", "o2"], "left_semi").union(first.where("o2 IS NULL"))
    return both.select(*KEY, "item", "shift").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """row, row2, item, first, last: positions in the document of every maximal run of words that an item shares with it
    at one of its alignments, and that holds at least one of the item's windows."""
    near = possible(docs, found).join(found.select(*KEY, F.lit(True).alias("near")).distinct(), KEY).select(*KEY, "text").dropDuplicates(KEY)
    at = near.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    asked = found.join(small(items.select("item", "run", F.posexplode("item_words").alias("offset", "term"))), "item").withColumn("pos", F.col("shift") + F.col("offset"))
    equal = asked.where("pos >= 0").join(at, [*KEY, "pos", "term"]).select(*KEY, "item", "shift", "run", "pos")
    line = Window.partitionBy(*KEY, "item", "shift").orderBy("pos")
    runs = equal.withColumn("run_of", F.col("pos") - F.row_number().over(line)).groupBy(*KEY, "item", "shift", "run_of").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("run").alias("run"))
    return runs.where("last - first + 1 >= run").select(*KEY, "item", "first", "last")


def proximity(index: DataFrame, pairs: DataFrame, within: int = NEAR) -> DataFrame:
    """row, row2, item, first, last: terms a and b of an item, in that order and at most ``within`` words apart."""
    left = index.withColumnRenamed("term", "a").withColumnRenamed("pos", "first").join(small(pairs), "a").withColumn("cell", F.explode(F.array(F.floor(F.col("first") / within), F.floor(F.col("first") / within) + 1)))
    right = index.withColumnRenamed("term", "b").withColumnRenamed("pos", "last").withColumn("cell", F.floor(F.col("last") / within))
    return left.join(right, [*KEY, "b", "cell"]).where((F.col("last") > F.col("first")) & (F.col("last") - F.col("first") <= within)).select(*KEY, "item", "first", "last").distinct()


def judged(documents: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """The key of each document, and what :func:`contamination` returns."""
    docs = _keyed(documents, doc_id, text)
    items = written(_items(benchmark, item_id, item_text), "items")
    terms = written(items.select(F.explode("item_words").alias("term")).distinct(), "terms")
    counts = written(term_counts(docs, terms), "term-counts")
    rare, pairs = written(rare_terms(items, counts), "rare-terms"), written(rare_pairs(items, counts), "rare-pairs")
    wanted = rare.select("t1").union(rare.select("t2")).union(pairs.select("a")).union(pairs.select("b")).where("t1 IS NOT NULL").select(F.col("t1").alias("term")).distinct()
    index = written(postings(docs, wanted), "postings")
    found = written(alignments(index, rare), "alignments")
    matches = written(phrase_matches(docs, items, found), "matches")
    in_order = Window.partitionBy(*KEY).orderBy("first", "last")
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.select(*KEY, "first", "last").distinct().withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest(F.coalesce(before, F.lit(-1)), F.col("first") - 1)))
    hit = spans.groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    named = matches.select(*KEY, "item").distinct().join(small(items.select("item", "item_id")), "item").where("item_id IS NOT NULL")
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("named"))
    close = proximity(index, pairs).select(*KEY, "item").distinct().groupBy(*KEY).agg(F.count("*").alias("n_near"))
    facts = written(hit.join(named, KEY, "full").join(close, KEY, "full"), "hits")
    discard(terms, counts, rare, pairs, index, found, matches)
    result = docs.select(*KEY, "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(facts, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return result.select(
        *KEY,
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("named").isNull(), 0).otherwise(F.size("named")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("named", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match) for every document."""
    return judged(documents, benchmark, doc_id, text, item_id, item_text).drop(*KEY)


def decontaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are not contaminated."""
    bad = written(judged(documents, benchmark, doc_id, text, item_id, item_text).where("contaminated").select(*KEY).distinct(), "contaminated")
    return except_rows(kept_apart(documents, doc_id, text), bad).select("doc.*")


def oracle() -> str:
    """DuckDB SQL for :func:`contamination` over documents and benchmark."""
    cut = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, {cut} AS w FROM documents), i AS (SELECT DISTINCT item_id, {cut} AS w FROM benchmark),
g AS (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WINDOW} THEN [w] ELSE list_transform(range(1, len(w) - {WINDOW} + 2), lambda s: w[s:s + {WINDOW} - 1]) END) AS g FROM i),
k AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM g), ns AS (SELECT DISTINCT n FROM k),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, ns WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, s, x.n FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM x) x JOIN k ON k.g = x.g AND k.n = x.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id),
ic AS (SELECT i.item_id, i.w, unnest(i.w) AS term, unnest(range(len(i.w))) AS o FROM i),
dp AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
c AS (SELECT term, count(p) AS n FROM (SELECT DISTINCT term FROM ic) LEFT JOIN dp USING (term) GROUP BY term),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, w ORDER BY n, o) AS i FROM (SELECT item_id, w, term, min(o) AS o FROM ic GROUP BY ALL) JOIN c USING (term)),
two AS (SELECT item_id, w, min_by(term, o) AS a, max_by(term, o) AS b FROM r WHERE i <= 2 GROUP BY item_id, w HAVING count(*) = 2),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT x.doc_id, two.item_id, two.w FROM two JOIN dp x ON x.term = a JOIN dp y ON y.term = b AND y.doc_id = x.doc_id AND y.p > x.p AND y.p <= x.p + {NEAR}) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_near, 0) AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)"""
