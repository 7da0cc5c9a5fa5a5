"""Entity candidates, mentions, sentence votes and content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scores as S
from feedloom.functions.text import text_of
from feedloom.functions.vectors import vector_sums
from feedloom.shared import small

# Thresholds of entities, votes and blocks.
SCORE_FLOOR, ALONE_FLOOR, AGREED_FLOOR = 0.30, 0.60, 0.40
MENTIONS, PRIMARY_FLOOR, ENTITIES = 6, 0.15, 15
MAX_SYMBOLS, MIN_STOP, GOOD_STOP, GOOD_WORDS = 0.20, 0.15, 0.20, 8
RELEVANCE = 0.05
GENERIC = ["the company", "the firm", "the group", "the business", "the maker", "the stock", "the shares", "the share price", "shares"]
CONFERENCE = r"(?i)research division|conference call participants|earnings call transcript|prepared remarks"
DESK = r"\b(Research Division|Securities|Capital Markets|Equity Research|Research Analyst|Research,? LLC|Global Markets)\b"


def entity_blocklist(candidates: DataFrame, stoplist: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Candidates with a fair score, two characters and a letter, that no stop list of their language or of English has."""
    word = F.lower(F.trim("text"))
    sane = candidates.where((F.col("score") >= SCORE_FLOOR) & (F.length(F.trim("text")) >= 2) & F.col("text").rlike(r"\p{L}"))
    stops = small(stoplist.select(F.col("lang").alias("stop_lang"), F.col("word").alias("stop_word")))
    return sane.join(stops, (word == F.col("stop_word")) & (F.col("stop_lang").isin("en") | (F.col("stop_lang") == F.col("lang"))), "left_anti")


def salience_filter(candidates: DataFrame, ranges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Candidates inside a salient range of their document; a document without ranges keeps all."""
    inside = candidates.join(ranges.select(F.col(doc).alias("r_doc"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), (F.col(doc) == F.col("r_doc")) & (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")), "left_semi")
    return inside.unionByName(candidates.join(ranges.select(doc).distinct(), doc, "left_anti"))


def ground_entities(candidates: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One candidate for each run of overlapping spans: the best by score, length and text, if its score is enough for
    the number of models that agree. Spans that only touch are apart."""
    order = Window.partitionBy(doc).orderBy("start", F.desc("end"), "text", "model")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = candidates.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("size"), "text", "start", "end", "label"))
    groups = rows.groupBy(doc, "island").agg(F.countDistinct("model").alias("models"), F.max("score").alias("top"), best.alias("b"))
    return groups.where(F.col("top") >= F.when(F.col("models") >= 2, AGREED_FLOOR).otherwise(ALONE_FLOOR)).select(doc, "b.start", "b.end", "b.text", "b.label", "b.score", "models")


def dedup_entities(entities: DataFrame, doc: str = "doc_id", most: int = ENTITIES) -> DataFrame:
    """One record for each (name in lower case, type), in order of first sight, the first ``most``.

    The most confident wins (the first on ties); a role other than "mentioned" and a sentiment are kept from whichever
    record had one when its turn came.
    """
    first = F.struct(F.lit(-1.0).alias("confidence"), F.lit(None).cast("string").alias("name"), F.lit("mentioned").alias("role"), F.lit(None).cast("string").alias("sentiment"))

    def fold(kept, e):
        role = F.when(kept["role"] != "mentioned", kept["role"]).otherwise(e["role"])
        mood = F.coalesce(kept["sentiment"], e["sentiment"])
        wins = e["confidence"] > kept["confidence"]
        return F.struct(
            F.when(wins, e["confidence"]).otherwise(kept["confidence"]).alias("confidence"),
            F.when(wins, e["name"]).otherwise(kept["name"]).alias("name"),
            F.when(wins & (e["role"] != "mentioned"), e["role"]).otherwise(role).alias("role"),
            F.when(wins & e["sentiment"].isNotNull(), e["sentiment"]).otherwise(mood).alias("sentiment"),
        )

    listed = entities.groupBy(doc, F.lower("name").alias("key"), "type").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "confidence", "name", "role", "sentiment"))).alias("l"))
    done = listed.select(doc, "type", "pos", F.aggregate("l", first, fold).alias("e"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("pos"))
    return done.withColumn("rank", rank).where(F.col("rank") <= most).select(doc, "type", "e.name", "e.confidence", "e.role", "e.sentiment", "rank")


def quoted(text: Column) -> Column:
    """A text as a regular expression for itself."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}-])", r"\\$1")


def match_starts(text: Column, pattern: Column) -> Column:
    """Places (from 0) at which the occurrences of a pattern start that regexp_extract_all finds: what lies between them
    and the occurrences before, added up."""
    pieces = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, found: F.struct(F.length(gap).alias("gap"), F.length(found).alias("size")))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    step = lambda acc, p: F.struct(F.when(p["size"].isNull(), acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"] + p["gap"]))).alias("starts"), F.coalesce(acc["at"] + p["gap"] + p["size"], acc["at"]).alias("at"))
    return F.aggregate(pieces, start, step, lambda acc: acc["starts"])


def mention_counts(df: DataFrame, text: str = "text", forms: str = "forms") -> DataFrame:
    """``df`` with mention_count (1 at least) and first_offset of any form of three letters or more, as whole words.

    Occurrences that overlap are one mention; those that touch are two.
    """
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(forms), F.array().cast("array<string>")), lambda f: F.lower(F.trim(F.coalesce(f, F.lit(""))))), lambda f: F.length(f) >= 3))
    rows = df.withColumns({"_body": body, "_own": own})
    spans = F.transform("_own", lambda f: F.transform(match_starts(F.col("_body"), F.concat(F.lit(r"\b"), quoted(f), F.lit(r"\b"))), lambda s: F.struct(s.alias("start"), (s + F.length(f)).alias("end"))))
    rows = rows.withColumn("_spans", F.array_sort(F.flatten(spans)))
    fold = lambda acc, s: F.struct((acc["n"] + (s["start"] >= acc["end"]).cast("int")).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    count = F.aggregate("_spans", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), fold, lambda acc: acc["n"])
    return rows.select(*df.columns, F.greatest(count, F.lit(1)).cast("long").alias("mention_count"), F.try_element_at("_spans", F.lit(1))["start"].cast("long").alias("first_offset"))


def disclosure_tail(df: DataFrame, markers: list[str], text: str = "text", share: float = 0.4, most: int = 3000) -> DataFrame:
    """``df`` with its text cut at the first disclosure marker in its last part; the text is cut to ``most`` characters before."""
    body = F.substring(F.coalesce(F.col(text), F.lit("")), 1, most)
    starts = match_starts(body, F.lit(f"(?i)(?:{'|'.join(markers)})"))
    first = F.try_element_at(F.filter(starts, lambda s: s >= share * F.length(body)), F.lit(1))
    return df.withColumn(text, F.coalesce(F.regexp_replace(F.left(body, first), r"\s+\z", ""), body))


def transcript_roster(df: DataFrame, text: str = "text", forms: str = "forms", primary: str = "is_primary") -> DataFrame:
    """Assets without those that a transcript only names as a broker: every mention is followed by a desk word within 40 characters."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.filter(F.coalesce(F.col(forms), F.array().cast("array<string>")), lambda f: F.length(f) >= 3)
    rows = df.withColumns({"_body": body, "_own": own})
    ends = F.flatten(F.transform("_own", lambda f: F.transform(match_starts(F.col("_body"), F.concat(F.lit("(?i)"), quoted(f))), lambda s: s + F.length(f))))
    only_desk = F.col("_body").rlike(CONFERENCE) & (F.size("_ends") > 0) & F.forall("_ends", lambda e: F.substring(F.col("_body"), e + 1, F.lit(40)).rlike("(?i)" + DESK))
    return rows.withColumn("_ends", ends).where(F.col(primary) | ~only_desk).select(*df.columns)


def mention_sentences(sentences: DataFrame, assets: DataFrame, doc: str = "doc_id", most: int = MENTIONS) -> DataFrame:
    """The first ``most`` sentences of a document that name an asset by one of its forms (two letters or more); the only
    primary subject of a document is also named by generic words for it."""
    lone = F.col("is_primary") & (F.sum(F.col("is_primary").cast("int")).over(Window.partitionBy(doc)) == 1)
    forms = F.filter(F.when(lone, F.concat("forms", F.array(*map(F.lit, GENERIC)))).otherwise(F.col("forms")), lambda f: F.length(f) >= 2)
    quoted = F.transform(forms, lambda f: F.regexp_replace(f, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    named = assets.select(doc, "ticker", "is_primary", F.concat(F.lit(r"(?i)\b(?:"), F.array_join(quoted, "|"), F.lit(r")\b")).alias("pattern"))
    rows = sentences.join(named, doc).where(F.regexp_count("text", F.col("pattern")) > 0)
    rank = F.row_number().over(Window.partitionBy(doc, "ticker").orderBy("sent_pos"))
    return rows.withColumn("i", rank).where(F.col("i") <= most).select(doc, "ticker", "is_primary", "sent_pos", "text", "vote")


def aspect_votes(mentions: DataFrame, assets: DataFrame, directions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, ticker, direction, magnitude, confidence, from_article, evidence: the votes of an asset's mentions.

    evidence holds up to three sentences of the winning side (of the neutral ones on a draw), or else the first mention. A primary subject with little confidence, and an asset without mentions, take the article's direction (from_article).
    """
    vote = F.col("vote")
    sums = mentions.groupBy(doc, "ticker").agg(F.count("*").alias("n"), F.count_if(vote == 1).alias("pos"), F.count_if(vote == -1).alias("neg"), F.array_sort(F.collect_list(F.struct("sent_pos", "vote", "text"))).alias("said"))  # at most MENTIONS
    rows = assets.select(doc, "ticker", "is_primary").join(sums, [doc, "ticker"], "left").join(directions, doc, "left")
    net, n = F.col("pos") - F.col("neg"), F.col("n")
    agree = F.greatest("pos", "neg")
    label, magnitude = S.vote_to_sentiment(net, n, agree)
    confidence = agree / n * F.least(F.lit(1.0), agree / 4) * (0.7 + 0.3 * magnitude)
    weak = n.isNotNull() & F.col("is_primary") & (confidence < PRIMARY_FLOOR)
    none = n.isNull()
    own = F.coalesce("article_direction", F.lit("neutral"))
    side = F.slice(F.filter("said", lambda s: s["vote"] == F.signum(net)), 1, 3)
    spans = F.transform(F.when(F.size(side) > 0, side).otherwise(F.slice("said", 1, 1)), lambda s: s["text"])
    return rows.select(doc, "ticker", F.when(none | weak, own).otherwise(label).alias("direction"), F.when(none | weak, 0.4).otherwise(magnitude).alias("magnitude"), F.when(none, 0.3).when(weak, F.greatest(confidence, F.lit(0.3))).otherwise(confidence).alias("confidence"), (none | F.coalesce(weak, F.lit(False))).alias("from_article"), F.coalesce(spans, F.array().cast("array<string>")).alias("evidence"))


def horizon_outlooks(mentions: DataFrame, votes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, ticker, short, medium, long: outlooks by the time cues of the mentions; the direction thrice without near or far
    cues, and where the direction is the article's."""
    rows = mentions.withColumn("bucket", S.horizon_bucket(F.col("text")))
    aggs = []
    for b in ("short", "medium", "long"):
        here = F.col("bucket") == b
        aggs += [F.count_if(here).alias(f"{b}_n"), F.count_if(here & (F.col("vote") == 1)).alias(f"{b}_p"), F.count_if(here & (F.col("vote") == -1)).alias(f"{b}_m")]
    sums = votes.select(doc, "ticker", "direction", "from_article").join(rows.groupBy(doc, "ticker").agg(*aggs), [doc, "ticker"], "left")

    def view(b):
        p, m, n = F.col(f"{b}_p"), F.col(f"{b}_m"), F.col(f"{b}_n")
        agree = F.greatest(p, m)
        return F.when(n > 0, S.vote_to_sentiment(p - m, n, agree)[0])

    plain = F.col("from_article") | (F.coalesce(F.col("short_n") + F.col("long_n"), F.lit(0)) == 0)
    base = F.coalesce(view("medium"), F.col("direction"))
    return sums.select(doc, "ticker", *[F.when(plain, F.col("direction")).otherwise(F.coalesce(view(b), S.decay_one_step(base))).alias(b) for b in ("short", "medium", "long")])


def article_direction(sentences: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, article_direction: the side with more sentences."""
    up, down = F.count_if(F.col("vote") == 1), F.count_if(F.col("vote") == -1)
    return sentences.groupBy(doc).agg(F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral").alias("article_direction"))


def block_labels(docs: DataFrame, stopwords: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, pos, block, label (good, near, bad) and kept: blocks of lines and sentences judged by their words, then near
    ones by the nearest sure block on either side."""
    blocks = F.filter(F.transform(F.split(F.regexp_replace(text_of(F.col(text)), r"([.!?])[ \t]+", "$1\n"), "\n"), lambda b: F.trim(b)), lambda b: b != "")
    rows = docs.select(doc, F.posexplode(blocks).alias("pos", "block"))
    words = F.regexp_extract_all("block", F.lit(r"(?U)\w+"), F.lit(0))
    rows = rows.withColumn("w", words)
    n = F.size("w")
    stop = F.size(F.filter("w", lambda w: F.lower(w).isin(stopwords))) / n
    symbols = F.least(F.lit(1.0), 10 * F.regexp_count("block", F.lit(r"[|/\\•·›»>#*=~^]")) / F.greatest(F.length("block"), F.lit(1)))
    label = F.when(n == 0, "bad").when(n <= 2, F.when(stop > 0, "near").otherwise("bad")).when(symbols > MAX_SYMBOLS, "bad").when(stop < MIN_STOP, "bad").when((n >= GOOD_WORDS) & (stop >= GOOD_STOP), "good").otherwise("near")
    rows = rows.select(doc, "pos", "block", label.alias("label")).withColumn("sure", F.when(F.col("label") != "near", F.col("label")))
    order = Window.partitionBy(doc).orderBy("pos")
    before = F.last("sure", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("sure", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    good = (F.col("label") == "good") | ((F.col("label") == "near") & (F.coalesce(before == "good", F.lit(False)) | F.coalesce(after == "good", F.lit(False)) | F.coalesce(before, after).isNull()))
    return rows.select(doc, "pos", "block", "label", good.alias("kept"))


def block_relevance(blocks: DataFrame, doc: str = "doc_id", floor: float = RELEVANCE) -> DataFrame:
    """doc, pos, cosine, relevant for good blocks (doc, pos, vector, title_vector): each against the mean of the others'
    mean and the title. A document with one block and no title is left as it is.

    The mean of the others is (sum - own) / (n - 1), so a document's vectors are summed once, and each block is compared in
    its own row.
    """
    sums = vector_sums(blocks, doc, "vector").select(F.col(doc).alias("_doc"), "total", "n")
    rows = blocks.select(doc, "pos", F.col("vector").cast("array<double>").alias("x"), F.col("title_vector").cast("array<double>").alias("t")).join(sums, F.col(doc).eqNullSafe(F.col("_doc")))

    def anchor(x, i):
        others, title = (F.get("total", i) - x) / (F.col("n") - 1), F.get("t", i)
        return F.when(F.col("n") < 2, title).when(title.isNull(), others).otherwise((others + title) / 2)

    added = lambda values: F.aggregate(values, F.lit(0.0), lambda total, v: total + v)
    times = lambda a, b: added(F.zip_with(a, b, lambda u, v: u * v))
    rows = rows.withColumn("a", F.transform("x", anchor))
    cosine = times(F.col("x"), F.col("a")) / F.sqrt(times(F.col("x"), F.col("x")) * times(F.col("a"), F.col("a")))
    found = rows.select(doc, "pos", cosine.alias("cosine"))
    return found.select(doc, "pos", "cosine", F.coalesce(F.col("cosine") >= floor, F.lit(True)).alias("relevant"))
