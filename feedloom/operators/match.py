"""Gazetteer matching: keyword hits, asset matches, primary subjects, sectors, contagion links, message context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import text_of
from feedloom.operators.keywords import ANYWHERE, keyword_spots, standing
from feedloom.shared import discard, small, written

# Thresholds, cue words and blocked acronyms of the matcher.
AMBIGUOUS_LENGTH, AMBIGUOUS_ZIPF, AMBIGUOUS_ID_LENGTH, WINDOW_CHARS = 4, 2.4, 3, 100
ACRONYMS = ["LEO", "SUI", "ICP", "AI", "IT", "ON", "OP", "ATOM", "GAS", "USD", "EUR", "GBP", "JPY", "CNY", "GOLD", "ALL", "CAR"]
FINANCE = (
    r"(?i)\b(?:etfs?|funds?|stocks?|shares?|ticker|nasdaq|nyse|cboe|futures|options?|tokens?|coins?|crypto|cryptocurrency|blockchain|staking|"
    r"trading|traded|traders?|investors?|rally|rallied|rallies|surged?|surges|plunged?|plunges|tumbled?|gains?|gained|selloff|sell-off|"
    r"bullish|bearish|yields?|bonds?|index|indices|markets?|exchange|earnings|revenue|prices?|spot|bullion|equit(?:y|ies)|valuations?|market\s+cap|safe\s+haven)\b"
)
#: Parts of which every finance cue holds one.
FINANCE_STEMS = (
    "etf fund stock share ticker nasdaq nyse cboe future option token coin crypto blockchain staking trad investor rally rallie surge plunge tumble gain selloff sell-off "
    "bullish bearish yield bond index indices market exchange earnings revenue price spot bullion equit valuation safe $ %"
).split()
MACRO = (
    r"(?i)\b(central bank|interest rate|rate (?:cut|hike|decision)|monetary policy|inflation|cpi|ppi|gdp|unemployment|jobless|nonfarm|payrolls|recession|"
    r"stimulus|quantitative easing|bond yield|sovereign debt|fiscal (?:policy|deficit)|tariff|trade (?:war|deal|agreement|deficit)|sanction|embargo|export ban|"
    r"currency devaluation|exchange rate|imf|world bank|opec|supply chain|oil (?:price|output|production|refinery|depot)|gas pipeline|crude|lng|grain export|energy crisis|price cap)\b"
)
ECONOMIES = (
    r"(?i)\b(united states|eurozone|euro area|european union|china|chinese|japan|japanese|germany|german|france|french|britain|british|"
    r"india|indian|russia|russian|brazil|canada|canadian|australia|mexico|south korea|korean|turkey|turkish|saudi|iran|argentina|indonesia|"
    r"federal reserve|bank of england|bank of japan|bundesbank|renminbi|pound sterling)\b"
)
ABBREVIATIONS = r"\b(U\.?S\.?A?|EU|UK|IMF|ECB|Fed|BOJ|PBOC|OPEC|Treasury)\b|\b(dollar|euro|yen|yuan|ruble|rupee)s?\b"
#: Phases of a match in order of strength, with relevance, bonus in the title, and confidence.
KINDS = {"cashtag": (3.0, 3.0, 1.0), "case_sensitive": (2.0, 2.0, 0.95), "identifier": (1.0, 2.0, 0.9), "alias": (0.5, 0.0, 0.7)}
#: How a dependency's relationship acts.
MECHANISMS = {"supplier": "supply_chain", "customer": "supply_chain", "competitor": "competitive", "sector_peer": "sector_rotation", "index_member": "index_flow", "parent": "ownership", "subsidiary": "ownership"}
# The entity type that each label stands for.
LABEL_TYPES = {
    "PERSON": "person",
    "person": "person",
    "ORG": "organization",
    "company": "organization",
    "organization": "organization",
    "financial institution": "organization",
    "GPE": "location",
    "NORP": "government",
    "government body": "government",
    "regulatory body": "regulatory_body",
    "cryptocurrency": "asset",
    "stock ticker": "asset",
    "index": "asset",
    "commodity": "asset",
    "economic indicator": "metric",
    "MONEY": "metric",
    "PERCENT": "metric",
    "PRODUCT": "product",
    "EVENT": "event",
}


def keyword_flags(gazetteer: DataFrame, word_freq: DataFrame, common_words: DataFrame) -> DataFrame:
    """``gazetteer`` with ambiguous and weak (can't corroborate) for each keyword.

    An alphabetic word is ambiguous when short or frequent; a case-sensitive identifier when short, common or a blocked
    acronym. Single letters, common words and blocked acronyms are weak.
    """
    key = F.lower(F.trim("keyword"))
    alpha = F.trim("keyword").rlike(r"^\p{L}+$")
    rows = gazetteer.withColumn("key", key).join(small(word_freq.select(F.col("word").alias("key"), "zipf")), "key", "left").join(small(common_words.select(F.col("word").alias("key"), F.lit(True).alias("common"))), "key", "left")
    common, blocked = F.coalesce("common", F.lit(False)), F.trim("keyword").isin(ACRONYMS)
    word = alpha & ((F.length(F.trim("keyword")) <= AMBIGUOUS_LENGTH) | (F.coalesce("zipf", F.lit(0.0)) >= AMBIGUOUS_ZIPF))
    identifier = (F.length(F.trim("keyword")) <= AMBIGUOUS_ID_LENGTH) | (alpha & common) | blocked
    ambiguous = F.when(F.col("kind") == "cashtag", False).when(F.col("kind") == "case_sensitive", identifier).otherwise(word)
    return rows.select(*gazetteer.columns, ambiguous.alias("ambiguous"), ((alpha & (common | (F.length(F.trim("keyword")) <= 1))) | blocked).alias("weak"))


def gazetteer_hits(articles: DataFrame, gazetteer: DataFrame, doc: str = "article_id") -> DataFrame:
    """One row for each (doc, asset, kind, keyword) with hits, in_title and context.

    One pass of the keywords' automaton over each text. context: a finance cue, $ or % within 100 characters of any occurrence.
    """
    usable = gazetteer.where((F.col("kind").isin("cashtag", "case_sensitive")) | ((F.col("kind") == "identifier") & (F.length("keyword") >= 3)) | ((F.col("kind") == "alias") & (F.length("keyword") >= 4)))
    found = keyword_spots(articles, usable, doc, text_of(F.col("title")), text_of(F.col("body")), near=FINANCE + "|[$%]", stems=FINANCE_STEMS, around=WINDOW_CHARS)
    named = found.join(small(usable.select("kind", "keyword", "asset_id").distinct()), ["kind", "keyword"])
    return named.select(doc, "asset_id", "kind", "keyword", F.size("starts").cast("long").alias("hits"), "in_title", "context")


def asset_matches(hits: DataFrame, flags: DataFrame, doc: str = "article_id") -> DataFrame:
    """One row for each (doc, asset): relevance, method and confidence of the strongest kind, evidence.

    Kept when a cashtag or an unambiguous keyword was hit, or when a hit with finance context has evidence that isn't weak.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = hits.join(small(flags.select("asset_id", "kind", "keyword", "ambiguous", "weak", "pos")), ["asset_id", "kind", "keyword"]).withColumn("phase", order)
    in_title = F.col("in_title").cast("int")
    relevance = F.when(F.col("kind") == "cashtag", 3.0 + 3.0 * in_title).when(F.col("kind") == "case_sensitive", 2.0 + 2.0 * in_title).when(F.col("kind") == "identifier", 1.0 + 0.3 * (F.col("hits") - 1) + 2.0 * in_title).otherwise(0.5)
    found = rows.groupBy(doc, "asset_id").agg(
        F.sum(relevance).alias("relevance"),
        F.min(F.struct("phase", "kind")).alias("first"),
        F.max("in_title").alias("in_title"),
        F.max((F.col("kind") == "cashtag") | ~F.col("ambiguous")).alias("strong"),
        F.max("context").alias("context"),
        F.max(~F.col("weak")).alias("corroborates"),
        F.array_sort(F.collect_set(F.struct("phase", "pos", "keyword"))).alias("evidence"),
    )
    confidence = F.try_element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])]), F.col("first.kind"))
    # Written once: what follows reads it in several places, and texts are to be searched once.
    return written(found.where(F.col("strong") | (F.col("context") & F.col("corroborates"))).select(doc, "asset_id", "relevance", F.col("first.kind").alias("method"), confidence.alias("confidence"), "in_title", "strong", F.transform("evidence", lambda e: e["keyword"]).alias("evidence")), "matches")


def title_subjects(matches: DataFrame, articles: DataFrame, assets: DataFrame, common_words: DataFrame, doc: str = "article_id") -> DataFrame:
    """``matches`` with in_title also where the asset's name, or its first word of four letters or more that isn't common,
    stands in the title."""
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    lead = F.split(name, r"\s+")[0]
    named = assets.select("asset_id", name.alias("_name"), F.when(F.length(lead) >= 4, lead).alias("_lead"))
    named = named.join(small(common_words.select(F.col("word").alias("_lead"), F.lit(True).alias("_common"))), "_lead", "left")
    word = lambda c: F.concat(F.lit(r"\b"), F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\b"))
    named = named.select("asset_id", F.when(F.col("_name") != "", word(F.col("_name"))).alias("_name"), F.when(F.col("_common").isNull(), word(F.col("_lead"))).alias("_lead"))
    rows = matches.join(small(named), "asset_id", "left").join(articles.select(doc, F.lower(text_of(F.col("title"))).alias("_title")), doc)
    found = [F.coalesce(F.regexp_count("_title", F.col(c)) > 0, F.lit(False)) for c in ("_name", "_lead")]
    return rows.withColumn("in_title", F.col("in_title") | found[0] | found[1]).select(*matches.columns)


def primary_subjects(matches: DataFrame, assets: DataFrame, doc: str = "article_id") -> DataFrame:
    """``matches`` (doc, asset_id, relevance, in_title) with is_primary.

    Indices and currencies only count when there is nothing else. Assets in the title are all primary; otherwise, among
    at most three, the top one if it has 3.0 and half as much again as the second.
    """
    rows = matches.join(small(assets.select("asset_id", "asset_class", "symbol")), "asset_id")
    each = Window.partitionBy(doc)
    macro = F.col("asset_class").isin("index", "forex")
    rows = rows.withColumn("eligible", ~macro | ~F.max(~macro).over(each))
    of_eligible = Window.partitionBy(doc, "eligible").orderBy(F.desc("relevance"), "symbol")
    rows = rows.withColumn("i", F.row_number().over(of_eligible)).withColumn("second", F.lead("relevance").over(of_eligible))
    rows = rows.withColumn("titled", F.max(F.col("eligible") & F.col("in_title")).over(each)).withColumn("n", F.sum(F.col("eligible").cast("int")).over(each))
    top = (F.col("i") == 1) & (F.col("n") <= 3) & (F.col("relevance") >= 3.0) & (F.col("relevance") >= 1.5 * F.coalesce("second", F.lit(0.0)))
    return rows.withColumn("is_primary", F.col("eligible") & F.when(F.col("titled"), F.col("in_title")).otherwise(top)).drop("eligible", "i", "second", "titled", "n")


def top_assets(matches: DataFrame, k: int = 20, doc: str = "article_id") -> DataFrame:
    """The ``k`` matches of each doc with most relevance, ties by symbol."""
    order = Window.partitionBy(doc).orderBy(F.desc("relevance"), "symbol")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sector_hits(articles: DataFrame, sectors: DataFrame, doc: str = "article_id") -> DataFrame:
    """Sectors with evidence (cashtags anywhere, identifiers of three letters or more as words), most first; else OTHER (9).

    One pass of the automaton of all sectors' keywords over each text.
    """
    usable = sectors.where("sector_id <> 9 AND (kind = 'cashtag' OR length(keyword) >= 3)").withColumn("kind", F.when(F.col("kind") == "cashtag", "cashtag").otherwise("identifier"))
    found = keyword_spots(articles, usable, doc, text_of(F.col("title")), text_of(F.col("body")), lambda kind: standing(kind, ANYWHERE))
    rows = found.select(doc, "kind", "keyword").join(small(usable), ["kind", "keyword"])
    counts = rows.groupBy(doc, "sector_id", "symbol").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    order = Window.partitionBy(doc).orderBy(F.desc("n"), "sector_id")
    level = F.when(F.col("n") > 2, "high").when(F.col("n") > 1, "medium").otherwise("low")
    found = counts.select(doc, "sector_id", "symbol", level.alias("confidence"), F.row_number().over(order).alias("rank"))
    rest = articles.select(doc).join(found.select(doc).distinct(), doc, "left_anti").select(doc, F.lit(9).alias("sector_id"), F.lit("OTHER").alias("symbol"), F.lit("low").alias("confidence"), F.lit(1).alias("rank"))
    return found.union(rest)


def top_keyword_class(posts: DataFrame, registry: DataFrame, other: int = 0, doc: str = "post_id", text: str = "text") -> DataFrame:
    """doc, class_id, confidence: the best registry entry of a post.

    A cashtag anywhere scores 1.0; otherwise more than one identifier .9 and a single one .8; ties by registry order;
    confidence is high from .9.
    """
    found = keyword_spots(posts, registry, doc, None, text_of(F.col(text)), lambda kind: standing(kind, ANYWHERE))
    rows = found.select(doc, "kind", "keyword").join(small(registry.select("class_id", "kind", "keyword")), ["kind", "keyword"])
    per = rows.groupBy(doc, "class_id").agg(F.max(F.col("kind") == "cashtag").alias("tag"), F.count("*").alias("n"))
    score = F.when(F.col("tag"), 1.0).when(F.col("n") > 1, 0.9).otherwise(0.8)
    best = per.withColumn("score", score).withColumn("i", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "class_id"))).where("i = 1")
    return posts.select(doc).join(best.select(doc, "class_id", "score"), doc, "left").select(doc, F.coalesce("class_id", F.lit(other)).alias("class_id"), F.when(F.col("score") >= 0.9, "high").otherwise("low").alias("confidence"))


def contagion_links(doc_assets: DataFrame, edges: DataFrame, most: int = 8, doc: str = "article_id") -> DataFrame:
    """The first ``most`` links from a doc's assets to their dependents, in order of asset and edge, each link once."""
    rows = doc_assets.join(small(edges), F.col("symbol") == F.col("source_ticker"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(doc, "source_ticker", "target_ticker").orderBy("asset_pos", "edge_pos"))).where("i = 1")
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("asset_pos", "edge_pos", "target_ticker"))
    mechanism = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MECHANISMS.items() for x in kv]), F.col("relationship")), F.lit("correlation"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select(doc, "source_ticker", "target_ticker", mechanism.alias("mechanism"), F.lit(0.7).alias("strength"), "rank")


def inferred_impacts(doc_assets: DataFrame, edges: DataFrame, most: int = 20, doc: str = "article_id") -> DataFrame:
    """The first ``most`` dependents that a doc doesn't mention itself (upper case), each once."""
    own = doc_assets.select(doc, F.upper("symbol").alias("target"))
    rows = doc_assets.join(small(edges), F.col("symbol") == F.col("source_ticker")).withColumn("target", F.upper("target_ticker")).join(own, [doc, "target"], "left_anti")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(doc, "target").orderBy("asset_pos", "edge_pos"))).where("i = 1")
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("asset_pos", "edge_pos", "target"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select(doc, "target", "relationship", F.lit(0.7).alias("confidence"), "rank")


def message_context(messages: DataFrame, back: int = 2) -> DataFrame:
    """group_id, message_id and the ids before it that give its context: the parent of a reply, else the last ``back``."""
    order = Window.partitionBy("group_id").orderBy("created", "message_id")
    before = F.array_compact(F.array(*[F.lag("message_id", i).over(order) for i in range(back, 0, -1)]))
    rows = messages.select("group_id", "message_id", "reply_to", before.alias("before"))
    parents = messages.select(F.col("message_id").alias("parent"), F.lit(True).alias("known"))
    return rows.join(parents, F.col("reply_to") == F.col("parent"), "left").select("group_id", "message_id", F.when(F.col("reply_to").isNotNull(), F.when(F.col("known"), F.array("reply_to")).otherwise(F.array().cast("array<bigint>"))).otherwise(F.col("before")).alias("context"))


def inherited_assets(messages: DataFrame, most: int = 64) -> DataFrame:
    """message_id, inherited_asset, inherited_from: the asset (and message) of the nearest classified message (asset_id not
    null) up the chain of replies (message_id, reply_to, asset_id); null without one.

    Pointers are doubled: after k rounds 2^k messages of a chain are looked through, so a chain of any length takes a
    logarithm of rounds (``most`` is never reached), and only chains without an answer go on. Chains that run in a circle
    have none; they stop when the rounds have passed all messages.
    """
    own = messages.groupBy("message_id").agg(F.min("reply_to").alias("up"), F.min("asset_id").alias("asset"))  # equal ids count once
    start = own.alias("m").join(own.select(F.col("message_id").alias("p"), F.col("asset").alias("p_asset"), F.col("up").alias("p_up")).alias("p"), F.col("up") == F.col("p"), "left")
    now = start.select("message_id", F.when(F.col("p_asset").isNotNull(), F.col("p")).alias("source"), F.col("p_asset").alias("asset"), F.when(F.col("p_asset").isNull(), F.col("p")).alias("at"))
    now, passed, total = written(now, "reply-chains"), 1, None
    for _ in range(most):
        open_rows = now.where("asset IS NULL AND at IS NOT NULL")
        if open_rows.isEmpty():
            break
        total = now.count() if total is None else total
        if passed > total:
            break
        far = now.select(F.col("message_id").alias("at"), F.col("source").alias("f_source"), F.col("asset").alias("f_asset"), F.col("at").alias("f_at"))
        moved = open_rows.join(far, "at", "left").select("message_id", F.col("f_source").alias("source"), F.col("f_asset").alias("asset"), F.col("f_at").alias("at"))
        after = written(now.where("asset IS NOT NULL OR at IS NULL").union(moved), "reply-chains")
        discard(now)
        now, passed = after, 2 * passed
    return now.select("message_id", F.col("asset").alias("inherited_asset"), F.col("source").alias("inherited_from"))


def triage_stage(articles: DataFrame, asset_docs: DataFrame, doc: str = "article_id") -> DataFrame:
    """doc, label, reason_code, confidence: market relevance by assets, then macro terms and named economies."""
    text = F.concat(text_of(F.col("title")), F.lit("\n"), F.substring(text_of(F.col("body")), 1, 4000))
    macro, economy = text.rlike(MACRO), text.rlike(ECONOMIES) | text.rlike(ABBREVIATIONS)
    rows = articles.join(asset_docs.select(doc).distinct().withColumn("has", F.lit(True)), doc, "left").select(doc, F.coalesce("has", F.lit(False)).alias("has"), macro.alias("macro"), economy.alias("economy"))
    has, macro, economy = F.col("has"), F.col("macro"), F.col("economy")
    label = F.when(has | (macro & economy), "relevant").when(macro, "borderline").otherwise("irrelevant")
    return rows.select(doc, label.alias("label"), F.when(label == "irrelevant", "non_economic").alias("reason_code"), F.when(has, 0.95).when(macro & economy, 0.7).when(macro, 0.5).otherwise(0.8).alias("confidence"))


def resolve_entities(candidates: DataFrame, overrides: DataFrame, qids: DataFrame) -> DataFrame:
    """Candidates (text, label, score, qid, qid_title) with name, entity_type, confidence, resolved_ticker and resolved_by.

    First an override (surface, canonical, type, ticker) of the trimmed lower-cased text, then the linked id in ``qids``
    (qid, qid_name, qid_type, qid_ticker), then the title that the linker gave for an id that ``qids`` doesn't hold, and
    else the text itself with the type of its label. Surfaces and ids are unique in their tables.
    """
    over = overrides.select(F.col("surface").alias("_surface"), F.col("canonical").alias("_name"), F.col("type").alias("_type"), F.col("ticker").alias("_ticker"))
    known = qids.select(F.col("qid").alias("_qid"), F.col("qid_name").alias("_qname"), F.col("qid_type").alias("_qtype"), F.col("qid_ticker").alias("_qticker"))
    rows = candidates.join(small(over), F.lower(F.trim("text")) == F.col("_surface"), "left").join(small(known), F.col("qid") == F.col("_qid"), "left")
    by = F.when(F.col("_surface").isNotNull(), "override").when(F.col("_qid").isNotNull(), "linked").when(F.col("qid").isNotNull() & (F.col("qid_title") != ""), "title").otherwise("label")
    kinds = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    labelled = F.coalesce(F.try_element_at(kinds, F.col("label")), F.lit("organization"))
    pick = lambda override, linked, title, label: F.when(by == "override", override).when(by == "linked", linked).when(by == "title", title).otherwise(label)
    return rows.select(
        *[F.col(c) for c in candidates.columns],
        pick(F.col("_name"), F.coalesce("_qname", "qid_title", "text"), F.col("qid_title"), F.col("text")).alias("name"),
        pick(F.col("_type"), F.coalesce("_qtype", F.lit("unknown")), labelled, labelled).alias("entity_type"),
        pick(F.lit(1.0), F.lit(0.9), F.lit(0.7), F.col("score")).alias("confidence"),
        pick(F.col("_ticker"), F.col("_qticker"), F.lit(None), F.lit(None)).alias("resolved_ticker"),
        by.alias("resolved_by"),
    )


def merge_tickers(own: Column, suggested: Column) -> Column:
    """Own tickers, then suggested ones in upper case, each once without regard to case."""
    upper = F.transform(own, F.upper)
    return F.concat(own, F.filter(F.array_distinct(F.transform(suggested, F.upper)), lambda t: ~F.array_contains(upper, t)))
