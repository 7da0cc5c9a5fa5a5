"""Analysis records: canonical forms, capped lists, validation, penalty details, attestations, gold and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators import match
from feedloom.operators.ledger import POINT_CAP
from feedloom.shared import small

# Causes of penalties by reason, and fields of a verdict's key.
CAUSES = {
    "classification_mismatch": "classification_mismatch",
    "missing_miner_classification": "missing_classification",
    "miner_needs_update": "needs_update",
    "article_content_mismatch": "article_content_mismatch",
    "validation_failed": "validation_failed",
    "cloned_embeddings": "cloned_embeddings",
}
KEY_FIELDS = ["sentiment", "asset_symbol", "content_type", "technical_quality", "market_analysis", "impact_potential"]
ECONOMIC_KINDS = ["cpi", "gdp", "jobs", "rates", "other"]


def economic_deltas(points: Column, most: int = 5, kinds: list[str] | None = None) -> Column:
    """The first points with actual less expected and less previous; null if either is; unknown kinds are other."""
    kinds = kinds or ECONOMIC_KINDS
    return F.transform(F.slice(points, 1, most), lambda p: F.struct(F.when(p["kind"].isin(kinds), p["kind"]).otherwise("other").alias("kind"), (p["actual"] - p["expected"]).alias("vs_expected"), (p["actual"] - p["previous"]).alias("vs_previous")))


def capped_claims(claims: Column, most: int = 10, context: int = 200) -> Column:
    """The first claims, then without those that lack a metric or a value; contexts are cut."""
    kept = F.filter(F.slice(claims, 1, most), lambda c: c["metric"].isNotNull() & c["value"].isNotNull())
    return F.transform(kept, lambda c: F.struct(c["metric"].alias("metric"), c["value"].alias("value"), F.substring(F.coalesce(c["context"], F.lit("")), 1, context).alias("context")))


def capped_quotes(quotes: Column, most: int = 5, chars: int = 1000) -> Column:
    kept = F.filter(F.slice(quotes, 1, most), lambda q: q["speaker"].isNotNull() & q["text"].isNotNull())
    return F.transform(kept, lambda q: F.struct(q["speaker"].alias("speaker"), F.substring(q["text"], 1, chars).alias("text")))


def canonical_article(fields: list[Column], assets: Column) -> Column:
    """Fields joined by bars, then ticker, direction and outlooks of the primary assets in order of ticker."""
    primary = F.array_sort(F.transform(F.filter(assets, lambda a: a["is_primary"]), lambda a: F.struct(a["ticker"], a["direction"], a["short"], a["medium"], a["long"])))
    each = F.transform(primary, lambda a: F.concat_ws("|", a["ticker"], a["direction"], a["short"], a["medium"], a["long"]))
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("none")) for c in fields], F.when(F.size(each) > 0, F.array_join(each, "|")))


def canonical_post(fields: list[Column], evidence: Column) -> Column:
    return F.concat(*[x for c in fields for x in (c.cast("string"), F.lit("|"))], F.array_join(F.array_sort(F.transform(evidence, F.lower)), "|"))


def categorical_key(fields: list[Column]) -> Column:
    """Fields joined by bars; a null is empty."""
    return F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in fields]), "|")


def analysis_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def validate_record(df: DataFrame, ranges: dict[str, tuple[float, float]], lengths: dict[str, int], enums: dict[str, list[str]]) -> DataFrame:
    """``df`` with is_valid and invalid_reason: the first field out of its range, length or set."""
    reason = F.lit(None).cast("string")
    checks = [(f"{c} out of range", ~F.col(c).between(*r)) for c, r in ranges.items()] + [(f"{c} too long", F.length(c) > n) for c, n in lengths.items()] + [(f"{c} unknown", ~F.col(c).isin(v)) for c, v in enums.items()]
    for text, bad in reversed(checks):
        reason = F.when(bad, text).otherwise(reason)
    return df.withColumn("invalid_reason", reason).withColumn("is_valid", F.col("invalid_reason").isNull())


def penalty_detail(discrepancies: DataFrame) -> DataFrame:
    """worker, epoch, resource_id, cause, failed_fields, preview, score of discrepancies with a known cause and an id."""
    cause = F.try_element_at(F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv]), F.col("reason"))
    failed = F.transform(F.filter(F.map_entries("field_results"), lambda e: ~e["value"]), lambda e: e["key"])
    rows = discrepancies.select("worker", "epoch", "resource_id", cause.alias("cause"), F.when(F.size(failed) > 0, F.array_join(F.array_sort(failed), ",")).alias("failed_fields"), "preview", F.coalesce("composite", "agreement").alias("score"))
    return rows.where("cause IS NOT NULL AND resource_id IS NOT NULL")


def accepted_attestations(messages: DataFrame, nodes: DataFrame, blocked: list[str], cap: int = POINT_CAP) -> DataFrame:
    """sender, epoch, root, uid, points of attestations that count.

    The signer must be the sender, the signature valid and the sender not blocked; the signed epoch is the number that
    has to grow. Points are finite, positive, rounded half to even and at most ``cap``; unknown workers are dropped; an
    attestation without points left still uses up its epoch. A root that isn't 64 hexadecimal digits is dropped.
    """
    sane = messages.where((F.col("sender") == F.col("signer")) & F.col("signature_ok") & ~F.col("sender").isin(blocked))
    before = F.max("epoch").over(Window.partitionBy("sender").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    fresh = sane.withColumn("before", F.coalesce(before, F.lit(-1))).where(F.col("epoch") > F.col("before"))
    points = fresh.select("sender", "epoch", F.when(F.col("root").rlike("^[0-9a-f]{64}$"), F.col("root")).otherwise("").alias("root"), F.explode("points").alias("worker", "p"))
    known = nodes.groupBy("worker").agg(F.min("uid").alias("uid"))
    rows = points.where(~F.isnan("p") & (F.abs("p") < float("inf")) & (F.col("p") > 0)).join(small(known), "worker")
    return rows.withColumn("points", F.bround("p", 0).cast("long")).where(F.col("points").between(1, cap)).select("sender", "epoch", "root", "uid", "points")


def message_group_class(messages: DataFrame, context: DataFrame, registry: DataFrame, inherited: DataFrame) -> DataFrame:
    """message_id, class_id, confidence, message_count, contributing, labels: class of a message with its context.

    The text is that of the context in reverse and then the message; an inherited class wins with high confidence.
    """
    texts = messages.select("message_id", "sender", "content")
    listed = context.select("message_id", F.posexplode(F.concat(F.reverse("context"), F.array("message_id"))).alias("pos", "part"))
    parts = listed.join(texts.withColumnRenamed("message_id", "part"), "part")
    joined = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sender", "content"))).alias("l"), F.count("*").alias("message_count"))
    whole = joined.select("message_id", "message_count", F.array_join(F.transform("l", lambda m: m["content"]), " ").alias("text"), F.array_join(F.transform("l", lambda m: F.concat(m["sender"], F.lit(": "), m["content"])), "\n").alias("labels"))
    found = match.top_keyword_class(whole, registry, doc="message_id")
    own = match.top_keyword_class(texts.withColumnRenamed("content", "text"), registry, doc="message_id").where("class_id <> 0").select(F.col("message_id").alias("part"))
    gave = listed.join(own, "part").groupBy("message_id").agg(F.array_sort(F.collect_list("part")).alias("contributing"))
    rows = whole.join(found, "message_id").join(gave, "message_id", "left").join(inherited.select("message_id", F.col("class_id").alias("given")), "message_id", "left")
    return rows.select("message_id", F.coalesce("given", "class_id").alias("class_id"), F.when(F.col("given").isNotNull(), "high").otherwise(F.col("confidence")).alias("confidence"), "message_count", F.coalesce("contributing", F.array().cast("array<bigint>")).alias("contributing"), F.sha2("labels", 256).alias("labels"))


def gazetteer_integrity(gazetteer: DataFrame, assets: DataFrame, word_freq: DataFrame, banned: list[str], common: float = 4.0) -> DataFrame:
    """keyword, problem: identifiers that two equities share, banned terms, single words that are too common."""
    rows = gazetteer.where("kind IN ('identifier', 'alias')").join(small(assets.select("asset_id", "asset_class")), "asset_id").withColumn("keyword", F.lower(F.trim("keyword")))
    shared = rows.where("asset_class = 'equity'").groupBy("keyword").agg(F.countDistinct("asset_id").alias("n")).where("n > 1").select("keyword", F.lit("shared").alias("problem"))
    listed = rows.where(F.col("keyword").isin(banned)).select("keyword", F.lit("banned").alias("problem"))
    frequent = rows.where(~F.col("keyword").contains(" ")).join(small(word_freq.where(F.col("zipf") >= common).select(F.col("word").alias("keyword"))), "keyword", "left_semi").select("keyword", F.lit("common").alias("problem"))
    return shared.union(listed).union(frequent).distinct()


def gold_eval(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: how often the language is right (of the cases that give one), recall of expected assets, forbidden assets
    found, forbidden parts of entity names found (entity_leaks), directions with the right sign.

    predicted: id, language, assets, entities, direction; gold: id, language, expect_assets, forbid_assets,
    forbid_entities, direction. A part leaks if the entity names of its case, joined with spaces, hold it in any case.
    """
    found = predicted.select("id", F.explode("assets").alias("ticker"))
    expected = gold.select("id", F.explode(F.array_distinct("expect_assets")).alias("ticker"))
    recall = expected.join(found.distinct().withColumn("hit", F.lit(1.0)), ["id", "ticker"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("asset_recall"))
    leaks = gold.select("id", F.explode(F.array_distinct("forbid_assets")).alias("ticker")).join(found.distinct(), ["id", "ticker"], "left_semi").agg(F.count("*").alias("forbidden_found"))
    names = predicted.select("id", F.lower(F.array_join("entities", " ")).alias("names"))
    parts = gold.select("id", F.explode("forbid_entities").alias("part")).join(names, "id").agg(F.count_if(F.col("names").contains(F.lower("part"))).alias("entity_leaks"))
    both = gold.select("id", F.col("language").alias("want"), F.col("direction").alias("want_sign")).join(predicted.select("id", "language", "direction"), "id")
    rates = both.agg(F.avg(F.when(F.col("want") != "", F.col("want").eqNullSafe(F.col("language")).cast("double"))).alias("language_accuracy"), F.avg((F.signum("want_sign") == F.signum("direction")).cast("double")).alias("direction_agreement"))
    return recall.crossJoin(leaks).crossJoin(parts).crossJoin(rates)  # each is one row


def corpus_compare(old: DataFrame, new: DataFrame, junk: list[str] | None = None, k: int = 12) -> DataFrame:
    """kind, key, old, new: counts of languages and tickers before and after, of relabelled languages, of all mentions of
    assets, of mentions of ``junk`` tickers, and of the ``k`` top tickers of either side (top_old, top_new; ties by ticker).

    A frame with a column weak (booleans beside its assets: only ambiguous words and no cashtag speak for it) counts a junk
    ticker only where it is weak.
    """
    sides = {"old": old, "new": new}
    language = {side: d.select(F.col("language").alias("key")) for side, d in sides.items()}
    weak = {side: F.col("weak") if "weak" in d.columns else F.transform("assets", lambda a: F.lit(True)) for side, d in sides.items()}
    ticker = {side: d.select(F.explode(F.arrays_zip(F.col("assets").alias("key"), weak[side].alias("weak"))).alias("a")).select("a.key", "a.weak") for side, d in sides.items()}

    def counted(kind: str, rows: dict[str, DataFrame]) -> DataFrame:
        both = None
        for side, d in rows.items():
            n = F.lit(1).cast("long")
            part = d.select("key", *[(n if x == side else n - 1).alias(x) for x in sides])
            both = part if both is None else both.union(part)
        return both.groupBy("key").agg(*[F.sum(x).alias(x) for x in sides]).select(F.lit(kind).alias("kind"), "key", *sides)

    tickers = counted("ticker", ticker)
    out = counted("language", language).union(tickers)
    whole = lambda kind, rows: counted(kind, rows).groupBy("kind").agg(*[F.sum(x).alias(x) for x in sides]).select("kind", F.lit("all").alias("key"), *sides)
    out = out.union(whole("mentions", ticker)).union(whole("junk", {side: d.where(F.col("weak") & F.col("key").isin(junk or [])) for side, d in ticker.items()}))
    for side in sides:
        out = out.union(tickers.where(F.col(side) > 0).orderBy(F.desc(side), "key").limit(k).select(F.lit(f"top_{side}").alias("kind"), "key", *sides))
    moved = old.select("id", F.col("language").alias("a")).join(new.select("id", F.col("language").alias("b")), "id").agg(F.count_if(F.col("a") != F.col("b")).alias("n"))
    return out.union(moved.select(F.lit("relabelled").alias("kind"), F.lit("all").alias("key"), F.lit(0).cast("long").alias("old"), F.col("n").alias("new")))
