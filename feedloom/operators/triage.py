"""Grading of triage claims, their routing, observations and pay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.scores import content_weight

# Labels, reasons, flags and weights of triage.
LABELS = ["relevant", "irrelevant", "borderline"]
REASONS = ["non_economic", "local_no_market_impact", "promo_spam", "other"]
FLAGS = ["valuable", "not_valuable"]
MARKET_SECTORS = ["MACRO", "MONETARY", "MARKET", "EQUITIES", "COMMODITIES", "CRYPTO", "GEOPOLITICS", "TECH", "ENERGY", "RATES"]
BORDERLINE_CAP, HARD, SOFT, FEE, POINTS = 3, 2.0, 0.4, 0.2, 6


def record_error(triage: Column) -> Column:
    """Why a triage record (label, reason_code, flag) is malformed; null if it is fine or there is none."""
    return (
        F.when(triage.isNull(), None).when(~F.coalesce(triage["label"].isin(LABELS), F.lit(False)), "bad_label")
        .when((triage["label"] == "irrelevant") & ~F.coalesce(triage["reason_code"].isin(REASONS), F.lit(False)), "missing_reason")
        .when(triage["flag"].isNotNull() & ~triage["flag"].isin(FLAGS), "bad_flag")
    )


def indicates_value(n_assets: Column, n_economic: Column, sector: Column) -> Column:
    """An analysis with an asset, an economic datum or a sector next to the market."""
    return (n_assets > 0) | (n_economic > 0) | F.coalesce(sector.isin(MARKET_SECTORS), F.lit(False))


def triage_labels(items: DataFrame, cap: int = BORDERLINE_CAP) -> DataFrame:
    """Items with their graded label: a malformed or missing record is irrelevant, and so is a borderline claim after
    the ``cap``-th of its batch."""
    border = (F.col("claim") == "borderline") & F.col("well_formed")
    nth = F.sum(F.when(border, 1).otherwise(0)).over(Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("label", F.when(~F.col("well_formed"), "irrelevant").when(border & (nth > cap), "irrelevant").otherwise(F.col("claim")))


def triage_events(labelled: DataFrame) -> DataFrame:
    """batch_id, article_id, severity, code: what is wrong with the claims of a batch.

    ``labelled`` has, besides the label: well_formed, flag, analysed, valuable, proof_ok, canary (pos, neg or null),
    canary_sure, has_asset, verdict (outside judgement, or null), stage_irrelevant.
    """
    rows = labelled
    event = lambda when, severity, code: rows.where(when).select("batch_id", "article_id", severity.alias("severity") if isinstance(severity, Column) else F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    border, flagged = F.col("label") == "borderline", (F.col("label") == "borderline") & F.col("analysed") & F.col("flag").isNotNull()
    mismatch = flagged & ((F.col("flag") == "valuable") != F.col("valuable"))
    kept = flagged & (F.col("flag") == "valuable") & F.col("valuable")
    plain = F.col("canary").isNull() & F.col("proof_ok")
    open_claim = (F.col("label") != "relevant") & ~kept & plain
    sampled = Window.partitionBy("batch_id").orderBy(F.md5(F.col("article_id").cast("string")), "article_id")  # a draw that comes out the same again
    clean = rows.where(open_claim & ~F.col("has_asset") & (F.col("label") == "irrelevant")).withColumn("i", F.row_number().over(sampled)).where("i = 1 AND verdict")
    parts = [
        event(~F.col("proof_ok"), "hard", "proof_failure"),
        event(~F.col("well_formed"), "soft", "triage_malformed"),
        event(mismatch, "soft", "borderline_flag_mismatch"),
        event(flagged & ~mismatch & (F.col("flag") == "not_valuable") & F.col("stage_irrelevant"), "soft", "borderline_unwarranted"),
        event((F.col("label") != "relevant") & F.col("canary").isNull() & ~(border & F.col("flag").isNotNull()) & F.col("analysed"), "soft", "analysis_on_nonrelevant"),
        event(F.col("proof_ok") & (F.col("canary") == "pos") & (F.col("label") != "relevant"), F.when(F.col("canary_sure"), "hard").otherwise("soft"), "canary_pos_missed"),
        event(F.col("proof_ok") & (F.col("canary") == "neg") & (F.col("label") == "relevant"), "soft", "canary_neg_flagged"),
        event(open_claim & F.col("has_asset"), "hard", "false_negative_deterministic"),
        clean.select("batch_id", "article_id", F.lit("soft").alias("severity"), F.lit("false_negative_llm").alias("code")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def triage_routing(labelled: DataFrame, events: DataFrame) -> DataFrame:
    """batch_id, article_id, route: relevant, borderline, valuable, discard or retire; articles with events leave the last three."""
    flagged = (F.col("label") == "borderline") & F.col("analysed") & F.col("flag").isNotNull()
    route = (
        F.when(F.col("label") == "relevant", "relevant").when(flagged & (F.col("flag") == "valuable"), "valuable").when(flagged, "discard").when(F.col("label") == "borderline", "borderline")
        .when(F.col("proof_ok") & F.col("canary").isNull() | (F.col("canary") == "neg"), "retire")
    )
    bad = events.where("code <> 'proof_failure'").select("batch_id", "article_id").distinct().withColumn("bad", F.lit(True))
    rows = labelled.withColumn("route", route).join(bad, ["batch_id", "article_id"], "left")
    return rows.where(F.col("route").isNotNull() & (F.col("bad").isNull() | F.col("route").isin("relevant", "borderline"))).select("batch_id", "article_id", "route")


def observations(events: DataFrame, graded: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id, article_id, score, weight for reputation: events score 0, graded rows their score, a clean batch its first
    article; one row an article, with the lowest score and the largest weight."""
    wrong = events.select("batch_id", "article_id", F.lit(0.0).alias("score"), F.when(F.col("severity") == "hard", HARD).otherwise(SOFT).alias("weight"))
    own = graded.select("batch_id", "article_id", F.col("score").cast("double"), F.when(F.col("substantive"), 2.0).otherwise(1.0).alias("weight"))
    clean = batches.where("full_push").join(events.select("batch_id").distinct(), "batch_id", "left_anti").select("batch_id", F.col("first_article").alias("article_id"), F.lit(1.0).alias("score"), F.lit(1.0).alias("weight"))
    return wrong.union(own).union(clean).groupBy("batch_id", "article_id").agg(F.min("score").alias("score"), F.max("weight").alias("weight"))


def pay_split(graded: DataFrame, assignees: int) -> DataFrame:
    """batch_id, article_id, pay: the payout of a batch, attributed to its articles.

    A fee for each article and points by its length for those kept; shared by the assignees, rounded half to even, at
    least 1 for a full push.
    """
    due = FEE / assignees + F.when(F.col("kept") & ~F.col("false_positive") & ~F.col("rewarded"), POINTS * content_weight(F.col("length")) / assignees).otherwise(0.0)
    rows = graded.withColumn("due", due)
    totals = rows.groupBy("batch_id").agg(F.sum("due").alias("total"), F.max("full_push").alias("full"))
    totals = totals.withColumn("payout", F.greatest(F.bround("total", 0), F.when(F.col("full"), 1.0).otherwise(0.0)))
    return rows.join(totals, "batch_id").select("batch_id", "article_id", F.round(F.col("due") * F.col("payout") / F.col("total"), 4).alias("pay"), F.col("payout").cast("long").alias("payout"))
