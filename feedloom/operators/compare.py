"""Comparison of independently made analyses: hard gates, tolerant scores, verdicts, clone pairs.

Pairs carry a submission's fields with the prefix ``m_`` and a reference's with ``v_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scores as S
from feedloom.functions.text import normalize_for_compare
from feedloom.shared import small

# Fields, weights and floors of the comparison.
ENUMS = {
    "overall_sentiment": "sentiment",
    "sentiment_direction": "sentiment_direction",
    "impact_potential": "impact",
    "technical_quality": "technical_quality",
    "urgency": "urgency",
    "factual_confidence": "factual_confidence",
    "temporal_focus": None,
    "market_analysis_type": None,
    "positioning_signal": None,
    "target_audience": None,
    "forward_event_type": None,
    "staleness_flag": None,
    "credibility_flag": None,
    "content_type": None,
    "primary_geo": None,
    "event_type": None,
    "event_date": None,
}
WEIGHTS = {"enums": 0.42, "assets": 0.15, "summary": 0.10, "entities": 0.08, "economic": 0.07, "event": 0.08, "narrative": 0.05, "embedding": 0.05}
TIER3_FLOOR, AGREEMENT_FLOOR, CONTAGION_FLOOR, COSINE_FLOOR, SUMMARY_FLOOR = 0.70, 0.80, 0.9, 0.90, 0.4
CLONE_ABOVE, CLONE_LEAD, CLONE_LEAST = 0.99, 0.05, 3
VALIDATOR_SIDE = ["reference_failed", "validator_error"]
CAPACITY = ["timeout", "missing_analysis", "capacity"]


def _m(name: str) -> Column:
    return F.col(f"m_{name}")


def _v(name: str) -> Column:
    return F.col(f"v_{name}")


def tier1_gate() -> Column:
    """Language bucket and primary sector are equal."""
    return (S.language_bucket(_m("language")) == S.language_bucket(_v("language"))) & _m("sector_id").eqNullSafe(_v("sector_id"))


def tier2_gate() -> Column:
    """Content hash and text counts are equal."""
    ok = F.lit(True)
    for name in ("content_hash", "word_count", "sentence_count", "char_count", "ticker_count"):
        ok = ok & _m(name).eqNullSafe(_v(name))
    return ok


def asset_presence_gate(floor: int = 1) -> Column:
    """False if the reference found ``floor`` assets or more by keyword and the submission has none."""
    by_keyword = F.size(F.filter(_v("assets"), lambda a: a["via"] == "keyword"))
    return ~((by_keyword >= floor) & (F.size(_m("assets")) == 0))


def embedding_gate(dim: int, floor: float = COSINE_FLOOR) -> Column:
    """ok, missing, zero_vector, not_normalized or mismatch, for the title and the narrative embedding.

    A side that the reference lacks is skipped; only the title's cosine is gated.
    """
    well = lambda c: F.coalesce(F.size(c) == dim, F.lit(False))
    names = ("title_embedding", "narrative_embedding")
    missing = [well(_v(n)) & ~well(_m(n)) for n in names]
    both = [well(_v(n)) & well(_m(n)) for n in names]
    norms = [(S.norm(_m(n)), S.norm(_v(n))) for n in names]
    out = F.when(missing[0] | missing[1], "missing")
    for (a, b), ok in zip(norms, both, strict=True):
        out = out.when(ok & ((a < 0.01) | (b < 0.01)), "zero_vector").when(ok & ((F.abs(a - 1) > 0.05) | (F.abs(b - 1) > 0.05)), "not_normalized")
    return out.when(both[0] & (S.dot(_m(names[0]), _v(names[0])) < floor), "mismatch").otherwise("ok")


def contagion_gate(floor: float = CONTAGION_FLOOR) -> Column:
    return S.jaccard(_m("links"), _v("links")) >= floor


def asset_agreement(pairs: DataFrame, key: str = "article_id") -> DataFrame:
    """key, n_common, agreement: the mean over common tickers of the agreement on direction and three outlooks.

    Without common tickers the agreement is 1 and nothing is gated.
    """
    m = pairs.select(key, F.explode("m_assets").alias("a")).select(key, "a.ticker", F.col("a").alias("a"))
    v = pairs.select(key, F.explode("v_assets").alias("b")).select(key, "b.ticker", F.col("b").alias("b"))
    fields = ("direction", "short", "medium", "long")
    per = sum((S.sentiment_agreement(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields), F.lit(0.0)) / len(fields)
    common = m.join(v, [key, "ticker"]).groupBy(key).agg(F.count("*").alias("n_common"), F.avg(per).alias("agreement"))
    return pairs.select(key).join(common, key, "left").select(key, F.coalesce("n_common", F.lit(0)).alias("n_common"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"))


#: Texts that are compared in normalised form; normalised() adds them once, as each score uses them several times.
TEXTS = ("headline", "one_liner", "paragraph", "event_title")


def normalised(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({f"n{side}_{t}": normalize_for_compare(F.col(f"{side}_{t}")) for side in ("m", "v") for t in TEXTS})


def tier3_parts() -> dict[str, Column]:
    """The eight parts of the tolerant score, over pairs with normalised texts."""
    enums = []
    for name, ladder in ENUMS.items():
        a, b = F.coalesce(F.lower(_m(name)), F.lit("none")), F.coalesce(F.lower(_v(name)), F.lit("none"))
        enums.append(S.ordinal_score(a, b, S.LADDERS[ladder]) if ladder else (a == b).cast("double"))
    text = lambda n: S.levenshtein_ratio(F.col(f"nm_{n}"), F.col(f"nv_{n}"))
    lower = lambda c: F.array_distinct(F.transform(c, F.lower))
    tickers = lambda c: F.array_distinct(F.transform(c, lambda a: a["ticker"]))
    return {
        "enums": sum(enums, F.lit(0.0)) / len(enums),
        "assets": S.jaccard(tickers(_m("assets")), tickers(_v("assets"))),
        "summary": 0.4 * text("headline") + 0.3 * text("one_liner") + 0.3 * text("paragraph"),
        "entities": S.jaccard(lower(_m("entities")), lower(_v("entities"))),
        "economic": S.jaccard(_m("economic"), _v("economic")),
        "event": 0.5 * text("event_title") + 0.5 * S.jaccard(_m("fingerprint"), _v("fingerprint")),
        "narrative": S.jaccard(lower(_m("narratives")), lower(_v("narratives"))),
        "embedding": F.coalesce(F.greatest(F.lit(0.0), S.dot(_m("narrative_embedding"), _v("narrative_embedding"))), F.lit(1.0)),
    }


def tier3_composite(pairs: DataFrame, dim: int, floor: float = TIER3_FLOOR, key: str = "article_id") -> DataFrame:
    """key, failed_gate (the first, or null), composite (0 behind a failed gate) and is_valid."""
    agreed = asset_agreement(pairs, key)
    scored = normalised(pairs).select("*", *[c.alias(f"part_{n}") for n, c in tier3_parts().items()])
    composite = sum((F.col(f"part_{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    gate = (
        F.when(~F.col("g.tier1"), "tier1").when(~F.col("g.tier2"), "tier2").when(~F.col("g.presence"), "asset_presence")
        .when((F.col("n_common") > 0) & (F.col("agreement") < AGREEMENT_FLOOR), "asset_agreement").when(~F.col("g.contagion"), "contagion").when(F.col("e") != "ok", "embedding")
    )
    rows = scored.select(key, gate_columns().alias("g"), embedding_gate(dim).alias("e"), composite.alias("c")).join(agreed, key)
    rows = rows.select(key, gate.alias("failed_gate"), "c")
    score = F.when(F.col("failed_gate").isNull(), F.col("c")).otherwise(0.0)
    return rows.select(key, "failed_gate", score.alias("composite"), (F.col("failed_gate").isNull() & (score >= floor)).alias("is_valid"))


def gate_columns() -> Column:
    """The gates that need nothing but the pair."""
    return F.struct(tier1_gate().alias("tier1"), tier2_gate().alias("tier2"), asset_presence_gate().alias("presence"), contagion_gate().alias("contagion"))


def pair_submissions(submissions: DataFrame, references: DataFrame, key: str = "article_id") -> DataFrame:
    """Submissions with their reference, matched on the key as text; has_reference tells which have one."""
    m = submissions.select(*[F.col(c).alias(c if c == key else f"m_{c}") for c in submissions.columns]).withColumn("k", F.col(key).cast("string"))
    v = references.select(F.col(key).cast("string").alias("k"), *[F.col(c).alias(f"v_{c}") for c in references.columns if c != key], F.lit(True).alias("has_reference"))
    return m.join(v, "k", "left").withColumn("has_reference", F.coalesce("has_reference", F.lit(False))).drop("k")


def title_content_match(pairs: DataFrame, key: str = "article_id", batch: str = "batch_id") -> DataFrame:
    """batch, rejected: any claimed title that is empty or differs from the reference's rejects its batch."""
    own = normalize_for_compare(_m("title"))
    ok = ~F.col("has_reference") | ((own != "") & (own == normalize_for_compare(_v("title"))))
    return pairs.groupBy(batch).agg(F.count_if(~ok).alias("mismatches"), F.max(~ok).alias("rejected"))


def summary_agreement(pairs: DataFrame, floor: float = SUMMARY_FLOOR, key: str = "article_id") -> DataFrame:
    """key, cosine, mismatch: null where a text is shorter than three characters or a vector is missing."""
    usable = (F.length(_m("summary")) >= 3) & (F.length(_v("summary")) >= 3)
    c = F.when(usable, S.cosine(_m("vector"), _v("vector")))
    return pairs.select(key, c.alias("cosine"), (c < floor).alias("mismatch"))


def exact_match(pairs: DataFrame, fields: list[str], key: str = "article_id") -> DataFrame:
    """key, one boolean a field (equal without regard to case), and the reason of the verdict."""
    same = {f: F.coalesce(F.lower(_m(f)) == F.lower(_v(f)), _m(f).isNull() & _v(f).isNull()) for f in fields}
    every = F.lit(True)
    for c in same.values():
        every = every & c
    reason = F.when(F.col(key).isNull(), "missing_id").when(_m("missing"), "missing_analysis").when(_v("failed"), "reference_failed").when(every, "ok").otherwise("mismatch")
    return pairs.select(key, *[c.alias(f"same_{f}") for f, c in same.items()], reason.alias("reason"))


def map_tolerance(sub: Column, ref: Column, eps: float = 0.05, tol: float = 0.05, k: int = 128) -> dict[str, Column]:
    """Keys whose values differ by more than ``tol`` (small values count as absent), worst five first.

    All reference keys count; the submission's own keys up to ``k`` together, the largest values first.
    """
    a, b = F.map_filter(sub, lambda _, v: F.abs(v) >= eps), F.map_filter(ref, lambda _, v: F.abs(v) >= eps)
    extra = F.array_sort(F.transform(F.map_entries(F.map_filter(a, lambda key, _: ~F.map_contains_key(b, key))), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("key"))))
    keys = F.concat(F.map_keys(b), F.transform(F.slice(extra, F.lit(1), F.greatest(F.lit(0), F.lit(k) - F.size(b))), lambda e: e["key"]))
    at = lambda m, key: F.coalesce(F.try_element_at(m, key), F.lit(0.0))
    diffs = F.filter(F.transform(keys, lambda key: F.struct((-F.abs(at(a, key) - at(b, key))).alias("d"), key.alias("key"))), lambda e: -e["d"] > tol)
    return {"n_diffs": F.size(diffs).cast("long"), "worst": F.array_join(F.transform(F.slice(F.array_sort(diffs), 1, 5), lambda e: e["key"]), ",")}


def clone_pairs(vectors: DataFrame, above: float = CLONE_ABOVE, batch: str = "batch_id", pos: str = "pos", vector: str = "vector", reference: str | None = None) -> DataFrame:
    """batch, a, b, sim: pairs of a batch (of three vectors or more) whose dot product is above the bar.

    With reference vectors a pair is dropped if its similarity exceeds that of the references by less than 0.05. A batch
    is a dozen rows, so the join inside it stays small.
    """
    sizes = vectors.groupBy(batch).agg(F.count("*").alias("n")).where(F.col("n") >= CLONE_LEAST)
    rows = vectors.join(small(sizes.select(batch)), batch, "left_semi")
    side = lambda tag: rows.select(batch, F.col(pos).alias(tag), F.col(vector).alias(f"{tag}_v"), *([F.col(reference).alias(f"{tag}_r")] if reference else []))
    found = side("a").join(side("b"), batch).where(F.col("a") < F.col("b")).withColumn("sim", S.dot(F.col("a_v"), F.col("b_v"))).where(F.col("sim") > above)
    if reference:
        found = found.where(F.col("a_r").isNull() | F.col("b_r").isNull() | (F.col("sim") - S.dot(F.col("a_r"), F.col("b_r")) >= CLONE_LEAD))
    return found.select(batch, "a", "b", "sim")


def batch_verdict(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, n, matches, match_rate, composite (of the matches), valid."""
    ok = F.col("is_valid")
    rows = results.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(ok).alias("matches"), F.avg(F.when(ok, F.col("composite"))).alias("composite"))
    return rows.withColumn("match_rate", F.col("matches") / F.col("n")).withColumn("valid", F.col("matches") == F.col("n"))


def failure_class(discrepancies: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, class: integrity if any reason is neither capacity nor the validator's own; validator_side if all are its own."""
    reason = F.col("reason")
    own = reason.isin(VALIDATOR_SIDE)
    capacity = reason.isin(CAPACITY) | reason.startswith("invalid_analysis_data")
    return discrepancies.groupBy(batch).agg(F.when(F.max(~own & ~capacity), "integrity").when(F.min(own), "validator_side").otherwise("capacity").alias("class"))


def rarity_weights(reference: DataFrame, fields: list[str], least: int = 200) -> DataFrame:
    """field, label, weight: -log2 of the label's share (at least a hundredth); nothing below ``least`` records."""
    rows = reference.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("label")) for f in fields])).alias("x")).select("x.*")
    return rarity_of_counts(rows.groupBy("field", "label").agg(F.count("*").alias("n")), least).drop("total")


def rarity_of_counts(counts: DataFrame, least: int = 200) -> DataFrame:
    """field, label, weight and total (records of the field) of counts (field, label, n): one row for each label."""
    total = F.sum("n").over(Window.partitionBy("field"))
    return counts.withColumn("total", total).where(F.col("total") >= least).select("field", "label", (-F.log2(F.greatest(F.lit(0.01), F.col("n") / F.col("total")))).alias("weight"), "total")


def faithfulness(cosine: Column, copy_spread: Column, n_tokens: Column, own_polarity: Column, text_polarity: Column) -> Column:
    """Weighted geometric mean of groundedness, abstractiveness and consistency."""
    consistent = F.when((n_tokens < 8) | text_polarity.isNull(), 0.7).when(own_polarity == text_polarity, 1.0).when((own_polarity == 0) | (text_polarity == 0), 0.7).otherwise(0.5)
    floor = lambda c: F.log(F.greatest(c, F.lit(1e-6)))
    return F.exp(0.45 * floor(F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))) + 0.40 * floor(copy_spread) + 0.15 * floor(consistent))


def quality_score(grounding: Column, enums: Column, extract: Column, semantic: Column, faithful: Column) -> Column:
    """The lesser of faithfulness and the weighted mean of the parts that are present."""
    parts = [(grounding, 0.45), (enums, 0.30), (extract, 0.15), (semantic, 0.10)]
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    mean = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0)) / total
    return F.greatest(F.lit(0.0), F.least(F.when(total > 0, mean).otherwise(0.0), faithful))


def mean_present(*parts: Column) -> Column:
    """Mean of the parts that aren't null."""
    n = sum((c.isNotNull().cast("int") for c in parts), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0)) / n)
