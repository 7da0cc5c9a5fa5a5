"""Scalar scores and lookups as column expressions: ladders, set and text similarity, recency, value, dates, gates."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import text_of

# Ordinal ladders, from one end to the other.
LADDERS = {
    "sentiment": ["very_bullish", "bullish", "slightly_bullish", "neutral", "slightly_bearish", "bearish", "very_bearish"],
    "sentiment_direction": ["positive", "neutral", "negative"],
    "impact": ["critical", "high", "medium", "low", "negligible"],
    "technical_quality": ["exceptional", "high", "medium", "low", "none"],
    "urgency": ["flash", "breaking", "developing", "same_day", "evergreen"],
    "factual_confidence": ["confirmed", "attributed", "speculative", "conditional", "rumor"],
}
SENTIMENT = LADDERS["sentiment"]
# Caps of the five parts of a post's value.
POST_CAPS = {"likes": 5000, "reposts": 1000, "quotes": 300, "replies": 600, "followers": 200_000}
# Time cues of a sentence.
SHORT_CUES = ["today", "this morning", "this afternoon", "intraday", "this week", "this session", "pre-?market", "after-?hours", "overnight", "on the day", "in early trading", "midday", "at the open", "at the close", "right now", "currently", "so far today"]
LONG_CUES = ["long-?term", "in the long run", "next year", "coming years", r"over the next \w+ years", r"by 20[2-9]\d", "multi-?year", "decade", "secular", "structural(?:ly)?", "strateg(?:y|ic)", "transformation", "roadmap", "pipeline", "for years to come", "over time"]
MEDIUM_CUES = ["next quarter", "coming quarters", "this year", "full-?year", "fiscal year", "guidance", "outlook", "forecast", "in the coming months", "over the coming months", "near-?term"]
# Market sectors to the topic taxonomy (id, symbol).
GICS = {
    "information technology": (7, "TECH"),
    "technology": (7, "TECH"),
    "communication services": (7, "TECH"),
    "communications": (7, "TECH"),
    "health care": (8, "SCIENCE"),
    "healthcare": (8, "SCIENCE"),
    "energy": (5, "COMMODITIES"),
    "materials": (5, "COMMODITIES"),
    "basic materials": (5, "COMMODITIES"),
    "financials": (4, "EQUITIES"),
    "financial services": (4, "EQUITIES"),
    "finance": (4, "EQUITIES"),
    "consumer discretionary": (4, "EQUITIES"),
    "consumer staples": (4, "EQUITIES"),
    "consumer cyclical": (4, "EQUITIES"),
    "consumer defensive": (4, "EQUITIES"),
    "industrials": (4, "EQUITIES"),
    "utilities": (4, "EQUITIES"),
    "real estate": (4, "EQUITIES"),
}
OTHER_SECTOR = (9, "OTHER")
SENTIMENT_VALUES = {"very_bullish": 1.0, "bullish": 0.5, "neutral": 0.0, "bearish": -0.5, "very_bearish": -1.0}
#: Seconds after which an item counts no more, and in which recency falls to zero.
MAX_AGE_S, RECENCY_HOURS = 10 * 86_400, 24.0


def lookup(values: dict) -> Column:
    """A literal map."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def rank(label: Column, ladder: list[str]) -> Column:
    """Place on a ladder, from 0; null if the label isn't on it."""
    return F.try_element_at(lookup({x: i for i, x in enumerate(ladder)}), label)


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    a, b = text_of(a), text_of(b)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def edit_distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace) between two texts, by bit vectors: a column of the table is two numbers of as many
    bits as the shorter text has characters, and a step to the next column is a few operations on whole numbers."""
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    for c, found in places.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in found:
            bits[i >> 3] |= 1 << (i & 7)
        masks[c] = int.from_bytes(bits, "little")
    whole = (1 << len(a)) - 1
    up, down = whole, 0  # where the table grows and falls by one from row to row
    get = masks.get
    for c in b:
        same = get(c, 0)
        equal = (((same & up) + up) ^ up | same | down) & whole
        grows = ((down | whole ^ (equal | up)) << 1 | 1) & whole
        up = (equal & up) << 1 & whole | whole ^ (equal | grows)
        down = grows & equal
    return len(b) + up.bit_count() - down.bit_count()  # from the top of the last column to its end


def whole_text_ratio(a: Column, b: Column) -> Column:
    """1 - edits / longer length, as :func:`levenshtein_ratio`, for texts of any length: its time is their product / 64."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else 0.0 if not x or not y else 1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in zip(left, right, strict=True)], dtype=float)

    return ratio(text_of(a), text_of(b))


def jaccard(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(F.array_distinct(a), b)) / union)


def ordinal_score(pred: Column, gold: Column, ladder: list[str]) -> Column:
    gap = F.abs(rank(pred, ladder) - rank(gold, ladder))
    return F.when(pred == gold, 1.0).otherwise(F.coalesce(1 - gap / (len(ladder) - 1), F.lit(0.0)))


def sentiment_agreement(a: Column, b: Column) -> Column:
    """1 within one step of the ladder, then less by a fifth for each further step; equality for labels off it."""
    gap = F.abs(rank(a, SENTIMENT) - rank(b, SENTIMENT))
    return F.when(gap <= 1, 1.0).when(gap.isNotNull(), F.greatest(F.lit(0.0), 1 - (gap - 1) / 5)).otherwise((a == b).cast("double"))


def vote_to_sentiment(net: Column, n: Column, agree: Column) -> tuple[Column, Column]:
    """Label and magnitude of ``net`` votes among ``n``, of which ``agree`` share the winning sign."""
    strength = F.abs(net) / n
    none = (n <= 0) | (net == 0)
    side = F.when(net > 0, "bullish").otherwise("bearish")
    degree = F.when((strength >= 0.75) & (agree >= 2), "very_").when(strength >= 0.4, "").otherwise("slightly_")
    return F.when(none, "neutral").otherwise(F.concat(degree, side)), F.when(none, 0.0).otherwise(strength)


def _cues(text: Column, cues: list[str]) -> Column:
    return sum((F.coalesce(text, F.lit("")).rlike(rf"(?i)\b{c}\b").cast("int") for c in cues), F.lit(0))


def horizon_bucket(sentence: Column) -> Column:
    """short, medium or long by the kind of time cue that occurs most; ties go to long, then short; none is medium."""
    short, long, medium = _cues(sentence, SHORT_CUES), _cues(sentence, LONG_CUES), _cues(sentence, MEDIUM_CUES)
    best = F.greatest(short, long, medium)
    return F.when(best == 0, "medium").when(long == best, "long").when(short == best, "short").otherwise("medium")


def sign(label: Column) -> Column:
    """1 bullish, -1 bearish, 0 neutral or unknown."""
    return F.coalesce(F.signum(3 - rank(label, SENTIMENT)), F.lit(0)).cast("int")


def reconcile_direction(direction: Column, short: Column, medium: Column, long: Column) -> Column:
    """A direction that all horizons speak against becomes the strongest of those; else it stays."""
    own = sign(direction)
    agrees = (sign(short) == own) | (sign(medium) == own) | (sign(long) == own)

    def weight(h: Column) -> Column:
        return F.when(sign(h) == -own, F.abs(rank(h, SENTIMENT) - 3)).otherwise(-1)

    best = F.greatest(weight(short), weight(medium), weight(long))
    strongest = F.when(weight(short) == best, short).when(weight(medium) == best, medium).otherwise(long)
    return F.when((own == 0) | agrees | (best < 0), direction).otherwise(strongest)


def decay_one_step(label: Column) -> Column:
    """The next label toward neutral."""
    at = rank(label, SENTIMENT)
    return F.coalesce(F.get(F.array(*map(F.lit, SENTIMENT)), (at + F.signum(3 - at)).cast("int")), F.lit("neutral"))


def market_session(published: Column) -> Column:
    """Session of an ISO time in UTC; unreadable times count as regular. The session time zone must be UTC."""
    t = F.try_to_timestamp(published)
    hour = F.hour(t)
    return F.when(t.isNull(), "regular").when(F.weekday(t) >= 5, "weekend").when(hour == 13, "pre_market").when(hour.between(14, 20), "regular").otherwise("after_hours")


def sanitize_forward_date(raw: Column, published: Column) -> Column:
    """A forward date that doesn't lie before publication; text without a date stays; null-like words become null."""
    s = F.trim(raw)
    year = F.regexp_extract(s, r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", 1)
    full = F.regexp_extract(s, r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", 0)
    day = F.regexp_extract(text_of(published), r"\d{4}-\d{2}-\d{2}", 0)
    dated = (day != "") & (year != "")
    stale = dated & ((year.try_cast("int") < F.substring(day, 1, 4).try_cast("int")) | ((year == F.substring(day, 1, 4)) & (F.length(full) == 10) & (full < day)))
    return F.when(s.isNull() | F.lower(s).isin("", "null", "none", "n/a", "na", "tbd", "unknown", "-") | stale, None).otherwise(s)


def recency(age_s: Column, hours: float = RECENCY_HOURS) -> Column:
    return clamp01(1 - age_s / 3600.0 / hours)


def post_value(likes: Column, reposts: Column, quotes: Column, replies: Column, followers: Column) -> Column:
    parts = zip((likes, reposts, quotes, replies, followers), POST_CAPS.values(), strict=True)
    return sum((clamp01(F.coalesce(c, F.lit(0)) / cap) for c, cap in parts), F.lit(0.0)) / 5


def mixed_score(relevant: Column, value: Column, age_s: Column) -> Column:
    """Half relevance, four tenths value, a tenth recency; 0 without a date or beyond ten days."""
    score = clamp01(0.5 * relevant.cast("double") + 0.4 * value + 0.1 * recency(age_s))
    return F.when(age_s.isNull() | (age_s > MAX_AGE_S), 0.0).otherwise(score)


def article_value(credibility: Column, content: Column) -> Column:
    return 0.6 * F.coalesce(credibility, F.lit(0.5)) + 0.4 * F.when(text_of(content) != "", 1.0).otherwise(0.5)


def source_id(source: Column) -> Column:
    return F.translate(F.lower(text_of(source)), " -", "__")


def safe_enum(c: Column, allowed: list[str], default: str) -> Column:
    """The allowed value that a label equals in lower case or as it is, without spaces around; else the default."""
    s = F.trim(c)
    return F.when(F.lower(s).isin(allowed), F.lower(s)).when(s.isin(allowed), s).otherwise(default)


def gics_to_sector(c: Column) -> tuple[Column, Column]:
    key = F.lower(F.trim(text_of(c)))
    return (
        F.coalesce(F.try_element_at(lookup({k: v[0] for k, v in GICS.items()}), key), F.lit(OTHER_SECTOR[0])),
        F.coalesce(F.try_element_at(lookup({k: v[1] for k, v in GICS.items()}), key), F.lit(OTHER_SECTOR[1])),
    )


def sentiment_to_float(c: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(SENTIMENT_VALUES), c), F.lit(0.0))


def emission_gate(reputation: Column, middle: float = 0.59, steep: float = 100.0, start: float = 0.63, full: float = 0.75, ceiling: float = 0.0) -> Column:
    """A logistic gate, raised by up to ``ceiling`` between ``start`` and ``full`` (a step at ``start`` if they don't differ)."""
    ramp = clamp01((reputation - start) / (full - start)) if full > start else (reputation >= start).cast("double")
    return 1 / (1 + F.exp(-steep * (reputation - middle))) * (1 + ceiling * ramp)


def content_weight(length: Column) -> Column:
    return F.when(length >= 2000, 3).when(length >= 500, 2).otherwise(1)


def language_bucket(code: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(code, F.lit("en")))).isin("en", ""), "en").otherwise("non-en")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))
