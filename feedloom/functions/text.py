"""Text features of articles, as column expressions: lengths, readability, densities, structure, titles, cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists, patterns and thresholds of the text features.
HEDGING = ["might", "could", "may", "possibly", "perhaps", "likely", "unlikely", "reportedly", "allegedly", "apparently", "seems", "appears", "suggests", "potential", "potentially", "estimated", "approximately", "speculated", "rumored"]
CERTAINTY = ["will", "confirmed", "definitive", "definitively", "certain", "certainly", "guaranteed", "absolutely", "undoubtedly", "clearly", "obviously", "announced", "officially", "verified", "proven"]
BULLISH_TERMS = ["surge", "soar", "rally", "jump", "gain", "rise", "bull", "record high", "ath", "boom", "breakout"]
BEARISH_TERMS = ["crash", "plunge", "drop", "fall", "sink", "bear", "collapse", "slump", "tumble", "selloff", "dump"]
CLICKBAIT = [
    r"(?i)you won't believe",
    r"(?i)this is (huge|massive|insane|crazy)",
    r"(?i)here'?s why",
    r"(?i)\d+ (things|reasons|ways)",
    r"(?i)(shocking|stunning|jaw.dropping)",
    r"(?i)what .+ doesn't want you to know",
    r"(🚀|💰|🔥|⚡){2,}",
    r"!!+",
    r"\b(BREAKING|URGENT|ALERT)\b",
]
NUMBER = r"[$€£¥]?\d[\d,]*\.?\d*[%]?"
QUOTE = r'"[^"]{10,}"'
TICKER = r"\$[A-Z]{1,6}\b"
LINK = r"https?://\S+"
TABLE = r"\|.*\|.*\|"
CODE = r"```[\s\S]*?```|`[^`]+`"
SUBHEADING = r"(?m)^#{1,4}\s|^[A-Z][A-Za-z\s]{3,50}:$|^[A-Z][A-Za-z\s]{3,50}\n={3,}"
BOILERPLATE = [
    r"(?i)\b(?:follow|like|connect with|find)\s+(?:us|me)\s+on\b[^.!?\n]*[.!?]?",
    r"(?i)\bshare\s+(?:this\s+)?on\b[^.!?\n]*[.!?]?",
    r"(?i)\(?\s*(?:photo|image|picture|credit|getty)\s*[:/][^)\n.!?]*\)?[.!?]?",
    r"(?i)\bphoto by\b[^.!?\n]*[.!?]?",
    r"(?i)\bgetty images\b",
    r"(?i)\b(?:reuters|afp|epa|ap)\s*/\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*",
    r"(?i)\b(?:subscribe to our newsletter|sign up for our[^.!?\n]*|accept (?:all )?cookies|advertisement|read more)\b[^.!?\n]*[.!?]?",
]
GUARD_LENGTH, GUARD_SHARE = 400, 0.4
EDGE = r".,!?;:'\""
#: Python's white space, as Java matches it with the flag U.
SPACE = r"(?U)\s+"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), SPACE, " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(r"(?U)\S+"), F.lit(0))


def pieces(c: Column, pattern: str) -> Column:
    """Parts between matches that aren't blank."""
    return F.filter(F.split(text_of(c), pattern), lambda x: x.rlike(r"(?U)\S"))


def rounded(value: Column, places: int) -> Column:
    """A value (below 2^40 or so) rounded to decimal places as its binary form lies, halves to the even digit.

    The built-in forms round the shortest decimal form of a double: 2.675 would become 2.68, though the double lies below it.
    Where that form is a half, the value is compared with it without error: a double in two halves of its bits.
    """
    scale = float(10 ** (places + 1))

    def by_bits(x: Column) -> Column:
        k = F.rint(x * scale)
        high = x * 134217729.0 - (x * 134217729.0 - x)
        off = (high * scale - k) + (x - high) * scale
        down = F.floor(k / 10)
        up = (off > 0) | ((off == 0) & (down % 2 == 1))
        half = (F.abs(k) % 10 == 5) & (F.abs(x * scale - k) <= 1e-9 * F.greatest(F.abs(k), F.lit(1.0)))
        return F.when(half, (down + up.cast("int")) / (scale / 10)).otherwise(F.round(x, places))

    return F.element_at(F.transform(F.array(value.cast("double")), by_bits), 1)


def length_features(body: Column) -> dict[str, Column]:
    """Counts of characters, words, sentences and paragraphs, and mean lengths; an empty text has none of any."""
    body = text_of(body)
    some = F.length(body) > 0
    n_words = F.regexp_count(body, F.lit(r"(?U)\S+"))
    sentences = F.when(some, F.greatest(F.size(pieces(body, r"(?<=[.!?])(?U:\s+)")), F.lit(1))).otherwise(0)
    paragraphs = F.when(some, F.greatest(F.size(pieces(body, r"\n(?U:\s*)\n")), F.lit(1))).otherwise(0)
    return {
        "char_count": F.length(body).cast("long"),
        "word_count": n_words.cast("long"),
        "sentence_count": sentences.cast("long"),
        "paragraph_count": paragraphs.cast("long"),
        "avg_sentence_length": rounded(n_words / F.greatest(sentences, F.lit(1)), 2),
        "avg_word_length": rounded(F.length(F.regexp_replace(body, SPACE, "")) / F.greatest(n_words, F.lit(1)), 2),
    }


def bare_word(w: Column) -> Column:
    """Lower case without punctuation at the edges."""
    return F.regexp_replace(F.lower(w), rf"^[{EDGE}]+|[{EDGE}]+$", "")


def syllables(body: Column) -> Column:
    """Syllables of a text: vowel groups of each word, less a silent last e; short words have one.

    Every word is looked at once; in a lambda each use of an expression would evaluate it again.
    """
    shape = F.transform(F.transform(words(body), bare_word), lambda w: F.struct(F.length(w).alias("n"), F.regexp_count(w, F.lit("[aeiouy]+")).alias("groups"), w.endswith("e").alias("e")))
    return F.aggregate(shape, F.lit(0), lambda total, w: total + F.when(w["n"] <= 2, 1).otherwise(F.greatest(w["groups"] - F.when(w["e"] & (w["groups"] > 1), 1).otherwise(0), F.lit(1)))).cast("long")


def readability(df: DataFrame, body: str) -> DataFrame:
    """``df`` with syllables, Flesch reading ease (0 to 100) and Flesch-Kincaid grade (0 or more); null without words."""
    shape = length_features(F.col(body))
    rows = df.withColumns({"_words": shape["word_count"], "_sentences": shape["sentence_count"], "syllables": syllables(F.col(body))})
    n, sentences, total = F.col("_words"), F.col("_sentences"), F.col("syllables")
    usable = (n > 0) & (sentences > 0)
    ease = 206.835 - 1.015 * (n / sentences) - 84.6 * (total / n)
    grade = 0.39 * (n / sentences) + 11.8 * (total / n) - 15.59
    return rows.withColumns({"flesch_ease": F.when(usable, rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)), 2)), "flesch_kincaid": F.when(usable, rounded(F.greatest(F.lit(0.0), grade), 2))}).drop("_words", "_sentences")


def density_features(body: Column) -> dict[str, Column]:
    """Shares of numbers and quoted text, counts of tickers, links and images."""
    body = text_of(body)
    n = F.greatest(F.regexp_count(body, F.lit(r"(?U)\S+")), F.lit(1))
    quoted = F.aggregate(F.regexp_extract_all(body, F.lit(QUOTE), F.lit(0)), F.lit(0), lambda total, q: total + F.length(q))
    tickers = F.regexp_extract_all(body, F.lit(TICKER), F.lit(0))
    return {
        "numeric_density": rounded(F.least(F.lit(1.0), F.regexp_count(body, F.lit(NUMBER)) / n), 4),
        "quote_density": rounded(F.least(F.lit(1.0), quoted / F.greatest(F.length(body), F.lit(1))), 4),
        "ticker_mentions": F.size(tickers).cast("long"),
        "unique_tickers": F.size(F.array_distinct(tickers)).cast("long"),
        "link_count": F.regexp_count(body, F.lit(LINK)).cast("long"),
        "image_count": (F.regexp_count(body, F.lit(r"!\[")) + F.regexp_count(body, F.lit(r"(?i)<img"))).cast("long"),
    }


def structure_flags(body: Column) -> dict[str, Column]:
    body = text_of(body)
    return {
        "has_table": body.rlike(TABLE),
        "has_chart": F.lower(body).rlike("chart|graph|figure|diagram"),
        "has_code": body.rlike(CODE),
        "subheadings": F.regexp_count(body, F.lit(SUBHEADING)).cast("long"),
    }


def _hits(c: Column, terms: list[str]) -> Column:
    return sum((c.contains(t).cast("int") for t in terms), F.lit(0))


def title_features(title: Column) -> dict[str, Column]:
    title = text_of(title)
    bull, bear = _hits(F.lower(title), BULLISH_TERMS), _hits(F.lower(title), BEARISH_TERMS)
    mood = F.when(bull > bear, F.when(bull == 1, "bullish").otherwise("very_bullish")).when(bear > bull, F.when(bear == 1, "bearish").otherwise("very_bearish")).otherwise("neutral")
    return {"title_words": F.regexp_count(title, F.lit(r"(?U)\S+")).cast("long"), "title_has_number": title.rlike(r"\d"), "title_has_question": title.contains("?"), "title_sentiment": mood}


def language_style(body: Column, title: Column) -> dict[str, Column]:
    """Shares of hedging and of certain words, and how many clickbait patterns a title shows (of three)."""
    found = words(F.lower(text_of(body)))
    n = F.size(found)

    def share(terms: list[str]) -> Column:
        hits = F.size(F.filter(found, lambda w: bare_word(w).isin(terms)))
        return F.when(n == 0, 0.0).otherwise(rounded(F.least(F.lit(1.0), hits / n), 4))

    bait = sum((text_of(title).rlike(p).cast("int") for p in CLICKBAIT), F.lit(0))
    return {"hedging": share(HEDGING), "certainty": share(CERTAINTY), "clickbait": rounded(F.least(F.lit(1.0), bait / 3), 4)}


def clean_text(c: Column) -> Column:
    """Text without tags and boilerplate phrases; the text without tags where cleaning would take nearly all of it."""
    base = squeezed(F.regexp_replace(text_of(c), "<[^>]+>", " "))
    out = base
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, pattern, " ")
    out = squeezed(out)
    gutted = (F.length(base) >= GUARD_LENGTH) & (F.length(out) < GUARD_SHARE * F.length(base))
    return F.when((out == "") | gutted, base).otherwise(out)


def norm_text(c: Column) -> Column:
    """NFC and single spaces. NFC is the one step without a built-in function."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    return squeezed(nfc(text_of(c)))


def norm_author(c: Column) -> Column:
    return F.trim(F.lower(text_of(c)))


def normalize_for_compare(c: Column) -> Column:
    """Lower case, single spaces, inner articles dropped (ends and half of doubled ones stay)."""
    out = squeezed(F.lower(text_of(c)))
    for article in (" a ", " an ", " the "):
        out = F.replace(out, F.lit(article), F.lit(" "))
    return squeezed(out)


def content_hash(title: Column, content: Column) -> Column:
    """SHA-256 of the lower-cased title and the first 500 characters of the content, white space squeezed."""
    both = F.concat(text_of(title), F.lit(" "), F.substring(text_of(content), 1, 500))
    return F.sha2(squeezed(F.lower(both)), 256)


def sentences(c: Column) -> Column:
    """Sentences of more than 20 characters, the first 20 of them, cut to 200 characters; decimals stay whole."""
    cut = F.split(text_of(c), r"(?<!\d)[.!?]+(?!\d)(?U:\s+)|\n+")
    long = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"^(?U:\s+)|(?U:\s+)$", ""))), lambda s: F.length(s) > 20)
    return F.transform(F.slice(long, 1, 20), lambda s: F.substring(s, 1, 200))


# What follows an entity without being part of it.
MODIFIERS = ["backed", "led", "owned", "run", "based", "controlled", "style", "era", "related", "linked", "funded", "driven", "focused", "themed", "branded", "sponsored", "affiliated"]
APPOSITIVES = ["principle", "effect", "equation", "paradox", "theorem", "conjecture", "law", "constant", "hypothesis"]


def entity_text_trim(c: Column) -> Column:
    """An entity without a tail like "-backed ..." and then without one like " principle"; never trimmed to nothing."""
    stripped = lambda x: F.regexp_replace(x, r"^(?U:\s+)|(?U:\s+)$", "")
    out = stripped(text_of(c))
    for pattern in (rf"(?idU)^(.*?)-(?:{'|'.join(MODIFIERS)})\b.*$", rf"(?idU)^(.+?)\s+(?:{'|'.join(APPOSITIVES)})$"):
        head = stripped(F.regexp_extract(out, pattern, 1))
        out = F.when(head == "", out).otherwise(head)
    return out


def copy_ratio(summary: Column, body: Column) -> dict[str, Column]:
    """Share of the summary's distinct word trigrams that the body has, and how far that is from copying."""

    def grams(c: Column) -> Column:
        # Three shifted copies side by side: inside a lambda the words would be found anew for every place.
        w = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"(?U)\w+"), F.lit(0))
        n = F.greatest(F.size(w) - 2, F.lit(0))
        two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.array_distinct(F.zip_with(two, F.slice(w, F.lit(3), n), lambda x, y: F.concat(x, F.lit(" "), y)))

    own, other = grams(summary), grams(body)
    copy = F.size(F.array_intersect(own, other)) / F.size(own)
    spread = F.when(F.size(own) == 0, 0.0).when(F.size(other) == 0, 1.0).otherwise(1 - F.greatest(F.lit(0.0), (copy - 0.35) / 0.65))
    return {"copy": F.when(F.size(own) > 0, copy).otherwise(0.0), "abstractive": spread}
