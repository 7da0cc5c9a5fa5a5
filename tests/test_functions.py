"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import scores as S
from feedloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "score"), [("bullish", "very_bullish", 1.0), ("very_bullish", "very_bearish", 0.0), ("bullish", "neutral", 0.8), ("odd", "odd", 1.0), ("odd", "bullish", 0.0)])
def test_sentiment_agreement(spark, a, b, score):
    assert one(spark, S.sentiment_agreement(F.lit(a), F.lit(b))) == pytest.approx(score)


@pytest.mark.parametrize(("net", "n", "agree", "label"), [(0, 4, 2, "neutral"), (3, 4, 3, "very_bullish"), (1, 1, 1, "bullish"), (-2, 5, 2, "bearish"), (-1, 5, 2, "slightly_bearish"), (2, 0, 1, "neutral")])
def test_votes(spark, net, n, agree, label):
    assert one(spark, S.vote_to_sentiment(F.lit(net), F.lit(n), F.lit(agree))[0]) == label


@pytest.mark.parametrize(("text", "bucket"), [("a long-term plan", "long"), ("fell today", "short"), ("guidance this year", "medium"), ("nothing here", "medium"), ("today and next year", "long"), (None, "medium")])
def test_horizon(spark, text, bucket):
    assert one(spark, S.horizon_bucket(F.lit(text))) == bucket


@pytest.mark.parametrize(("d", "s", "m", "l", "out"), [("bullish", "bearish", "very_bearish", "neutral", "very_bearish"), ("bullish", "neutral", "neutral", "neutral", "bullish"), ("bullish", "bearish", "bullish", "bearish", "bullish"), ("neutral", "bearish", "bearish", "bearish", "neutral"), ("bearish", "bullish", "slightly_bullish", "bullish", "bullish")])
def test_reconcile(spark, d, s, m, l, out):  # noqa: E741
    assert one(spark, S.reconcile_direction(*map(F.lit, (d, s, m, l)))) == out


@pytest.mark.parametrize(("raw", "out"), [("2024-03-01", "2024-03-01"), ("2024-01-10", None), ("2023", None), ("n/a", None), ("next quarter", "next quarter"), (None, None), (" 2024-02 ", "2024-02")])
def test_forward_date(spark, raw, out):
    assert one(spark, S.sanitize_forward_date(F.lit(raw), F.lit("2024-01-15T00:00:00Z"))) == out


@pytest.mark.parametrize(("t", "session"), [("2024-01-05T13:10:00Z", "pre_market"), ("2024-01-05T14:00:00Z", "regular"), ("2024-01-05T22:00:00Z", "after_hours"), ("2024-01-06T15:00:00Z", "weekend"), ("never", "regular"), (None, "regular")])
def test_market_session(spark, t, session):
    assert one(spark, S.market_session(F.lit(t))) == session


def test_levenshtein_counts_characters(spark):
    assert one(spark, S.levenshtein_ratio(F.lit("né"), F.lit("ne"))) == 0.5
    assert one(spark, S.levenshtein_ratio(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, S.levenshtein_ratio(F.lit(None).cast("string"), F.lit(""))) == 1.0


def test_both_jaccards(spark):
    empty, ab = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, S.jaccard(empty, empty)) == 1.0
    assert one(spark, S.jaccard(empty, empty, None)) is None
    assert one(spark, S.jaccard(ab, F.array(F.lit("b")))) == 0.5


def test_length_features(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in T.length_features(F.lit("One two. Three!\n\nFour")).items()]).first()
    assert (row.word_count, row.sentence_count, row.paragraph_count) == (4, 3, 2)
    row = spark.range(1).select(*[c.alias(n) for n, c in T.length_features(F.lit("")).items()]).first()
    assert (row.word_count, row.sentence_count, row.paragraph_count, row.avg_word_length) == (0, 0, 0, 0)


def test_clean_text_keeps_short_articles_and_guards_long_ones(spark):
    assert one(spark, T.clean_text(F.lit("<p>Profit rose.</p> Follow us on Google and others. Photo: AFP"))) == "Profit rose."
    assert one(spark, T.clean_text(F.lit("Advertisement"))) == "Advertisement"
    long = "Photo: " + "x" * 500
    assert one(spark, T.clean_text(F.lit(long))) == long


def test_normalize_for_compare(spark):
    assert one(spark, T.normalize_for_compare(F.lit("The plan of the  a the city"))) == "the plan of the city"


@pytest.mark.parametrize(("text", "out"), [("Elon Musk-backed firm", "Elon Musk"), ("Anthropic principle", "Anthropic"), ("-led", "-led"), ("Acme", "Acme")])
def test_entity_trim(spark, text, out):
    assert one(spark, T.entity_text_trim(F.lit(text))) == out


def test_copy_ratio(spark):
    same = T.copy_ratio(F.lit("a b c d"), F.lit("a b c d e"))
    assert one(spark, same["copy"]) == 1.0 and one(spark, same["abstractive"]) == pytest.approx(0.0)
    none = T.copy_ratio(F.lit("a b"), F.lit("a b c"))
    assert one(spark, none["abstractive"]) == 0.0


def test_emission_gate(spark):
    assert one(spark, S.emission_gate(F.lit(0.59))) == pytest.approx(0.5)
    assert one(spark, S.emission_gate(F.lit(0.9), ceiling=0.5)) == pytest.approx(1.5)


def test_entity_trim_takes_lines_and_spaces_as_python_does(spark):
    assert one(spark, T.entity_text_trim(F.lit("\u00a0Elon\u2028Musk-backed firm\t"))) == "Elon\u2028Musk"
    assert one(spark, T.entity_text_trim(F.lit("Acme\u00a0law"))) == "Acme"


def test_edit_distance_looks_at_what_differs_only():
    random = __import__("random").Random(3)
    for _ in range(300):
        a = "".join(random.choices("abé", k=random.randint(0, 90)))
        b = a[: random.randint(0, 90)] + "b" + a[random.randint(0, 90) :] if random.random() < 0.5 else "".join(random.choices("abé", k=random.randint(0, 90)))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        assert S.edit_distance(a, b) == row[-1]
    import time

    long = "abcdefghij" * 20_000
    start = time.process_time()
    assert S.edit_distance(long + "x" + long, long + "yz" + long) == 2
    assert time.process_time() - start < 5
