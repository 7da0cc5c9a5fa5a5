"""Operators on small frames: gates, ledger rules, reputation, clusters, health, sources, streams."""


import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import scores, text, vectors
from feedloom.operators import attest, compare, entities, events, health, keywords, ledger, match, models, records
from feedloom.sources import feeds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_broadcast_rules(spark):
    sent = [(1, "a", 10, 10, {1: 5}), (2, "a", 10, 10, {1: 9}), (3, "a", 10, 11, {1: 7, 2: 9000, 3: 0}), (4, "a", 10, 900, {1: 1}), (5, "a", 12, 12, {1: -1}), (6, "a", 12, 12, {1: 2}), (7, "b", 12, 12, {4: 4})]
    df = spark.createDataFrame(sent, "arrival long, sender string, epoch long, seq long, points map<int,int>")
    got = {(r.sender, r.epoch): (r.seq, r.points) for r in ledger.accepted_broadcasts(df).collect()}
    # The empty payload of seq 12 uses its number up, so the later message with that number is refused.
    assert got == {("a", 10): (11, {1: 7}), ("b", 12): (12, {4: 4})}


def test_reputation_is_the_ordered_fold(spark):
    random.seed(3)
    seen = [(e, "v", t, a, random.random(), random.choice([0.4, 1.0, 2.0])) for t in ("x", "y") for e in range(6) for a in range(4)]
    df = spark.createDataFrame(random.sample(seen, len(seen)), "epoch long, sender string, target string, article_id long, score double, weight double")
    got = {r.target: (r.reputation, r.n) for r in ledger.reputation_replay(df).collect()}
    for t in ("x", "y"):
        value = 0.5
        for e, _, _, a, s, w in sorted(x for x in seen if x[2] == t):
            value = (1 - 0.03 * w) * value + 0.03 * w * s
        assert got[t][0] == pytest.approx(value) and got[t][1] == 24


def test_weights_do_not_depend_on_the_window(spark):
    one = spark.createDataFrame([(1, 10), (2, 30)], "uid long, reward long")
    ten = spark.createDataFrame([(1, 100), (2, 300)], "uid long, reward long")
    a = {r.uid: r.weight for r in ledger.weights(one, 100, 500.0, 0.02, 0.001).collect()}
    b = {r.uid: r.weight for r in ledger.weights(ten, 1000, 500.0, 0.02, 0.001).collect()}
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1.0)


def test_window_counts_held_epochs(spark):
    sums = spark.createDataFrame([(3, 1, 5)], "epoch long, worker long, points long")
    held = spark.createDataFrame([(2,), (3,), (9,)], "epoch long")
    assert rows(ledger.window_totals(sums, held, 1, 4)) == [(1, 5, 2)]


def test_touching_entities_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, 5, "Apple", "m1", "ORG", 0.7), (1, 0, 9, "Apple Inc", "m2", "ORG", 0.5), (1, 9, 12, "Bob", "m1", "P", 0.5), (1, 20, 24, "Cat", "m1", "P", 0.9)], "doc_id long, start long, end long, text string, model string, label string, score double")
    assert rows(entities.ground_entities(df).select("text", "models")) == [("Apple", 2), ("Cat", 1)]


def test_entity_fold_keeps_roles(spark):
    df = spark.createDataFrame([(1, 0, "Acme", "org", 0.5, "subject", None), (1, 1, "ACME", "org", 0.9, "mentioned", "bullish"), (1, 2, "acme", "org", 0.9, "peer", None)], "doc_id long, pos int, name string, type string, confidence double, role string, sentiment string")
    assert rows(entities.dedup_entities(df).select("name", "confidence", "role", "sentiment")) == [("ACME", 0.9, "subject", "bullish")]


def test_mentions_merge_overlaps(spark):
    df = spark.createDataFrame([("Apple Inc. and apple, AppleInc", ["Apple", "Apple Inc"]), ("none", ["zzz"]), (None, None)], "text string, forms array<string>")
    assert [(r.mention_count, r.first_offset) for r in entities.mention_counts(df).collect()] == [(2, 0), (1, None), (1, None)]


def test_mentions_roster_and_starts_equal_brute_force(spark):
    draw = random.Random(9)
    words = ["Acme", "Corp", "acme", "$AB", "a.b", "x", "Securities", "asked", "gained", "earnings call transcript", "Capital Markets", "é"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(120)]
    forms = ["Acme Corp", "Corp acme", "acme", "a.b", "x", " Gained "]
    df = spark.createDataFrame([(i, t, forms, i % 5 == 0) for i, t in enumerate(texts)], "id long, text string, forms array<string>, is_primary boolean")
    got = {r.id: (r.mention_count, r.first_offset) for r in entities.mention_counts(df).collect()}
    kept = {r.id for r in entities.transcript_roster(df).collect()}
    for i, t in enumerate(texts):
        spans = sorted(m.span() for f in {f.strip().lower() for f in forms} if len(f) > 2 for m in re.finditer(rf"\b{re.escape(f)}\b", t.lower()))
        n = sum(a >= max([-1, *(e for _, e in spans[:k])]) for k, (a, _) in enumerate(spans))
        assert got[i] == (max(1, n), spans[0][0] if spans else None), t
        ends = [m.end() for f in forms if len(f) > 2 for m in re.finditer(re.escape(f), t, re.I)]
        only = bool(ends) and bool(re.search(entities.CONFERENCE, t)) and all(re.search(entities.DESK, t[e : e + 40], re.I) for e in ends)
        assert (i in kept) == (i % 5 == 0 or not only), t


def test_disclosure_only_in_the_last_part(spark):
    df = spark.createDataFrame([("Disclosure: x. " + "a" * 50 + " Disclosure: y",), ("plain",), (None,)], "text string")
    assert [len(r.text) for r in entities.disclosure_tail(df, ["disclosure:"]).collect()] == [65, 5, 0]


def test_automaton_equals_regular_expressions(spark):
    draw = random.Random(4)
    words = ["gold", "$ABC", "ABC", "acme corp", "corp", "a a", "$AB", "x-y", "the", "ÉTÉ", "é", ".", "$abc1", "goldé", "_gold", "İ"]
    texts = ["".join(w + draw.choice([" ", " ", "", ",", "\n"]) for w in draw.choices(words, k=draw.randint(0, 30))) for _ in range(150)] + [None, ""]
    table = [("cashtag", "$ABC"), ("cashtag", "$ab"), ("case_sensitive", "ABC"), ("case_sensitive", "abc"), ("identifier", "gold"), ("identifier", "Acme Corp"), ("alias", "a a"), ("identifier", "x-y"), ("alias", "été"), ("alias", "$ABC")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = keywords.keyword_spots(docs, spark.createDataFrame(table, "kind string, keyword string"), "id", F.lit("gold x"), F.col("text"), near="acme", around=5)
    got = {(r.id, r.kind, r.keyword): (r.starts, r.in_title, r.context) for r in found.collect()}
    wanted = {}
    for i, t in enumerate(texts):
        text = "gold x\n" + (t or "")
        for kind, k in table:
            own, key = (text, k) if kind == "case_sensitive" else (text.lower(), k.lower())
            pattern = re.escape(key) + "(?![a-z0-9])" if kind == "cashtag" else rf"\b{re.escape(key)}\b"
            starts = [m.start() for m in re.finditer(pattern, own)]
            if starts:
                wanted[i, kind, k] = (starts, starts[0] + len(k) <= 6, any("acme" in own[max(s - 5, 0) : s + len(k) + 5] for s in starts))
    assert got == wanted and len(wanted) > 200


def test_cues_with_stems_are_those_of_the_pattern():
    draw, cue = random.Random(3), keywords.Cue(match.FINANCE + "|[$%]", match.FINANCE_STEMS)
    words = ["ETFs", "funds", "a stock", "Shares", "nyse", "option", "trading", "Rallied", "rallies", "gained", "sell-off", "indices", "index", "market  cap", "safe haven", "equities", "x", "the", "5%", "$1", "İ", "ſhares", "overshares"]
    for _ in range(500):
        text = " ".join(draw.choices(words, weights=[1] * 16 + [30, 30] + [1] * 5, k=draw.randint(1, 60)))
        low = text.lower()
        places = cue.places(low) if len(low) == len(text) else None
        for at in range(0, len(text), 7):
            assert cue.near(text, [at], 3, 20, places) == bool(re.search(match.FINANCE + "|[$%]", text[max(at - 20, 0) : at + 23]))


def test_automaton_of_two_hundred_thousand_keywords(spark):
    table = spark.range(200_000).selectExpr("'identifier' AS kind", "concat('key', id, ' name') AS keyword")
    docs = spark.createDataFrame([(i, f"of key{i * 997} name and key{i} names") for i in range(200)], "id long, text string")
    found = keywords.keyword_spots(docs, table, "id", None, F.col("text"))
    assert sorted((r.id, r.keyword, r.starts) for r in found.collect()) == [(i, f"key{i * 997} name", [3]) for i in range(200)]
    assert table.selectExpr("sum(length(keyword) + 8)").first()[0] > keywords.CHARS  # more than one list


def test_clone_pairs_need_three_vectors(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "batch_id long, pos int, vector array<double>")
    assert rows(compare.clone_pairs(df)) == [(2, 0, 1, 1.0)]


def test_failure_classes(spark):
    df = spark.createDataFrame([(1, "timeout"), (1, "clone"), (2, "reference_failed"), (3, "reference_failed"), (3, "invalid_analysis_data: x")], "batch_id long, reason string")
    assert rows(compare.failure_class(df)) == [(1, "integrity"), (2, "validator_side"), (3, "capacity")]


def test_cluster_events_does_not_depend_on_order(spark):
    unit = [1.0] + [0.0] * 63
    other = [0.0, 1.0] + [0.0] * 62
    data = [(5, "f1", "h1", 1, unit, ["a", "b"]), (3, "f1", "h2", 1, other, ["c"]), (9, "f9", "h2", 2, other, ["x", "y"]), (7, "f7", "h7", 3, unit, ["q"]), (8, "f8", "h8", 3, unit, ["r"]), (11, "fz", "hz", 4, other, ["k", "l", "m", "n"]), (12, "fy", "hy", 5, unit, ["k", "l", "m", "n", "o"]), (20, "fx", "hx", 6, unit, ["solo"])]
    schema = "id long, fingerprint string, content_hash string, event_type int, title_vector array<double>, title_words array<string>"
    want = [(3, 3), (5, 3), (7, 7), (8, 7), (9, 3), (11, 11), (12, 11), (20, 20)]
    for order in (data, data[::-1]):
        assert rows(events.cluster_events(spark.createDataFrame(order, schema))) == want


def test_title_pairs_are_exact(spark):
    random.seed(5)
    sets = {i: random.sample("abcdefghij", random.randint(1, 6)) for i in range(60)}
    df = spark.createDataFrame([(i, w) for i, w in sets.items()], "id long, words array<string>")
    first = {}
    for i, w in sets.items():
        first.setdefault(frozenset(w), i)
    want = sorted((min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) >= 0.6 * len(a | b))
    assert rows(events.title_pairs(df)) == want


def test_health_backoff_and_parking(spark):
    log = [(1, t, t, "timeout", None) for t in range(5)] + [(2, t, t, "faith", 0.1) for t in range(10)] + [(2, 50, 50, "faith", 0.9), (3, 1, 1, "valid", 10.0), (3, 2, 2, "valid", 900.0)]
    df = spark.createDataFrame(log, "worker long, ts_s long, seq long, kind string, value double")
    got = {r.worker: r for r in health.worker_health(df).collect()}
    assert got[1].until == 4 + 30 and got[1].window == 1.0
    assert got[2].parked_until == 0 and got[3].window == 4.25
    assert [(w, what) for w, _, what, *_ in rows(health.health_sessions(df)) if what != "batch_size_changed"] == [(2, "parked"), (2, "unparked")]
    sizes = sorted((w, t, a, b) for w, t, what, a, b in rows(health.health_sessions(df)) if what == "batch_size_changed")
    assert sizes == [(1, 0, 12, 9), (1, 1, 9, 6), (1, 2, 6, 5), (1, 3, 5, 4), (2, 9, 12, 9), (3, 1, 12, 14)]
    assert rows(health.parked_spans(health.health_sessions(df))) == [(2, 9, 50)]


def test_merkle_root_folds_like_a_list(spark):
    import hashlib
    import json

    def h(x):
        return hashlib.sha256(x.encode()).hexdigest()

    for n in (1, 2, 3, 5, 6, 7, 11):
        data = [(1, 2, "article", str(i), "w", "valid", "k", float(i)) for i in range(n)]
        got = attest.merkle_roots(spark.createDataFrame(data, "validator long, epoch long, resource_type string, resource_id string, worker string, verdict string, categorical_key string, points double")).first()
        level = sorted(h(json.dumps({"categorical_key": "k", "miner_hotkey": "w", "points_awarded": float(i), "resource_id": str(i), "resource_type": "article", "validator_verdict": "valid"}, sort_keys=True, separators=(",", ":"))) for i in range(n))
        while len(level) > 1:
            level = [h(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        assert (got.root, got.n) == (level[0], n)


def test_merkle_trees_of_several_blocks_and_proofs(spark):
    import hashlib

    def h(x):
        return hashlib.sha256(x.encode()).hexdigest()

    sizes = {1: 1023, 2: 1024, 3: 1025, 4: 2048, 5: 2051, 6: 3, 7: 4097}
    data = [(v, 9, "article", str(i // 2), "w", "valid", "k", float(i // 2)) for v, n in sizes.items() for i in range(n)]
    verdicts = spark.createDataFrame(data, "validator long, epoch long, resource_type string, resource_id string, worker string, verdict string, categorical_key string, points double").repartition(3)
    plan = attest.merkle_roots(verdicts)
    roots, own = {r.validator: (r.root, r.n) for r in plan.collect()}, {}
    for r in attest.leaves(verdicts).collect():
        own.setdefault(r.validator, []).append(r.leaf)
    for v, n in sizes.items():
        level = sorted(own[v])
        while len(level) > 1:
            level = [h(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        assert roots[v] == (level[0], n)
    asked = spark.createDataFrame([(v, 9, sorted(own[v])[i]) for v, n in sizes.items() for i in (0, n // 2, n - 1)] + [(1, 9, "none")], "validator long, epoch long, leaf string")
    proofs = attest.inclusion_proofs(verdicts, asked).withColumn("root", attest.proved_root(F.col("leaf"), F.col("proof"))).collect()
    assert {(r.validator, r.leaf) for r in proofs} == {(v, leaf) for v, _, leaf in map(tuple, asked.where("leaf <> 'none'").collect())}
    assert all(r.root == roots[r.validator][0] for r in proofs)
    assert max(len(r.proof) for r in proofs) == 13 and all(r.proof == [] for r in proofs if sizes[r.validator] == 1)


def test_numbers_round_as_they_lie(spark):
    draw = random.Random(1)
    values = [draw.randint(1, 4000) / draw.randint(1, 400) for _ in range(3000)] + [draw.randint(1, 100_000) / 1000 for _ in range(3000)] + [i / 8 for i in range(900)] + [2.675, 1.005, 0.0, 0.00005, 100.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.rounded(F.col("x"), 2).alias("two"), text.rounded(F.col("x"), 4).alias("four")).collect()
    assert all((r.two, r.four) == (round(r.x, 2), round(r.x, 4)) for r in got)


def test_edit_distance_equals_the_table():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ("".join(draw.choices("abcé", k=draw.choice([0, 1, 3, 20, 70, 130]))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert scores.edit_distance(a, b) == row[-1]
    assert scores.edit_distance("ab" * 20_000, "ba" * 20_000) == 2


def test_inherited_assets_of_chains_and_circles(spark):
    chain = [(i, i - 1 if i else None, 7 if i == 0 else None) for i in range(600)]  # all inherit from the first
    circle = [(1000, 1002, None), (1001, 1000, None), (1002, 1001, None), (1003, 1002, None)]
    other = [(2000, 2001, 5), (2001, 2000, None), (2002, 9999, None), (2003, 2001, 6), (2004, 2003, None), (2005, 2005, 3), (2006, 2006, None)]
    got = {r.message_id: (r.inherited_asset, r.inherited_from) for r in match.inherited_assets(spark.createDataFrame([*chain, *circle, *other], "message_id long, reply_to long, asset_id int")).collect()}
    assert all(got[i] == (7, 0) for i in range(1, 600)) and got[0] == (None, None)
    assert all(got[i] == (None, None) for i in (1000, 1001, 1002, 1003, 2002, 2006))
    assert (got[2000], got[2001], got[2003], got[2004], got[2005]) == ((5, 2000), (5, 2000), (5, 2000), (6, 2003), (3, 2005))


def test_narratives_fade_sleep_and_wake(spark):
    days = [(s, d) for s, ds in {"a": [0] * 25 + [4, 10, 50], "b": [0, 29], "c": [0, 30, 31], "d": [0, 5, 90]}.items() for d in ds]
    got = {}
    for r in events.narrative_history(spark.createDataFrame(days, "slug string, day long"), 92).orderBy("slug", "from_day").collect():
        got.setdefault(r.slug, []).append((r.from_day, r.state))
    assert got["a"] == [(0, "active"), (9, "fading"), (10, "active"), (15, "fading"), (40, "dormant"), (50, "active"), (55, "fading"), (80, "dormant")]
    assert got["b"] == [(0, "emerging"), (5, "fading"), (29, "emerging"), (34, "fading"), (59, "dormant")]
    assert got["c"] == [(0, "emerging"), (5, "fading"), (30, "active"), (36, "fading"), (61, "dormant")]
    assert got["d"] == [(0, "emerging"), (10, "fading"), (35, "dormant"), (90, "active")]
    now = {r.slug: r.state for r in events.narrative_lifecycle(spark.createDataFrame(days, "slug string, day long"), 92).collect()}
    assert now == {slug: states[-1][1] for slug, states in got.items()}


def test_gazetteer_boundaries(spark):
    articles = spark.createDataFrame([(1, "", "$ABCD and $ABC."), (2, "", "xacme corp acme corps"), (3, "Acme Corp", "acme corp stocks"), (4, None, None)], "article_id long, title string, body string")
    gazetteer = spark.createDataFrame([(1, "cashtag", "$ABC"), (1, "identifier", "acme corp"), (1, "identifier", "xx")], "asset_id int, kind string, keyword string")
    got = rows(match.gazetteer_hits(articles, gazetteer))
    assert got == [(1, 1, "cashtag", "$ABC", 1, False, True), (3, 1, "identifier", "acme corp", 2, True, True)]


def test_unreadable_state_is_empty(spark, tmp_path):
    assert feeds.read_state(spark, str(tmp_path / "none"), "worker long, epoch long").count() == 0


def test_writing_an_epoch_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "state")
    feeds.write_state(spark.createDataFrame([(1, 5, 1), (2, 6, 2)], "worker long, points long, epoch long"), path)
    feeds.write_state(spark.createDataFrame([(3, 7, 2)], "worker long, points long, epoch long"), path)
    assert rows(feeds.read_state(spark, path, "worker long, points long, epoch long")) == [(1, 5, 1), (3, 7, 2)]


def test_language_reads_the_whole_text(spark):
    import math
    import re
    from collections import Counter

    def grams(x):
        b = " " + re.sub(r"[^a-zé]+", " ", (x or "").lower()) + " "
        return [b[i : i + 3] for i in range(len(b) - 2)]

    # The first 2,000 characters are of one language, what follows of the other.
    data = [(1, "aa bab abba " * 40, "aa"), (2, "éé oxo exx " * 40 + "!", "ee"), (3, "aa bab abba " * 170 + "éé oxo exx " * 600, None), (4, "", None), (5, None, None), (6, "b" * 1999 + " oxo" * 900, "ee")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = {}
    for lang in ("aa", "ee"):
        n = Counter(g for _, x, k in data if k == lang for g in grams(x))
        top = sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:5]
        profiles[lang] = {g: math.log(c / sum(n.values())) for g, c in top}
    got = models.learn_profiles(df.where("lang IS NOT NULL"), "lang", "text", most=5)
    assert {(r.lang, r.trigram): r.weight for r in got.collect()} == pytest.approx({(k, g): w for k, p in profiles.items() for g, w in p.items()})
    found = {r.doc_id: (r.code, r.confidence) for r in models.detect_language(df, got, "doc_id", "text").collect()}
    for key, x, _ in data:
        own = grams(x)
        score = {k: sum(p[g] + 12 for g in own if g in p) / len(own) for k, p in profiles.items()} if own else {}
        best = max(sorted(score), key=score.get, default="en")
        want = math.exp(score[best]) / sum(map(math.exp, score.values())) if score else 0.0
        assert found[key][0] == best and found[key][1] == pytest.approx(want)
    assert found[3][0] == "ee"


def test_vector_pairs_miss_none_near_the_bar(spark):

    # 400 pairs of a type just above the bar, and 100 just below; vectors of others are far away.
    rng, data, close = np.random.default_rng(7), [], set()
    for i in range(500):
        u, v = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        c = 0.7501 if i < 400 else 0.7499
        data += [(2 * i, f"t{i % 2}", u.tolist()), (2 * i + 1, f"t{i % 2}", (c * u + (1 - c * c) ** 0.5 * v).tolist())]
    data += [(5000, "t0", data[0][2]), (5001, "t1", data[0][2]), (5002, None, data[0][2]), (5003, "t0", None), (5004, "t0", data[0][2][:3]), (5005, "t0", [None] + data[0][2][1:])]
    x = np.array([v for i, _, v in data if i < 5000])
    for a, b in zip(*np.nonzero(np.triu(x @ x.T, 1) > 0.75), strict=True):
        if data[a][1] == data[b][1]:
            close.add((int(a), int(b)))
    df = spark.createDataFrame(data, "id long, type string, vector array<double>")
    for block in (2000, 60):
        got = [(r.a, r.b) for r in events.similar_vectors(df, 0.75, "type", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == close and len(close) >= 400
    words = spark.createDataFrame([(i, f"f{i}", f"h{i}", t, v, [f"w{i}"]) for i, t, v in data if i < 1000], "id long, fingerprint string, content_hash string, event_type string, title_vector array<double>, title_words array<string>")
    event = {r.id: r.event_id for r in events.cluster_events(words).collect()}
    assert all(event[a] == event[b] for a, b in close if b < 1000)


def test_close_centroids_in_several_lists_equal_brute_force(spark):
    draw = np.random.default_rng(9)
    x, y = draw.normal(size=(70, 5)), draw.normal(size=(45, 5))
    articles = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (100, None), (101, []), (102, [1.0])], "id long, vector array<double>")
    narratives = spark.createDataFrame([*((f"n{j}", v.tolist()) for j, v in enumerate(y)), ("none", None), ("short", [2.0])], "slug string, centroid array<double>")
    for at_once in (20_000, 7):
        got = {(r.id, r.slug): r.sim for r in events.close_centroids(articles, narratives, 1.5, at_once).collect()}
        assert got == pytest.approx({(int(i), f"n{j}"): (x @ y.T)[i, j] for i, j in zip(*np.nonzero(x @ y.T >= 1.5), strict=True)} | {(102, "short"): 2.0})


def test_group_class_and_status_by_hand(spark):
    messages = spark.createDataFrame([(1, "ann", "buy $ABC now"), (2, "bob", "why?"), (3, "cy", "gold, gold"), (4, "dee", "nothing")], "message_id long, sender string, content string")
    context = spark.createDataFrame([(1, []), (2, [1]), (3, [2, 1]), (4, [])], "message_id long, context array<long>")
    registry = spark.createDataFrame([(1, "cashtag", "$ABC"), (2, "identifier", "gold"), (2, "identifier", "now")], "class_id int, kind string, keyword string")
    inherited = spark.createDataFrame([(4, 9)], "message_id long, class_id int")
    got = {r.message_id: (r.class_id, r.confidence, r.message_count, r.contributing) for r in records.message_group_class(messages, context, registry, inherited).collect()}
    assert got == {1: (1, "high", 1, [1]), 2: (1, "high", 2, [1]), 3: (1, "high", 3, [1, 3]), 4: (9, "high", 1, [])}
    state = dict(health.fresh(), window=6.0, timeouts=2.0, sends=3.0, fails=1.0, faiths=4.0, park_level=1.0, until=130.0, parked_until=190.0, size=17.9)
    known = spark.createDataFrame([(1, *map(float, state.values()))], f"worker long, {health.STATE}")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = health.worker_status(known, frame([(1, True), (2, True), (3, False)], "worker long, alive boolean"), frame([(1, 40), (1, 30)], "worker long, uid long"), 100, frame([(2, 5)], "worker long, inflight long"), frame([(1, 1.23456)], "worker long, median double"), frame([(1, 0.59)], "worker long, reputation double"))
    got = {r.worker: tuple(r)[1:] for r in rows.collect()}
    assert got == {1: (30, True, 6.0, 0, 2.0, 3, 1, 4, 1, 17, 90.0, True, 1.23, 0.5), 2: (-1, True, health.WINDOW_START, 5, 0.0, 0, 0, 0, 0, 12, 0.0, False, None, None)}


def test_vector_sums_take_nulls_and_lengths(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", None), ("b", [1.0]), ("b", [1.0, 5.0]), (None, [2.0])]
    df = spark.createDataFrame(rows, "slug string, vector array<double>").repartition(3)
    assert {r.slug: (r.total, r.n) for r in vectors.vector_sums(df, "slug", "vector").collect()} == {"a": ([4.0, 2.0], 3), "b": ([2.0, 5.0], 2), None: ([2.0], 1)}


def test_block_relevance_by_hand(spark):
    x = {0: [1.0, 0.0], 1: [0.6, 0.8], 2: [-1.0, 0.1]}
    df = spark.createDataFrame([(1, p, v, [0.0, 1.0]) for p, v in x.items()] + [(2, 0, [1.0, 1.0], None), (3, 0, [1.0, 1.0], [1.0, -1.0])], "doc_id long, pos int, vector array<double>, title_vector array<double>")
    got = {(r.doc_id, r.pos): (r.cosine, r.relevant) for r in entities.block_relevance(df).collect()}
    for p, v in x.items():
        others = np.mean([u for q, u in x.items() if q != p], axis=0)
        a = (others + np.array([0.0, 1.0])) / 2
        want = float(np.dot(v, a) / np.sqrt(np.dot(v, v) * np.dot(a, a)))
        assert got[1, p] == (pytest.approx(want), want >= 0.05)
    assert got[2, 0] == (None, True) and got[3, 0] == (pytest.approx(0.0), False)


def test_merged_events_equal_brute_force(spark):
    draw = random.Random(5)
    base = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(12)]

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    data = []
    for i in range(260):
        v = unit([x + draw.gauss(0, 0.25) for x in draw.choice(base)]) if draw.random() < 0.7 else unit(draw.choice(base))
        v = draw.choice([v, v, v, [0.5 * x for x in v], None])
        words = draw.choice([[], None, [f"w{draw.randrange(40)}" for _ in range(draw.randint(1, 4))], ["same", "title"]]) if draw.random() < 0.4 else [f"u{i}"]
        data.append((i, draw.choice(["x", "x", "y", None]), draw.randrange(60) * 20_000 + draw.randrange(3), words, v))
    links = {i: i for i, *_ in data}

    def root(i):
        while links[i] != i:
            i = links[i]
        return i

    for a, ka, ta, wa, va in data:
        for b, kb, tb, wb, vb in data:
            if a < b and ka == kb and ka is not None and abs(ta - tb) <= 48 * 3600:
                alike = wa is not None and wb is not None and (len(set(wa) & set(wb)) / len(set(wa) | set(wb)) >= 0.6 if set(wa) | set(wb) else True)
                if alike or va and vb and sum(x * y for x, y in zip(va, vb, strict=True)) >= 0.8:
                    x, y = root(a), root(b)
                    links[max(x, y)] = min(x, y)
    df = spark.createDataFrame(data, "id long, event_type string, first_s long, words array<string>, vector array<double>")
    got = {r.id: r.component for r in events.merge_clusters(df).collect()}
    assert got == {i: root(i) for i in links}
    assert 20 < len(set(got.values())) < 240


def test_pivots_spare_most_pairs_of_clustered_vectors(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(60, 16))
    x = centres[draw.integers(0, 60, 3000)] + draw.normal(scale=0.15, size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    blocks = events.near_blocks(df, 0.9, block=150).groupBy("cell", "kind", "i", "j").agg(F.count_if(F.col("side") == F.when(F.col("kind") == 0, F.col("i")).otherwise(0)).alias("n"), F.count_if(F.col("side") == F.when(F.col("kind") == 0, F.col("j")).otherwise(1)).alias("m")).collect()
    compared = sum(r.n * (r.n - 1) / 2 if r.kind == 0 and r.i == r.j else r.n * r.m for r in blocks)
    assert compared < 0.1 * len(x) * (len(x) - 1) / 2
    got = {(r.a, r.b) for r in events.similar_vectors(df, 0.9, block=150).collect()}
    a, b = np.nonzero(np.triu(x @ x.T > 0.9, 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 10_000


def test_centroid_drift_streams_a_narrative(spark):

    rng = np.random.default_rng(3)
    sizes = {"hot": 900, "b": 40, "c": 1, None: 5}
    data = [(slug, i, rng.normal(size=8).tolist()) for slug, n in sizes.items() for i in range(n)]
    shuffled = [data[i] for i in rng.permutation(len(data))]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = events.centroid_drift(spark.createDataFrame(shuffled, "slug string, seq long, vector array<double>"))
        # No group is gathered in one frame.
        plan = out._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan and "MapInPandas" in plan
        got = {r.slug: r.centroid for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = {}
    for slug, _, v in data:
        x = np.array(v) if slug not in want else 0.95 * want[slug] + 0.05 * np.array(v)
        want[slug] = x / np.linalg.norm(x)
    assert set(got) == set(want)
    for slug, x in want.items():
        assert got[slug] == pytest.approx(x.tolist())


def test_votes_without_a_majority_have_no_confidence(spark):
    mentions = spark.createDataFrame([(1, "ABC", i, "x", 0) for i in range(3)] + [(2, "ABC", 0, "next year", 1), (2, "ABC", 1, "today", -1), (2, "ABC", 2, "x", 0)], "doc_id long, ticker string, sent_pos int, text string, vote int")
    assets = spark.createDataFrame([(1, "ABC", False), (2, "ABC", True)], "doc_id long, ticker string, is_primary boolean")
    directions = spark.createDataFrame([(1, "bearish"), (2, "bullish")], "doc_id long, article_direction string")
    votes = entities.aspect_votes(mentions, assets, directions)
    got = {r.doc_id: r for r in votes.collect()}
    assert (got[1].direction, got[1].confidence, got[1].from_article) == ("neutral", 0.0, False)
    # A primary subject with conflicting mentions takes the article's direction, on all horizons.
    assert (got[2].direction, got[2].magnitude, got[2].confidence, got[2].from_article) == ("bullish", 0.4, 0.3, True)
    outlook = {r.doc_id: (r.short, r.medium, r.long) for r in entities.horizon_outlooks(mentions, votes).collect()}
    assert outlook[2] == ("bullish",) * 3


def test_subjects_by_name_in_the_title(spark):
    matches = spark.createDataFrame([(1, i, False) for i in (1, 2, 3, 4)], "article_id long, asset_id int, in_title boolean")
    articles = spark.createDataFrame([(1, "3M and Take-Two shares jump; target missed")], "article_id long, title string")
    assets = spark.createDataFrame([(1, "3M"), (2, "Take-Two Interactive"), (3, "Target Corp"), (4, "Globex")], "asset_id int, name string")
    common = spark.createDataFrame([("target",)], "word string")
    got = {r.asset_id: r.in_title for r in match.title_subjects(matches, articles, assets, common).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_vectors_without_structure_are_copied_for_wide_blocks_only(spark):
    x = np.random.default_rng(4).normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    assert events.near_blocks(df, 0.35).count() <= 4 * len(x)  # visits to cells were some twenty copies of each
    got = {(r.a, r.b) for r in events.similar_vectors(df, 0.35).collect()}
    a, b = np.nonzero(np.triu(x @ x.T > 0.35, 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 10_000


def test_title_pairs_of_long_titles_end_in_the_join(spark):
    random.seed(8)
    base = [random.sample(range(400), random.randint(5, 40)) for _ in range(25)]
    sets = [sorted({*random.sample(w, int(len(w) * random.choice((0.7, 0.8, 0.9, 1)))), *random.sample(range(400), random.randint(0, 3))}) for w in base for _ in range(8)]
    df = spark.createDataFrame([(i, f"g{i % 2}", [f"w{x}" for x in w]) for i, w in enumerate(sets)], "id long, kind string, words array<string>")
    first, want = {}, set()
    for i, w in enumerate(sets):
        first.setdefault((i % 2, frozenset(w)), i)
    for (g, a), i in first.items():
        want |= {(f"g{g}", i, j) for (h, b), j in first.items() if g == h and i < j and len(a & b) >= 0.6 * len(a | b)}
    found = events.title_pairs(df, within="kind")
    assert {tuple(r) for r in found.select("g", "a", "b").collect()} == want and len(want) > 100
    # Pairs that share too few words don't reach the shuffle that makes pairs distinct.
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_of_many_types_without_structure_are_not_sent_to_every_cell(spark):
    x = np.random.default_rng(6).normal(size=(1400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, f"t{i % 2}", v.tolist()) for i, v in enumerate(x)], "id long, type string, vector array<double>")
    assert events.near_blocks(df, 0.75, "type").count() <= 3 * len(x)
    got = {(r.a, r.b) for r in events.similar_vectors(df, 0.75, "type").collect()}
    a, b = np.nonzero(np.triu(x @ x.T > 0.75, 1))
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i % 2 == j % 2}


def test_merge_clusters_writes_a_vector_once(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(40, 4)).round(3)
    x[20:, :] = x[:20, :] * 2
    x[5], x[25] = [0.0, 1.0, 0.0, 0.0], [-0.0, 1.0, 0.0, 0.0]  # equal, though their bits differ
    data = [(i, "t", i * 3600 * 5, [f"w{i}"], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id long, event_type string, first_s long, words array<string>, vector array<float>")
    tables, write = [], events.written

    def put(frame, name):
        tables.append(write(frame, name))
        return tables[-1]

    monkeypatch.setattr(events, "written", put)
    got = {r.id: r.component for r in events.merge_clusters(df, hours=120).collect()}
    assert sum(t.count() for t in tables if "vector" in t.columns) == len(x)
    y, want = x.astype(np.float32).astype(float), list(range(len(x)))
    for _ in x:
        for i, a in enumerate(y):
            for j, b in enumerate(y):
                if abs(i - j) * 5 <= 120 and a @ b >= 0.8:
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want))
