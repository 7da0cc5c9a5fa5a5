"""Conversation repair, spot signatures and periodic runs against SQL and brute force, with edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import conversations, periodic_runs, spot_signatures

TYPES = "conv_id long, turn long, role string, text string, place string, cost int"


def sql(query, name, rows, columns):
    import pandas as pd

    db = duckdb.connect()
    db.register("given", pd.DataFrame(rows, columns=columns).convert_dtypes())
    db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
    found = db.execute(query)
    names = [d[0] for d in found.description]
    return {row[0]: dict(zip(names, row, strict=True)) for row in found.fetchall()}


# -- 11: conversation repair
def _cheapest(items):
    """Cost and least letters by dynamic programming over (class, truncated, stays)."""
    now = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for kind, cut, stays in reversed(items):
        row = kind | 4 * cut | 8 if stays else 0
        base = [min((cost + now[to][0], letter + now[to][1]) for letter, cost, passed, to in conversations.arcs(row, state) if passed) for state in range(4)]
        now = list(base)
        for _ in range(3):
            now = [min(base[s], (2 + now[conversations.TURN[s]][0], "I" + now[conversations.TURN[s]][1])) for s in range(4)]
    return now[0]


def test_auction_finds_the_least_of_the_cheapest_strings_whole_and_in_blocks():
    draw, known, tails = random.Random(3), {}, ["", "II", "I", ""]
    for _ in range(400):
        items = [(draw.randrange(4), draw.random() < 0.3, draw.random() < 0.8) for _ in range(draw.randint(1, 40))]
        rows = bytes(kind | 4 * cut | 8 * stays for kind, cut, stays in items)
        repeats = [draw.choice([0, 0, 1, 2, 7]) if stays else draw.choice([1, 3, 6]) for *_, stays in items]
        full = [x for (kind, cut, stays), n in zip(items, repeats, strict=True) for x in [(kind, cut, True)] * stays + [(kind, cut, False)] * n]
        wanted = _cheapest(full)
        cost, letters, state = conversations.solve(rows, repeats, conversations.END, known)
        assert (cost, "".join(letters) + tails[state]) == wanted
        cuts = sorted({0, len(rows), *(draw.randrange(len(rows)) for _ in range(3))})
        ends = [conversations.END]
        for a, b in reversed(list(zip(cuts, cuts[1:], strict=False))):
            table = conversations.cost_table(rows[a:b], repeats[a:b], known)
            ends.insert(0, tuple(min(conversations.NEVER, *(table[4 * x + y] + ends[0][y] for y in range(4))) for x in range(4)))
        state, out = 0, ""
        for a, b, before, after in zip(cuts, cuts[1:], ends, ends[1:], strict=False):
            cost, letters, reached = conversations.solve(rows[a:b], repeats[a:b], after, known, state)
            assert cost == before[state]
            state, out = reached, out + "".join(letters)
        assert out + tails[state] == wanted[1]


def _talk(n, seed):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(draw.randint(1, 9)):
            if draw.random() < 0.9:
                rows.append((conv, turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), draw.choice(["Yes.", "no", "", " \t", None, "So? ", "é!"])))
    return rows


def test_conversations_equal_sql_with_nulls_and_blocks(spark):
    long = [(10_001, i, "user" if i % 3 else "assistant", f"row {i % 1700}{'.' * (i % 2)}") for i in range(4300)]
    rows = [*_talk(150, 5), (10_000, None, "user", "a."), (10_000, 3, "assistant", "b."), (10_002, 1, "", None), *long]
    got = {r.conv_id: r.asDict() for r in conversations.digests(spark.createDataFrame([(*r, "x", 1) for r in rows], TYPES)).collect()}
    wanted = sql(conversations.oracle(), "conversations", rows, ["conv_id", "turn", "role", "text"])
    assert got == wanted


def test_repaired_messages_and_repeated_rows(spark):
    rows = [(None, 1, "system", "s."), (None, 1, "user", "a."), (1, 1, "user", "a."), (1, 1, "user", "a."), (1, 2, "user", "b"), (2, 5, "tool", " ")] + [(3, None, "user", "same.")] * 50
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TYPES)
    got = {}
    for r in conversations.repaired(frame).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert got[1] == [(0, "user", "a."), (1, "assistant", "b")] and got[3] == [(0, "user", "same."), (1, "assistant", "")]
    assert [x[1] for x in got[None]][-2:] == ["user", "assistant"] and 2 not in got
    assert conversations.repaired(frame.limit(0)).count() == conversations.digests(frame.limit(0)).count() == 0


def test_conversation_of_dropped_rows_and_long_text(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    intact = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 > 4)
    rows = [(7, dropped, "user", "gone."), (8, intact, "user", "word " * 400_000 + ".")]
    got = {r.conv_id: r for r in conversations.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[7].gaps, got[7].cost, got[7].audit, got[7].repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[8].audit, got[8].truncated) == ("KI", 0)


# -- 12: spot signatures
TEXTS = [None, "", " ", "no anchors here", "The house of the old man is by a river and the sea", "The house of the old man is by a river and the sea", "É " * 50, "a " * 400, "to be or not to be", "der Hund und die Katze sind im Garten mit dem Ball", ": " * 2000, "word " * 3000]


def test_spots_equal_sql(spark):
    draw = random.Random(2)
    words = "the of and a house river man old sea tree der und die hund x1 42 étoile".split()
    texts = [*TEXTS, *(" ".join(draw.choices(words, k=draw.randint(1, 60))) for _ in range(150))]
    rows = [(7 * i - 40, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.asDict() for r in spot_signatures.compare_edited(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_chars int, fingerprint string")).collect()}
    assert got == sql(spot_signatures.oracle(), "documents", rows, ["doc_id", "text"])


def test_spots_of_repeated_and_null_rows_and_an_empty_table(spark):
    rows = [(1, "the cat sat on a mat of straw")] * 3 + [(None, "x"), (None, None), (2, "two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = spot_signatures.compare_edited(frame).collect()
    assert len(got) == 6 and sorted(r.near_next == 1 for r in got if r.doc_id == 1) == [False, True, True]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert spot_signatures.compare_edited(frame.limit(0)).count() == 0
    one = spot_signatures.compare_edited(frame.where("doc_id = 2")).first()
    assert one.edited_sha256 == hashlib.sha256(b"twt").hexdigest() and one.near_next == 1


def test_spots_of_very_long_texts(spark):
    rows = [(1, "the x y " * 100_000), (2, "the " * 200_000), (3, ": ; . " * 150_000)]
    got = {r.doc_id: r for r in spot_signatures.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_chars == 800_000 and got[3].fingerprint == ""


def test_similar_pairs_equal_brute_force(spark):
    draw, texts = random.Random(4), []
    nouns = [f"n{i}" for i in range(300)]
    for _ in range(40):
        base = [w for _ in range(draw.randint(5, 60)) for w in (draw.choice(["the", "a", "of"]), draw.choice(nouns), draw.choice(nouns))]
        texts.append(base)
        for _ in range(draw.randint(0, 3)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(nouns)
            texts.append(copy)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(998, None), (999, "")], "doc_id long, text string")
    pairs, members = spot_signatures.similar(frame, 0.8)
    sets = {r.doc_id: frozenset(r.signatures) for r in spot_signatures.fingerprints(frame).collect()}
    of = {r.doc_id: r["class"] for r in members.collect()}
    assert set(of) == set(sets)
    wanted = {(min(of[a], of[b]), max(of[a], of[b])) for a in sets for b in sets if of[a] != of[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0}
    assert {(r.a, r.b) for r in pairs.collect()} == wanted and len(wanted) > 10
    assert all((of[a] == of[b]) == (sets[a] == sets[b]) for a in sets for b in sets)


# -- 13: periodic runs
def _runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_equal_brute_force():
    draw = random.Random(5)

    def made():
        n, k = draw.randint(0, 400), draw.choice([1, 2, 3, 10, 1000])
        words = [draw.randrange(k) for _ in range(n)]
        for _ in range(draw.randint(0, 3) if n > 8 else 0):
            a = draw.randrange(n)
            p = 1 + draw.randrange(max(1, (n - a) // 3))
            if p > 3 and draw.random() < 0.4:
                r = 1 + draw.randrange(p // 2)
                for i in range(a, min(n, a + p - 1)):
                    words[i] = words[a + (i - a) % r]
            for i in range(a, min(n, a + p * draw.randint(2, 12) + draw.randrange(p))):
                words[i] = words[a + (i - a) % p]
        return words

    for _ in range(60):
        texts = [made() for _ in range(draw.randint(1, 12))]
        assert periodic_runs.runs_of([np.array(x, np.int64) for x in texts]) == [_runs(x) for x in texts]


def test_run_digests_equal_brute_force(spark):
    draw = random.Random(6)
    texts = [None, "", " \t\n", "a b c", "a " * 50, "a b\n" * 9 + "c", "x " * 5, "é  é é é é é z"]
    texts += [" ".join(draw.choices(["a", "b", "c", "dd"], k=draw.randint(1, 120))) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "q " * 8, 1, "z")], "doc_id long, text string, start int, runs string")
    got = {r.doc_id: r for r in periodic_runs.digests(frame).collect()}
    for i, text in [*enumerate(texts), (None, "q " * 8)]:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = _runs(words)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (runs and 1000 * best[1] // best[2] or None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()


def test_detect_keeps_columns_and_takes_long_texts(spark):
    frame = spark.createDataFrame([(1, "ab cd ef " * 100_000, "k", 5)], "doc_id long, text string, _key string, period int")
    found = periodic_runs.detect(frame)
    row = found.first()
    assert found.columns == ["doc_id", "_key", *periodic_runs.ADDED] and row._key == "k"
    assert (row.n_runs, row.start, row.length, row.period, bytes(row.collapsed)) == (1, 0, 300_000, 3, b"ab cd ef")
    assert periodic_runs.detect(frame.limit(0)).count() == 0


@pytest.mark.parametrize("run", [periodic_runs.digests, spot_signatures.compare_edited])
def test_equal_rows_have_results_of_their_own(spark, run):
    frame = spark.createDataFrame([(3, "the sun and the moon are in the sky")] * 4, "doc_id long, text string")
    assert run(frame).count() == 4 and run(frame).select("doc_id").where(F.col("doc_id") == 3).count() == 4
