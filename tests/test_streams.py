"""Streams over several micro-batches, and operators that have no SQL."""

import datetime
import os
import random

from feedloom.operators import compare, events, health, match, records
from feedloom.streaming import jobs


def put(spark, folder, n, data, schema):
    """One more file of the table rows; files are read in the order of their times."""
    frame = spark.createDataFrame(data, schema).toPandas()
    if "ts" in frame:
        frame["ts"] = frame["ts"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
    frame.to_parquet(f"{folder}/rows.parquet{n or ''}")
    os.utime(f"{folder}/rows.parquet{n or ''}", (1_700_000_000 + n, 1_700_000_000 + n))


START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_reputation_closes_epochs_by_time_and_counts_late_rows(spark, tmp_path):
    schema = "ts timestamp, target long, epoch long, article_id long, sender long, score double, weight double"
    first = int(START.replace(tzinfo=datetime.UTC).timestamp()) // 3600
    row = lambda hour, target, *rest: (at(hour * 3600 + 60), target, first + hour, *rest)
    put(spark, tmp_path, 0, [row(0, 1, 2, 1, 1.0, 1.0), row(0, 1, 1, 1, 0.9, 1.0), row(0, 1, 1, 1, 0.2, 1.0), row(0, 1, 1, 1, 0.2, 2.0), row(0, 1, 3, 1, 1.5, 1.0), row(0, 1, 3, 1, 0.5, 11.0), row(0, 1, 3, 1, 0.5, 0.0)], schema)
    put(spark, tmp_path, 1, [row(0, 1, 1, 2, 0.4, 1.0), row(1, 1, 1, 1, 1.0, 1.0), row(1, 1, 1, 1, 0.9, 3.0)], schema)
    put(spark, tmp_path, 2, [row(5, 2, 1, 1, 0.0, 1.0)], schema)  # another target's row closes epochs 0 to 2 for all
    put(spark, tmp_path, 3, [row(0, 1, 9, 9, 0.0, 1.0), row(6, 3, 1, 1, 1.0, 1.0)], schema)  # late for target 1
    put(spark, tmp_path, 4, [row(6, 1, 1, 1, 0.0, 1.0), row(1, 7, 1, 1, 1.0, 1.0)], schema)  # late for a target without state, too
    put(spark, tmp_path, 5, [row(20, 2, 1, 1, 1.0, 1.0)], schema)
    got = jobs.run(jobs.reputation(jobs.stream(spark, str(tmp_path), "rows"))).collect()
    value, want = 0.5, []
    for score, weight in ((0.2, 2.0), (0.4, 1.0), (1.0, 1.0)):  # by article and sender, the lowest score of each
        value += 0.03 * weight * (score - value)
    want.append((1, 0, value, 3, 1))  # closed in the batch after the row that passed its end, which also has the late row
    value += 0.03 * 3 * (0.9 - value)
    want.append((1, 1, value, 4, 1))
    want.append((1, 6, value + 0.03 * (0.0 - value), 5, 1))
    want += [(2, 5, 0.485, 1, 0), (3, 6, 0.515, 1, 0)]
    assert [(r.target, r.epoch - first, round(r.reputation, 12), r.n, r.late) for r in sorted(got, key=lambda r: (r.target, r.epoch))] == [(t, e, round(v, 12), n, late) for t, e, v, n, late in want]


def test_dedup_within_300_seconds_inside_and_across_batches(spark, tmp_path):
    schema = "ts timestamp, key long"
    put(spark, tmp_path, 0, [(at(0), 1), (at(299), 1), (at(300), 1), (at(10), 2)], schema)
    put(spark, tmp_path, 1, [(at(500), 1), (at(599), 1), (at(309), 2)], schema)
    put(spark, tmp_path, 2, [(at(600), 1), (at(8000), 3)], schema)  # the watermark leaves the state of 1 and 2
    put(spark, tmp_path, 3, [(at(7900), 1), (at(8100), 3), (at(50), 2)], schema)  # the last is late
    got = jobs.run(jobs.dedup_recent(jobs.stream(spark, str(tmp_path), "rows"), "key")).collect()
    assert sorted((r.key, int((r.ts - START).total_seconds())) for r in got) == [(1, 0), (1, 300), (1, 600), (1, 7900), (2, 10), (3, 8000)]


def test_broadcasts_stay_newer_over_batches_and_idle_senders_leave(spark, tmp_path):
    schema = "ts timestamp, sender long, epoch long, seq long, arrival long"
    put(spark, tmp_path, 0, [(at(0), 1, 10, 10, 2), (at(0), 1, 10, 9, 1), (at(0), 1, 10, 8, 3), (at(0), 1, 10, 500, 4)], schema)
    put(spark, tmp_path, 1, [(at(60), 1, 10, 10, 5), (at(60), 1, 11, 11, 6), (at(60), 2, 11, 11, 7)], schema)
    put(spark, tmp_path, 2, [(at(3600 * 400), 2, 411, 411, 8)], schema)
    put(spark, tmp_path, 3, [(at(3600 * 400), 1, 411, 411, 9), (at(0), 1, 10, 10, 10)], schema)  # the last is late: no replay
    got = jobs.run(jobs.accept_broadcasts(jobs.stream(spark, str(tmp_path), "rows"))).collect()
    assert sorted(r.arrival for r in got) == [1, 2, 6, 7, 8, 9]


def test_health_of_a_stream_equals_the_batch_and_idle_workers_start_anew(spark, tmp_path):
    schema = "ts timestamp, worker long, ts_s long, seq long, kind string, value double"
    draw, rows = random.Random(8), []
    for i in range(200):
        rows.append((at(i * 30), draw.randrange(4), i * 30, i, draw.choice(["valid", "timeout", "invalid", "ack_fail", "fail", "faith"]), draw.choice([0.3, 0.7, None])))
    for n in range(4):
        put(spark, tmp_path, n, rows[n * 50 : n * 50 + 50], schema)
    put(spark, tmp_path, 4, [(at(86_400 * 30), 9, 86_400 * 30, 999, "valid", 0.3)], schema)
    put(spark, tmp_path, 5, [(at(86_400 * 30), 0, 86_400 * 30, 1000, "timeout", None)], schema)
    got = jobs.run(jobs.worker_health(jobs.stream(spark, str(tmp_path), "rows"))).collect()
    batch = {r.worker: tuple(r) for r in health.worker_health(spark.createDataFrame([r[1:] for r in rows], schema.split(", ", 1)[1])).collect()}
    assert set(batch.values()) <= {tuple(r) for r in got}
    anew = health.fresh()
    health.step(anew, 86_400.0 * 30, "timeout", None)
    assert (0, *anew.values()) in {tuple(r) for r in got}


def test_running_rarity_ends_like_the_batch(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.choice("aab"), draw.choice("xyz") if i % 7 else None) for i in range(450)]
    for n in range(3):
        put(spark, tmp_path, n, rows[n * 150 : n * 150 + 150], "kind string, side string")
    got = jobs.running_rarity(jobs.stream(spark, str(tmp_path), "rows"), ["kind", "side"])
    assert {r.total for r in got.collect()} == {300, 450}  # none before there are 200
    for total in (300, 450):
        batch = compare.rarity_weights(spark.createDataFrame(rows[:total], "kind string, side string"), ["kind", "side"])
        assert sorted(map(str, got.where(f"total = {total}").select("field", "label", "weight").collect())) == sorted(map(str, batch.collect()))


def test_leases_time_out_without_a_later_event(spark, tmp_path):
    schema = "item long, worker long, ts timestamp, what string"
    put(spark, tmp_path, 0, [(1, 7, at(0), "open"), (2, 8, at(0), "open"), (2, 8, at(50), "done"), (3, 9, at(0), "open"), (3, 4, at(90), "open"), (5, 1, at(0), "open"), (5, 1, at(200), "done")], schema)
    put(spark, tmp_path, 1, [(4, 1, at(5000), "done")], schema)
    put(spark, tmp_path, 2, [(4, 2, at(5010), "open")], schema)
    got = jobs.run(jobs.leases(jobs.stream(spark, str(tmp_path), "rows"), ttl=100)).collect()
    start = 1_704_067_200_000_000
    # 1: no event ever follows; 3: opened anew, then none; 5: closed too late; 4: still in time
    assert sorted((r.item, r.worker, r.opened_us - start) for r in got) == [(1, 7, 0), (3, 4, 90_000_000), (5, 1, 0)]


def test_resolve_entities(spark):
    rows = [(1, " Fed ", "ORG", 0.4, "Q1", "Federal"), (2, "Acme", "ORG", 0.4, "Q1", "Acme Inc"), (3, "Bolt", "GPE", 0.4, "Q9", "Bolt (town)"), (4, "Bolt", "odd", 0.4, "Q9", ""), (5, "Cold", "PERSON", 0.6, None, None), (6, None, None, None, None, None)]
    found = match.resolve_entities(
        spark.createDataFrame(rows, "id long, text string, label string, score double, qid string, qid_title string"),
        spark.createDataFrame([("fed", "Federal Reserve", "government", None)], "surface string, canonical string, type string, ticker string"),
        spark.createDataFrame([("Q1", "Acme Corp", None, "ACM")], "qid string, qid_name string, qid_type string, qid_ticker string"),
    )
    assert [tuple(r)[-5:] for r in sorted(found.collect())] == [
        ("Federal Reserve", "government", 1.0, None, "override"), ("Acme Corp", "unknown", 0.9, "ACM", "linked"), ("Bolt (town)", "location", 0.7, None, "title"),
        ("Bolt", "organization", 0.4, None, "label"), ("Cold", "person", 0.6, None, "label"), (None, "organization", None, None, "label"),
    ]


def test_gold_counts_entity_leaks(spark):
    predicted = spark.createDataFrame([(1, "en", ["A"], ["Jan Novak", "Praha"], 1), (2, None, ["B", "B"], [], -1)], "id long, language string, assets array<string>, entities array<string>, direction int")
    gold = spark.createDataFrame([(1, "en", ["A", "A", "C"], [], ["novak praha", "brno"], 1), (2, "de", [], ["B"], ["x"], 1)], "id long, language string, expect_assets array<string>, forbid_assets array<string>, forbid_entities array<string>, direction int")
    assert records.gold_eval(predicted, gold).first().asDict() == {"asset_recall": 0.5, "forbidden_found": 1, "entity_leaks": 1, "language_accuracy": 0.5, "direction_agreement": 0.5}


def test_candidate_groups_match_brute_force(spark):
    random.seed(3)
    base = [[random.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    near = lambda v, s: [x + random.gauss(0, s) for x in v]
    rows = [(i, near(base[i % 5], 0.45)) for i in range(40)] + [(50, [2 * x for x in base[1]]), (51, base[1]), (52, None), (53, [0.0] * 6)]
    slugs = [("a", near(base[0], 0.2)), ("b", near(base[0], 0.2))]

    def cos(u, v):
        if not u or not v:
            return 0.0
        n = (sum(x * x for x in u) * sum(x * x for x in v)) ** 0.5
        return sum(x * y for x, y in zip(u, v, strict=True)) / n if n else 0.0

    merged = {}
    for i, v in rows:
        best = min((-cos(v, c), s) for s, c in slugs)
        merged[i] = best[1] if -best[0] > 0.75 else None
    left = {i: v for i, v in rows if merged[i] is None}
    group = {i: i for i in left}
    for _ in left:
        for i in left:
            for j in left:
                if cos(left[i], left[j]) > 0.70:
                    group[i] = group[j] = min(group[i], group[j])
    got = events.candidate_groups(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(slugs, "slug string, centroid array<double>"))
    assert {(r.id, r.merged_into, r.group_id) for r in got.collect()} == {(i, merged[i], group.get(i)) for i, _ in rows}
    assert len(set(group.values())) < len(group) and any(merged.values())


def test_rotated_log_gives_the_same_rows_in_batch_and_as_a_stream(spark, tmp_path):
    from feedloom.sources import worker_log

    worker_log.register(spark)
    folder, state, out = tmp_path / "logs", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()
    log = folder / "worker.log"
    line = lambda i: f"2024-01-0{1 + i // 400} 10:00:00.{100 + i % 400} line {i} é\n"

    def read_on():
        stream = spark.readStream.format("rotating_log").option("split", "1000").load(str(log))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    log.write_text("".join(map(line, range(300))) + "2024-01-01 10:00:00.999 half a li")
    assert read_on() == sorted(line(i)[:-1] for i in range(300))
    with log.open("a") as f:
        f.write("ne\n" + "".join(map(line, range(300, 350))))
    log.rename(folder / "worker.log.1")
    log.write_text("".join(map(line, range(350, 900))))
    (folder / "other.log").write_text("2024-01-01 10:00:00.000 of another log\n")
    want = sorted([line(i)[:-1] for i in range(900)] + ["2024-01-01 10:00:00.999 half a line"])
    assert read_on() == want
    (folder / "worker.log.1").rename(folder / "worker.log.2")
    log.rename(folder / "worker.log.1")
    log.write_text(line(900))
    want = sorted([*want, line(900)[:-1]])
    assert read_on() == want == read_on()
    batch = spark.read.format("rotating_log").option("split", "777").load(str(log))
    assert sorted(r.value for r in batch.collect()) == want
    assert batch.select("file", "at").distinct().count() == len(want) and batch.rdd.getNumPartitions() > 10
