"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return format(round(v, 5) + 0.0, ".5f")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = sorted([plain(x) for x in row] for row in frame.select(*columns).collect())
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted([plain(row[names.index(c)]) for c in columns] for row in result.fetchall())
    assert found == wanted


def test_names_and_sql_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_events_take_all_articles_and_vectors(spark, tmp_path):
    from feedloom.plans.inputs import table

    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in (3, 4, 460, 499)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i)] * 64, i % 3) for i in range(500)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r.id, r.vector[0]) for r in table(spark, str(tmp_path), "event_links").collect()) == [(3, 3.0), (4, 4.0), (460, 460.0), (499, 499.0)]
    for name in ("e02_cluster_events", "e03_merge_clusters"):
        assert sorted(r.id for r in entry.queries()[name](spark, str(tmp_path)).collect()) == [3, 4, 460, 499]
    drift = {r.slug: r.centroid for r in entry.queries()["e09_centroid_drift"](spark, str(tmp_path)).collect()}
    assert set(drift) == {"n3", "n4", "n5", "n2"}


def _files(source, folder, n, **replaced):
    """The given tables, with some of them as folders of ``n`` files."""
    import pyarrow.parquet as pq

    for table in TABLES:
        if table not in replaced:
            os.symlink(f"{source}/{table}.parquet", f"{folder}/{table}.parquet")
    for table, order in replaced.items():
        rows = pq.read_table(f"{source}/{table}.parquet").sort_by(order)
        os.mkdir(f"{folder}/{table}.parquet")
        for i in range(n):
            pq.write_table(rows.slice(len(rows) * i // n, len(rows) * (i + 1) // n - len(rows) * i // n), f"{folder}/{table}.parquet/part-{i:04}.parquet")


def same_as_sql(spark, name, folder):
    frame = entry.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    db = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    result = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    found = sorted([plain(x) for x in row] for row in frame.select(*columns).collect())
    assert found and found == sorted([plain(x) for x in row] for row in result)


@pytest.mark.parametrize("small_batches", [False, True])
def test_running_rarity_of_a_folder_of_files(spark, tmp_path, monkeypatch, small_batches):
    if small_batches:
        monkeypatch.setattr("feedloom.plans.flows.AT_ONCE", 1)
    _files(FOLDER, tmp_path, 3, documents="doc_id")
    same_as_sql(spark, "a10_running_rarity", tmp_path)


def test_stream_triage_of_a_folder_of_files(spark, tmp_path):
    _files(FOLDER, tmp_path, 3, documents="doc_id")
    same_as_sql(spark, "x09_stream_triage", tmp_path)


def test_entity_trim_follows_its_sql_on_odd_titles_and_large_ids(spark, tmp_path):
    texts = [None, "", " x", "\tlead", "\x0bvt", "word\x0bmore z", "line\u2028sep y", "\x85nel", "state-owned firm", "-led", "plain words"]
    rows = [(start + 105 * k + m, text, "en", "s") for start in (0, 2**31 + 7) for k, text in enumerate(texts) for m in range(105)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for table in TABLES:
        if table != "documents":
            os.symlink(f"{FOLDER}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    same_as_sql(spark, "t38_entity_text_trim", tmp_path)
