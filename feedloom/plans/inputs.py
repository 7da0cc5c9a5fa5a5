"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both read.

The given tables hold no news feed, so articles, posts, messages, gazetteer and ledger are projections of documents,
conversations and events (SURVEY 7.2); texts get market phrases appended by the remainder of their id.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.shared import small  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "articles": """
SELECT doc_id AS article_id, CAST(floor(doc_id / 12) AS BIGINT) AS batch_id, doc_id % 12 AS pos, doc_id % 50 AS worker, lang, source,
       1704067200 + doc_id * 3600 AS published_s,
       concat(substr(split_part(coalesce(text, ''), chr(10), 1), 1, 200), CASE doc_id % 5 WHEN 0 THEN ' shares surge to record high: why?' WHEN 1 THEN ' 5 reasons for the BREAKING crash!!'
              WHEN 2 THEN ' The a the plan of nvidia' WHEN 3 THEN ' bitcoin and gold' ELSE CASE doc_id % 3 WHEN 0 THEN ' Globex and Acme gain' ELSE '' END END) AS title,
       concat(coalesce(text, ''), CASE doc_id % 7
         WHEN 0 THEN ' Shares of $ABC and $XYZ rose 4.5% today to $1,200. Follow us on Google for updates. Inflation in China may possibly rise, confirmed the board of bitcoin.'
         WHEN 1 THEN concat(chr(10), chr(10), 'Analysts said "this is a long quoted statement" at https://example.com/a1 with a chart. See ![img] and <img src=x>. | a | b | c | The target price of target and ABC was raised. Acme Corp said it will pay.')
         WHEN 2 THEN ' Photo: Some Agency. The central bank will cut. Oil price outlook for next quarter is officially confirmed. Globex stocks and XYZ fell.'
         WHEN 3 THEN ' Long-term roadmap next year, guidance this year. The nvidia stocks and $BTC are trading today at the open. Initech and Acme Corp gained.'
         WHEN 4 THEN ' The company said shares of Globex may fall. Interest rate cut in Japan. Gold bullion rally.' ELSE '' END) AS body
FROM {documents}""",
    "posts": """
SELECT conv_id * 100 + turn AS post_id, text, role AS author, 1704067200 + conv_id * 900 + turn * 60 AS created_s, conv_id % 4 AS asset_id,
       conv_id * 37 % 7000 AS likes, conv_id * 11 % 1300 AS reposts, turn * 53 % 400 AS quotes, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 91 % 800 END AS replies, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE conv_id * 1009 % 300000 END AS followers
FROM {conversations}""",
    "pairs": """
SELECT a.doc_id AS article_id, a.t AS sub_text, b.t AS ref_text, a.doc_id % 7 AS i, b.doc_id % 5 AS j, a.doc_id % 11 AS m
FROM (SELECT doc_id, coalesce(text, '') AS t FROM {documents}) a JOIN (SELECT doc_id, coalesce(text, '') AS t FROM {documents}) b ON a.doc_id = b.doc_id + 1""",
    "ledger": """
SELECT event_id, user_id % 97 AS worker, CAST(floor({epoch_s} / 3600) AS BIGINT) AS epoch, event_type, value, CAST(round(abs(value)) AS BIGINT) AS points FROM {events}""",
    "nodes": """
SELECT CAST(c_custkey AS BIGINT) AS uid, CAST(c_custkey AS BIGINT) AS worker, c_acctbal > 0 AS permit, CAST(c_acctbal AS DOUBLE) AS stake, c_custkey * 1000 AS block_at_registration FROM {customer}""",
    "vectors": """
SELECT vec_id, CAST(floor(vec_id / 10) AS BIGINT) AS batch_id, vec_id % 10 AS pos, embedding, label FROM {embeddings}""",
}
#: Small dimension tables of the queries; the corpus has invented words, so most keywords are those that "articles" adds.
VIEWS |= {
    "assets": """
SELECT * FROM (VALUES (1, 'ABC', 'Acme Corp', 'equity', 'Technology'), (2, 'XYZ', 'Globex', 'equity', 'energy'), (3, 'NVDA', 'nvidia', 'equity', 'Technology'), (4, 'BTC', 'bitcoin', 'crypto', 'unknown'),
  (5, 'XAU', 'gold', 'commodity', 'materials'), (6, 'TGT', 'target', 'equity', 'finance'), (7, 'INI', 'Initech', 'index', 'finance'), (8, 'THE', 'the', 'equity', 'finance')) AS t(asset_id, symbol, name, asset_class, sector)""",
    "gazetteer": """
SELECT * FROM (VALUES (1, 'cashtag', '$ABC', 0), (1, 'case_sensitive', 'ABC', 1), (1, 'identifier', 'acme corp', 2), (2, 'cashtag', '$XYZ', 3), (2, 'case_sensitive', 'XYZ', 4), (2, 'alias', 'globex', 5), (3, 'identifier', 'nvidia', 6),
  (4, 'cashtag', '$BTC', 7), (4, 'identifier', 'bitcoin', 8), (5, 'alias', 'gold', 9), (6, 'alias', 'target', 10), (7, 'identifier', 'initech', 11), (8, 'identifier', 'the', 12), (8, 'alias', 'them', 13)) AS t(asset_id, kind, keyword, pos)""",
    "word_freq": "SELECT * FROM (VALUES ('gold', 4.8), ('target', 4.9), ('the', 7.7), ('bitcoin', 3.9), ('globex', 1.1)) AS t(word, zipf)",
    "common_words": "SELECT * FROM (VALUES ('gold'), ('target'), ('the')) AS t(word)",
    "edges": """
SELECT * FROM (VALUES ('ABC', 0, 'XYZ', 'supplier'), ('ABC', 1, 'NVDA', 'competitor'), ('XYZ', 0, 'XAU', 'sector_peer'), ('XYZ', 1, 'ABC', 'customer'), ('NVDA', 0, 'TGT', 'index_member'), ('NVDA', 1, 'tgt2', 'odd'), ('BTC', 0, 'XAU', 'odd'), ('BTC', 1, 'NVDA', 'odd'), ('THE', 0, 'TGT', 'supplier')) AS t(source_ticker, edge_pos, target_ticker, relationship)""",
    "sectors": """
SELECT * FROM (VALUES (1, 'CRYPTO', 'cashtag', '$BTC', 0), (1, 'CRYPTO', 'identifier', 'bitcoin', 1), (2, 'MACRO', 'identifier', 'inflation', 2), (2, 'MACRO', 'identifier', 'central bank', 3), (2, 'MACRO', 'identifier', 'china', 4), (4, 'EQUITIES', 'cashtag', '$ABC', 5),
  (4, 'EQUITIES', 'identifier', 'shares', 6), (4, 'EQUITIES', 'identifier', 'stocks', 7), (5, 'COMMODITIES', 'identifier', 'gold', 8), (5, 'COMMODITIES', 'identifier', 'oil', 9), (9, 'OTHER', 'identifier', 'the', 10)) AS t(sector_id, symbol, kind, keyword, pos)""",
}
#: Dimensions with what the given tables add: every word of the documents as a keyword, every part as an asset.
VIEWS |= {
    "gazetteer_whole": VIEWS["gazetteer"] + """
UNION ALL SELECT DISTINCT CAST(1 + length(word) % 8 AS INT) AS asset_id, CASE WHEN length(word) <= 4 THEN 'alias' ELSE 'identifier' END AS kind, word AS keyword, CAST(100 + length(word) AS INT) AS pos FROM {words_of_documents}""",
    "assets_whole": VIEWS["assets"] + """
UNION ALL SELECT CAST(1000 + p_partkey AS INT) AS asset_id, concat('P', p_partkey) AS symbol, p_name AS name, lower(p_type) AS asset_class, p_brand AS sector FROM {part}""",
}
#: Spelled differently by the two engines.
DIALECT = {
    "spark": {
        "epoch_s": "unix_timestamp(ts)",
        "words_of_documents": "(SELECT lower(word) AS word FROM {documents} LATERAL VIEW explode(split(coalesce(text, ''), '[^A-Za-z]+')) AS word WHERE word <> '') AS x",
        "sentences_of_documents": "(SELECT doc_id, CAST(k AS BIGINT) AS k, sentence FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '[.!?]+ ')) AS k, sentence) AS x",
    },
    "duckdb": {
        "epoch_s": "epoch(ts)",
        "words_of_documents": "(SELECT lower(word) AS word FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[^A-Za-z]+')) AS word FROM {documents}) WHERE word <> '') AS x",
        "sentences_of_documents": "(SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS k, unnest(l) AS sentence FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+ ') AS l FROM {documents})) AS x",
    },
}


def spelled(name: str, engine: str) -> str:
    """The SQL of a view, with the tables that it reads in braces."""
    sql = VIEWS[name]
    for word, text in DIALECT[engine].items():
        sql = sql.replace(f"{{{word}}}", text)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view of them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = spelled(name, "spark").replace('"end"', "`end`")
    return spark.sql(sql, **{x: table(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", sql))})


def cte(*names: str) -> str:
    """The views as common table expressions of DuckDB, to put before a query (after WITH)."""
    out: list[str] = []

    def add(name: str) -> None:
        sql = spelled(name, "duckdb")
        for x in re.findall(r"\{(\w+)\}", sql):
            if x in VIEWS:
                add(x)
        text = f"{name} AS ({re.sub(r'\{(\w+)\}', r'\1', sql)})"
        if text not in out:
            out.append(text)

    for name in names:
        add(name)
    return ", ".join(out)


class Plans:
    """Queries and their SQL, as a module of plans collects them."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[..., DataFrame], sql: str | None, *views: str) -> None:
        """``query`` takes the views (or tables) as frames; ``sql`` may use them by name."""
        self.queries[name] = lambda spark, sf_dir: query(*[table(spark, sf_dir, v) for v in views])
        derived = [v for v in views if v in VIEWS]
        if sql is not None:
            head = f"WITH {cte(*derived)}" if derived else ""
            more = sql.strip()
            if derived and more.upper().startswith("WITH "):
                more = "," + more[4:]
            self.sql[name] = f"{head} {more}"
