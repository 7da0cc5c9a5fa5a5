"""Sources and sinks: articles, posts, messages, analysis blobs, logs, votes, dimension and state tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.shared import small

ARTICLE = "id bigint, url string, title string, summary string, content string, rawHtml string, published string, source string, topic string, extra map<string,string>, analysisData string"
POST = "id bigint, text string, createdAt string, lang string, likeCount bigint, retweetCount bigint, quoteCount bigint, replyCount bigint, author struct<id:bigint,username:string,followersCount:bigint>"
MESSAGE = "id string, groupId string, sender string, content string, replyToId string, createdAt string"
ANALYSIS = "assets array<struct<ticker:string,direction:string>>, topicSignature struct<primarySectorId:int,primarySectorSymbol:string>, triage struct<label:string,reasonCode:string,flag:string>"
TIMESTAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})"
ANSI = r"\x1b\[[0-9;]*m"


def snake(df: DataFrame) -> DataFrame:
    """Columns in snake case."""
    return df.withColumnsRenamed({c: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower() for c in df.columns})


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return snake(spark.read.schema(ARTICLE).json(path))


def read_posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Posts with counts of 0 where there are none, and their authors."""
    raw = snake(spark.read.schema(POST).json(path))
    counts = ["like_count", "retweet_count", "quote_count", "reply_count"]
    posts = raw.select("id", "text", "created_at", "lang", F.col("author.id").alias("author_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    authors = raw.where("author.id IS NOT NULL").select("author.*").groupBy("id").agg(F.max("username").alias("username"), F.max("followersCount").alias("followers_count"))
    return posts, authors


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return snake(spark.read.schema(MESSAGE).json(path))


def parse_analysis(df: DataFrame, column: str) -> DataFrame:
    """``df`` with analysis and discrepancy: an unreadable blob is kept and labelled, not dropped."""
    parsed = F.from_json(column, f"{ANALYSIS}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = df.withColumn("analysis", parsed)
    bad = F.col(column).isNotNull() & (F.col("analysis").isNull() | F.col("analysis._corrupt").isNotNull())
    return rows.withColumn("discrepancy", F.when(bad, "invalid_analysis_data")).withColumn("analysis", F.when(~bad, F.col("analysis").dropFields("_corrupt")))


def load_dims(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Dimension tables from JSON arrays of objects, with the position of each."""
    out = {}
    for name in names:
        rows = spark.read.option("multiLine", True).json(f"{folder}/{name}.json")
        out[name] = rows.withColumn("pos", F.monotonically_increasing_id())
    return out


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select("article.*", "expect")


def parse_log(lines: DataFrame, cutoff: str | None = None) -> DataFrame:
    """ts and line of log lines that start with a time, at or after the cutoff, without colour codes."""
    clean = F.regexp_replace("value", ANSI, "")
    rows = lines.select(F.try_to_timestamp(F.regexp_extract(clean, TIMESTAMP, 1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), clean.alias("line")).where("ts IS NOT NULL")
    return rows if cutoff is None else rows.where(F.col("ts") >= F.lit(cutoff).cast("timestamp"))


def read_worker_log(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    return parse_log(spark.read.text(path), cutoff)


def read_commitments(df: DataFrame, column: str = "data") -> DataFrame:
    """validator, uid, score from two forms of JSON; other texts are ignored."""
    one = F.from_json(column, "scores map<string,double>, miner_uid int, score double")
    rows = df.select("validator", one.alias("c"))
    many = rows.where("c.scores IS NOT NULL").select("validator", F.explode("c.scores").alias("uid", "score")).select("validator", F.col("uid").try_cast("int").alias("uid"), "score")
    single = rows.where("c.scores IS NULL AND c.miner_uid IS NOT NULL").select("validator", F.col("c.miner_uid").alias("uid"), F.col("c.score").alias("score"))
    return many.unionByName(single)


def read_stored_analyses(articles: DataFrame, analyses: DataFrame, min_chars: int = 200, n: int = 1000) -> DataFrame:
    """The newest ``n`` articles with an analysis and a body of more than ``min_chars`` characters."""
    return articles.where(F.length("content") > min_chars).join(analyses, "id").orderBy(F.desc("published"), "id").limit(n)


def write_completed(df: DataFrame, path: str) -> None:
    """Processed rows that weren't submitted, by epoch; writing an epoch again replaces it."""
    df.where("status = 'Processed' AND NOT submitted").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def write_state(df: DataFrame, path: str) -> None:
    """A snapshot by epoch; an epoch that is written again is replaced as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state at a path; an empty table where there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def dimension(df: DataFrame) -> DataFrame:
    """A dimension with a broadcast hint if it is small enough."""
    return small(df)
