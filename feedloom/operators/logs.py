"""Validation logs: parsing, counts, mismatches and reports on a worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases and patterns of the log.
PHRASES = {"received": ["received tweetbatch"], "accepted": ["batch accepted"], "rejected": ["batch rejected"], "timeouts": ["request timeout after", "adding penalty to hotkey"]}
FAILED = r"failed_fields=\['([^]]+)'\]"
COMPARED = r"(\w+) \(miner=([^ ]+) vs validator=([^)]+)\)"
LAZY = r"(?i)Miner classification: subnet_id=\d+, sentiment=neutral, content_type=other, tech=none, market=other, impact=none"
MISMATCH = r"Mismatch for (\w+):\s*(.+?)\s*\|\s*preview=(.*)$"
MISMATCHED = r"(\w+)\(m=([^|]+)\|v=([^)]+)\)"
PREVIEW = r"preview=(.+)$"
WORKER = r"(passed|failed) for miner (\w{48}|\w{12}\.\.)[ \n]"


def log_stats(lines: DataFrame) -> DataFrame:
    """One row of counts: messages of each kind, samplings, all-default answers, and the rate of acceptance."""
    low = F.lower("line")
    has = lambda texts: F.count_if(F.coalesce(sum((low.contains(t).cast("int") for t in texts), F.lit(0)) > 0, F.lit(False)))
    row = lines.agg(*[has(texts).alias(name) for name, texts in PHRASES.items()], F.count_if(low.contains("sampling") & low.contains("from batch")).alias("sampled"), F.count_if(F.col("line").rlike(LAZY)).alias("lazy"))
    total = F.col("accepted") + F.col("rejected")
    return row.withColumn("accept_rate", F.when(total > 0, 100.0 * F.col("accepted") / total).otherwise(0.0))


def field_failures(lines: DataFrame) -> DataFrame:
    """field and how often it failed."""
    fields = F.split(F.regexp_replace(F.regexp_extract("line", FAILED, 1), "'", ""), ",")
    return lines.where(F.col("line").rlike(FAILED)).select(F.explode(fields).alias("f")).select(F.trim("f").alias("field")).where("field <> ''").groupBy("field").agg(F.count("*").alias("n"))


def mismatch_patterns(lines: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent (field, submitted, reference) mismatches."""
    found = lines.where(F.col("line").contains("Failed fields: ")).select(F.explode(F.regexp_extract_all("line", F.lit(COMPARED), F.lit(0))).alias("m"))
    rows = found.select(*[F.lower(F.regexp_extract("m", COMPARED, i)).alias(n) for i, n in ((1, "field"), (2, "submitted"), (3, "reference"))])
    return rows.groupBy("field", "submitted", "reference").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "submitted", "reference").limit(k)


def worker_counts(lines: DataFrame) -> DataFrame:
    """worker (12 characters), accepted, rejected."""
    rows = lines.select(F.regexp_extract("line", WORKER, 1).alias("what"), F.substring(F.regexp_extract("line", WORKER, 2), 1, 12).alias("worker")).where("worker <> ''")
    return rows.groupBy("worker").agg(F.count_if(F.col("what") == "passed").alias("accepted"), F.count_if(F.col("what") == "failed").alias("rejected"))


def worker_report(lines: DataFrame, prefix: str) -> DataFrame:
    """worker, accepted, rejected, rate and a band of diagnosis for one worker."""
    row = worker_counts(lines.where(F.lower("line").contains(prefix.lower()))).where(F.col("worker").startswith(prefix))
    rate = 100.0 * F.col("accepted") / (F.col("accepted") + F.col("rejected"))
    return row.withColumn("rate", rate).withColumn("band", F.when(rate == 0, "always_rejected").when(rate < 50, "mostly_rejected").otherwise("mostly_accepted"))


def _details(lines: DataFrame, prefix: str) -> DataFrame:
    """A worker's lines with what they are (passed, failed, mismatch, detail) and the fields that they name, in both forms of the log."""
    low, line = F.lower("line"), F.col("line")
    what = (
        F.when(line.rlike(MISMATCH), "mismatch").when(low.contains("rejection detail"), "detail")
        .when(low.contains("batch validation passed for miner"), "passed").when(low.contains("batch validation failed for miner"), "failed")
    )
    named = F.filter(F.transform(F.split(F.replace(F.regexp_extract("line", FAILED, 1), F.lit("'"), F.lit("")), ","), lambda f: F.trim(f)), lambda f: f != "")
    fields = F.when(what == "mismatch", F.regexp_extract_all(F.regexp_extract("line", MISMATCH, 2), F.lit(MISMATCHED), F.lit(1))).when((what == "detail") & line.rlike(FAILED), named).otherwise(F.array().cast("array<string>"))
    preview = F.substring(F.when(what == "mismatch", F.regexp_extract("line", MISMATCH, 3)).otherwise(F.regexp_extract("line", PREVIEW, 1)), 1, 80)
    return lines.where(low.contains(prefix.lower())).select("ts", "line", what.alias("what"), fields.alias("fields"), preview.alias("preview")).where("what IS NOT NULL")


def worker_fields(lines: DataFrame, prefix: str) -> DataFrame:
    """field, n and its share in percent of all failures of fields of one worker."""
    rows = _details(lines, prefix).select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("total"))), F.lit(True)).select("field", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))  # a sum of one row


def worker_mismatches(lines: DataFrame, prefix: str) -> DataFrame:
    """field, submitted, reference, n: the values behind the failed fields of one worker, and how often each pair was logged."""
    found = _details(lines, prefix).where("what = 'mismatch'").select(F.explode(F.regexp_extract_all(F.regexp_extract("line", MISMATCH, 2), F.lit(MISMATCHED), F.lit(0))).alias("m"))
    return found.select(*[F.regexp_extract("m", MISMATCHED, i).alias(n) for i, n in ((1, "field"), (2, "submitted"), (3, "reference"))]).groupBy("field", "submitted", "reference").agg(F.count("*").alias("n"))


def worker_recent(lines: DataFrame, prefix: str, failures: int = 10, passes: int = 5) -> DataFrame:
    """what (failed or passed), ts, fields, preview, rank: a worker's last failures and passes, newest first.

    A line that names the fields completes the failure just before it and has its time; without one, a mismatch line is a
    failure of its own and a detail line none. A detail line needs a preview to complete a failure.
    """
    rows = _details(lines, prefix).where("what <> 'detail' OR preview <> ''")
    before = F.lag(F.struct("what", "ts")).over(_order(F.when(F.col("what") == "passed", 1).otherwise(0)))
    after = rows.withColumn("before", before)
    open_failure = F.coalesce(F.col("before.what") == "failed", F.lit(False))
    failed = after.where((F.col("what") == "mismatch") | ((F.col("what") == "detail") & open_failure)).select(F.lit("failed").alias("what"), F.when(open_failure, F.col("before.ts")).otherwise(F.col("ts")).alias("ts"), "fields", "preview")
    passed = after.where("what = 'passed'").select("what", "ts", "fields", F.lit("").alias("preview"))
    kept = lambda d, n: d.orderBy(F.desc("ts"), "preview", "fields").limit(n)
    both = kept(failed, failures).union(kept(passed, passes))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("what").orderBy(F.desc("ts"), "preview", "fields")))


def _order(group: Column) -> Window:
    """Lines of one worker by time; its passes apart, as they neither open nor complete a failure."""
    return Window.partitionBy(group).orderBy("ts", "line")
