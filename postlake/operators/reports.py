"""Reports on sources and their crawl runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each source; a later id wins a tie. One grouped maximum, no sort."""
    last = F.max(F.struct("finished_at", "event_id", "status", "jobs_seen"))
    return runs.groupBy("source_id").agg(last.alias("r"), F.count(F.lit(1)).alias("runs")).select("source_id", "r.*", "runs")


def health(latest: DataFrame) -> DataFrame:
    """healthy, failed or blocked by the last run; anything else counts as changed."""
    name = F.when(F.col("status") == "succeeded", "healthy").when(F.col("status").isin("failed", "blocked"), F.col("status")).otherwise("changed")
    return latest.withColumn("health", name)


def backoff(latest: DataFrame) -> DataFrame:
    """When each source is due again: 2, 6 or 24 hours after success, failure or a block."""
    hours = F.when(F.col("status") == "succeeded", 2).when(F.col("status") == "blocked", 24).otherwise(6)
    return latest.withColumn("hours", hours).withColumn("due_at", F.col("finished_at") + F.make_interval(hours=F.col("hours")))


def activity(runs: DataFrame, most: int = 200) -> DataFrame:
    return runs.orderBy(F.desc("finished_at"), F.desc("event_id")).limit(most)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row on a batch of results(status, jobs_seen): how many of each status, how many at all, and the jobs seen."""
    of = [F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "blocked", "running")]
    return results.agg(F.count(F.lit(1)).alias("sources"), *of, F.sum("jobs_seen").alias("jobs_seen"))
