"""Work done again in bounded steps, and facets that only the current generation of a source may replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guarded_facets(stored: DataFrame, snapshots: DataFrame, values: DataFrame, current: DataFrame) -> DataFrame:
    """stored facets(source_id, facet_key, value_key, jobs, observed_at), replaced by those snapshots that are of their source's current generation.

    snapshots(source_id, generation, observed_at) has one row a listing, also where it has no facets, and then none stay;
    values(source_id, generation, facet_key, value_key, jobs, ordinal) are its facets, of which the last counts. current(source_id, generation).
    """
    valid = snapshots.join(current, ["source_id", "generation"], "left_semi")
    fresh = values.groupBy("source_id", "generation", "facet_key", "value_key").agg(F.max_by("jobs", "ordinal").alias("jobs")).join(valid, ["source_id", "generation"])
    kept = stored.join(valid.select("source_id"), "source_id", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def batch(postings: DataFrame, after, most: int) -> DataFrame:
    """The next open postings in the order of their ids: at most so many (the feature), beyond the cursor ``after`` (None: from the first)."""
    rows = postings.filter("status = 'open'")
    return (rows if after is None else rows.filter(F.col("id") > after)).orderBy("id").limit(most)


def program_topics(classified: DataFrame) -> DataFrame:
    """(job_id, topic_key, evidence) of rows with type and program: a co-op by its type is that alone, else the title's programs count."""
    by_type = F.coalesce(F.col("type") == "Co-op", F.lit(False))
    title = F.array(*[F.struct(F.lit(f"program:{p}").alias("topic_key"), F.col(f"program.{p}").alias("evidence")) for p in ("internship", "coop")])
    found = F.when(by_type, F.array(F.struct(F.lit("program:coop").alias("topic_key"), F.lit("employment_type:coop").alias("evidence")))).otherwise(title)
    return classified.select(F.col("id").alias("job_id"), F.explode(found).alias("t")).select("job_id", "t.*").filter("evidence IS NOT NULL")


def replaced_topics(topics: DataFrame, done: DataFrame, made: DataFrame, prefix: str) -> DataFrame:
    """topics(job_id, topic_key, ...) where those with the prefix, of the postings done, are the made ones."""
    ours = done.select(F.col("id").alias("job_id")).withColumn("_done", F.lit(True))
    stale = F.startswith("topic_key", F.lit(prefix)) & F.col("_done")
    return topics.join(ours, "job_id", "left").filter(~F.coalesce(stale, F.lit(False))).drop("_done").unionByName(made)


def checkpoint(postings: DataFrame, done: DataFrame, made: DataFrame) -> DataFrame:
    """One row: processed, matched, memberships, next_cursor (null at the end) and more: whether open postings are left beyond it."""
    step = done.agg(F.count(F.lit(1)).alias("processed"), F.max("id").alias("next_cursor"))
    hits = made.agg(F.countDistinct("job_id").alias("matched"), F.count(F.lit(1)).alias("memberships"))
    last = postings.filter("status = 'open'").agg(F.max("id").alias("_last"))
    row = step.crossJoin(hits).crossJoin(last)  # one row each
    return row.select("processed", "matched", "memberships", "next_cursor", F.coalesce(F.col("_last") > F.col("next_cursor"), F.lit(False)).alias("more"))
