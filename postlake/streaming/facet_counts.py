"""Facet counts kept up by what merges touch, in place of a recount.

Two tables of versions: the contributions (official_url, key, value) of each url's canonical posting, and the counts (key, value, jobs) of
distinct urls. A merge names the urls it touched; their contributions before and after give the deltas of the counts. Counts are
committed first, contributions after them, each once a batch: if the driver is lost between the two, the batch, coming again, finds its
counts there and only sets the contributions, which follow from the postings alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators.facets import own_values
from postlake.operators.search import canonical
from postlake.sources.shared import kept
from postlake.streaming.versions import VersionedTable

WRITER = "facets"


class FacetCounts:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], arrays: tuple[str, ...] = (), buckets: int = 64):
        self.keys, self.arrays = keys, arrays
        self.given = VersionedTable(spark, f"{path}/contributions", "official_url", buckets)
        self.counts = VersionedTable(spark, f"{path}/counts", "value", buckets)

    def contributions(self, postings: DataFrame) -> DataFrame:
        """(official_url, key, value): what the canonical posting of each url counts for; values count without regard to case."""
        rows = own_values(canonical(postings), self.keys, self.arrays).filter("label <> ''")
        return rows.select("official_url", "key", F.lower("label").alias("value")).distinct()

    def build(self, postings: DataFrame) -> None:
        rows = kept(self.contributions(postings))
        self.given.commit(rows, None)
        self.counts.commit(rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("jobs")), None)

    def apply(self, postings: DataFrame, touched: DataFrame, batch: int, between=None) -> None:
        """Follow a merge that left postings behind and touched(official_url); between is called between the two commits."""
        # the commits below read each of these more than once, and a version of the postings is large beside what it contributes
        urls = kept(touched.select("official_url").distinct())
        after = kept(self.contributions(postings.join(urls, "official_url", "left_semi")))
        before = self.given.read().join(urls, "official_url", "left_semi")
        moved = after.withColumn("n", F.lit(1)).unionByName(before.withColumn("n", F.lit(-1))).groupBy("key", "value").agg(F.sum("n").alias("n")).filter("n <> 0")
        moved = kept(moved)

        def add(now: DataFrame, deltas: DataFrame) -> DataFrame:
            both = now.select("key", "value", F.col("jobs").alias("n")).unionByName(deltas.select("key", "value", "n"))
            return both.groupBy("key", "value").agg(F.sum("n").alias("jobs")).filter("jobs > 0")

        self.counts.update(moved, add, WRITER, batch)
        if between:
            between()
        fresh = after.unionByName(urls.select("official_url", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
        self.given.update(fresh, lambda now, rows: now.join(rows.select("official_url").distinct(), "official_url", "left_anti").unionByName(rows.filter("key IS NOT NULL")), WRITER, batch)

    def read(self) -> DataFrame:
        return self.counts.read()
