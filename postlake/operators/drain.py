"""Catalogs drained pass by pass until nothing is left to read: iteration to a fixpoint, with each pass written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.sources.shared import kept

STATE = "source_id long, cursor long, total long, stalls int, done boolean, error string"


def drain(spark: SparkSession, sources: DataFrame, crawl: Callable[[DataFrame, int], DataFrame], max_passes: int = 20, max_stalls: int = 1) -> tuple[DataFrame, DataFrame]:
    """(postings, state) of all sources(source_id), each read from page one until its cycle is complete.

    crawl(open(source_id, cursor), pass) gives the segments that a pass reads: (source_id, ok, next_page, total, complete, jobs array of
    struct(external_id, official_url, title)), at most one a source. A posting is known by its external id, or else its url; the last
    pass that has it counts, and within a pass its last place. A pass without success, postings or advance is a stall; of a source more than max_stalls in a
    row, a change of the page count, or max_passes end it with an error, and its postings do not count. State and postings of each pass are
    written, so a pass never repeats those before it; the loop ends with the last open source.
    """
    state = sources.select("source_id").distinct().select("source_id", F.lit(1).cast("long").alias("cursor"), F.lit(None).cast("long").alias("total"), F.lit(0).alias("stalls"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"))
    state, seen = kept(state), None
    for number in range(max_passes):
        open_ = state.filter("NOT done AND error IS NULL")
        if open_.isEmpty():
            break
        rows = kept(crawl(open_.select("source_id", "cursor"), number))
        good = F.coalesce(F.col("ok") & (F.size("jobs") > 0), F.lit(False))
        each = rows.filter(good).select("source_id", F.posexplode("jobs").alias("at", "job")).select("source_id", F.lit(number).alias("pass"), "at", "job.*")
        seen = each if seen is None else seen.unionByName(each)
        s = state.join(rows.withColumns({"_good": good, "_total": F.col("total")}).drop("jobs", "total", "ok"), "source_id", "left")
        was_open = ~F.col("done") & F.col("error").isNull()
        ok = F.coalesce("_good", F.lit(False))
        changed = ok & F.col("total").isNotNull() & ~F.col("_total").eqNullSafe(F.col("total"))
        finished = ok & ~changed & F.coalesce("complete", F.lit(False))
        advanced = ok & ~changed & ~finished & F.coalesce(F.col("next_page") > F.col("cursor"), F.lit(False))
        stalled = ~changed & ~finished & ~advanced
        error = (
            F.when(changed, "page count changed").when(stalled & (F.col("stalls") >= max_stalls), F.when(ok, "did not advance").otherwise("no result"))
            .when(F.lit(number == max_passes - 1) & ~finished, "too many passes")
        )
        state = kept(s.select(
            "source_id", F.when(was_open & advanced, F.col("next_page")).otherwise(F.col("cursor")).alias("cursor"), F.when(was_open & ok, F.coalesce("total", "_total")).otherwise(F.col("total")).alias("total"),
            F.when(was_open & stalled, F.col("stalls") + 1).when(was_open & advanced, 0).otherwise(F.col("stalls")).alias("stalls"), (F.col("done") | (was_open & finished)).alias("done"), F.when(was_open, error).otherwise(F.col("error")).alias("error")))
    if seen is None:
        seen = spark.createDataFrame([], "source_id long, pass int, at int, external_id string, official_url string, title string")
    last = F.max_by(F.struct("external_id", "official_url", "title"), F.struct("pass", "at")).alias("p")
    found = seen.groupBy("source_id", F.coalesce("external_id", "official_url").alias("posting")).agg(last).join(state.filter("done").select("source_id"), "source_id", "left_semi")
    return found.select("source_id", "posting", "p.*"), state
