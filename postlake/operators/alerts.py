"""Review and digest planning: suppression by identity, recipients, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_identity(candidates: DataFrame, keys: str = "keys", rank: list = ("rank",)) -> DataFrame:
    """Candidates that share no key with an earlier one, kept or not.

    A key's first claimant is a grouped minimum, so the OR over keys needs no pairs: explode, minimum, group back.
    """
    order = F.struct(*rank)
    each = candidates.select("id", order.alias("_r"), F.explode(keys).alias("_key"))
    claims = each.groupBy("_key").agg(F.min("_r").alias("_first"))
    late = each.join(claims, "_key").filter("_first < _r").select("id").distinct()
    return candidates.join(late, "id", "left_anti")


def sent_to_all(matches: DataFrame, recipients: DataFrame, sent: DataFrame) -> DataFrame:
    """Matches that every enabled recipient of their profile has been sent: a division by counts.

    Only what was sent is joined; no match meets all recipients. A match of a profile without recipients isn't among them.
    """
    people = recipients.filter("enabled").select("profile", "recipient").distinct()
    needed = people.groupBy("profile").agg(F.count(F.lit(1)).alias("_needed"))
    had = sent.select("match_id", "recipient").distinct().join(matches.select("match_id", "profile").distinct(), "match_id").join(people, ["profile", "recipient"])
    had = had.groupBy("match_id", "profile").agg(F.count(F.lit(1)).alias("_had"))
    return had.join(needed, "profile").filter("_had = _needed").select("match_id")


def envelopes(pending: DataFrame) -> DataFrame:
    """pending(match_id, recipient) by the set of recipients: one message for each set."""
    sets = pending.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_set("recipient")), ",").alias("recipients"))
    return sets.groupBy("recipients").agg(F.count(F.lit(1)).alias("matches"), F.min("match_id").alias("first_match"))


def retry(failed: DataFrame) -> DataFrame:
    """Minutes until the next attempt: 5, 15, 60, then 360."""
    return failed.withColumn("minutes", F.element_at(F.array(*map(F.lit, (5, 15, 60, 360))), F.least(F.greatest("attempt", F.lit(1)), F.lit(4)).cast("int")))


def top_per_bucket(feed: DataFrame, most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "id"))
    return feed.withColumn("n", nth).filter(F.col("n") <= most).drop("n")
