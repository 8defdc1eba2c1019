"""From matches to messages: the review feed, what was sent, and what a digest says. delivery.py has the rest of the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.alerts import first_of_identity


def review_feed(candidates: DataFrame, closed_keys: DataFrame, most: int = 100) -> DataFrame:
    """The next candidates(id, bucket, score, seen_at, keys) to review, best bucket first; how many are shown is the feature.

    A candidate claims all its keys whether or not it is shown, so a later one that shares any is not shown; neither is one that has a
    key of closed_keys(key), those of postings reviewed or sent before.
    """
    rank = candidates.withColumns({"_score": -F.col("score"), "_seen": -F.unix_seconds(F.col("seen_at").cast("timestamp"))})
    firsts = first_of_identity(rank, rank=["bucket", "_score", "_seen", "id"])
    known = candidates.select("id", F.explode("keys").alias("key")).join(closed_keys.select("key"), "key", "left_semi").select("id")
    return firsts.join(known, "id", "left_anti").orderBy("bucket", F.desc("score"), F.desc("seen_at"), "id").limit(most).drop("_score", "_seen")


def history_of(sent: DataFrame, matches: DataFrame) -> DataFrame:
    """(recipient, key, first_sent_at): what each recipient was told, under every key of it."""
    each = sent.join(matches.select("match_id", F.explode("keys").alias("key")), "match_id")
    return each.groupBy("recipient", "key").agg(F.min("sent_at").alias("first_sent_at"))


def status_summary(matches: DataFrame, items: DataFrame, recipients: DataFrame) -> DataFrame:
    """One row a profile: active matches, matches with an item in a queue, enabled recipients."""
    queued = items.filter("status = 'queued'").select("match_id").distinct().withColumn("_queued", F.lit(1))
    per = matches.filter("is_active").join(queued, "match_id", "left").groupBy("profile").agg(F.count(F.lit(1)).alias("active"), F.count("_queued").alias("queued"))
    people = recipients.filter("enabled").groupBy("profile").agg(F.count(F.lit(1)).alias("recipients"))
    return per.join(people, "profile", "left").withColumn("recipients", F.coalesce("recipients", F.lit(0)))


def candidates_for(canonical: DataFrame, topics: DataFrame, urls: DataFrame) -> DataFrame:
    """canonical postings whose url is among urls(source_id, official_url), with their sorted programs and recruiting years."""
    of = lambda prefix, name: F.array_sort(F.collect_set(F.when(F.startswith("topic_key", F.lit(prefix)), F.substring("topic_key", len(prefix) + 1, 200)))).alias(name)
    asked = canonical.join(urls.select("source_id", "official_url").distinct(), ["source_id", "official_url"], "left_semi")
    known = topics.groupBy(F.col("job_id").alias("id")).agg(of("program:", "program_keys"), of("year:", "recruiting_years"))
    blank = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return asked.join(known, "id", "left").select(*asked.columns, blank("program_keys"), blank("recruiting_years"))


def persisted(stored: DataFrame, judged: DataFrame) -> DataFrame:
    """Matches (job_id, profile, open_generation, score, terms, is_active, eligible) after judged(job_id, profile, open_generation, program_keys, score, evidence).

    Whatever its score, a posting of a student program is active and keeps its eligibility, 0 for a new one; any other only loses its
    activity where it was stored. evidence holds structs of code, label and points.
    """
    key = ["job_id", "profile", "open_generation"]
    gate = F.lit("candidate:student-program|Server program gate: internship or co-op|0")
    terms = F.concat(F.transform("evidence", lambda e: F.concat_ws("|", e.code, e.label, e.points.cast("string"))), F.array(gate))
    program = F.coalesce(F.arrays_overlap("program_keys", F.array(F.lit("internship"), F.lit("coop"))), F.lit(False))
    new = judged.select(*key, program.alias("_program"), F.col("score").alias("_score"), terms.alias("_terms"))
    rows = stored.withColumn("_stored", F.lit(True)).join(new, key, "full").filter("_stored OR _program")
    pick = lambda a, b: F.when(F.col("_program"), F.col(a)).otherwise(F.col(b)).alias(b)
    return rows.select(*key, pick("_score", "score"), pick("_terms", "terms"), F.coalesce("_program", "is_active").alias("is_active"), F.coalesce("eligible", F.lit(0)).alias("eligible"))


def decorated(items: DataFrame) -> DataFrame:
    """What a digest says of items(id, location, published_at, first_seen_at, program, is_summer, terms): when, where, why (four labels at most, the feature)."""
    day = lambda c: F.substring(c, 1, 10)
    label = lambda t: F.coalesce(F.nullif(F.get(F.split(t, r"\|"), F.lit(1)), F.lit("")), t)
    shown = F.coalesce(F.nullif("location", F.lit("")), F.lit("Location not specified"))
    posted = F.nullif("published_at", F.lit(""))
    timing = F.when(posted.isNotNull(), F.concat(F.lit("Posted "), day("published_at"))).otherwise(F.concat(F.lit("First seen "), day("first_seen_at")))
    note = F.when(F.col("program") == "Co-op", F.when(F.col("is_summer"), "Summer work term").otherwise("Work-term dates not stated; verify possible semester overlap"))
    return items.select("id", shown.alias("location"), timing.alias("timing"), note.alias("schedule_note"), F.slice(F.transform(F.coalesce("terms", F.array().cast("array<string>")), label), 1, 4).alias("reasons"))


def new_since(discovered: Column, first_seen: Column, watermark: Column) -> Column:
    """Whether a posting, found after its source's baseline, is newer than the profile's activation; without one all are."""
    return F.coalesce(discovered & (watermark.isNull() | (watermark == "") | (first_seen > watermark)), F.lit(False))
