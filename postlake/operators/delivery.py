"""From judged matches to sent messages: reviews, plans of digests, claims, and what a delivery does to its message.

Relations, beside columns of their own:
matches(match_id, profile, job_id, generation, score, is_active, eligible, notified_at);
jobs(job_id, generation, status, canonical, student, after_baseline, official_url, apply_url, first_seen_at, published_at, keys);
profiles(profile, enabled, mail_state, activation, next_digest_at, lease_until); recipients(profile, recipient, enabled);
messages(message_id, profile, channel, recipients, status, matches, scheduled_at, attempt, retry_at, lease_until, error, sent_at);
items(message_id, match_id, recipient); history(profile, recipient, key, first_sent_at).
Times are timestamps. Every step is a function from relations to relations, so a step that runs again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.alerts import first_of_identity
from postlake.operators.ranking import placed

# Minutes until a message is tried again, by attempts; minutes of a lease, between digests, and of grace before one is due.
DELAYS = (5, 15, 60, 360)
LEASE, PAUSE, GRACE = 5, 120, 1
# The status that each kind of failure leads to.
FAILURES = {"auth": "auth_blocked", "retryable": "retryable", "permanent": "failed"}


def later(at: Column, minutes: int | Column) -> Column:
    return at + F.make_interval(mins=F.lit(minutes) if isinstance(minutes, int) else minutes)


def _time(now: str) -> Column:
    return F.lit(now).cast("timestamp")


# -- reviews -------------------------------------------------------------------------------------------------------------------------


def _plain(c: str, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", "")), 1, most)


def web_url(c: Column) -> Column:
    """A url of the web with scheme and host in lower case and at least a slash as path; null for anything else."""
    head, rest = F.regexp_extract(c, r"(?i)^(https?://[^/?#\s]+)(\S*)$", 1), F.regexp_extract(c, r"(?i)^(https?://[^/?#\s]+)(\S*)$", 2)
    return F.when(head != "", F.concat(F.lower(head), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def targets(matches: DataFrame, jobs: DataFrame, profiles: DataFrame, history: DataFrame) -> DataFrame:
    """What may be reviewed: active matches of open, canonical postings of student programs, with is_new and notified (to anyone of the profile)."""
    rows = matches.filter("is_active").join(jobs.filter("status = 'open' AND canonical AND student"), ["job_id", "generation"]).join(profiles.select("profile", "activation"), "profile")
    told = rows.select("match_id", "profile", F.explode("keys").alias("key")).join(history.select("profile", "key").distinct(), ["profile", "key"], "left_semi")
    rows = rows.join(told.select("match_id").distinct().withColumn("_told", F.lit(True)), "match_id", "left")
    new = F.coalesce(F.col("after_baseline") & (F.col("activation").isNull() | (F.col("first_seen_at") > F.col("activation"))), F.lit(False))
    return rows.select("match_id", "profile", "job_id", "official_url", "apply_url", new.alias("is_new"), F.col("_told").isNotNull().alias("notified"))


def decided(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """reviews(review, profile, job_id, official_url, decision, rationale, verified_url) with match_id and reason: why one is refused, else null.

    A review names its match by the posting's id or its url; of several the smallest match_id counts. The first reason counts.
    candidates are those of :func:`targets`.
    """
    asked = reviews.select("review", "profile", F.nullif(_plain("job_id", 200), F.lit("")).alias("_job"), F.nullif(_plain("official_url", 2000), F.lit("")).alias("_url"))
    c = candidates.withColumn("job_id", F.col("job_id").cast("string"))
    named = asked.join(c, (asked["profile"] == c["profile"]) & (F.col("_job") == c["job_id"])).select("review", "match_id", c["official_url"], "apply_url", "is_new", "notified")
    linked = asked.join(c, (asked["profile"] == c["profile"]) & (F.col("_url") == c["official_url"])).select("review", "match_id", c["official_url"], "apply_url", "is_new", "notified")
    found = named.unionByName(linked).groupBy("review").agg(F.min(F.struct("match_id", "official_url", "apply_url", "is_new", "notified")).alias("t"))
    verified = web_url(_plain("verified_url", 2000))
    rows = reviews.join(found, "review", "left")
    invalid = ~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)) | (_plain("rationale", 2000) == "") | verified.isNull()
    reason = (
        F.when(invalid, "invalid_review_payload").when(F.col("t").isNull(), "job_match_not_found").when(~F.col("t.is_new"), "job_is_not_new_after_source_baseline")
        .when(F.col("t.notified"), "posting_identity_already_notified")
        .when(~(verified.eqNullSafe(F.col("t.official_url")) | verified.eqNullSafe(F.col("t.apply_url"))), "verified_url_does_not_match_official_url")
    )
    return rows.select("review", "profile", "decision", F.when(~invalid, F.col("t.match_id")).alias("match_id"), reason.alias("reason"))


def apply_reviews(matches: DataFrame, messages: DataFrame, items: DataFrame, profiles: DataFrame, judged: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(matches, messages, items, profiles) after the accepted of judged (of :func:`decided`), in order of review.

    The last decision on a match sets its eligibility; any rejection takes it out of messages not yet sent, and a message
    left without items goes; an approval makes its profile's next digest due now.
    """
    accepted = judged.filter("reason IS NULL")
    last = accepted.groupBy("match_id").agg(F.max_by("decision", "review").alias("_decision"), F.bool_or(F.col("decision") == "reject").alias("_rejected"))
    rows = matches.join(last.select("match_id", "_decision"), "match_id", "left")
    rows = rows.withColumn("eligible", F.when(F.col("is_active") & F.col("_decision").isNotNull(), F.col("_decision") == "approve").otherwise(F.col("eligible"))).select(*matches.columns)
    unsent = messages.filter("status <> 'sent'").select("message_id")
    dropped = items.join(last.filter("_rejected").select("match_id"), "match_id", "left_semi").join(unsent, "message_id", "left_semi").select("message_id", "match_id", "recipient")
    left = items.join(dropped, ["message_id", "match_id", "recipient"], "left_anti")
    empty = unsent.join(left.select("message_id"), "message_id", "left_anti")
    approved = accepted.filter("decision = 'approve'").select("profile").distinct().withColumn("_approved", F.lit(True))
    due = F.col("_approved").isNotNull() & (F.col("next_digest_at").isNull() | (F.col("next_digest_at") > _time(now)))
    people = profiles.join(approved, "profile", "left").withColumn("next_digest_at", F.when(due, _time(now)).otherwise(F.col("next_digest_at"))).select(*profiles.columns)
    return rows, messages.join(empty, "message_id", "left_anti"), left.select(*items.columns), people


# -- plans ---------------------------------------------------------------------------------------------------------------------------


def pending(matches: DataFrame, jobs: DataFrame, recipients: DataFrame, items: DataFrame, history: DataFrame) -> DataFrame:
    """(profile, match_id, score, time, recipient) still to tell.

    Of postings that share an identity the best by score, time and id counts for all recipients, also while it waits in a message:
    its lesser twins are not told in its place. What a recipient was told under any key, or has an item of, is left out.
    """
    live = matches.filter("is_active AND eligible").join(jobs.filter("status = 'open' AND after_baseline"), ["job_id", "generation"]).withColumn("time", F.coalesce("published_at", "first_seen_at"))
    ranked = live.select(F.col("match_id").alias("id"), (-F.col("score")).alias("_score"), (-F.unix_micros(F.col("time").cast("timestamp"))).alias("_time"), F.transform("keys", lambda k: F.concat_ws(" ", F.col("profile").cast("string"), k)).alias("keys"), "canonical")
    best = first_of_identity(ranked, rank=["_score", "_time", "id"]).filter("canonical").select(F.col("id").alias("match_id"))
    due = live.join(best, "match_id", "left_semi").join(recipients.filter("enabled").select("profile", "recipient").distinct(), "profile")
    due = due.join(items.select("match_id", "recipient"), ["match_id", "recipient"], "left_anti")
    told = due.select("match_id", "recipient", "profile", F.explode("keys").alias("key")).join(history.select("profile", "recipient", "key"), ["profile", "recipient", "key"], "left_semi")
    return due.join(told.select("match_id", "recipient"), ["match_id", "recipient"], "left_anti").select("profile", "match_id", "score", "time", "recipient")


def recipient_sets(rows: DataFrame) -> DataFrame:
    """One row a match of :func:`pending`, with the set of its recipients as text."""
    people = F.array_join(F.array_sort(F.collect_set(F.col("recipient").cast("string"))), ", ").alias("recipients")
    return rows.groupBy("profile", "match_id", "score", "time").agg(people)


BEST = ("score", "time")


def may_plan(now: str) -> Column:
    """Whether a profile may be planned for: enabled, with mail, due within a minute, and not held by another planner."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= _time(now))
    due = F.col("next_digest_at").isNull() | (F.col("next_digest_at") <= later(_time(now), GRACE))
    return F.coalesce(F.col("enabled") & (F.col("mail_state") == "connected") & due & free, F.lit(False))


def plan(rows: DataFrame, profiles: DataFrame, now: str, most: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, items, profiles) of one planning: at most one message a profile, with ``most`` matches (both are the feature).

    The best match of a profile names the set of recipients; its message takes the matches of that set among the best ``most`` + 1. What is left
    makes the profile due again at once, else it rests. The rank is limited before the shuffle, so no task holds a profile's backlog.
    """
    ready = profiles.filter(may_plan(now))
    order = Window.partitionBy("profile").orderBy(F.desc("score"), F.desc("time"), "match_id")
    top = recipient_sets(rows.join(ready.select("profile"), "profile", "left_semi")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most + 1)
    lead = F.first("recipients").over(Window.partitionBy("profile").orderBy("nth"))
    taken = F.sum(F.when(F.col("recipients") == F.col("_lead"), 1).otherwise(0)).over(Window.partitionBy("profile").orderBy("nth"))
    top = top.withColumn("_lead", lead).withColumn("_taken", taken)
    chosen = (F.col("recipients") == F.col("_lead")) & (F.col("_taken") <= most)
    left = top.groupBy("profile").agg(F.count_if(~chosen).alias("_left"))
    rests = profiles.withColumn("_ready", may_plan(now)).join(left, "profile", "left")
    next_at = F.when(F.coalesce("_left", F.lit(0)) > 0, _time(now)).otherwise(later(_time(now), PAUSE))
    rests = rests.withColumn("next_digest_at", F.when(F.col("_ready"), next_at).otherwise(F.col("next_digest_at"))).select(*profiles.columns)
    own = top.filter(chosen).withColumn("message_id", F.concat_ws("@", F.col("profile").cast("string"), F.lit(now)))
    items = own.select("message_id", "match_id", F.explode(F.split("recipients", ", ")).alias("recipient"))
    messages = own.groupBy("message_id", "profile", "recipients").agg(F.count(F.lit(1)).alias("matches")).select(
        "message_id", "profile", F.lit("email").alias("channel"), "recipients", F.lit("queued").alias("status"), "matches", _time(now).alias("scheduled_at"), F.lit(0).alias("attempt"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("retry_at", "timestamp"), ("lease_until", "timestamp"), ("error", "string"), ("sent_at", "timestamp"))])
    return messages, items, rests


def numbered(rows: DataFrame, most: int = 500) -> DataFrame:
    """Every match of :func:`pending` with the message it would be part of, were all of them planned now: of each profile and set of recipients
    ``most`` a message, best first. A set may hold nearly all matches; its places come from a sort by range."""
    sets = recipient_sets(rows)
    out = placed(sets, ["profile", "recipients"], [F.desc("score"), F.desc("time"), F.asc("match_id")])
    return out.withColumn("message", F.floor((F.col("place") - 1) / most))


# -- delivery ------------------------------------------------------------------------------------------------------------------------


def claim(messages: DataFrame, profiles: DataFrame, now: str, most: int = 4) -> DataFrame:
    """messages after a sender took the next ones of each profile (how many at once is the feature): those queued, due again, or in sending past
    their lease, of enabled profiles with mail, oldest first. They are sending, leased, and count one more attempt."""
    at = _time(now)
    free = (F.col("status") == "queued") | ((F.col("status") == "retryable") & (F.col("retry_at") <= at)) | ((F.col("status") == "sending") & (F.col("lease_until") <= at))
    able = profiles.filter("enabled AND mail_state = 'connected'").select("profile")
    nth = F.row_number().over(Window.partitionBy("profile").orderBy("scheduled_at", "message_id"))
    chosen = messages.filter(free & (F.col("channel") == "email")).join(able, "profile", "left_semi").select("profile", "message_id", "scheduled_at").withColumn("nth", nth).filter(F.col("nth") <= most)
    rows = messages.join(chosen.select("message_id", F.lit(True).alias("_mine")), "message_id", "left")
    mine = F.col("_mine").isNotNull()
    return rows.withColumns({
        "status": F.when(mine, "sending").otherwise(F.col("status")), "lease_until": F.when(mine, later(at, LEASE)).otherwise(F.col("lease_until")),
        "attempt": F.when(mine, F.col("attempt") + 1).otherwise(F.col("attempt")), "error": F.when(~mine, F.col("error")),
    }).select(*messages.columns)


def _changed(messages: DataFrame, touched: DataFrame, changes) -> DataFrame:
    """messages with changes(hit) applied, where hit is whether touched(message_id, ...) has the message."""
    rows = messages.join(touched.withColumn("_hit", F.lit(True)), "message_id", "left")
    return rows.withColumns(changes(F.col("_hit").isNotNull())).select(*messages.columns)


def _keep(hit: Column, **new: Column | None) -> dict[str, Column]:
    return {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()}


def released(messages: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """messages after claimed ones were given back unsent: queued, as if this attempt had not been."""
    def changes(hit):
        hit = hit & (F.col("status") == "sending")
        return _keep(hit, attempt=F.greatest(F.col("attempt") - 1, F.lit(0)), retry_at=_time(now), lease_until=None, error=None) | _keep(hit, status=F.lit("queued"))

    return _changed(messages, ids.select("message_id").distinct(), changes)


def sent(messages: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """messages after those of ids that are in sending went out."""
    def changes(hit):
        hit = hit & (F.col("status") == "sending")
        return _keep(hit, sent_at=_time(now), retry_at=None, lease_until=None, error=None) | _keep(hit, status=F.lit("sent"))

    return _changed(messages, ids.select("message_id").distinct(), changes)


def delay(attempt: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DELAYS)), F.greatest(F.least(attempt, F.lit(len(DELAYS))), F.lit(1)).cast("int"))


def failed(messages: DataFrame, failures: DataFrame, now: str) -> DataFrame:
    """messages after failures(message_id, kind, reason): refused by the mail's sign-in they wait, passing trouble is tried again after 5, 15,
    60 and then 360 minutes by the attempts counted when claimed, anything else ends there. No number of attempts ends a message."""
    def changes(hit):
        status = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])[F.col("_kind")]
        again = F.when(F.col("_kind") == "retryable", later(_time(now), delay(F.col("attempt"))))
        return _keep(hit, status=status, error=F.substring("_reason", 1, 500), retry_at=again, lease_until=None)

    one = failures.groupBy("message_id").agg(F.max(F.struct("kind", "reason")).alias("f")).select("message_id", F.col("f.kind").alias("_kind"), F.col("f.reason").alias("_reason"))
    return _changed(messages, one, changes)


def profiles_after_failures(profiles: DataFrame, messages: DataFrame, failures: DataFrame) -> DataFrame:
    """profiles, blocked where the mail's sign-in refused one of their messages."""
    refused = messages.join(failures.filter("kind = 'auth'").select("message_id"), "message_id", "left_semi").select("profile").distinct().withColumn("_refused", F.lit(True))
    rows = profiles.join(refused, "profile", "left")
    return rows.withColumn("mail_state", F.when(F.col("_refused").isNotNull(), "blocked").otherwise(F.col("mail_state"))).select(*profiles.columns)


def retried(messages: DataFrame, profile: int, now: str) -> DataFrame:
    """messages, those of the profile that failed for good or by sign-in due again now, without their error."""
    again = F.coalesce((F.col("profile") == profile) & (F.col("channel") == "email") & F.col("status").isin("auth_blocked", "failed"), F.lit(False))
    return messages.withColumns(_keep(again, retry_at=_time(now), error=None) | _keep(again, status=F.lit("retryable")))


def cleared(messages: DataFrame, items: DataFrame, matches: DataFrame, profile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, items, matches) without the profile's backlog: its unsent messages with their items go, and matches never told are not eligible."""
    unsent = messages.filter((F.col("profile") == profile) & (F.col("status") != "sent")).select("message_id")
    waiting = F.coalesce((F.col("profile") == profile) & F.col("notified_at").isNull(), F.lit(False))
    return messages.join(unsent, "message_id", "left_anti"), items.join(unsent, "message_id", "left_anti"), matches.withColumn("eligible", ~waiting & F.col("eligible"))
