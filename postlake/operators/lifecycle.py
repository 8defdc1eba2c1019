"""The life of sources, listings and postings: what a crawl may close, keep, repair, lease and record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import fixed
from postlake.functions.classifiers import spaced

# Codes and words of blocked pages.
BLOCKED_CODES = (401, 403, 429, 520, 521, 522, 523, 524)
BLOCKED_WORDS = r"(?i)(cloudflare|captcha|challenge|blocked|access denied)"


def is_navigation(title: Column, url: Column) -> Column:
    plain = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.coalesce(plain.rlike(fixed.NAVIGATION_TITLE) | url.rlike(fixed.DOCUMENT_URL) | url.rlike(fixed.NAVIGATION_URL), F.lit(False))


def instant(text: Column) -> Column:
    """A timestamp of one of the two spellings in use, null for anything else."""
    return F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[T ][0-9]{2}:[0-9]{2}:[0-9]{2})"), F.regexp_replace(F.substring(text, 1, 19), "T", " ")))


def after_baseline(published: Column, baseline: Column, previous: Column) -> Column:
    """Whether a posting is new for its source: published no more than 36 hours before both known times. Unknown times count as new."""
    cutoff = F.greatest(instant(baseline), instant(previous)) - F.make_interval(hours=F.lit(36))
    return F.coalesce(instant(published) >= cutoff, F.lit(True))


def close_unseen(state: DataFrame, seen: DataFrame, complete: DataFrame) -> DataFrame:
    """state(source_id, official_url, title, status) with gone: open and not seen; of a source whose listing is not complete only what is no posting.

    complete(source_id, complete) has one row for each source that was listed; other sources lose nothing.
    """
    marked = state.join(seen.select("source_id", "official_url").distinct().withColumn("_seen", F.lit(True)), ["source_id", "official_url"], "left").join(complete, "source_id", "left")
    gone = (F.col("status") == "open") & F.col("_seen").isNull() & F.col("complete").isNotNull() & (F.col("complete") | is_navigation(F.col("title"), F.col("official_url")))
    return marked.withColumn("gone", F.coalesce(gone, F.lit(False))).select(*state.columns, "gone")


def two_cycle_close(state: DataFrame, cycles: DataFrame) -> DataFrame:
    """state with gone, for catalogs read page by page: open and last seen before the previous cycle of its source began."""
    rows = state.join(cycles.select("source_id", "previous_start"), "source_id", "left")
    return rows.withColumn("gone", F.coalesce((F.col("status") == "open") & (F.col("last_seen_at") < F.col("previous_start")), F.lit(False))).select(*state.columns, "gone")


def close_twins(state: DataFrame) -> DataFrame:
    """state with gone: an http posting whose https twin is open in the same source."""
    bare = F.regexp_replace("official_url", "^https?://", "")
    secure = state.filter("status = 'open'").filter(F.startswith("official_url", F.lit("https://"))).select("source_id", bare.alias("_bare")).distinct().withColumn("_twin", F.lit(True))
    rows = state.withColumn("_bare", bare).join(secure, ["source_id", "_bare"], "left")
    return rows.withColumn("gone", F.coalesce(F.startswith("official_url", F.lit("http://")) & F.col("_twin"), F.lit(False))).select(*state.columns, "gone")


def mirror_title(c: Column) -> Column:
    """A title in one width and lower case, signs as single spaces, to tell mirrors of one posting."""
    return F.trim(F.regexp_replace(F.lower(spaced(c)), r"[^\p{L}\p{N}]+", " "))


def mirror_id(c: Column) -> Column:
    """An id in one width and lower case, with its signs; null where it is blank."""
    return F.nullif(F.lower(spaced(c)), F.lit(""))


def without_mirrors(incoming: DataFrame) -> DataFrame:
    """incoming(source_id, ordinal, title, external_id, requisition_id, official_url, first_party) without the mirrors of first-party postings.

    Of one source's postings with the same title and id the first that is first-party is the one; a posting stays if no id of it has such a
    one, or if one of its ids leads to its own url. So other hosts' copies go, and so do later first-party ones under another url.
    ids count in one width and lower case, with their signs; ordinals are unique within a source.
    """
    ids = F.array_distinct(F.array_compact(F.array(mirror_id(F.col("external_id")), mirror_id(F.col("requisition_id")))))
    each = incoming.select("source_id", "ordinal", "official_url", "first_party", mirror_title(F.col("title")).alias("_title"), F.explode(ids).alias("_id"))
    chosen = each.filter("first_party").groupBy("source_id", "_title", "_id").agg(F.min_by("official_url", "ordinal").alias("_url"))
    met = each.join(chosen, ["source_id", "_title", "_id"]).groupBy("source_id", "ordinal").agg(F.bool_or(F.col("_url") == F.col("official_url")).alias("_own"))
    return incoming.join(met.filter(~F.col("_own")), ["source_id", "ordinal"], "left_anti").select(*incoming.columns)


def replace_topics(stored: DataFrame, fresh: DataFrame, touched: DataFrame, namespaces: tuple[str, ...]) -> DataFrame:
    """The topics after touched jobs were classified anew: theirs in the namespaces are those of fresh, all others stay."""
    inside = F.lit(False)
    for n in namespaces:
        inside |= (F.col("topic_key") == n) if not n.endswith(":") else F.startswith("topic_key", F.lit(n))
    kept = stored.filter(~inside).unionByName(stored.filter(inside).join(touched.select("job_id"), "job_id", "left_anti"))
    return kept.unionByName(fresh.filter(inside).join(touched.select("job_id"), "job_id", "left_semi")).distinct()


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def changes(stored: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and change: created, updated or unchanged, by a hash of the columns; nulls compare like values."""
    old, new = (df.select(*key, fingerprint(*columns).alias(name)) for df, name in ((stored, "_old"), (incoming, "_new")))
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return new.join(old, key, "left").select(*key, change.alias("change"))


def refresh_catalog(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources after a new version of the catalog: what changed its url or adapter starts over, all others keep their cursor and due time."""
    old = stored.select("source_id", F.col("url").alias("_url"), F.col("adapter").alias("_adapter"), "cursor", "next_run_at", F.lit(True).alias("_known"))
    rows = incoming.join(old, "source_id", "left")
    same = F.col("_known").isNotNull() & F.col("url").eqNullSafe(F.col("_url")) & F.col("adapter").eqNullSafe(F.col("_adapter"))
    return rows.select("source_id", "url", "adapter", F.when(same, F.col("cursor")).alias("cursor"), F.when(same, F.col("next_run_at")).alias("next_run_at"), (~same).alias("reset"))


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of now that before lacks, all columns compared."""
    h = lambda df: fingerprint(*df.columns)
    return now.withColumn("_h", h(now)).join(before.select(h(before).alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def lease_due(sources: DataFrame, now: str, most: int, minutes: int = 10) -> DataFrame:
    """The next sources to crawl (a bounded batch is the feature): enabled, due, not leased; never-run ones first, then by company."""
    at = F.lit(now).cast("timestamp")
    due = sources.filter("enabled").filter(F.col("next_run_at").isNull() | (F.col("next_run_at") <= at)).filter(F.col("lease_until").isNull() | (F.col("lease_until") <= at))
    return due.orderBy(F.asc_nulls_first("next_run_at"), "company", "source_id").limit(most).withColumn("lease_until", at + F.make_interval(mins=F.lit(minutes)))


def supersede(runs: DataFrame) -> DataFrame:
    """runs with status superseded where a run still counts as running and a later one of its source began."""
    last = runs.groupBy("source_id").agg(F.max(F.struct("finished_at", "event_id")).alias("_last"))
    old = (F.col("status") == "running") & (F.struct("finished_at", "event_id") < F.col("_last"))
    return runs.join(last, "source_id").withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).select(*runs.columns)


def admit_results(latest: DataFrame, results: DataFrame) -> DataFrame:
    """Second-try results with recorded and next_run_at: a success, or anything where nothing was known, counts; a backoff is never shortened."""
    rows = results.join(latest.select("source_id", F.col("status").alias("_before"), F.col("next_run_at").alias("_due")), "source_id", "left")
    recorded = (F.col("status") == "succeeded") | F.col("_before").isNull()
    return rows.select("source_id", "status", recorded.alias("recorded"), F.when(recorded & (F.col("status") == "succeeded"), F.col("next_run_at")).otherwise(F.greatest("_due", "next_run_at")).alias("next_run_at"))


def needs_fallback(status: Column, jobs_seen: Column) -> Column:
    return F.coalesce(status.isNull() | status.isin("blocked", "failed") | ((status == "succeeded") & (jobs_seen == 0)), F.lit(False))


def recovery_queue(sources: DataFrame, now: str, priority: DataFrame | None = None, most: int = 500) -> DataFrame:
    """Problem sources to read again in a browser, with place (``most`` at once is the feature).

    Those count that are due, or were checked between 45 minutes ago and 5 minutes ahead. Named priority(source_id) come first, then those that a native
    reader may recover, then by health: sources without postings before others, and in either group healthy, inactive, blocked and failed ones;
    then those unchecked for longest (never checked ones first of all), then by company and id.
    """
    at = F.lit(now).cast("timestamp")
    problem = F.col("health").isin("failed", "blocked", "inactive") | ((F.col("health") == "healthy") & (F.col("jobs") == 0))
    due = F.col("next_run_at").isNull() | (F.col("next_run_at") <= at) | F.col("checked_at").between(at - F.make_interval(mins=F.lit(45)), at + F.make_interval(mins=F.lit(5)))
    state = F.when(F.col("health") == "healthy", 0).when(F.col("health") == "inactive", 1).when(F.col("health") == "blocked", 2).otherwise(3)
    native = (F.col("adapter") == "workday") | (F.col("health") == "blocked") | (F.col("last_error") == "empty_board") | (F.col("jobs") > 0)
    rows = sources.filter(problem & F.coalesce(due, F.lit(False)))
    first = rows.join(priority.select("source_id").distinct().withColumn("_first", F.lit(True)), "source_id", "left") if priority is not None else rows.withColumn("_first", F.lit(None).cast("boolean"))
    ranked = first.withColumns({"native": F.coalesce(native, F.lit(False)), "rank": F.when(F.col("jobs") == 0, 0).otherwise(10) + state})
    order = [F.col("_first").isNull(), F.desc("native"), "rank", F.asc_nulls_first("checked_at"), "company", "source_id"]
    top = ranked.orderBy(*order).limit(most)  # a bounded number of rows is numbered
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_first")


def policy_changed(sources: DataFrame, checkpoints: DataFrame, jobs: DataFrame, policy: DataFrame, stored_version: str | None, version: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(sources, checkpoints, jobs, version) after a new crawl policy for the sources of policy(source_id).

    With another version than the stored one these sources start over: due now, without their checkpoint; and of their open postings those known to lie
    outside the policy's country (location_region non_us) close, while unknown and mixed ones stay open. With the same version nothing changes.
    """
    if stored_version == version:
        return sources, checkpoints, jobs, version
    named = policy.select("source_id").distinct().withColumn("_named", F.lit(True))
    mark = lambda df: df.join(named, "source_id", "left")
    hit, at = F.col("_named").isNotNull(), F.lit(now)
    due = mark(sources).withColumn("next_run_at", F.when(hit, at).otherwise(F.col("next_run_at"))).select(*sources.columns)
    out = F.coalesce(hit & (F.col("status") == "open") & (F.col("location_region") == "non_us"), F.lit(False))
    closed = mark(jobs).withColumns({"closed_at": F.when(out, F.coalesce("closed_at", at)).otherwise(F.col("closed_at")), "status": F.when(out, "closed").otherwise(F.col("status"))}).select(*jobs.columns)
    return due, checkpoints.join(named, "source_id", "left_anti"), closed, version


def quiet_walk(jobs: DataFrame, matches: DataFrame, messages: DataFrame, items: DataFrame, quiet: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs, matches, messages, items) after walks of the sources of quiet(source_id) that announce nothing.

    What was queued of their matches not yet told leaves the messages not yet sent, a message left without items goes, such matches are
    not eligible, and the sources' postings count as known from the start. Sent mail stays.
    """
    own = jobs.join(quiet.select("source_id").distinct(), "source_id", "left_semi").select(F.col("id").alias("job_id"))
    waiting = matches.filter("notified_at IS NULL").join(own, "job_id", "left_semi").select("match_id")
    unsent = messages.filter("status <> 'sent'").select("message_id")
    gone = items.join(waiting, "match_id", "left_semi").join(unsent, "message_id", "left_semi").select("message_id", "match_id").distinct()
    left = items.join(gone, ["message_id", "match_id"], "left_anti").select(*items.columns)
    empty = unsent.join(left.select("message_id"), "message_id", "left_anti")
    flagged = lambda df, key, names, column, value: df.join(names.distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn(column, F.when(F.col("_hit").isNotNull(), value).otherwise(F.col(column))).select(*df.columns)
    known = flagged(jobs, "id", own.select(F.col("job_id").alias("id")), "after_baseline", F.lit(False))
    return known, flagged(matches, "match_id", waiting, "eligible", F.lit(False)), messages.join(empty, "message_id", "left_anti"), left


def result_class(empty: Column, error: Column, jobs: Column, final_url: Column, code: Column) -> Column:
    """(status, code) of a second try; the first rule that fits decides."""
    of = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("code"))
    error = F.coalesce(error, F.lit(""))
    return (
        F.when(empty, of("succeeded", "empty_board")).when(F.startswith(error, F.lit("Rejected unsafe browser listing candidate:")), of("failed", "unsafe_listing"))
        .when((jobs > 0) & final_url.isNotNull(), of("succeeded", "jobs_recovered")).when(code.isin(*BLOCKED_CODES) | error.rlike(BLOCKED_WORDS), of("blocked", "blocked_challenge"))
        .when(code >= 400, of("failed", "http_error")).when(error.rlike("(?i)exceeded 60 seconds|timeout"), of("failed", "navigation_timeout")).when(error != "", of("failed", "navigation_error"))
        .otherwise(of("failed", "empty_board"))
    )


def drained(pages: DataFrame) -> DataFrame:
    """pages(source_id, external_id, official_url, title, ordinal) with one row a posting, by external id or else url; the last page wins."""
    last = F.max_by(F.struct("external_id", "official_url", "title"), "ordinal").alias("r")
    return pages.groupBy("source_id", F.coalesce("external_id", "official_url").alias("posting")).agg(last, F.count(F.lit(1)).alias("seen")).select("source_id", "posting", "r.*", "seen")


def merged_facets(native: DataFrame, derived: DataFrame) -> DataFrame:
    """(source_id, key, value, jobs): what the source itself counts wins over what its listing shows."""
    rows = native.withColumn("_own", F.lit(0)).unionByName(derived.withColumn("_own", F.lit(1)))
    return rows.groupBy("source_id", "key", "value").agg(F.min_by("jobs", "_own").alias("jobs"), (F.min("_own") == 0).alias("native"))


def running_and_stale(runs: DataFrame, now: str, latest: int = 100, seconds: int = 120) -> DataFrame:
    """One row on the latest runs (how many is the feature): running ones, and running ones older than that many seconds."""
    w = runs.orderBy(F.desc("finished_at"), F.desc("event_id")).limit(latest)
    old = F.col("finished_at") < F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(seconds))
    running = F.col("status") == "running"
    return w.agg(F.count(F.lit(1)).alias("runs"), F.count_if(running).alias("running"), F.count_if(running & old).alias("stale"))


def ranked_links(links: DataFrame, score: Column, least: int = 35) -> DataFrame:
    """links(page, pos, href, text), each url of a page once at its first place, that score at least so much, best first."""
    first = links.withColumn("href", F.regexp_replace("href", "#.*$", "")).groupBy("page", "href").agg(F.min(F.struct("pos", "text")).alias("f")).select("page", "href", "f.pos", "f.text")
    scored = first.withColumn("score", score).filter(F.col("score") >= least)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "pos")))
