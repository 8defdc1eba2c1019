"""Stored postings whose url changed: which incoming one replaces it, which mirrors close, and repairs asked for by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.urls import listing_identity_url, origin
from postlake.operators.lifecycle import mirror_id, mirror_title


def _identities(df: DataFrame) -> DataFrame:
    """One row per mirror identity of a row, with how late it is asked: by external id, then by requisition."""
    pair = lambda c, n: F.struct(mirror_id(F.col(c)).alias("identity"), F.lit(n).alias("rank"))
    each = df.select("*", F.explode(F.array(pair("external_id", 3), pair("requisition_id", 4))).alias("_i"))
    return each.filter("_i.identity <> ''").select("*", "_i.identity", "_i.rank").drop("_i")


def url_candidates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_id, official_url, rank, id, was, status): the stored postings that an incoming one may be, best rank first.

    Rank 0 has its url, 1 its external id (of several the largest id), 2 its listing identity and title, 3 and 4 an id of mirrors and its
    title; 2 to 4 only for a first-party listing. Four equi-joins on the source and one key each; a source's rows are never compared in pairs.
    """
    old = stored.select("source_id", "id", F.col("official_url").alias("was"), "status", "external_id", "requisition_id", mirror_title(F.col("title")).alias("_title"))
    new = incoming.select("source_id", "official_url", "external_id", "requisition_id", "first_party", mirror_title(F.col("title")).alias("_title"))
    own = new.filter("first_party")
    out = ["source_id", "official_url", "rank", "id", "was", "status"]
    exact = new.join(old.select("source_id", F.col("was").alias("official_url"), "id", "was", "status"), ["source_id", "official_url"]).withColumn("rank", F.lit(0))
    last = old.filter("external_id <> ''").groupBy("source_id", "external_id").agg(F.max(F.struct("id", "was", "status")).alias("r")).select("source_id", "external_id", "r.*")
    external = new.join(last, ["source_id", "external_id"]).withColumn("rank", F.lit(1))
    keyed = lambda df, url: df.drop("external_id", "requisition_id").withColumn("_listing", listing_identity_url(F.col(url)))
    listing = keyed(own, "official_url").join(keyed(old, "was"), ["source_id", "_listing", "_title"]).withColumn("rank", F.lit(2))
    known = _identities(old).select("source_id", "identity", "_title", "id", "was", "status").distinct()
    mirror = _identities(own).select("source_id", "official_url", "identity", "_title", "rank").join(known, ["source_id", "identity", "_title"])
    return exact.select(out).union(external.select(out)).union(listing.select(out)).union(mirror.select(out))


def url_targets(candidates: DataFrame) -> DataFrame:
    """(source_id, official_url, rank, id, was): the stored posting of each incoming one, of equal rank the smallest id."""
    return candidates.groupBy("source_id", "official_url").agg(F.min(F.struct("rank", "id", "was")).alias("t")).select("source_id", "official_url", "t.*")


def url_repairs(candidates: DataFrame) -> DataFrame:
    """(id, official_url): stored postings that take a new url; claimed by several, the smallest url counts."""
    return url_targets(candidates).filter("was <> official_url").groupBy("id").agg(F.min("official_url").alias("official_url"))


def repair_mirrors(candidates: DataFrame) -> DataFrame:
    """(id): open mirrors of an incoming posting that are neither its target nor on its url."""
    mirrors = candidates.filter("rank >= 2 AND status = 'open' AND was <> official_url").select("source_id", "official_url", "id")
    targets = url_targets(candidates).select("source_id", "official_url", F.col("id").alias("_target"))
    return mirrors.join(targets, ["source_id", "official_url"]).filter("id <> _target").select("id").distinct()


def valid_repair(id: Column, current: Column, new: Column) -> Column:
    """Whether a repair names a posting and moves it, over https, within one origin."""
    secure = lambda u: F.startswith(F.lower(u), F.lit("https://"))
    ok = (F.trim(id) != "") & (F.trim(current) != F.trim(new)) & secure(F.trim(current)) & secure(F.trim(new)) & (origin(current) == origin(new))
    return F.coalesce(ok, F.lit(False))


def repaired(state: DataFrame, repairs: DataFrame) -> DataFrame:
    """(id, official_url) of open postings that valid repairs(id, current_url, new_url) move: from the url they have to one their source lacks.

    Of several repairs of one posting from its url, the smallest new url counts.
    """
    asked = repairs.filter(valid_repair(F.col("id").cast("string"), F.col("current_url"), F.col("new_url"))).groupBy("id", F.trim("current_url").alias("official_url")).agg(F.min(F.trim("new_url")).alias("new_url"))
    moved = state.filter("status = 'open'").select("id", "source_id", "official_url").join(asked, ["id", "official_url"])
    taken = state.select("source_id", F.col("official_url").alias("new_url")).distinct()
    return moved.join(taken, ["source_id", "new_url"], "left_anti").select("id", F.col("new_url").alias("official_url"))


def closed_dead(state: DataFrame, dead: DataFrame) -> DataFrame:
    """(id) of open postings that dead(id, current_url) names by the https url that they still have."""
    named = dead.filter(F.startswith(F.lower(F.trim("current_url")), F.lit("https://"))).select("id", F.trim("current_url").alias("official_url")).distinct()
    return state.filter("status = 'open'").join(named, ["id", "official_url"], "left_semi").select("id")


# Shapes of urls that lead nowhere.
BROKEN_WORKDAY = r"(?s)^https://.*\.myworkdayjobs\.com/job/.*$"
BROKEN_ORACLE = r"(?is)oraclecloud\.com/en/sites/.*/job/.*/"


def broken_url(url: Column) -> Column:
    return F.coalesce(url.rlike(BROKEN_WORKDAY) | url.rlike(BROKEN_ORACLE) | (F.instr(url, "//jobs/") > 8), F.lit(False))


def sources_to_repair(sources: DataFrame, postings: DataFrame, after: int, most: int = 4) -> DataFrame:
    """The next enabled sources past ``after`` that hold an open posting on a broken url (a bounded batch is the feature)."""
    broken = postings.filter("status = 'open'").filter(broken_url(F.col("official_url"))).select("source_id").distinct()
    return sources.filter("enabled AND posting_url IS NOT NULL").filter(F.col("source_id") > after).join(broken, "source_id", "left_semi").orderBy("source_id").limit(most)


def resumed(sources: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """sources(source_id, posting_url, adapter) with page, cycle and previous_cycle of their checkpoints(source_id, value as JSON).

    A checkpoint counts only if it was written for the same url and adapter, with a positive whole page number and a start as text;
    what is malformed, or of another kind, starts over (nulls).
    """
    v = F.try_parse_json("value")
    of = lambda name, kind: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == ("STRING" if kind == "string" else "BIGINT"), F.try_variant_get(v, f"$.{name}", kind))
    read = checkpoints.select("source_id", of("listingUrl", "string").alias("posting_url"), of("adapter", "string").alias("adapter"), of("nextPage", "bigint").alias("page"), of("cycleStartedAt", "string").alias("cycle"), of("previousCycleStartedAt", "string").alias("previous_cycle"))
    return sources.join(read.filter("page > 0 AND cycle IS NOT NULL"), ["source_id", "posting_url", "adapter"], "left").select(*sources.columns, "page", "cycle", "previous_cycle")
