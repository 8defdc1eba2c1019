"""Audited sources and pages: normal forms, safe new urls, overlays, snapshots admitted row by row, and walks that announce nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import fixed, urls
from postlake.functions.text import blank_to_null

# What audit files say of uploads and alerts, and states without a career page.
CAN, CAN_WHEN_APPLYING = "가능", "지원 시 가능"
NOT_ENABLED = ("NO_ACTIVE_CAREERS", "UNRESOLVED")


def company_tokens(company: Column) -> Column:
    """The lower-case words of a name that tell it from others: four letters and more, or three and more in capitals."""
    words = F.filter(F.split(company, "[^A-Za-z0-9]+"), lambda w: (F.length(w) >= 4) | ((F.length(w) >= 3) & (w == F.upper(w))))
    return F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*fixed.COMPANY_STOP_WORDS))


def first_rule(rules: list[tuple[str, Column, Column | bool]]) -> Column:
    """The verdict of the first of (name, condition, verdict) whose condition holds; false where none does or it cannot be told."""
    verdict = F.lit(False)
    for _, condition, then in reversed(rules):
        verdict = F.when(condition, F.lit(then)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def safe_recommendation(company: Column, original: Column, recommended: Column) -> Column:
    """Whether a recommended career page is the company's own, by a table of rules. Junk urls are not."""
    (_, host0, _, _), (_, host, path, query) = urls.parts(original), urls.parts(recommended)
    whole, labels = F.concat(path, query), lambda h: F.split(h, r"\.")
    root = lambda h: F.array_join(F.slice(labels(h), F.greatest(F.size(labels(h)) - 1, F.lit(1)), 2), ".")
    for_jobs = whole.rlike(fixed.JOB_PATH)
    on_career_host = host.rlike(r"^(jobs?|careers?)\.")
    of_careers = host.rlike(r"\.jobs$") | host.rlike("careers?")
    names_company = F.exists(company_tokens(company), lambda t: F.lower(F.concat(host, path)).contains(t))
    return first_rule([
        ("no host on either side", (host == "") | (host0 == ""), False),
        ("a list of others' postings", host.rlike(fixed.THIRD_PARTY_AGGREGATOR) | (host.rlike(r"^(www\.)?ycombinator\.com$") & path.rlike("(?i)^/jobs/?$")), False),
        ("a page that lists nothing", whole.rlike(fixed.NON_LISTING_PATH), False),
        ("a single posting", whole.rlike(fixed.JOB_DETAIL) & ~path.rlike(r"(?i)/jobs?/search([/?#]|$)"), False),
        ("the same origin", urls.origin(original) == urls.origin(recommended), for_jobs | on_career_host | of_careers),
        ("the same root domain", root(host0) == root(host), for_jobs | on_career_host),
        ("a board whose url names no company", host.rlike(r"^recruiting[0-9]*\.ultipro\.com$") & path.rlike("(?i)/JobBoard/"), True),
        ("the company's name on a career host", names_company, host.rlike(fixed.ATS_HOST) | of_careers | host.rlike(r"^(jobs?|careers?|talent)\.") | for_jobs),
    ])


def _tenant_catalog(url: Column) -> Column:
    """The one catalog whose url names its company by a number alone (fixed values)."""
    scheme, host, path, query = urls.parts(url)
    has = lambda k, v: query.rlike(f"(?i)[?&]{k}={v}(&|$)")
    return (scheme == "https") & (host == "cgi.njoyn.com") & (F.lower(path) == "/corp/xweb/xweb.asp") & has("clid", "21001") & has("page", "joblisting") & has("countryid", "us")


def safe_listing(company: Column, original: Column, candidate: Column) -> Column:
    """Whether a page may be read as the company's listing: a safe recommendation, a public catalog, or its own tenant; no vendor's home."""
    (_, host0, _, _), (_, host, path, query) = urls.parts(original), urls.parts(candidate)
    never = (host == "") | (host0 == "") | (host.rlike(fixed.ATS_VENDOR_LANDING) & path.rlike("^/?$")) | F.concat(path, query).rlike(fixed.NON_LISTING_PATH)
    tenant = (F.lower(F.trim(company)) == "cgi") & _tenant_catalog(candidate) & (host0.rlike(r"(^|\.)cgi\.com$") | _tenant_catalog(original))
    either = F.coalesce(tenant, F.lit(False)) | safe_recommendation(company, original, candidate) | F.coalesce(urls.is_public_catalog(candidate), F.lit(False))
    return F.coalesce(~never & either, F.lit(False))


def verified_identity(job: Column, requisition: Column, official: Column, apply: Column) -> Column:
    """Whether a reviewed pair of urls belongs to one requisition; hosts and shapes are fixed values of one company."""
    (s0, h0, p0, q0), (s1, h1, p1, q1) = urls.parts(official), urls.parts(apply)
    wanted = F.upper(F.trim(requisition))
    plain = (q0 == "") & (q1 == "") & ~official.contains("#") & ~apply.contains("#") & (s0 == "https") & (s1 == "https")
    ok = F.length(F.trim(job)).between(1, 200) & wanted.rlike(r"^JR-[0-9]{6,12}$") & plain & (h0 == "search.jobs.barclays") & p0.rlike(r"(?i)^/job/([^/?#]+/)+13015/[0-9]+/?$")
    ok &= (h1 == "barclays.wd3.myworkdayjobs.com") & p1.rlike(r"(?i)^/External_Career_Site_Barclays/job/([^/?#]+/)+[^/?#]+/apply/?$") & p1.contains(F.concat(F.lit("_"), wanted, F.lit("/apply")))
    return F.coalesce(ok, F.lit(False))


def host_adapter(url: Column) -> Column:
    """The application system that serves a url, by its host first of all; ``custom`` for any other."""
    _, host, path, query = urls.parts(url)
    below = lambda d: (host == d) | F.endswith(host, F.lit("." + d))
    return (
        F.when(F.endswith(host, F.lit("greenhouse.io")) | query.rlike("[?&]gh_jid(=|&|$)"), "greenhouse").when(below("lever.co") & (host != "lever.co"), "lever")
        .when(host.contains("myworkdayjobs") | host.contains("myworkdaysite") | F.startswith(host, F.lit("workday")), "workday").when(F.endswith(host, F.lit("ashbyhq.com")), "ashby").when(host.contains("icims"), "icims")
        .when(host.contains("phenom") | F.lower(url).contains("jointalentcommunity"), "phenom").when(below("dayforcehcm.com"), "dayforce").when(below("smartrecruiters.com"), "smartrecruiters").otherwise("custom")
    )


def audited(records: DataFrame) -> DataFrame:
    """Sources of audit records(ledger_id, master_row, company, posting_url, adapter, verification, confidence, resume_upload, job_alerts)."""
    seen = F.coalesce(host_adapter(F.col("posting_url")), F.lit("custom"))
    adapter = F.when(seen.isin("dayforce", "smartrecruiters") | ((F.col("adapter") == "custom") & (seen != "custom")), seen).otherwise(F.coalesce("adapter", seen))
    return records.select(
        F.lower(F.coalesce("ledger_id", F.concat(F.lit("audit-row-"), F.col("master_row").cast("string")))).alias("source_id"), "master_row", F.trim("company").alias("company"), blank_to_null(F.col("posting_url")).alias("posting_url"), adapter.alias("adapter"),
        F.lower("verification").alias("verification"), F.lower("confidence").alias("confidence"), F.when(F.col("resume_upload") == CAN, "available").when(F.col("resume_upload") == CAN_WHEN_APPLYING, "job_only").otherwise("unknown").alias("resume_upload"),
        F.when(F.col("job_alerts") == CAN, "available").otherwise("unknown").alias("job_alerts"), F.coalesce(~F.col("verification").isin(*NOT_ENABLED), F.lit(True)).alias("enabled"))


def repeated_keys(sources: DataFrame) -> DataFrame:
    """(kind, key, rows): ids and row numbers that more than one source has; none may, before sources are stored."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in ("source_id", "master_row")])
    return sources.select(F.explode(pairs).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def overlaid(sources: DataFrame, results: DataFrame, overrides: DataFrame, rejected: DataFrame) -> DataFrame:
    """sources(source_id, company, posting_url, adapter) with what overrides(source_id, url, adapter) state, else with the safe new url of
    results(source_id, url, adapter) that is not among rejected(url); applied tells what changed. An override may take a url away."""
    fresh = results.join(rejected.select("url"), "url", "left_anti").select("source_id", F.col("url").alias("_new"), F.col("adapter").alias("_new_adapter"))
    fixed = overrides.select("source_id", F.col("url").alias("_url"), F.col("adapter").alias("_adapter"), F.lit(True).alias("_fixed"))
    rows = sources.join(fresh, "source_id", "left").join(fixed, "source_id", "left")
    safe = F.coalesce((F.col("_new") != F.col("posting_url")) & safe_recommendation(F.col("company"), F.col("posting_url"), F.col("_new")), F.lit(False))
    pick = lambda a, b, c: F.when(F.col("_fixed"), F.col(a)).when(safe, F.col(b)).otherwise(F.col(c)).alias(c)
    return rows.select("source_id", "company", pick("_url", "_new", "posting_url"), pick("_adapter", "_new_adapter", "adapter"), F.coalesce("_fixed", safe).alias("applied"))


def admitted(snapshot: DataFrame, origins: DataFrame) -> DataFrame:
    """snapshot(source_id, title, official_url, external_id, ordinal) with reason: null where a row is admitted.

    origins(source_id, origin) are those a source may list. Rows without a title or url, or titled like no posting, are skipped; a url that is
    no https url, carries a user, or is of another origin is refused. Of one url the last row counts. external_id is read from the url where none is stated.
    """
    text = lambda c, n: F.nullif(F.substring(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), 1, n), F.lit(""))
    rows = snapshot.withColumns({"title": text("title", 500), "official_url": text("official_url", 2000), "external_id": text("external_id", 200)})
    scheme, host, path, query = urls.parts(F.col("official_url"))
    part = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    named = F.nullif(F.regexp_extract(query, "[?&]job[iI]d=([^&]*)", 1), F.lit(""))
    ids = F.coalesce("external_id", part(r"(?i)/jobs/([0-9]+)"), part(r"(?i)/JobDetail/[^/]+/([^/?#]+)"), part(r"(?i)/jobs?/([^/?#]+)"), named)
    known = origins.select("source_id", F.col("origin").alias("_origin")).distinct().withColumn("_known", F.lit(True))
    found = rows.withColumns({"_origin": urls.origin(F.col("official_url")), "external_id": ids}).join(known, ["source_id", "_origin"], "left")
    last = found.groupBy("source_id", "official_url").agg(F.max("ordinal").alias("_last"))
    reason = (
        F.when(F.col("title").isNull() | F.col("official_url").isNull() | F.col("title").rlike(fixed.NON_JOB_TITLE), "skipped").when((host == "") | host.isNull(), "invalid-url")
        .when((scheme != "https") | host.contains("@") | F.col("_known").isNull(), "outside-origin").when(F.col("ordinal") < F.col("_last"), "repeated")
    )
    return found.join(last, ["source_id", "official_url"], "left").select("source_id", "ordinal", "title", "official_url", "external_id", reason.alias("reason"))


def after_quiet_walk(items: DataFrame, messages: DataFrame, matches: DataFrame, walked: DataFrame) -> DataFrame:
    """items(message_id, match_id) that stay after walked(source_id) were read for the first time: all but unsent ones of matches(match_id, source_id,
    notified) not yet told. Messages left without items are those that no row here names."""
    quiet = matches.filter("NOT notified").join(walked.select("source_id").distinct(), "source_id", "left_semi").select("match_id")
    unsent = items.join(messages.filter("status <> 'sent'").select("message_id"), "message_id", "left_semi").join(quiet, "match_id", "left_semi")
    return items.join(unsent.select("message_id", "match_id").distinct(), ["message_id", "match_id"], "left_anti")
