"""What lists and detail views show of postings, and an audit of their topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.classifiers import spaced
from postlake.functions.text import blank_to_null


def clean_array(c: Column) -> Column:
    """Trimmed values without blanks and repeats, in their order; empty for null."""
    values = F.transform(F.coalesce(c, F.array().cast("array<string>")), F.trim)
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def json_texts(c: Column) -> Column:
    """The texts of a JSON array, in order; other members, malformed texts and null give none."""
    members = F.coalesce(F.from_json(c, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(members, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


# What states, regions and areas a mapped posting may have, and what stands for unknown texts.
STATES = ("new", "saved", "hidden", "applied")
ARRANGEMENTS = ("remote", "hybrid", "onsite")
REGIONS = ("us", "non_us", "mixed", "unknown")
AREAS = ("ai-ml", "data-analytics", "software-engineering")
NO_SUMMARY = "Open the official posting for the full role description."
NO_LOCATION = "Location not specified"
TEXTS = (
    "employment_type", "description", "responsibilities", "qualifications", "department", "team", "business_unit", "job_family", "job_function", "industry", "office", "location_city", "location_state", "location_country", "location_postal_code",
    "salary_currency", "salary_interval", "benefits", "education_requirements", "experience_requirements", "experience_level", "shift_schedule", "travel_requirements", "security_clearance", "requisition_id", "apply_url", "source_posted_text",
    "source_updated_at", "valid_through", "published_at",
)
JSON_ARRAYS = ("skills", "secondary_locations", "languages")


def mapped(rows: DataFrame) -> DataFrame:
    """Stored rows as a view shows them: unknown words replaced by defaults, blank texts null, JSON arrays as arrays of texts, evidence by its label.

    Of the optional columns only those that rows has are mapped (arrays only where they are JSON); all others pass through.
    """
    one_of = lambda c, words, default: F.when(F.col(c).isin(*words), F.col(c)).otherwise(default)
    or_else = lambda c, text: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text))
    label = lambda e: F.coalesce(blank_to_null(F.get(F.split(e, "[|]"), F.lit(1))), e)
    terms = F.array_distinct(F.filter(F.transform(json_texts(F.col("resume_match_evidence")), label), lambda t: t != ""))
    made = {
        "arrangement": one_of("arrangement", ARRANGEMENTS, "onsite"), "status": one_of("review_state", STATES, "new"), "location_region": one_of("location_region", REGIONS, "unknown"), "location": or_else("location", NO_LOCATION),
        "summary": or_else("summary", NO_SUMMARY), "area_keys": F.filter(json_texts(F.col("area_keys")), lambda a: a.isin(*AREAS)), "matched_terms": terms, "match_score": F.coalesce("resume_match_score", F.lit(0)),
    }
    made |= {c: blank_to_null(F.col(c)) for c in TEXTS if c in rows.columns} | {c: json_texts(F.col(c)) for c in JSON_ARRAYS if dict(rows.dtypes).get(c) == "string"}
    return rows.withColumns(made)


def area_keys(topics: DataFrame) -> DataFrame:
    """(id, area_keys): the sorted areas of each posting, without their prefix."""
    areas = topics.filter(F.startswith("topic_key", F.lit("area:")))
    return areas.groupBy(F.col("job_id").alias("id")).agg(F.sort_array(F.collect_set(F.expr("substring(topic_key, 6)"))).alias("area_keys"))


def listed(postings: DataFrame) -> DataFrame:
    """The list view: a summary of at most 1,200 characters (the feature), and defaults for what is unknown."""
    blank = [F.coalesce(blank_to_null(F.col(c)), F.lit(d)).alias(c) for c, d in (("arrangement", "onsite"), ("review_state", "new"), ("location", "Location not specified"))]
    return postings.select("id", "title", "company", *blank, "official_url", F.substring(F.coalesce("summary", "description"), 1, 1200).alias("summary"), "published_at", "first_seen_at")


def details(postings: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """The detail view: the posting, its areas in order, its source's name; blanks as nulls, arrays cleaned."""
    areas = F.coalesce("area_keys", F.array().cast("array<string>")).alias("area_keys")
    rows = postings.join(area_keys(topics), "id", "left").join(sources.select("source_id", "source_name"), "source_id", "left")
    return rows.select(
        "id", "source_id", "source_name", "title", "company", areas, F.substring(F.coalesce("summary", "description"), 1, 1200).alias("summary"), *[blank_to_null(F.col(c)).alias(c) for c in ("employment_type", "department", "team")],
        clean_array(F.col("skills")).alias("skills"), clean_array(F.col("languages")).alias("languages"), "salary_min", "salary_max", "published_at", "valid_through",
    )


# The columns of the detail view, in their order.
DETAILS = (
    "id", "source_id", "company", "title", "location", "arrangement", "summary", "official_url", "first_seen_at", "last_seen_at", "review_state", "employment_type", "description", "responsibilities", "qualifications", "skills",
    "department", "team", "business_unit", "job_family", "job_function", "industry", "office", "secondary_locations", "location_city", "location_state", "location_country", "location_postal_code", "latitude", "longitude",
    "location_region", "salary_min", "salary_max", "salary_currency", "salary_interval", "benefits", "education_requirements", "experience_requirements", "experience_level", "shift_schedule", "travel_requirements",
    "security_clearance", "languages", "requisition_id", "apply_url", "source_posted_text", "source_updated_at", "valid_through", "published_at",
)


def looked_up(rows: DataFrame, topics: DataFrame, matches: DataFrame) -> DataFrame:
    """rows(id, open_generation, ...) with area_keys in order (null if none), and score and evidence of the active match of that generation, of several the best.

    Each look-up is one row an id, so rows move once, by id. They need no other columns yet: where those can be made from
    few, look up first and make them after it.
    """
    one = F.struct("open_generation", "score", "evidence")
    active = matches.filter("is_active AND score IS NOT NULL").groupBy(F.col("job_id").alias("id")).agg(F.collect_list(one).alias("_ms"))  # the matches of one posting
    found = rows.join(area_keys(topics), "id", "left").join(active, "id", "left")
    own = F.filter("_ms", lambda m: m["open_generation"] == F.col("open_generation"))
    best = F.array_max(F.transform(own, lambda m: F.struct(m["score"], m["evidence"])))
    return found.select(*rows.columns, "area_keys", best["score"].alias("resume_match_score"), best["evidence"].alias("resume_match_evidence"))


def detailed(found: DataFrame) -> DataFrame:
    """All of DETAILS (null where rows of looked_up lack a column), area_keys, score and evidence."""
    own = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in DETAILS]
    return found.select(*own, F.coalesce("area_keys", F.array().cast("array<string>")).alias("area_keys"), "resume_match_score", "resume_match_evidence")


def detail_view(postings: DataFrame, topics: DataFrame, matches: DataFrame) -> DataFrame:
    """All of DETAILS (null where postings lack a column), area_keys in order, and score and evidence of the posting's match.

    matches(job_id, open_generation, is_active, score, evidence): only an active match of the posting's own generation counts, of several the best.
    """
    return detailed(looked_up(postings, topics, matches))


def title_key(c: Column) -> Column:
    """A title in one width and lower case, to tell whether it is known."""
    return F.lower(spaced(c))


def topic_audit(postings: DataFrame, topics: DataFrame, topic: str, known: DataFrame) -> DataFrame:
    """One row: open postings, how many have the topic, their share in percent to two places, and the titles of known(title) that none of these has, in order."""
    has = topics.filter(F.col("topic_key") == topic).select(F.col("job_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    rows = postings.join(has, "id", "left")
    present = rows.filter("_has").select(title_key(F.col("title")).alias("_key")).distinct()
    missed = known.select("title", title_key(F.col("title")).alias("_key")).join(present, "_key", "left_anti")
    named = missed.agg(F.array_sort(F.collect_list("title")))  # a list of titles that a person wrote
    counts = rows.agg(F.count(F.lit(1)).alias("jobs"), F.count("_has").alias("matched"))
    share = F.when(F.col("jobs") > 0, F.round(10_000 * F.col("matched") / F.col("jobs")) / 100).otherwise(0.0)
    return counts.withColumns({"coverage": share, "known_missed": named.scalar()})


def audit_sample(matched: DataFrame, most: int = 100) -> DataFrame:
    """The first postings by company, title, url and id, with place (how many are shown is the feature, 100 at most)."""
    order = ["company", "title", "official_url", "id"]
    top = matched.orderBy(*order).limit(max(0, min(100, most)))
    return top.select(*order, F.row_number().over(Window.orderBy(*order)).alias("place"))


def evidence_histogram(topics: DataFrame) -> DataFrame:
    """(evidence, jobs) of topics(job_id, evidence array): each posting counts once for an evidence."""
    return topics.select("job_id", F.explode(F.array_distinct("evidence")).alias("evidence")).groupBy("evidence").agg(F.countDistinct("job_id").alias("jobs"))


def activity(runs: DataFrame) -> DataFrame:
    """What a feed says of runs(id, company, status, jobs_seen, jobs_created, jobs_updated, jobs_closed, error, started_at, finished_at)."""
    failed = F.coalesce(F.col("status").isin("failed", "blocked"), F.lit(False))
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    said = lambda *p: F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit("")) if i % 2 == 0 else F.lit(x) for i, x in enumerate(p)])
    return runs.select(
        "id", F.when(failed, "source.failed").otherwise("source.changed").alias("kind"), F.when(failed, "error").otherwise("success").alias("severity"),
        F.when(failed, said("company", " crawl ", "status", ".")).otherwise(said("company", " refreshed ", "jobs_seen", " roles.")).alias("summary"),
        F.coalesce(known("finished_at"), known("started_at"), F.lit("1970-01-01T00:00:00.000Z")).alias("occurred_at"),
        F.coalesce(known("error"), said("jobs_created", " created, ", "jobs_updated", " updated, ", "jobs_closed", " closed.")).alias("details"),
    )


def source_list(sources: DataFrame) -> DataFrame:
    """Sources with the times that a list shows; an empty time counts as unknown."""
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return sources.select("source_id", "company", "health", first("last_crawled_at", "checked_at").alias("last_checked_at"), first("next_crawl_at", "checked_at").alias("next_run_at"))


# What gives way, step by step, when a record is too large for one payload.
LONG_TEXTS = ("description", "responsibilities", "qualifications", "benefits", "education_requirements", "experience_requirements", "summary", "source_posted_text")
LONG_ARRAYS = ("skills", "secondary_locations", "languages")
OPTIONAL = ("department", "team", "business_unit", "job_family", "job_function", "industry", "office")
TEXT_STEPS = (100_000, 20_000, 2_000)


def bounded_record(columns: list[str], most: int = 1_499_800) -> Column:
    """The columns as a JSON object without nulls, of at most so many bytes (in an array of one); null if what is required is larger.

    What is too large loses its raw payload, then the ends of long texts (counted in code points) and arrays in three steps, then optional
    fields.
    """
    lean = [c for c in columns if c != "raw_payload"]
    needed = [c for c in lean if c not in LONG_TEXTS + OPTIONAL]
    cut = lambda c, n: (F.substring(F.col(c), 1, n) if c in LONG_TEXTS else F.slice(F.col(c), 1, 100) if c in LONG_ARRAYS else F.col(c)).alias(c)
    steps = [columns, lean, *[[cut(c, n) for c in lean] for n in TEXT_STEPS], [cut(c, 0) for c in needed]]
    records = [F.to_json(F.struct(*s)) for s in steps]
    return F.coalesce(*[F.when(F.octet_length(r) + 2 <= most, r) for r in records])


def text_members(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value): the members of a JSON array that are texts; numbers, nulls, objects and malformed arrays give none."""
    each = df.select(key, F.explode(F.from_json(F.col(column), "array<variant>")).alias("_v"))
    return each.filter(F.schema_of_variant("_v") == "STRING").select(key, F.try_variant_get("_v", "$", "string").alias("value"))


# The fields that a listing's own facets count.
FACETS = ("department", "team", "business_unit", "job_family", "job_function", "industry", "employment_type", "arrangement", "city", "state", "country", "experience_level", "skills")


def derived_facets(listing: DataFrame) -> DataFrame:
    """(source_id, key, value, jobs, place) of the listing's columns among FACETS; place orders a key's values by count, then by name.

    All keys are counted in one pass; an unknown arrangement and blank values do not count, skills count once for each time stated.
    """

    def counted_as(key: str) -> Column:
        values = F.col(key) if key == "skills" else F.array(F.when(F.col(key) != "unknown", F.col(key)) if key == "arrangement" else F.col(key))
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))

    pairs = [counted_as(k) for k in FACETS if k in listing.columns]
    each = listing.select("source_id", F.explode(F.concat(*pairs)).alias("f")).select("source_id", "f.*").filter("value <> ''")
    counted = each.groupBy("source_id", "key", "value").agg(F.count(F.lit(1)).alias("jobs"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("source_id", "key").orderBy(F.desc("jobs"), "value")))
