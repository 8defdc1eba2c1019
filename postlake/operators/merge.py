"""Merge of a listing snapshot into the stored postings: a pure function of state, snapshot and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the columns of a snapshot do to those of a stored posting.
#: The snapshot always has its way.
OVERWRITTEN = ("title", "company", "resume_match_hash", "topic_classified_at", "area_classified_at")
#: The snapshot counts where it states something: not null; for arrays not empty; for words not unknown.
FILLED = (
    "external_id", "location", "employment_type", "summary", "description", "responsibilities", "qualifications", "department", "team", "business_unit", "job_family", "job_function", "industry", "office", "location_city", "location_state",
    "location_country", "location_postal_code", "latitude", "longitude", "salary_min", "salary_max", "salary_currency", "salary_interval", "benefits", "education_requirements", "experience_requirements", "experience_level", "shift_schedule",
    "travel_requirements", "security_clearance", "requisition_id", "apply_url", "source_posted_text", "source_updated_at", "valid_through", "raw_payload", "description_hash", "published_at",
)
ARRAYS = ("skills", "secondary_locations", "languages")
WORDS = ("arrangement", "location_region")
#: What was stored first stays.
KEPT = ("requisition_identity_key", "external_identity_key", "url_identity_key")
#: Set when a posting is created, and never by a later snapshot.
INSERTED = ("review_state", "alert_discovered_after_baseline")


def _stated(name: str, value: Column) -> Column:
    """The value if it states something, else null."""
    return F.when(F.size(value) > 0, value) if name in ARRAYS else F.nullif(value, F.lit("unknown")) if name in WORDS else value


def reduced(incoming: DataFrame) -> DataFrame:
    """One row per (source, url), as if its rows were merged one after the other by ordinal."""
    nth = F.col("ordinal")

    def one(c: str) -> Column:
        value = F.col(c)
        if c in OVERWRITTEN:
            return F.max_by(value, nth)
        if c in KEPT:
            return F.min_by(value, F.when(value.isNotNull(), nth))
        if c in INSERTED:
            return F.min_by(value, nth)
        said = F.max_by(value, F.when(_stated(c, value).isNotNull(), nth))
        return F.coalesce(said, F.max_by(value, F.when(value.isNotNull(), nth))) if c in ARRAYS + WORDS else said

    ruled = [c for c in (*OVERWRITTEN, *FILLED, *ARRAYS, *WORDS, *KEPT, *INSERTED) if c in incoming.columns]
    return incoming.groupBy("source_id", "official_url").agg(*[one(c).alias(c) for c in ruled])


def merge(state: DataFrame, incoming: DataFrame, now: str, complete: bool | str = True) -> DataFrame:
    """The next state and what happened to each row: created, updated, reopened, closed or unchanged.

    A posting not seen is closed only if the listing is complete and its source is part of the snapshot; complete may name a boolean
    column of incoming, by which a source's listing is complete if all its rows say so. A closed posting that is seen again
    starts a new generation. Columns of the state that have no rule, or that the snapshot lacks, stay; a created posting has nulls there.
    Of the snapshot only columns that the state has count. A null among arrays and words of the snapshot states nothing.
    """
    ruled = [c for c in reduced(incoming).columns if c in state.columns and c not in ("source_id", "official_url")]
    new = reduced(incoming).select("source_id", "official_url", *[F.col(c).alias(f"_new_{c}") for c in ruled], F.lit(True).alias("_seen"))
    says = F.coalesce(F.bool_and(complete), F.lit(False)) if isinstance(complete, str) else F.lit(complete)
    listed = incoming.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"), says.alias("_listed")).drop("_n")
    both = state.withColumn("_stored", F.lit(True)).join(new, ["source_id", "official_url"], "full").join(listed, "source_id", "left")
    seen, stored, was_open = F.coalesce("_seen", F.lit(False)), F.coalesce("_stored", F.lit(False)), F.col("status") == "open"
    gone = ~seen & was_open & F.coalesce("_listed", F.lit(False))
    reopened = seen & stored & ~was_open
    event = F.when(~stored, "created").when(reopened, "reopened").when(seen, "updated").when(gone, "closed").otherwise("unchanged")

    def next_value(c: str) -> Column:
        old, fresh = F.col(c), F.col(f"_new_{c}")
        if c in OVERWRITTEN:
            return F.when(seen, fresh).otherwise(old)
        if c in INSERTED:
            return F.when(stored, old).otherwise(fresh)
        return F.coalesce(old, fresh) if c in KEPT else F.coalesce(_stated(c, fresh), old, fresh)

    made = {c: next_value(c) for c in ruled} | {
        "status": F.when(seen, "open").when(gone, "closed").otherwise(F.col("status")), "first_seen_at": F.coalesce("first_seen_at", F.lit(now)), "last_seen_at": F.when(seen, F.lit(now)).otherwise(F.col("last_seen_at")),
        "generation": (F.coalesce("generation", F.lit(1)) + F.when(reopened, 1).otherwise(0)).cast("long"),
    }
    if "reopened_at" in state.columns:
        made["reopened_at"] = F.when(reopened, F.lit(now)).otherwise(F.col("reopened_at"))
    if "closed_at" in state.columns:
        made["closed_at"] = F.when(gone, F.lit(now)).when(~seen, F.col("closed_at"))
    return both.select(*[made.get(c, F.col(c)).alias(c) for c in state.columns], event.alias("event"))
