"""Search over postings: the canonical posting of each url first, then filters, then a page."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import MARKED, PLAIN, tokens
from postlake.functions.titles import clinical_extern, coop_by_posting, has_any, padded


def canonical(postings: DataFrame) -> DataFrame:
    """The open posting of each url seen last; ties go to the first company, then the first id."""
    newest = Window.partitionBy("official_url").orderBy(F.desc("first_seen_at"), "company", "id")
    return postings.filter("status = 'open'").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


TEXT_FIELDS = ("title", "company", "location", "summary", "description")
#: Filter field and column of the equality filters; values of one field join by OR, without regard to case.
EQUAL = {
    "companies": "company", "cities": "city", "states": "state", "countries": "country", "regions": "region", "employment_types": "employment_type", "departments": "department", "teams": "team",
    "business_units": "business_unit", "job_families": "job_family", "job_functions": "job_function", "industries": "industry", "offices": "office", "experience_levels": "experience_level",
    "salary_currencies": "salary_currency", "salary_intervals": "salary_interval", "educations": "education", "shifts": "shift", "travel": "travel", "clearances": "clearance",
}
ARRAYS = {"skills": "skills", "languages": "languages"}
AREAS = ("ai-ml", "data-analytics", "software-engineering")
# Names of one brand, each of which stands for all.
ALIASES = (("Barclays", "Barclays US"),)


def has_prefix(word: str, fields=TEXT_FIELDS) -> Column:
    return F.exists(tokens(F.concat_ws(" ", *fields)), lambda t: F.startswith(t, F.lit(word)))


@dataclass(frozen=True)
class Filters:
    """Fields join by AND, the values of one field by OR; an empty field filters nothing."""

    companies: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    teams: tuple[str, ...] = ()
    business_units: tuple[str, ...] = ()
    job_families: tuple[str, ...] = ()
    job_functions: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    offices: tuple[str, ...] = ()
    experience_levels: tuple[str, ...] = ()
    salary_currencies: tuple[str, ...] = ()
    salary_intervals: tuple[str, ...] = ()
    educations: tuple[str, ...] = ()
    shifts: tuple[str, ...] = ()
    travel: tuple[str, ...] = ()
    clearances: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    query: str = ""
    location: str = ""
    arrangement: str = ""
    review_state: str = ""
    topic: str = ""
    areas: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    programs: tuple[str, ...] = ()
    seasons: tuple[str, ...] = ()
    salary_from: float | None = None
    salary_to: float | None = None
    published_from: str | None = None
    published_to: str | None = None
    as_of: str | None = None
    limit: int = 50
    offset: int = 0

    def condition(self, text_fields=TEXT_FIELDS) -> Column:
        """What a posting's own columns decide; topics are joined by :func:`search`."""
        c = F.lit(True)
        for field, column in EQUAL.items():
            if values := getattr(self, field):
                wanted = {v.strip().lower() for v in values}
                if field == "companies":
                    wanted |= {n.lower() for names in ALIASES for n in names if wanted & {x.lower() for x in names}}
                c &= F.lower(column).isin(sorted(wanted))
        for field, column in ARRAYS.items():
            if values := getattr(self, field):
                c &= F.arrays_overlap(F.transform(column, F.lower), F.array(*[F.lit(v.lower()) for v in values]))
        for word in tokens_of(self.query):
            c &= has_prefix(word, text_fields)
        for value, column in ((self.arrangement, "arrangement"), (self.review_state, "review_state")):
            if value and value != "all":
                c &= F.col(column) == value
        if self.location:
            c &= F.lower(F.coalesce("location", F.lit(""))).contains(self.location.lower())
        if self.seasons:
            c &= has_any(padded(F.col("title")), [x.lower() for x in self.seasons])
        if self.as_of:  # an expiry that is unknown is in the future
            c &= F.col("valid_through").isNull() | (F.col("valid_through") >= self.as_of)
        if self.salary_from is not None:
            c &= F.col("salary_max") >= self.salary_from
        if self.salary_to is not None:
            c &= F.col("salary_min") <= self.salary_to
        if self.published_from:
            c &= F.col("published_at") >= self.published_from
        if self.published_to:  # the day itself counts
            c &= F.col("published_at") < F.date_format(F.date_add(F.lit(self.published_to).cast("date"), 1), "yyyy-MM-dd")
        return c


def tokens_of(query: str) -> list[str]:
    plain = query.lower().translate(str.maketrans(MARKED, PLAIN))
    return list(dict.fromkeys(re.findall(r"[^\W_]+", plain)))


def _with_topics(found: DataFrame, topics: DataFrame, wanted: list[str], flag: str) -> DataFrame:
    """found with flag: whether the posting has one of the wanted topics. Only these topics are joined, one row a posting."""
    has = topics.filter(F.col("topic_key").isin(wanted)).select(F.col("job_id").alias("id")).distinct().withColumn(flag, F.lit(True))
    return found.join(has, "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def by_topics(found: DataFrame, topics: DataFrame, filters: Filters) -> DataFrame:
    """The topic filters: topic, areas, recruiting years and programs, each by semi join or by a flag beside the title's own words."""
    keys, title = found.columns, padded(F.col("title"))
    for wanted in ([filters.topic] if filters.topic else [], [f"area:{a}" for a in filters.areas if a in AREAS]):
        if wanted:
            found = found.join(topics.filter(F.col("topic_key").isin(wanted)).select(F.col("job_id").alias("id")), "id", "left_semi")
    if years := sorted({y for y in filters.years if 2000 <= y <= 2100}):
        # a topic's year counts only for a title that states none
        found = _with_topics(found, topics, [f"year:{y}" for y in years], "_year")
        found = found.filter(has_any(title, years) | ~title.rlike(" 20[0-9][0-9] ") & F.col("_year"))
    programs = [p.lower() for p in filters.programs]
    if programs:
        by_topic = [p for p in programs if p in ("internship", "coop")]
        found = _with_topics(found, topics, [f"program:{p}" for p in by_topic], "_program")
        found = found.filter(F.col("_program") | (has_any(title, ["regular"]) if "regular" in programs else F.lit(False)))
        if "internship" in by_topic and "coop" not in by_topic:
            found = without_coops(found, topics)
    return found.select(*keys)


def without_coops(found: DataFrame, topics: DataFrame) -> DataFrame:
    coops = topics.filter("topic_key = 'program:coop'").select(F.col("job_id").alias("id"))
    return found.filter(~coop_by_posting(F.col("employment_type"), F.col("official_url"))).join(coops, "id", "left_anti")


def student_programs(found: DataFrame, topics: DataFrame, internships_only: bool = False) -> DataFrame:
    """Internships and co-ops, or internships that are no co-ops; clinical externships are neither."""
    wanted = ["program:internship"] if internships_only else ["program:internship", "program:coop"]
    found = found.filter(~clinical_extern(F.col("title"))).join(topics.filter(F.col("topic_key").isin(wanted)).select(F.col("job_id").alias("id")), "id", "left_semi")
    return without_coops(found, topics) if internships_only else found


def search(postings: DataFrame, filters: Filters, topics: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """The matching canonical postings, unordered; filters never reach below the choice of the canonical one.

    topics(job_id, topic_key) are needed by the topic filters. matches(job_id, score, is_active, open_generation) keep the
    postings with an active match of their generation and add its score.
    """
    found = canonical(postings).filter(filters.condition([f for f in TEXT_FIELDS if f in postings.columns]))
    if topics is not None:
        found = by_topics(found, topics, filters)
    if matches is not None:
        active = matches.filter("is_active").select(F.col("job_id").alias("id"), "open_generation", "score")
        found = found.join(active, ["id", "open_generation"])
    return found


def page(found: DataFrame, filters: Filters) -> DataFrame:
    """Known publication dates first, newest first, then the best score where there is one, newest seen, company and id."""
    size = filters.limit if 1 <= filters.limit <= 100 else 50
    score = [F.desc("score")] if "score" in found.columns else []
    return found.orderBy(F.desc_nulls_last("published_at"), *score, F.desc("first_seen_at"), "company", "id").offset(max(0, filters.offset)).limit(size)


def after(found: DataFrame, last_id: int | None, size: int) -> DataFrame:
    """Keyset page: the next size rows by id."""
    return (found if last_id is None else found.filter(F.col("id") > last_id)).orderBy("id").limit(size)


def page_with_more(found: DataFrame, last_id: int | None, size: int) -> DataFrame:
    """:func:`after` with has_more on every row: whether a next page has rows. One row more than the page is looked at."""
    rows = after(found, last_id, size + 1)
    w = Window.orderBy("id")  # at most size + 1 rows
    return rows.withColumns({"_n": F.row_number().over(w), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > size}).filter(F.col("_n") <= size).drop("_n")
