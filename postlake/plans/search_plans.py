"""Queries over postings with titles, arrays and topics: filters, facets and projections, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.operators import facets, projections, search
from postlake.plans.catalog import query
from postlake.sources.proxy import table
from postlake.sources.rich import RICH_SQL, _sql, generation, matches, rich_postings, topics

WITH = f"WITH {RICH_SQL}"
#: A title in lower case between spaces, its separators as spaces.
PAD = "(' ' || lower(trim(translate(title, '-_/\\,.:;()[]{}–—|+&', '                   '))) || ' ')"
PAD_POLICY = "(' ' || lower(translate(title, '-‐‑–—/(),', '         ')) || ' ')"
COOP = """(contains(lower(translate(coalesce(employment_type, ''), '_- /', '')), 'coop') OR id IN (SELECT job_id FROM topics WHERE topic_key = 'program:coop'))"""
CLINICAL = f"""(regexp_matches({PAD_POLICY}, ' (extern|externs|externship|externships) ') AND regexp_matches({PAD_POLICY},
  ' (nurse|nursing|radiology|radiologic|pharmacy|pharmacist|respiratory care|respiratory therapy|surgical tech|surgical technologist|patient care|medical assistant|sonography|sonographer|imaging technologist|clinical laboratory|laboratory technologist) '))"""


def found(spark, sf_dir, **wanted):
    return search.search(rich_postings(spark, sf_dir), search.Filters(**wanted), topics(spark, sf_dir))


@query(WITH + "SELECT id, company, department FROM best WHERE lower(department) IN ('building', 'machinery') AND lower(region) IN ('asia', 'europe', 'america') AND lower(city) IN ('city 1', 'city 7', 'city 12', 'city 30')")
def search_equal_fields(spark, sf_dir):
    out = found(spark, sf_dir, departments=("BUILDING", "machinery "), regions=("asia", "Europe", "AMERICA"), cities=("city 1", "City 7", "CITY 12", "city 30"))
    return out.select("id", "company", "department")


@query(WITH + "SELECT id, valid_through, arrangement FROM best WHERE (valid_through IS NULL OR valid_through >= '1998-06-01') AND arrangement = 'remote' AND review_state = 'new'")
def search_unexpired(spark, sf_dir):
    return found(spark, sf_dir, as_of="1998-06-01", arrangement="remote", review_state="new").select("id", "valid_through", "arrangement")


@query(WITH + "SELECT id FROM best WHERE len(list_filter(skills, lambda s: lower(s) IN ('sql', 'r'))) > 0 AND list_contains(languages, 'Français')")
def search_arrays(spark, sf_dir):
    return found(spark, sf_dir, skills=("SQL", "r"), languages=("FRANÇAIS",)).select("id")


@query(WITH + """SELECT id FROM best WHERE id IN (SELECT job_id FROM topics WHERE topic_key = 'ai-data') AND id IN (SELECT job_id FROM topics WHERE topic_key IN ('area:ai-ml', 'area:data-analytics'))""")
def search_topic_and_areas(spark, sf_dir):
    return found(spark, sf_dir, topic="ai-data", areas=("ai-ml", "data-analytics", "unknown")).select("id")


@query(WITH + f"""SELECT id, title FROM best WHERE contains({PAD}, ' 2026 ') OR contains({PAD}, ' 2027 ')
  OR (NOT regexp_matches({PAD}, ' 20[0-9][0-9] ') AND id IN (SELECT job_id FROM topics WHERE topic_key IN ('year:2026', 'year:2027')))""")
def search_recruiting_years(spark, sf_dir):
    return found(spark, sf_dir, years=(2027, 2026, 1999)).select("id", "title")


@query(WITH + f"SELECT id FROM best WHERE (id IN (SELECT job_id FROM topics WHERE topic_key = 'program:internship') OR contains({PAD}, ' regular ')) AND NOT {COOP}")
def search_internships_or_regular(spark, sf_dir):
    return found(spark, sf_dir, programs=("Internship", "regular")).select("id")


@query(WITH + "SELECT id FROM best WHERE id IN (SELECT job_id FROM topics WHERE topic_key IN ('program:internship', 'program:coop'))")
def search_internships_and_coops(spark, sf_dir):
    return found(spark, sf_dir, programs=("internship", "coop")).select("id")


@query(WITH + f"SELECT id, title FROM best WHERE id IN (SELECT job_id FROM topics WHERE topic_key = 'program:internship') AND NOT {COOP} AND NOT {CLINICAL}")
def internships_only(spark, sf_dir):
    return search.student_programs(search.canonical(rich_postings(spark, sf_dir)), topics(spark, sf_dir), internships_only=True).select("id", "title")


@query(WITH + f"SELECT id, title FROM best WHERE id IN (SELECT job_id FROM topics WHERE topic_key IN ('program:internship', 'program:coop')) AND NOT {CLINICAL}")
def internships_or_coops(spark, sf_dir):
    return search.student_programs(search.canonical(rich_postings(spark, sf_dir)), topics(spark, sf_dir)).select("id", "title")


@query(WITH + f"SELECT id, title FROM best WHERE contains({PAD}, ' summer ') OR contains({PAD}, ' fall ')")
def search_seasons(spark, sf_dir):
    return found(spark, sf_dir, seasons=("Summer", "fall")).select("id", "title")


@query(WITH + "SELECT id, location FROM best WHERE contains(lower(location), 'nation_1')")
def search_place(spark, sf_dir):
    return found(spark, sf_dir, location="Nation_1").select("id", "location")


@query(WITH + """, words AS (SELECT id, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, company, location, summary, description))), '[\\p{L}\\p{N}]+') AS w FROM best)
  SELECT id FROM words WHERE len(list_filter(w, lambda t: starts_with(t, 'eleve'))) > 0 AND len(list_filter(w, lambda t: starts_with(t, 'resume'))) > 0 AND len(list_filter(w, lambda t: starts_with(t, 'custom'))) > 0""")
def search_words_without_marks(spark, sf_dir):
    return found(spark, sf_dir, query="Élève résumé custom").select("id")


@query(WITH + """SELECT b.id, score, published_at FROM best b JOIN matches m ON m.job_id = b.id AND m.open_generation = b.open_generation AND is_active
  ORDER BY published_at DESC NULLS LAST, score DESC, first_seen_at DESC, company, b.id LIMIT 60""")
def search_resume_matches(spark, sf_dir):
    f = search.Filters(limit=60)
    return search.page(search.search(rich_postings(spark, sf_dir), f, matches=matches(spark, sf_dir)), f).select("id", "score", "published_at")


@query(WITH + "SELECT id, (SELECT count(*) FROM best WHERE id > 2000) > 40 AS has_more FROM best WHERE id > 2000 ORDER BY id LIMIT 40")
def keyset_page_with_more(spark, sf_dir):
    return search.page_with_more(search.canonical(rich_postings(spark, sf_dir)), 2000, 40).select("id", "has_more")


SCALARS = ("company", "city", "country", "region", "department", "team", "arrangement", "employment_type")


@query(WITH + ", each AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, trim({k}) AS label, official_url FROM best" for k in SCALARS[:-1]) + f"""
  UNION ALL SELECT 'employment_type', trim(employment_type), official_url FROM best WHERE lower(translate(trim(employment_type), '_- /', '')) IN ('fulltime', 'fulltimeemployee', 'modifiedfulltime', 'parttime', 'temporary', 'contractor', 'contract',
    'intern', 'internship', 'regular', 'permanent', 'seasonal', 'casual', 'freelance', 'apprentice', 'apprenticeship', 'fixedterm', 'fixedtermcontract', 'employeeregularpermanent')
  UNION ALL SELECT 'skills', trim(unnest(skills)), official_url FROM best UNION ALL SELECT 'languages', trim(unnest(languages)), official_url FROM best
  UNION ALL SELECT 'programs', 'regular', official_url FROM best WHERE contains({PAD}, ' regular ')
  UNION ALL SELECT 'programs', substr(topic_key, 9), official_url FROM best JOIN topics ON job_id = id WHERE topic_key LIKE 'program:%'
  UNION ALL SELECT 'seasons', s, official_url FROM best, (VALUES ('spring'), ('summer'), ('fall'), ('winter')) v(s) WHERE contains({PAD}, ' ' || s || ' ')
  UNION ALL SELECT 'years', y, official_url FROM (SELECT official_url, unnest(string_split({PAD}, ' ')) AS y FROM best) WHERE regexp_full_match(y, '[0-9]{{4}}') AND y BETWEEN '2000' AND '2100'
  UNION ALL SELECT 'years', substr(topic_key, 6), official_url FROM best JOIN topics ON job_id = id WHERE regexp_full_match(topic_key, 'year:[0-9]{{4}}')),
  counted AS (SELECT key, min(label) AS value, count(DISTINCT official_url) AS jobs FROM each WHERE label <> '' GROUP BY key, lower(label))
  SELECT key, value, jobs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY jobs DESC, lower(value), value) AS n FROM counted) WHERE n <= 100""")
def facets_of_all_keys(spark, sf_dir):
    return facets.all_facets(search.canonical(rich_postings(spark, sf_dir)), topics(spark, sf_dir), SCALARS)


@query(WITH + """, a AS (SELECT job_id, string_agg(substr(topic_key, 6), ',' ORDER BY topic_key) AS areas FROM topics WHERE topic_key LIKE 'area:%' GROUP BY 1)
  SELECT id, coalesce(areas, '') AS area_keys, substr(coalesce(summary, description), 1, 1200) AS summary, coalesce(nullif(trim(employment_type), ''), '') AS employment_type, c_name AS source_name,
    array_to_string(list_distinct(list_filter(list_transform(coalesce(skills, []), lambda s: trim(s)), lambda s: s <> '')), ',') = '' AS no_skills
  FROM rich LEFT JOIN a ON job_id = id JOIN customer ON c_custkey = source_id""")
def posting_details(spark, sf_dir):
    from postlake.sources.proxy import table

    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"))
    out = projections.details(rich_postings(spark, sf_dir), topics(spark, sf_dir), sources)
    return out.select("id", F.array_join("area_keys", ",").alias("area_keys"), "summary", F.coalesce("employment_type", F.lit("")).alias("employment_type"), "source_name", (F.size("skills") == 0).alias("no_skills"))


TITLES_KNOWN = ("Machine Learning Intern - 2026", "  DATA   engineer/Fall", "Nobody's Title", "Software Intern, 1999")


@query(WITH + f""", has AS (SELECT best.* FROM best WHERE id IN (SELECT job_id FROM topics WHERE topic_key = 'ai-data')), known AS (SELECT unnest({_sql(tuple(t.replace("'", "''") for t in TITLES_KNOWN))}) AS title)
  SELECT (SELECT count(*) FROM best) AS jobs, (SELECT count(*) FROM has) AS matched, round(10000.0 * (SELECT count(*) FROM has) / (SELECT count(*) FROM best)) / 100 AS coverage,
  (SELECT string_agg(title, '|' ORDER BY title) FROM known WHERE trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) NOT IN (SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) FROM has)) AS known_missed""".replace("WITH WITH", "WITH"))
def topic_audit(spark, sf_dir):
    known = spark.createDataFrame([(t,) for t in TITLES_KNOWN], "title string")
    found = projections.topic_audit(search.canonical(rich_postings(spark, sf_dir)), topics(spark, sf_dir), "ai-data", known)
    return found.withColumn("known_missed", F.array_join("known_missed", "|"))


@query(WITH + """ SELECT company, title, official_url, id, (row_number() OVER (ORDER BY company, title, official_url, id))::INT AS place FROM best WHERE id IN (SELECT job_id FROM topics WHERE topic_key = 'ai-data') QUALIFY place <= 100""")
def topic_sample(spark, sf_dir):
    has = topics(spark, sf_dir).filter("topic_key = 'ai-data'").select(F.col("job_id").alias("id")).distinct()
    return projections.audit_sample(search.canonical(rich_postings(spark, sf_dir)).join(has, "id", "left_semi"))


#: Detail columns under another name in the postings at hand, and those put together from the id.
RENAMED = {"location_city": "city", "location_country": "country", "location_region": "region", "last_seen_at": "first_seen_at"}
PUT_TOGETHER = tuple(c for c in projections.DETAILS if c not in RENAMED and c not in (
    "id", "source_id", "company", "title", "location", "arrangement", "summary", "official_url", "first_seen_at", "review_state", "employment_type", "description", "skills", "department", "team", "salary_min", "salary_max", "languages", "valid_through", "published_at",
    "secondary_locations", "latitude", "longitude"))


def _put_together(rows):
    n = F.col("id")
    made = {c: F.col(o) for c, o in RENAMED.items()} | {c: F.when(n % (i + 2) > 0, F.concat(F.lit(f"{c} "), n % (i + 5))) for i, c in enumerate(PUT_TOGETHER)}
    return rows.withColumns(made | {"latitude": (n % 180 - 90).cast("double"), "longitude": F.when(n % 2 == 0, (n % 360 - 180).cast("double")), "secondary_locations": F.when(n % 3 == 0, F.array(F.lit("Elsewhere")))})


DETAIL_SQL = ", ".join(
    f"{RENAMED[c]} AS {c}" if c in RENAMED else f"CASE WHEN id % {PUT_TOGETHER.index(c) + 2} > 0 THEN '{c} ' || id % {PUT_TOGETHER.index(c) + 5} END AS {c}" if c in PUT_TOGETHER
    else {"latitude": "(id % 180 - 90)::DOUBLE AS latitude", "longitude": "CASE WHEN id % 2 = 0 THEN (id % 360 - 180)::DOUBLE END AS longitude", "secondary_locations": "CASE WHEN id % 3 = 0 THEN 'Elsewhere' END AS secondary_locations",
          "skills": "array_to_string(skills, ',') AS skills", "languages": "array_to_string(languages, ',') AS languages"}.get(c, c) for c in projections.DETAILS)


@query(WITH + f""", a AS (SELECT job_id, string_agg(substr(topic_key, 6), ',' ORDER BY topic_key) AS area_keys FROM topics WHERE starts_with(topic_key, 'area:') GROUP BY 1)
  SELECT {DETAIL_SQL}, coalesce(area_keys, '') AS area_keys, m.score AS resume_match_score, CASE WHEN m.score IS NOT NULL THEN 'role:x|Role|' || m.score END AS resume_match_evidence
  FROM rich LEFT JOIN a ON a.job_id = id LEFT JOIN matches m ON m.job_id = id AND m.is_active AND m.open_generation = rich.open_generation""")
def posting_detail_view(spark, sf_dir):
    """All 49 columns of the detail view, with areas, score and evidence."""
    evidence = F.concat(F.lit("role:x|Role|"), "score")
    n = F.col("o_orderkey")
    found = projections.looked_up(table(spark, sf_dir, "orders").withColumns({"id": n, "open_generation": generation(n)}), topics(spark, sf_dir), matches(spark, sf_dir).withColumn("evidence", evidence))
    out = projections.detailed(_put_together(rich_postings(spark, sf_dir, found, ("area_keys", "resume_match_score", "resume_match_evidence"))))
    return out.withColumns({c: F.array_join(c, ",") for c in ("skills", "languages", "area_keys", "secondary_locations")})


@query(WITH + """, w AS (SELECT official_url, ' ' || regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS t FROM best) SELECT value, count(DISTINCT official_url) AS jobs FROM w JOIN (VALUES ('spring'), ('summer'), ('fall'), ('winter')) s(value) ON contains(t, ' ' || value || ' ') GROUP BY 1""")
def season_facet(spark, sf_dir):
    return facets.season_facet(search.canonical(rich_postings(spark, sf_dir)), facets.season_values(spark))
