"""Queries over links read as postings, JSON parameters, guarded facets, backfills and mapped rows, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.operators import anchors, backfills, classify, merge, projections
from postlake.plans.catalog import query
from postlake.sources.parameters import json_rows
from postlake.sources.proxy import table
from postlake.sources.rich import RICH_SQL, ROLES, _dealt, _sql, rich_postings, topics

PAGE = "https://acme.example/careers/open"
HOST = "https://acme.example"
ORACLE = "https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX"
#: Links of a page: href, text, then what they are as postings (url, title, id, arrangement) or why they are none.
LINKS = (
    ("/jobs/12345-data-engineer", "Data Engineer", f"{HOST}/jobs/12345-data-engineer", "Data Engineer", None, "unknown", None),
    ("https://boards.greenhouse.io/acme/jobs/778", " Remote&nbsp;  Nurse ", "https://boards.greenhouse.io/acme/jobs/778", "Remote Nurse", "778", "remote", None),
    ("../jobs/99?x=1#top", "Field Technician", f"{HOST}/jobs/99?x=1", "Field Technician", None, "unknown", "no-detail"),
    ("../jobs/999?x=1#top", "Field Technician", f"{HOST}/jobs/999?x=1", "Field Technician", "999", "unknown", None),
    ("/careers/data-analyst", "Apply now", f"{HOST}/careers/data-analyst", "Data Analyst", None, "unknown", None),
    ("/careers/benefits", "Benefits Analyst", f"{HOST}/careers/benefits", "Benefits Analyst", None, "unknown", "list"),
    ("/search-jobs?q=1", "All our roles", f"{HOST}/search-jobs?q=1", "All our roles", None, "unknown", "list"),
    ("#senior-engineer", "Senior Engineer", f"{PAGE}#senior-engineer", "Senior Engineer", "senior-engineer", "unknown", None),
    ("#top", "Back to top", PAGE, "Back to top", None, "unknown", "same-page"),
    ("/files/role.pdf", "Engineer role", f"{HOST}/files/role.pdf", "Engineer role", None, "unknown", "document"),
    ("https://other.example/jobs/12345", "Engineer", "https://other.example/jobs/12345", "Engineer", "12345", "unknown", "foreign-host"),
    ("/about", "About the company", f"{HOST}/about", "About the company", None, "unknown", "no-detail"),
    ("/jobs/4567", "Job", f"{HOST}/jobs/4567", "Job", "4567", "unknown", "text-length"),
    ("/careers/open/software-developer", "Software Developer", f"{PAGE}/software-developer", "Software Developer", None, "unknown", None),
    ("https://jobs.lever.co/acme/abc-1", "Designer", "https://jobs.lever.co/acme/abc-1", "Designer", None, "unknown", None),
    ("https://jobs.lever.co/acme", "Our culture", "https://jobs.lever.co/acme", "Our culture", None, "unknown", "no-detail"),
    (f"{ORACLE}/job/300/?keyword=a", "Plant Manager", f"{ORACLE}/job/300/?keyword=a", "Plant Manager", "300", "unknown", None),
    (f"{ORACLE}/events", "Events for engineers", f"{ORACLE}/events", "Events for engineers", None, "unknown", "navigation"),
    ("//acme.example/jobs/44444/", "12 Clerk of works", f"{HOST}/jobs/44444/", "12 Clerk of works", "44444", "unknown", None),
    ("/jobs/night-shift_nurse", "3 cards Night", f"{HOST}/jobs/night-shift_nurse", "Night Shift Nurse", None, "unknown", None),
    ("?jobid=77", "Warehouse associate", f"{PAGE}?jobid=77", "Warehouse associate", "77", "unknown", None),
    ("?page=2", "Warehouse associate", f"{PAGE}?page=2", "Warehouse associate", None, "unknown", "same-page"),
    ("/job-detail?job=A1", "Cook and baker", f"{HOST}/job-detail?job=A1", "Cook and baker", "A1", "unknown", None),
    ("/careers/apply?jobtitle=Lead+Engineer", "Click here", f"{HOST}/careers/apply?jobtitle=Lead+Engineer", "Lead Engineer", None, "unknown", None),
    ("/careers/life-here", "Read more", f"{HOST}/careers/life-here", "Life Here", None, "unknown", "generic-text"),
    ("https://boards.greenhouse.io/acme/jobs/778", "Nurse (night)", "https://boards.greenhouse.io/acme/jobs/778", "Nurse (night)", "778", "unknown", None),
)
LINKS_SQL = "links AS (SELECT o_custkey AS source_id, o_orderkey AS ordinal, " + ", ".join(f"{_sql(tuple(x[i] for x in LINKS))}[o_orderkey % {len(LINKS)} + 1] AS {c}" for i, c in ((2, "official_url"), (3, "title"), (4, "external_id"), (5, "arrangement"), (6, "refused"))) + " FROM orders)"


def _links(spark, sf_dir):
    n = F.col("o_orderkey")
    at = lambda i: _dealt(tuple(x[i] for x in LINKS), n)
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_custkey").alias("source_id"), F.col("c_name").alias("company"), F.lit(PAGE).alias("source_url"), n.alias("ordinal"), at(0).alias("href"), at(1).alias("text"))


@query(f"WITH {LINKS_SQL} SELECT source_id, ordinal, official_url, title, external_id, arrangement, refused FROM links")
def judged_anchors(spark, sf_dir):
    return anchors.judged(_links(spark, sf_dir)).drop("company")


@query(f"""WITH {LINKS_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY source_id, official_url ORDER BY ordinal DESC) AS nth FROM links WHERE refused IS NULL)
  SELECT source_id, official_url, title, external_id, arrangement, c_name AS company FROM last JOIN customer ON source_id = c_custkey WHERE nth = 1""")
def anchor_postings(spark, sf_dir):
    return anchors.postings(_links(spark, sf_dir))


PAGE_LINKS_SQL = """found AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>'), 1)::BIGINT - 1 AS ordinal FROM pages),
  links AS (SELECT page_id, url, ordinal, coalesce(nullif(regexp_extract(a, '(?is)^<a\\s[^>]*?\\shref\\s*=\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(a, '(?is)^<a\\s+href\\s*=\\s*"([^"]*)"', 1), '')) AS href,
    trim(regexp_replace(replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM found)"""


@query(f"""WITH {PAGE_LINKS_SQL} SELECT page_id, ordinal, href, text, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href WHEN href LIKE '#%' THEN regexp_extract(url, '^[^#]*') || href
    ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) || href END AS target FROM links""")
def page_links(spark, sf_dir):
    found = anchors.page_links(table(spark, sf_dir, "pages"))
    return found.select("page_id", "ordinal", "href", "text", anchors.resolved(F.col("href"), F.col("url")).alias("target"))


@query("""WITH p AS (SELECT o_orderkey AS message, '[{"id":' || o_orderkey || ',"kind":"' || o_orderpriority || '","score":' || (o_orderkey % 7) || '.5},{"id":null,"kind":3},{"id":' || o_custkey || '}]' AS payload FROM orders),
  e AS (SELECT message, unnest(CAST(payload AS JSON[])) AS v FROM p)
  SELECT message, (v->>'$.id')::BIGINT AS id, v->>'$.kind' AS kind, (v->>'$.score')::DOUBLE AS score FROM e""")
def json_parameter_rows(spark, sf_dir):
    n = F.col("o_orderkey").cast("string")
    payload = F.concat(F.lit('[{"id":'), n, F.lit(',"kind":"'), "o_orderpriority", F.lit('","score":'), (F.col("o_orderkey") % 7).cast("string"), F.lit('.5},{"id":null,"kind":3},{"id":'), F.col("o_custkey").cast("string"), F.lit("}]"))
    return json_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message"), payload.alias("payload")), "payload", "id bigint, kind string, score double")


@query("""WITH old AS (SELECT c_custkey AS source_id, 'department' AS facet_key, unnest(['a', 'b']) AS value_key, 1::BIGINT AS jobs, 0::BIGINT AS observed_at FROM customer),
  heads AS (SELECT c_custkey AS source_id, c_custkey % 3 AS generation, c_custkey % 3 = 1 AS is_current FROM customer WHERE c_custkey % 3 > 0),
  fresh AS (SELECT o_custkey AS source_id, o_orderpriority AS value_key, arg_max(o_orderkey % 9, o_orderkey) AS jobs FROM orders WHERE o_custkey IN (SELECT source_id FROM heads WHERE is_current) GROUP BY 1, 2)
  SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM heads WHERE is_current) UNION ALL SELECT source_id, 'team', value_key, jobs, 7::BIGINT FROM fresh""")
def guarded_facets(spark, sf_dir):
    n = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    old = c.select(n.alias("source_id"), F.lit("department").alias("facet_key"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("value_key"), F.lit(1).cast("long").alias("jobs"), F.lit(0).cast("long").alias("observed_at"))
    heads = c.filter(n % 3 > 0).select(n.alias("source_id"), (n % 3).alias("generation"), F.lit(7).cast("long").alias("observed_at"))
    current = c.select(n.alias("source_id"), F.lit(1).cast("long").alias("generation"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.lit("team").alias("facet_key"), F.col("o_orderpriority").alias("value_key"), (F.col("o_orderkey") % 9).alias("jobs"), F.col("o_orderkey").alias("ordinal"))
    return backfills.guarded_facets(old, heads, o.join(heads.select("source_id", "generation"), "source_id"), current)


#: SQL: the program evidence of a title's role; the roles are dealt by id.
ROLE_PROGRAMS = tuple({"Software Intern": "title:intern", "Machine Learning Intern": "title:intern"}.get(r) for r in ROLES), tuple("title:co-op" if "Co-op" in r else None for r in ROLES)
BACKFILL_SQL = f"""{RICH_SQL}, batch AS (SELECT id, employment_type LIKE 'Co-Op%' AS is_coop, {_sql(ROLE_PROGRAMS[0])}[id % {len(ROLES)} + 1] AS internship, {_sql(ROLE_PROGRAMS[1])}[id % {len(ROLES)} + 1] AS coop FROM rich WHERE status = 'open' AND id > 500 ORDER BY id LIMIT 1000),
  made AS (SELECT id, 'program:coop' AS topic_key, CASE WHEN coalesce(is_coop, false) THEN 'employment_type:coop' ELSE coop END AS evidence FROM batch UNION ALL SELECT id, 'program:internship', CASE WHEN NOT coalesce(is_coop, false) THEN internship END FROM batch),
  known AS (SELECT * FROM made WHERE evidence IS NOT NULL)"""


@query(f"""WITH {BACKFILL_SQL} SELECT job_id, topic_key, NULL::VARCHAR AS evidence FROM topics WHERE NOT (starts_with(topic_key, 'program:') AND job_id IN (SELECT id FROM batch)) UNION ALL SELECT id, topic_key, evidence FROM known""")
def backfilled_programs(spark, sf_dir):
    batch = backfills.batch(rich_postings(spark, sf_dir), 500, 1000)
    return backfills.replaced_topics(topics(spark, sf_dir).withColumn("evidence", F.lit(None).cast("string")), batch, backfills.program_topics(_titled(batch)), "program:")


@query(f"""WITH {BACKFILL_SQL} SELECT count(*) AS processed, (SELECT count(DISTINCT id) FROM known) AS matched, (SELECT count(*) FROM known) AS memberships, max(id) AS next_cursor,
  (SELECT count(*) > 0 FROM rich WHERE status = 'open' AND id > (SELECT max(id) FROM batch)) AS more FROM batch""")
def backfill_checkpoint(spark, sf_dir):
    rows = rich_postings(spark, sf_dir)
    batch = backfills.batch(rows, 500, 1000)
    return backfills.checkpoint(rows, batch, backfills.program_topics(_titled(batch)))


def _titled(batch):
    return classify.classified(batch, ("program", "type"))


SKILL_TEXTS = ('["Python", 3, "SQL", null]', "not-json", None, '{"a":1}', "[]")
EVIDENCE = ('["python|Python skills|3","sql","x||1","python|Python skills|9"]', None, "[1]")
AREAS = ('["ai-ml","unheard","software-engineering"]', None)
_list = lambda *xs: "[" + ", ".join("[]::VARCHAR[]" if x == () else _sql(x) + "::VARCHAR[]" for x in xs) + "]"


@query(f"""WITH {RICH_SQL} SELECT id, CASE id % 6 WHEN 3 THEN 'onsite' WHEN 4 THEN 'onsite' ELSE arrangement END AS arrangement, CASE WHEN id % 4 = 3 THEN 'new' ELSE review_state END AS status, CASE WHEN id % 5 = 1 THEN 'Location not specified' ELSE location END AS location,
    coalesce(summary, 'Open the official posting for the full role description.') AS summary, CASE WHEN id % 3 > 0 THEN department END AS department, {_list(("Python", "SQL"), (), (), (), ())}[id % 5 + 1] AS skills,
    {_list(("Python skills", "sql", "x||1"), (), ())}[id % 3 + 1] AS matched_terms, {_list(("ai-ml", "software-engineering"), ())}[id % 2 + 1] AS area_keys, CASE id % 3 WHEN 0 THEN 'us' ELSE 'unknown' END AS location_region, coalesce(CASE WHEN id % 2 = 0 THEN id % 101 END, 0)::INT AS match_score FROM rich""")
def mapped_postings(spark, sf_dir):
    n = F.col("id")
    rows = rich_postings(spark, sf_dir).withColumns({
        "arrangement": F.when(n % 6 == 3, "unknown").when(n % 6 == 4, F.lit(None)).otherwise(F.col("arrangement")), "review_state": F.when(n % 4 == 3, "odd").otherwise(F.col("review_state")), "location": F.when(n % 5 != 1, F.col("location")).otherwise(""),
        "department": F.when(n % 3 > 0, F.concat(F.lit(" "), "department")).otherwise("  "), "skills": _dealt(SKILL_TEXTS, n), "resume_match_evidence": _dealt(EVIDENCE, n), "area_keys": _dealt(AREAS, n), "location_region": F.when(n % 3 == 0, "us").when(n % 3 == 1, "moon"),
        "resume_match_score": F.when(n % 2 == 0, (n % 101).cast("int")),
    })
    return projections.mapped(rows).select("id", "arrangement", "status", "location", "summary", "department", "skills", "matched_terms", "area_keys", "location_region", "match_score")


@query(f"""WITH {RICH_SQL}, e AS (SELECT DISTINCT id, unnest(skills) AS evidence FROM rich) SELECT evidence, count(*) AS jobs FROM e GROUP BY 1""")
def evidence_counts(spark, sf_dir):
    return projections.evidence_histogram(rich_postings(spark, sf_dir).select(F.col("id").alias("job_id"), F.col("skills").alias("evidence")))


MERGED = ("title", "employment_type", "summary", "skills", "arrangement", "location_region", "url_identity_key", "review_state")
NEXT_SQL = f"""{RICH_SQL}, rows AS (SELECT * REPLACE (CASE WHEN id % 4 = 2 THEN 'unknown' ELSE arrangement END AS arrangement), CASE WHEN id % 3 = 0 THEN 'unknown' ELSE region END AS location_region, 'url:' || id AS url_identity_key FROM rich),
  state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, official_url ORDER BY id) AS nth FROM rows WHERE team <> '3-MEDIUM') WHERE nth = 1),
  inc AS (SELECT * FROM rows WHERE department <> 'BUILDING' AND team <> '5-LOW'),
  red AS (SELECT source_id, official_url, arg_max(title, id) AS title, arg_max(employment_type, id) AS employment_type, arg_max(summary, id) AS summary, coalesce(arg_max(skills, id) FILTER (len(skills) > 0), arg_max(skills, id)) AS skills,
    coalesce(arg_max(arrangement, id) FILTER (arrangement <> 'unknown'), 'unknown') AS arrangement, coalesce(arg_max(location_region, id) FILTER (location_region <> 'unknown'), 'unknown') AS location_region,
    arg_min(url_identity_key, id) AS url_identity_key, arg_min(review_state, id) AS review_state FROM inc GROUP BY 1, 2)"""


@query(f"""WITH {NEXT_SQL} SELECT source_id, official_url, coalesce(r.title, s.title) AS title, coalesce(r.employment_type, s.employment_type) AS employment_type, coalesce(r.summary, s.summary) AS summary,
    CASE WHEN len(r.skills) > 0 THEN r.skills ELSE coalesce(s.skills, r.skills) END AS skills, coalesce(nullif(r.arrangement, 'unknown'), s.arrangement, r.arrangement) AS arrangement, coalesce(nullif(r.location_region, 'unknown'), s.location_region, r.location_region) AS location_region,
    coalesce(s.url_identity_key, r.url_identity_key) AS url_identity_key, CASE WHEN s.id IS NULL THEN r.review_state ELSE s.review_state END AS review_state,
    CASE WHEN r.source_id IS NOT NULL THEN 'open' WHEN s.status = 'open' AND source_id IN (SELECT source_id FROM inc) THEN 'closed' ELSE s.status END AS status,
    coalesce(s.first_seen_at, '2026') AS first_seen_at, CASE WHEN r.source_id IS NOT NULL THEN '2026' ELSE s.first_seen_at END AS last_seen_at, CASE WHEN r.source_id IS NOT NULL AND s.status = 'closed' THEN 2 ELSE 1 END::BIGINT AS generation,
    CASE WHEN r.source_id IS NOT NULL AND s.status = 'closed' THEN '2026' END AS reopened_at, CASE WHEN r.source_id IS NULL AND s.status = 'open' AND source_id IN (SELECT source_id FROM inc) THEN '2026' WHEN r.source_id IS NULL AND s.status = 'closed' THEN '2025' END AS closed_at,
    CASE WHEN s.id IS NULL THEN 'created' WHEN r.source_id IS NOT NULL AND s.status = 'closed' THEN 'reopened' WHEN r.source_id IS NOT NULL THEN 'updated' WHEN s.status = 'open' AND source_id IN (SELECT source_id FROM inc) THEN 'closed' ELSE 'unchanged' END AS event
  FROM state s FULL JOIN red r USING (source_id, official_url)""")
def merged_columns(spark, sf_dir):
    n = F.col("id")
    rows = rich_postings(spark, sf_dir).withColumns({
        "arrangement": F.when(n % 4 == 2, "unknown").otherwise(F.col("arrangement")), "location_region": F.when(n % 3 == 0, "unknown").otherwise(F.col("region")), "url_identity_key": F.concat(F.lit("url:"), n)})
    state = rows.filter("team <> '3-MEDIUM'").groupBy("source_id", "official_url").agg(*[F.min_by(c, "id").alias(c) for c in (*MERGED, "status", "first_seen_at")])
    state = state.withColumns({"last_seen_at": F.col("first_seen_at"), "generation": F.lit(1).cast("long"), "reopened_at": F.lit(None).cast("string"), "closed_at": F.when(F.col("status") == "closed", "2025")})
    incoming = rows.filter("department <> 'BUILDING' AND team <> '5-LOW'").withColumn("ordinal", n)
    return merge.merge(state, incoming, "2026")


PROGRAM_SQL = """programs AS (SELECT id, title, CASE WHEN regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])intern(s|ships?)?($|[^\\p{L}\\p{N}])') THEN 'title:intern'
    WHEN regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])extern(s|ships?)?($|[^\\p{L}\\p{N}])') AND NOT regexp_matches(lower(title), 'nurse|radiology|surgical tech') THEN 'title:externship' END AS internship,
    CASE WHEN regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])(co[ -]op|coop)($|[^\\p{L}\\p{N}])') THEN 'title:co-op' END AS coop FROM rich)"""


@query(f"WITH {RICH_SQL}, {PROGRAM_SQL} SELECT id, internship, coop FROM programs")
def title_programs(spark, sf_dir):
    return classify.classified(rich_postings(spark, sf_dir), ("program",)).select("id", "program.internship", "program.coop")


@query(f"""WITH {RICH_SQL} SELECT id, title, company, coalesce(arrangement, 'onsite') AS arrangement, coalesce(review_state, 'new') AS review_state, coalesce(location, 'Location not specified') AS location, official_url,
  substr(coalesce(summary, description), 1, 1200) AS summary, published_at, first_seen_at FROM rich""")
def listed_postings(spark, sf_dir):
    return projections.listed(rich_postings(spark, sf_dir))
