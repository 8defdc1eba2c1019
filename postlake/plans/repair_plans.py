"""Queries over repairs of urls, checkpoints, feeds of activity, bounded records, derived facets and stored matches, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import urls
from postlake.operators import delivery, projections, repairs, review, search
from postlake.plans.catalog import query
from postlake.sources.proxy import RUNS_SQL, runs, table
from postlake.sources.rich import RICH_SQL, _dealt, _sql, matches, rich_postings, topics
from postlake.sources.shared import kept

TITLES = ("Data Engineer", "Nurse Extern", "Software Intern", "Internal Auditor")


def _stored(spark, sf_dir):
    """One stored posting per order; four neighbours share a title and a requisition."""
    n = F.col("o_orderkey")
    group = F.floor(n / 4)
    url = F.when(n % 5 == 2, F.concat(F.lit("https://search.jobs.barclays/en/job/"), n, F.lit("/"))).otherwise(F.concat(F.lit("https://a.example/job/"), n))
    return table(spark, sf_dir, "orders").select(
        F.floor(n / 40).alias("source_id"), n.alias("id"), url.alias("official_url"), _dealt(TITLES, group).alias("title"), F.concat(F.lit("E-"), n).alias("external_id"),
        F.concat(F.lit("R"), group).alias("requisition_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))


def _incoming(spark, sf_dir):
    """One incoming posting for each first line not returned: on its url, moved with its id, without its locale, with an id spelt otherwise, or retitled."""
    n = F.col("l_orderkey")
    kind, group = n % 5, F.floor(n / 4)
    url = F.when(kind == 0, F.concat(F.lit("https://a.example/job/"), n)).when(kind == 2, F.concat(F.lit("https://search.jobs.barclays/job/"), n)).otherwise(F.concat(F.lit("https://b.example/job/"), n))
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_returnflag <> 'A'")
    return rows.select(
        F.floor(n / 40).alias("source_id"), url.alias("official_url"), F.when(kind == 4, "Retitled").otherwise(_dealt(TITLES, group)).alias("title"),
        F.when(kind == 1, F.concat(F.lit("E-"), n)).when(kind >= 3, F.concat(F.lit(" e-"), n)).alias("external_id"), F.when(kind <= 1, F.concat(F.lit("r"), group)).alias("requisition_id"), (n % 3 > 0).alias("first_party"))


REPAIR_SQL = f"""stored AS (SELECT o_orderkey // 40 AS source_id, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 2 THEN 'https://search.jobs.barclays/en/job/' || o_orderkey || '/' ELSE 'https://a.example/job/' || o_orderkey END AS was,
    {_sql(TITLES)}[o_orderkey // 4 % {len(TITLES)} + 1] AS title, 'E-' || o_orderkey AS ext, 'r' || o_orderkey // 4 AS req, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM orders),
  incoming AS (SELECT l_orderkey // 40 AS source_id, l_orderkey AS k, CASE l_orderkey % 5 WHEN 0 THEN 'https://a.example/job/' || l_orderkey WHEN 2 THEN 'https://search.jobs.barclays/job/' || l_orderkey ELSE 'https://b.example/job/' || l_orderkey END AS url,
    CASE WHEN l_orderkey % 5 = 4 THEN 'Retitled' ELSE {_sql(TITLES)}[l_orderkey // 4 % {len(TITLES)} + 1] END AS title, l_orderkey % 3 > 0 AS own FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'A'),
  found AS (SELECT url, 0 AS rank, id, was, status FROM incoming i JOIN stored s ON s.source_id = i.source_id AND was = url
    UNION ALL SELECT url, 1, id, was, status FROM incoming i JOIN stored s ON s.source_id = i.source_id AND ext = 'E-' || k WHERE k % 5 = 1
    UNION ALL SELECT url, 2, id, was, status FROM incoming i JOIN stored s ON s.source_id = i.source_id AND s.title = i.title AND rtrim(replace(was, '/en/job/', '/job/'), '/') = url WHERE own
    UNION ALL SELECT url, 3, id, was, status FROM incoming i JOIN stored s ON s.source_id = i.source_id AND s.title = i.title AND s.id = k WHERE own AND k % 5 IN (1, 3, 4)
    UNION ALL SELECT url, 4, id, was, status FROM incoming i JOIN stored s ON s.source_id = i.source_id AND s.title = i.title AND req = 'r' || k // 4 WHERE own AND k % 5 <= 1),
  target AS (SELECT url, first(id ORDER BY rank, id) AS id, first(was ORDER BY rank, id) AS was FROM found GROUP BY url)"""


@query(f"WITH {REPAIR_SQL} SELECT id, min(url) AS official_url FROM target WHERE was <> url GROUP BY id")
def moved_postings(spark, sf_dir):
    return repairs.url_repairs(repairs.url_candidates(_stored(spark, sf_dir), _incoming(spark, sf_dir)))


@query(f"WITH {REPAIR_SQL} SELECT DISTINCT f.id FROM found f JOIN target t ON t.url = f.url WHERE f.rank >= 2 AND f.status = 'open' AND f.was <> f.url AND f.id <> t.id")
def mirrors_to_close(spark, sf_dir):
    return repairs.repair_mirrors(kept(repairs.url_candidates(_stored(spark, sf_dir), _incoming(spark, sf_dir))))


# Per order a repair asked for: within the origin, to a taken url, to another origin, without https, from a url it no longer has.
NEW_SQL = """asked AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 4 THEN 'https://a.example/old' ELSE 'https://a.example/job/' || o_orderkey END AS current_url,
  CASE o_orderkey % 6 WHEN 0 THEN 'https://a.example/job/' || (o_orderkey + 1) WHEN 1 THEN 'https://b.example/job/' || o_orderkey WHEN 2 THEN 'http://a.example/new/' || o_orderkey ELSE 'https://a.example/new/' || o_orderkey END AS new_url FROM orders)"""


def _asked(spark, sf_dir):
    n = F.col("o_orderkey")
    at = lambda p, c=n: F.concat(F.lit(p), c)
    new = F.when(n % 6 == 0, at("https://a.example/job/", n + 1)).when(n % 6 == 1, at("https://b.example/job/")).when(n % 6 == 2, at("http://a.example/new/")).otherwise(at("https://a.example/new/"))
    return table(spark, sf_dir, "orders").select(n.alias("id"), F.when(n % 6 == 4, "https://a.example/old").otherwise(at("https://a.example/job/")).alias("current_url"), new.alias("new_url"))


@query(f"""WITH {REPAIR_SQL}, {NEW_SQL} SELECT s.id, new_url AS official_url FROM stored s JOIN asked a ON a.id = s.id AND current_url = was WHERE status = 'open' AND s.id % 6 NOT IN (1, 2)
  AND NOT EXISTS (SELECT 1 FROM stored t WHERE t.source_id = s.source_id AND t.was = new_url)""")
def requested_repairs(spark, sf_dir):
    return repairs.repaired(_stored(spark, sf_dir), _asked(spark, sf_dir))


@query(f"WITH {REPAIR_SQL}, {NEW_SQL} SELECT s.id FROM stored s JOIN asked a ON a.id = s.id AND current_url = was WHERE status = 'open'")
def closed_dead_urls(spark, sf_dir):
    return repairs.closed_dead(_stored(spark, sf_dir), _asked(spark, sf_dir))


BROKEN = ("https://acme.wd5.myworkdayjobs.com/job/1", "https://acme.wd5.myworkdayjobs.com/en/job/1", "https://x.oraclecloud.com/en/sites/A/job/2/x", "https://a.example//jobs/3", "https://a.example/jobs/4", "http://a.myworkdayjobs.com/job/5", "//jobs/6")


@query(f"""WITH u AS (SELECT o_custkey, {_sql(BROKEN)}[(o_orderkey + o_custkey) % {len(BROKEN)} + 1] AS url FROM orders WHERE o_orderstatus <> 'F')
  SELECT c_custkey AS source_id FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_custkey > 100 AND EXISTS (SELECT 1 FROM u WHERE o_custkey = c_custkey
    AND (url GLOB 'https://*.myworkdayjobs.com/job/*' OR url ILIKE '%oraclecloud.com/en/sites/%/job/%/%' OR instr(url, '//jobs/') > 8)) ORDER BY 1 LIMIT 25""")
def broken_url_sources(spark, sf_dir):
    url = _dealt(BROKEN, F.col("o_orderkey") + F.col("o_custkey")).alias("official_url")
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), url, F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("posting_url"))
    return repairs.sources_to_repair(own, held, 100, 25).select("source_id")


STATES = (
    '{"listingUrl":"U","adapter":"A","nextPage":3,"cycleStartedAt":"2026-01-01","previousCycleStartedAt":"2025-12-01"}', '{"listingUrl":"U","adapter":"A","nextPage":"3","cycleStartedAt":"2026-01-01"}',
    '{"listingUrl":"U","adapter":"B","nextPage":3,"cycleStartedAt":"2026-01-01"}', '{"listingUrl":"U","adapter":"A","nextPage":0,"cycleStartedAt":"2026-01-01"}', '{"listingUrl":"U","adap', '{"listingUrl":"U","adapter":"A","nextPage":7,"cycleStartedAt":"2026-02-02","previousCycleStartedAt":5}',
)


@query(f"""WITH s AS (SELECT c_custkey AS source_id, 'U' AS posting_url, CASE WHEN c_custkey % 4 = 0 THEN 'B' ELSE 'A' END AS adapter, {_sql(STATES)}[c_custkey % {len(STATES)} + 1] AS raw FROM customer),
  j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END::JSON AS v FROM s), ok AS (SELECT *, v->>'$.listingUrl' = posting_url AND v->>'$.adapter' = adapter AND json_type(v, '$.nextPage') IN ('UBIGINT', 'BIGINT') AND TRY_CAST(v->>'$.nextPage' AS BIGINT) > 0 AND json_type(v, '$.cycleStartedAt') = 'VARCHAR' AS fits FROM j)
  SELECT source_id, CASE WHEN fits THEN TRY_CAST(v->>'$.nextPage' AS BIGINT) END AS page, CASE WHEN fits THEN v->>'$.cycleStartedAt' END AS cycle, CASE WHEN fits AND json_type(v, '$.previousCycleStartedAt') = 'VARCHAR' THEN v->>'$.previousCycleStartedAt' END AS previous_cycle FROM ok""")
def resumed_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = c.select(F.col("c_custkey").alias("source_id"), F.lit("U").alias("posting_url"), F.when(F.col("c_custkey") % 4 == 0, "B").otherwise("A").alias("adapter"))
    return repairs.resumed(own, c.select(F.col("c_custkey").alias("source_id"), _dealt(STATES, F.col("c_custkey")).alias("value"))).drop("posting_url", "adapter")


@query(f"""WITH {RUNS_SQL} SELECT event_id AS id, CASE WHEN status IN ('failed', 'blocked') THEN 'source.failed' ELSE 'source.changed' END AS kind, CASE WHEN status IN ('failed', 'blocked') THEN 'error' ELSE 'success' END AS severity,
  CASE WHEN status IN ('failed', 'blocked') THEN 'Source ' || source_id || ' crawl ' || status || '.' ELSE 'Source ' || source_id || ' refreshed ' || k || ' roles.' END AS summary,
  CASE WHEN event_id % 5 = 0 THEN '1970-01-01T00:00:00.000Z' WHEN event_id % 5 = 1 THEN 'began' ELSE 'ended' END AS occurred_at, CASE WHEN status = 'failed' THEN 'timeout' ELSE k || ' created, 0 updated, 1 closed.' END AS details FROM runs""")
def activity_feed(spark, sf_dir):
    n = F.col("event_id")
    rows = runs(spark, sf_dir).select(
        n.alias("id"), F.concat(F.lit("Source "), "source_id").alias("company"), "status", F.col("k").alias("jobs_seen"), F.col("k").alias("jobs_created"), F.lit(0).alias("jobs_updated"), F.lit(1).alias("jobs_closed"),
        F.when(F.col("status") == "failed", "timeout").otherwise("").alias("error"), F.when(n % 5 > 0, "began").alias("started_at"), F.when(n % 5 == 1, "").when(n % 5 > 1, "ended").alias("finished_at"))
    return projections.activity(rows)


@query("""WITH c AS (SELECT *, '2026-01-0' || (1 + c_custkey % 9) AS checked FROM customer) SELECT c_custkey AS source_id, c_name AS company, c_mktsegment AS health, CASE WHEN c_custkey % 3 > 0 THEN checked ELSE '2026-02-01' END AS last_checked_at,
  CASE WHEN c_custkey % 2 = 0 THEN checked ELSE '2026-03-01' END AS next_run_at FROM c WHERE c_mktsegment = 'MACHINERY' AND c_name ILIKE '%er#0000%1%'""")
def listed_sources(spark, sf_dir):
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        n.alias("source_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("health"), F.concat(F.lit("2026-01-0"), n % 9 + 1).alias("checked_at"),
        F.when(n % 3 == 1, "").when(n % 3 == 0, "2026-02-01").alias("last_crawled_at"), F.when(n % 2 == 1, "2026-03-01").alias("next_crawl_at"))
    return projections.source_list(rows).filter("health = 'MACHINERY' AND company ILIKE '%er#0000%1%'")


MOST = 4_200
# Bytes of {"doc_id":1,"description":"..."} in an array, with JSON's escapes, for a text of the documents.
SIZE_SQL = r"""(length(doc_id::VARCHAR) + 30 + octet_length(encode({0})) + length({0}) - length(regexp_replace({0}, '["\\\\\n\t\r\x08\x0C]', '', 'g')) + 5 * (length({0}) - length(regexp_replace({0}, '[\x00-\x07\x0B\x0E-\x1F]', '', 'g'))))"""


@query(f"""SELECT doc_id, CASE WHEN text IS NULL OR {SIZE_SQL.format("text")} + 19 <= {MOST} THEN true ELSE false END AS raw, CASE WHEN {SIZE_SQL.format("text")} <= {MOST} THEN length(text) WHEN {SIZE_SQL.format("text[:100000]")} <= {MOST} THEN least(length(text), 100000)
  WHEN {SIZE_SQL.format("text[:20000]")} <= {MOST} THEN least(length(text), 20000) WHEN {SIZE_SQL.format("text[:2000]")} <= {MOST} THEN least(length(text), 2000) END AS kept FROM documents""")
def bounded_descriptions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"), F.lit("{}").alias("raw_payload"))
    record = rows.select("doc_id", projections.bounded_record(rows.columns, MOST).alias("r"))
    return record.select("doc_id", F.get_json_object("r", "$.raw_payload").isNotNull().alias("raw"), F.length(F.get_json_object("r", "$.description")).cast("long").alias("kept"))


MEMBERS = ('["a",1,null,"b"]', "[]", '{"a":"b"}', '["broken', '[["c"],"d",true,"2"]')


@query(f"WITH d AS (SELECT o_orderkey AS id, {_sql(MEMBERS)}[o_orderkey % {len(MEMBERS)} + 1] AS raw FROM orders), j AS (SELECT id, unnest(CASE WHEN json_valid(raw) AND json_type(raw) = 'ARRAY' THEN raw::JSON[] END) AS v FROM d) SELECT id, v->>'$' AS value FROM j WHERE json_type(v) = 'VARCHAR'")
def text_members(spark, sf_dir):
    n = F.col("o_orderkey")
    return projections.text_members(table(spark, sf_dir, "orders").select(n.alias("id"), _dealt(MEMBERS, n).alias("raw")), "id", "raw")


@query(f"""WITH {RICH_SQL}, e AS (SELECT source_id, unnest([{{'key': 'department', 'value': department}}, {{'key': 'team', 'value': team}}, {{'key': 'arrangement', 'value': arrangement}}, {{'key': 'city', 'value': city}}, {{'key': 'country', 'value': country}}, {{'key': 'employment_type', 'value': employment_type}}]) AS f FROM rich
    UNION ALL SELECT source_id, {{'key': 'skills', 'value': unnest(skills)}} FROM rich), n AS (SELECT source_id, f.key AS key, f.value AS value, count(*) AS jobs FROM e WHERE f.value <> '' GROUP BY 1, 2, 3)
  SELECT *, row_number() OVER (PARTITION BY source_id, key ORDER BY jobs DESC, value) AS place FROM n""")
def listing_facets(spark, sf_dir):
    return projections.derived_facets(rich_postings(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {RICH_SQL}, t AS (SELECT job_id, list_sort(list(DISTINCT substr(topic_key, 9)) FILTER (starts_with(topic_key, 'program:'))) AS p, list_sort(list(DISTINCT substr(topic_key, 6)) FILTER (starts_with(topic_key, 'year:'))) AS y FROM topics GROUP BY 1)
  SELECT id, coalesce(array_to_string(p, ','), '') AS programs, coalesce(array_to_string(y, ','), '') AS years FROM best LEFT JOIN t ON job_id = id WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = source_id AND official_url = 'https://jobs.example/' || (c_custkey % 500) || '/1-URGENT')""")
def loaded_candidates(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.format_string("https://jobs.example/%d/1-URGENT", F.col("c_custkey") % 500).alias("official_url"))
    found = review.candidates_for(search.search(rich_postings(spark, sf_dir), search.Filters()), topics(spark, sf_dir), asked)
    return found.select("id", F.array_join("program_keys", ",").alias("programs"), F.array_join("recruiting_years", ",").alias("years"))


@query(f"""WITH {RICH_SQL}, old AS (SELECT * FROM matches WHERE job_id % 4 > 0), new AS (SELECT o_orderkey AS job_id, (o_orderkey % 3 + 1 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::INT AS open_generation, (o_orderkey % 50)::INT AS score, o_orderkey % 3 < 2 AS program FROM orders WHERE o_orderkey % 6 > 0)
  SELECT job_id, open_generation, CASE WHEN n.program THEN n.score ELSE o.score END AS score, coalesce(n.program, o.is_active) AS is_active, CASE WHEN o.job_id IS NOT NULL AND job_id % 5 = 0 THEN 1 ELSE 0 END AS eligible,
    CASE WHEN n.program THEN 'skill|Python|' || n.score || ';candidate:student-program|Server program gate: internship or co-op|0' ELSE 'old' END AS terms
  FROM old o FULL JOIN new n USING (job_id, open_generation) WHERE o.score IS NOT NULL OR n.program""")
def persisted_matches(spark, sf_dir):
    n = F.col("job_id")
    old = matches(spark, sf_dir).filter(n % 4 > 0).select("job_id", F.lit(1).alias("profile"), "open_generation", "score", F.array(F.lit("old")).alias("terms"), "is_active", F.when(n % 5 == 0, 1).otherwise(0).alias("eligible"))
    score = (n % 50).cast("int")
    evidence = F.array(F.struct(F.lit("skill").alias("code"), F.lit("Python").alias("label"), score.alias("points")))
    keys = F.when(n % 3 == 0, F.array(F.lit("coop"))).when(n % 3 == 1, F.array(F.lit("x"), F.lit("internship"))).otherwise(F.array(F.lit("new-grad")))
    judged = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")).filter(n % 6 > 0).select(
        "job_id", F.lit(1).alias("profile"), (n % 3 + 1 + F.when(n % 10 == 0, 1).otherwise(0)).cast("int").alias("open_generation"), keys.alias("program_keys"), score.alias("score"), evidence.alias("evidence"))
    return review.persisted(old, judged).select("job_id", "open_generation", "score", "is_active", "eligible", F.array_join("terms", ";").alias("terms"))


@query(f"""WITH {RICH_SQL} SELECT id, location, CASE WHEN published_at IS NOT NULL THEN 'Posted ' || published_at ELSE 'First seen ' || first_seen_at END AS timing,
  CASE WHEN id % 3 > 0 THEN NULL WHEN id % 2 = 0 THEN 'Summer work term' ELSE 'Work-term dates not stated; verify possible semester overlap' END AS schedule_note, CASE WHEN id % 4 = 0 THEN 'Python,plain,b||1,C' ELSE 'Only' END AS reasons FROM rich WHERE first_seen_at > '1996-01-01' OR id % 7 = 0""")
def digest_rows(spark, sf_dir):
    n = F.col("id")
    terms = F.when(n % 4 == 0, F.array(*map(F.lit, ("a|Python|3", "plain", "b||1", "c|C|2", "d|D|1")))).otherwise(F.array(F.lit("x|Only|9")))
    rows = rich_postings(spark, sf_dir).filter(review.new_since(F.lit(True), F.col("first_seen_at"), F.when(n % 7 > 0, "1996-01-01")))
    items = rows.select("*", F.when(n % 3 == 0, "Co-op").otherwise("Internship").alias("program"), (n % 2 == 0).alias("is_summer"), terms.alias("terms"))
    return review.decorated(items).withColumn("reasons", F.array_join("reasons", ","))


HOSTS = ("http://jobs.example/A/1", "HTTP://JOBS.example/b#x", "https://jobs.example/c", "http://other.example/d", "Junk Url")


@query(f"SELECT c_custkey AS source_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'https://jobs.example/A/1' WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 1 THEN 'https://JOBS.example/b#x' ELSE {_sql(HOSTS)}[c_custkey % 5 + 1] END AS url FROM customer")
def secured_urls(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("source_id"), urls.secured(_dealt(HOSTS, n), F.when(n % 2 == 0, "https://jobs.example/careers").otherwise("http://jobs.example/careers")).alias("url"))


LABELS = (("Page 3", "2", "next", " 5 "), ("6", "1", "page2", "2"), (), ("PAGE  4", "3 of 9", "04"), None)


@query(f"SELECT c_custkey AS source_id, ['2,3,5', '2', '', '4', NULL][c_custkey % 5 + 1] AS pages FROM customer")
def further_pages(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("source_id"), F.array_join(urls.further_pages(_dealt(LABELS, n)), ",").alias("pages"))


MAIL = """m AS (SELECT o_orderkey AS message_id, o_custkey % 3 AS profile, CASE WHEN o_orderkey % 5 > 0 THEN 'email' ELSE 'push' END AS channel, ['sent', 'failed', 'auth_blocked', 'queued'][o_orderkey % 4 + 1] AS status FROM orders)"""


def _mail(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("message_id"), (F.col("o_custkey") % 3).alias("profile"), F.when(n % 5 > 0, "email").otherwise("push").alias("channel"), _dealt(("sent", "failed", "auth_blocked", "queued"), n).alias("status"), F.lit(None).cast("timestamp").alias("retry_at"), F.lit("refused").alias("error"))


@query(f"WITH {MAIL}, a AS (SELECT *, profile = 1 AND channel = 'email' AND status IN ('failed', 'auth_blocked') AS again FROM m) SELECT message_id, CASE WHEN again THEN 'retryable' ELSE status END AS status, CASE WHEN again THEN '2026-01-01' END AS retry_at, CASE WHEN NOT again THEN 'refused' END AS error FROM a")
def retried_messages(spark, sf_dir):
    return delivery.retried(_mail(spark, sf_dir), 1, "2026-01-01").select("message_id", "status", F.date_format("retry_at", "yyyy-MM-dd").alias("retry_at"), "error")


@query(f"WITH {MAIL} SELECT l_orderkey AS message_id, l_linenumber AS match_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM m WHERE message_id = l_orderkey AND profile = 1 AND status <> 'sent')")
def items_after_clearing(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("match_id"))
    return delivery.cleared(_mail(spark, sf_dir), items, _told(spark, sf_dir), 1)[1]


def _told(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("match_id"), (F.col("o_custkey") % 3).alias("profile"), F.when(n % 4 == 0, F.col("o_orderdate")).alias("notified_at"), (n % 5 > 0).alias("eligible"))


@query("SELECT o_orderkey AS match_id, o_orderkey % 5 > 0 AND NOT (o_custkey % 3 = 1 AND o_orderkey % 4 > 0) AS eligible FROM orders")
def matches_after_clearing(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("match_id"))
    return delivery.cleared(_mail(spark, sf_dir), items, _told(spark, sf_dir), 1)[2].select("match_id", "eligible")
