"""The registered queries and, written apart from them, the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions.urls import canonical_url, registrable_domain
from postlake.functions.classifiers import url_adapter
from postlake.operators import alerts, classify, facets, merge, reports, search
from postlake.sources.proxy import POSTINGS_SQL, RUNS_SQL, listings, postings, runs, table

QUERIES, SQL = {}, {}
CANONICAL = """canonical AS (SELECT * FROM postings p WHERE status = 'open' AND NOT EXISTS (
  SELECT 1 FROM postings q WHERE q.status = 'open' AND q.official_url = p.official_url AND (q.first_seen_at > p.first_seen_at
    OR (q.first_seen_at = p.first_seen_at AND (q.company < p.company OR (q.company = p.company AND q.id < p.id))))))"""
WITH = f"WITH {POSTINGS_SQL}, {CANONICAL} "
ORDER = "ORDER BY published_at DESC NULLS LAST, first_seen_at DESC, company, id"


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BASIC = search.Filters(regions=("asia", "EUROPE"), employment_types=("1-urgent", "2-high", "5-low"), limit=50)


@query(WITH + f"SELECT id, company, title, official_url, first_seen_at, published_at FROM canonical WHERE lower(region) IN ('asia','europe') AND lower(employment_type) IN ('1-urgent','2-high','5-low') {ORDER} LIMIT 50")
def search_basic(spark, sf_dir):
    found = search.search(postings(spark, sf_dir), BASIC)
    return search.page(found, BASIC).select("id", "company", "title", "official_url", "first_seen_at", "published_at")


@query(WITH + f"SELECT id, published_at FROM canonical WHERE lower(region) IN ('asia','europe') AND lower(employment_type) IN ('1-urgent','2-high','5-low') {ORDER} LIMIT 20 OFFSET 40")
def search_second_page(spark, sf_dir):
    f = search.Filters(regions=BASIC.regions, employment_types=BASIC.employment_types, limit=20, offset=40)
    return search.page(search.search(postings(spark, sf_dir, titled=False), f), f).select("id", "published_at")


@query(WITH + "SELECT count(*) AS total FROM canonical WHERE lower(region) IN ('asia','europe')")
def search_count(spark, sf_dir):
    return search.search(postings(spark, sf_dir, titled=False), search.Filters(regions=("Asia", "Europe"))).agg(F.count(F.lit(1)).alias("total"))


@query(WITH + "SELECT id, official_url, company, first_seen_at FROM canonical")
def canonical_postings(spark, sf_dir):
    return search.canonical(postings(spark, sf_dir, titled=False)).select("id", "official_url", "company", "first_seen_at")


@query(WITH + "SELECT id, salary_min, salary_max FROM canonical WHERE salary_max >= 150000 AND salary_min <= 180000")
def search_salary_overlap(spark, sf_dir):
    return search.search(postings(spark, sf_dir, titled=False), search.Filters(salary_from=150000, salary_to=180000)).select("id", "salary_min", "salary_max")


@query(WITH + "SELECT id, published_at FROM canonical WHERE published_at >= '1995-03-01' AND published_at < '1997-07-01'")
def search_published_between(spark, sf_dir):
    return search.search(postings(spark, sf_dir, titled=False), search.Filters(published_from="1995-03-01", published_to="1997-06-30")).select("id", "published_at")


@query(WITH + """SELECT id, title FROM canonical WHERE len(list_filter(regexp_extract_all(lower(title || ' ' || company || ' ' || country), '[\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'customer'))) > 0
  AND len(list_filter(regexp_extract_all(lower(title || ' ' || company || ' ' || country), '[\\p{L}\\p{N}]+'), lambda t: starts_with(t, 's'))) > 0""")
def search_full_text(spark, sf_dir):
    return search.search(postings(spark, sf_dir), search.Filters(query="Customer S")).select("id", "title")


@query(WITH + "SELECT id, country FROM canonical WHERE contains(lower(country), 'tion_1')")
def search_location(spark, sf_dir):
    return search.search(postings(spark, sf_dir, titled=False).withColumn("location", F.col("country")), search.Filters(location="tion_1")).select("id", "country")


@query(WITH + "SELECT id, title FROM canonical WHERE id > 1000 ORDER BY id LIMIT 100")
def keyset_page(spark, sf_dir):
    return search.after(search.canonical(postings(spark, sf_dir)), 1000, 100).select("id", "title")


@query(WITH + """, each AS (SELECT 'company' AS key, trim(company) AS label, official_url FROM canonical UNION ALL SELECT 'country', trim(country), official_url FROM canonical
  UNION ALL SELECT 'region', trim(region), official_url FROM canonical UNION ALL SELECT 'employment_type', trim(employment_type), official_url FROM canonical),
  counted AS (SELECT key, min(label) AS value, count(DISTINCT official_url) AS jobs FROM each WHERE label <> '' GROUP BY key, lower(label))
  SELECT key, value, jobs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY jobs DESC, lower(value), value) AS n FROM counted) WHERE n <= 100""")
def facet_values(spark, sf_dir):
    return facets.facets(search.canonical(postings(spark, sf_dir, titled=False)))


@query(WITH + """, words AS (SELECT DISTINCT official_url, unnest(list_distinct(string_split(lower(title), ' '))) AS word FROM canonical)
  SELECT word, count(DISTINCT official_url) AS jobs FROM words WHERE word <> '' GROUP BY word""")
def title_word_facet(spark, sf_dir):
    words = search.canonical(postings(spark, sf_dir)).select("official_url", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.countDistinct("official_url").alias("jobs"))


LATEST = f"""WITH {RUNS_SQL}, latest AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS runs,
  row_number() OVER (PARTITION BY source_id ORDER BY finished_at DESC, event_id DESC) AS n FROM runs) WHERE n = 1) """


@query(LATEST + "SELECT source_id, event_id, status, runs, CASE status WHEN 'succeeded' THEN 'healthy' WHEN 'failed' THEN 'failed' WHEN 'blocked' THEN 'blocked' ELSE 'changed' END AS health FROM latest")
def source_health(spark, sf_dir):
    return reports.health(reports.latest_runs(runs(spark, sf_dir))).select("source_id", "event_id", "status", "runs", "health")


@query(LATEST + """SELECT source_id, CASE status WHEN 'succeeded' THEN 2 WHEN 'blocked' THEN 24 ELSE 6 END AS hours,
  strftime(finished_at + to_hours(CASE status WHEN 'succeeded' THEN 2 WHEN 'blocked' THEN 24 ELSE 6 END), '%Y-%m-%d %H:%M:%S') AS due_at FROM latest""")
def source_backoff(spark, sf_dir):
    due = reports.backoff(reports.latest_runs(runs(spark, sf_dir)))
    return due.select("source_id", "hours", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"))


@query(LATEST + f""", {POSTINGS_SQL} SELECT (SELECT count(*) FROM customer) AS sources, (SELECT count(*) FROM postings WHERE status = 'open') AS open_jobs,
  (SELECT count(*) FROM latest WHERE status IN ('failed', 'blocked')) AS errors, (SELECT count(DISTINCT source_id) FROM runs) AS crawled""")
def overview(spark, sf_dir):
    r = runs(spark, sf_dir)
    parts = [
        table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("sources")),
        postings(spark, sf_dir, titled=False).filter("status = 'open'").agg(F.count(F.lit(1)).alias("open_jobs")),
        reports.latest_runs(r).agg(F.count_if(F.col("status").isin("failed", "blocked")).alias("errors"), F.count(F.lit(1)).alias("crawled")),
    ]
    out = parts[0]
    for one in parts[1:]:  # one row each
        out = out.join(one, how="cross")
    return out


@query(f"WITH {RUNS_SQL} SELECT event_id, source_id, status FROM runs ORDER BY finished_at DESC, event_id DESC LIMIT 200")
def activity(spark, sf_dir):
    return reports.activity(runs(spark, sf_dir)).select("event_id", "source_id", "status")


@query(f"""WITH {RUNS_SQL} SELECT source_id, count(*) AS runs, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END)::BIGINT AS succeeded,
  sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed, coalesce(max(CASE WHEN status = 'succeeded' THEN k END), -1) AS most_seen FROM runs GROUP BY source_id""")
def run_totals(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.max(F.when(F.col("status") == "succeeded", F.col("k"))), F.lit(-1)).alias("most_seen"))


@query("""SELECT c_mktsegment AS segment, count(*) AS companies, coalesce(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 0)::BIGINT AS with_talent,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_jobs FROM customer GROUP BY 1""")
def catalog_summary(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    return c.join(o, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("companies"), F.count_if(F.col("c_acctbal") > 0).alias("with_talent"), F.count_if(F.col("has").isNull()).alias("without_jobs"))


MERGE_STATE = """state AS (SELECT source_id, official_url, min(title) AS title, min(company) AS company, max(published_at) AS published_at, min(salary_min) AS salary_min, max(salary_max) AS salary_max,
  max(status) AS status, min(first_seen_at) AS first_seen_at FROM postings WHERE id % 3 <> 0 GROUP BY 1, 2),
 incoming AS (SELECT * FROM postings WHERE id % 2 = 0 AND source_id % 4 <> 1)"""


@query(f"""WITH {POSTINGS_SQL}, {MERGE_STATE}, l AS (SELECT source_id, official_url, id, title, company, published_at FROM incoming),
 r AS (SELECT source_id, official_url, arg_max(title, id) AS title, arg_max(company, id) AS company, (arg_max(published_at, id) FILTER (WHERE published_at IS NOT NULL)) AS published_at FROM l GROUP BY 1, 2),
 b AS (SELECT coalesce(s.source_id, r.source_id) AS source_id, coalesce(s.official_url, r.official_url) AS official_url, s.status AS old, r.source_id IS NOT NULL AS seen, s.source_id IS NOT NULL AS stored,
   CASE WHEN r.source_id IS NOT NULL THEN r.title ELSE s.title END AS title, coalesce(r.published_at, s.published_at) AS published_at, coalesce(s.first_seen_at, '2026-01-01') AS first_seen_at
   FROM state s FULL JOIN r ON s.source_id = r.source_id AND s.official_url = r.official_url)
 SELECT source_id, official_url, title, published_at, first_seen_at,
   CASE WHEN NOT stored THEN 'created' WHEN seen AND old <> 'open' THEN 'reopened' WHEN seen THEN 'updated'
        WHEN old = 'open' AND source_id IN (SELECT source_id FROM incoming) THEN 'closed' ELSE 'unchanged' END AS event,
   CAST(CASE WHEN stored AND seen AND old <> 'open' THEN 2 ELSE 1 END AS BIGINT) AS generation FROM b""")
def merge_snapshot(spark, sf_dir):
    p = postings(spark, sf_dir)
    state = p.filter("id % 3 <> 0").groupBy("source_id", "official_url").agg(
        F.min("title").alias("title"), F.min("company").alias("company"), F.max("published_at").alias("published_at"), F.min("salary_min").alias("salary_min"), F.max("salary_max").alias("salary_max"),
        F.max("status").alias("status"), F.min("first_seen_at").alias("first_seen_at"))
    state = state.withColumns({"last_seen_at": F.col("first_seen_at"), "generation": F.lit(1).cast("long")})
    incoming = p.filter("id % 2 = 0 AND source_id % 4 <> 1").withColumn("ordinal", F.col("id"))
    return merge.merge(state, incoming, "2026-01-01").select("source_id", "official_url", "title", "published_at", "first_seen_at", "event", "generation")


@query("""WITH c AS (SELECT o_orderkey AS id, o_totalprice AS score, 'r' || (o_custkey % 400) AS a, 'x' || (o_orderkey % 5003) AS b FROM orders),
  k AS (SELECT id, score, a AS key FROM c UNION ALL SELECT id, score, b FROM c),
  late AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS n FROM k) WHERE n > 1)
  SELECT id FROM c WHERE id NOT IN (SELECT id FROM late)""")
def identity_suppression(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("rank"), F.array(F.concat(F.lit("r"), F.col("o_custkey") % 400), F.concat(F.lit("x"), F.col("o_orderkey") % 5003)).alias("keys"))
    return alerts.first_of_identity(c, rank=["rank", "id"]).select("id")


@query("""WITH due AS (SELECT o_orderkey AS match_id, s_suppkey AS recipient FROM orders JOIN supplier ON s_nationkey = o_custkey % 25 AND s_acctbal > 0),
  sent AS (SELECT l_orderkey AS match_id, l_suppkey AS recipient FROM lineitem)
  SELECT DISTINCT match_id FROM due d WHERE NOT EXISTS (SELECT 1 FROM due e WHERE e.match_id = d.match_id AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.match_id = e.match_id AND s.recipient = e.recipient))""")
def sent_to_every_recipient(spark, sf_dir):
    matches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_custkey") % 25).alias("profile"))
    people = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("profile"), F.col("s_suppkey").alias("recipient"), (F.col("s_acctbal") > 0).alias("enabled"))
    sent = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("recipient"))
    return alerts.sent_to_all(matches, people, sent)


@query("""WITH s AS (SELECT l_orderkey AS m, string_agg(r, ',' ORDER BY r) AS recipients FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS r FROM lineitem) GROUP BY 1)
  SELECT recipients, count(*) AS matches, min(m) AS first_match FROM s GROUP BY 1""")
def digest_envelopes(spark, sf_dir):
    return alerts.envelopes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.concat("l_returnflag", "l_linestatus").alias("recipient")))


@query("SELECT event_id, CASE WHEN event_id % 7 <= 1 THEN 5 WHEN event_id % 7 = 2 THEN 15 WHEN event_id % 7 = 3 THEN 60 ELSE 360 END AS minutes FROM events")
def retry_delays(spark, sf_dir):
    return alerts.retry(table(spark, sf_dir, "events").withColumn("attempt", F.col("event_id") % 7)).select("event_id", "minutes")


@query("""WITH f AS (SELECT o_orderkey AS id, o_totalprice AS score, (CASE WHEN year(o_orderdate) >= 1996 THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::INTEGER AS bucket FROM orders)
  SELECT id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS n FROM f) WHERE n <= 25""")
def review_feed(spark, sf_dir):
    bucket = F.when(F.year("o_orderdate") >= 1996, 2).otherwise(0) + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return alerts.top_per_bucket(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), bucket.alias("bucket")), 25).select("id", "bucket")


@query(r"""WITH u AS (SELECT page_id, regexp_replace(lower(trim(url)), '#.*$', '') AS w FROM pages)
  SELECT page_id, regexp_replace(regexp_replace(string_split(w, '?')[1], '/+$', ''), '/apply$', '') || CASE WHEN strpos(w, '?') > 0 THEN substr(w, strpos(w, '?')) ELSE '' END AS canonical FROM u""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query("""SELECT domain, count(*) AS pages FROM (SELECT array_to_string(list_slice(p, len(p) - 1, len(p)), '.') AS domain FROM (SELECT string_split(string_split(string_split(url, '://')[2], '/')[1], '.') AS p FROM pages)) GROUP BY 1""")
def pages_by_domain(spark, sf_dir):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(registrable_domain(host).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("""SELECT page_id, generate_subscripts(h, 1)::BIGINT - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)""")
def page_anchors(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS events FROM events GROUP BY 1")
def json_members(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH k AS (SELECT o_orderkey AS id, unnest(['req:' || (o_custkey % 90), 'url:' || (o_orderkey % 700)]) AS key FROM orders)
  SELECT id FROM orders o JOIN (SELECT id, bool_or(key IN (SELECT 'req:' || c_custkey FROM customer WHERE c_custkey % 11 = 0)) AS hit FROM k GROUP BY id) h ON o.o_orderkey = h.id WHERE NOT hit""")
def not_in_history(spark, sf_dir):
    each = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.concat(F.lit("req:"), F.col("o_custkey") % 90), F.concat(F.lit("url:"), F.col("o_orderkey") % 700))).alias("key"))
    history = table(spark, sf_dir, "customer").filter("c_custkey % 11 = 0").select(F.concat(F.lit("req:"), "c_custkey").alias("key"))
    return each.select("id").distinct().join(each.join(history, "key").select("id"), "id", "left_anti")


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: t IN ('the', 'und', 'les'))) AS hits FROM documents
  WHERE len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: t IN ('the', 'und', 'les'))) >= 3""")
def topic_signals(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda t: t.isin("the", "und", "les"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).filter("hits >= 3")


def turn(*answers) -> str:
    """SQL: the known answers to the wordings of listings, in their order."""
    said = ", ".join("NULL" if a is None else f"'{a}'" for a in answers)
    return f"([{said}])[p_partkey % {len(answers)} + 1]"


INTERNSHIP = turn("title:intern", None, None, "title:werkstudent", None, "title:estagio", None, None, "title:intern", "title:intern", "title:intern")
COOP = turn(None, None, "title:co-op", None, None, None, None, None, None, None, None)
TYPE = turn("Full-time", "Part-time / Temporary", "Internship / Regular", "Co-op", None, None, None)
REGION = turn("us", "non_us", "unknown", "us", "non_us", "non_us", "unknown", "non_us", "unknown")
KNOWN = f"""known AS (SELECT p_partkey AS id, {INTERNSHIP} AS internship, {COOP} AS coop, {TYPE} AS kind, {REGION} AS region,
  {turn("Chicago", None, None, "Syracuse", None, None, None, None, None)} IS NOT NULL OR {turn(*[None] * 8, "CA")} IS NOT NULL AS in_us, p_partkey FROM part)"""


@query(f"WITH {KNOWN} SELECT id, internship, coop FROM known")
def job_programs(spark, sf_dir):
    return classify.classified(listings(spark, sf_dir), ("program",)).select("id", "program.internship", "program.coop")


@query(f"""WITH {KNOWN} SELECT id, kind AS type, CASE WHEN kind = 'Co-op' OR coop IS NOT NULL THEN 'Co-op' ELSE coalesce(kind, CASE WHEN internship IS NOT NULL THEN 'Internship' END) END AS effective,
  CASE WHEN kind = 'Co-op' OR coop IS NOT NULL THEN 'coop' WHEN internship IS NOT NULL OR kind LIKE 'Internship%' THEN 'internship' ELSE '' END AS keys FROM known""")
def job_employment_types(spark, sf_dir):
    return classify.classified(listings(spark, sf_dir), ("kind",)).select("id", "type", F.col("kind.employment_type").alias("effective"), F.array_join("kind.keys", ",").alias("keys"))


@query(f"WITH {KNOWN} SELECT region, count(*) AS jobs FROM known GROUP BY 1")
def job_regions(spark, sf_dir):
    return classify.classified(listings(spark, sf_dir), ("region",)).groupBy("region").agg(F.count(F.lit(1)).alias("jobs"))


@query(f"""WITH {KNOWN}, stated AS (SELECT *, coalesce({turn(None, None, None, None, None, "2027", None, "2026", None, None, None)}, '') AS t, coalesce({turn(None, "2027", None, None, None)}, '') AS b FROM known)
  SELECT id, CASE WHEN t <> '' AND b <> '' AND t <> b THEN t || ':title:explicit-year,' || b || ':body:explicit-program-cycle' WHEN t <> '' THEN t || ':title:explicit-year' WHEN b <> '' THEN b || ':body:explicit-program-cycle'
    WHEN id % 3 = 0 AND in_us AND (internship IS NOT NULL OR coop IS NOT NULL OR kind = 'Co-op' OR kind LIKE 'Internship%') THEN '2027:inferred:us-program-posted-h2' ELSE '' END AS years FROM stated""")
def job_recruiting_years(spark, sf_dir):
    years = F.array_join(F.transform("years", lambda y: F.concat_ws(":", y["year"].cast("string"), y["evidence"])), ",")
    return classify.classified(listings(spark, sf_dir), ("years",)).select("id", years.alias("years"))


@query(f"""WITH t AS (SELECT p_partkey AS id, {turn("title:machine learning", None, None, "title:data science", None, None, None, None, "title:ai", None, "title:research scientist")} AS a,
    CASE WHEN p_partkey % 4 = 0 THEN 'skill:pytorch' END AS b, p_partkey % 5 = 2 AS tracks FROM part)
  SELECT id, a IS NOT NULL OR b IS NOT NULL OR tracks AS matched, (4 * (a IS NOT NULL)::INT + 4 * (b IS NOT NULL)::INT + 4 * tracks::INT)::INTEGER AS score,
    concat_ws(',', CASE WHEN tracks THEN 'body:data engineering,body:machine learning' END, b, a) AS evidence FROM t""")
def job_ai_data_topic(spark, sf_dir):
    return classify.classified(listings(spark, sf_dir), ("topic",)).select("id", "topic.matched", "topic.score", F.array_join("topic.evidence", ",").alias("evidence"))


@query(f"""WITH t AS (SELECT p_partkey AS id, unnest(['ai-ml', 'data-analytics', 'software-engineering']) AS area, p_partkey % 5 = 2 AS tracks, p_partkey % 4 = 0 AS torch,
    unnest([{turn("title:machine learning", *[None] * 7, "title:ai", None, "title:research scientist")}, {turn(*[None] * 3, "title:data science", *[None] * 5, "title:analytics", None)}, {turn(None, None, "title:backend", None, None, None, "title:firmware", *[None] * 4)}]) AS a FROM part),
  e AS (SELECT id, area, concat_ws(',', CASE WHEN tracks AND area = 'ai-ml' THEN 'body-track:machine learning' WHEN tracks AND area = 'data-analytics' THEN 'body-track:data engineering,body-track:data track' END,
    CASE WHEN torch AND area = 'ai-ml' THEN 'skill:pytorch' END, a) AS evidence, (4 * (a IS NOT NULL)::INT + 4 * (torch AND area = 'ai-ml')::INT + CASE WHEN tracks AND area = 'ai-ml' THEN 2 WHEN tracks AND area = 'data-analytics' THEN 4 ELSE 0 END)::INTEGER AS score FROM t)
  SELECT id, area, score, evidence FROM e WHERE score > 0""")
def job_areas(spark, sf_dir):
    each = classify.classified(listings(spark, sf_dir), ("areas",)).select("id", F.explode("areas").alias("a"))
    return each.select("id", "a.area", "a.score", F.array_join("a.evidence", ",").alias("evidence"))


@query(f"SELECT p_partkey AS id, {turn('greenhouse', 'lever', 'phenom', 'custom', 'workday', 'custom')} AS adapter FROM part")
def url_adapters(spark, sf_dir):
    return listings(spark, sf_dir).select("id", url_adapter(F.col("url")).alias("adapter"))


@query(f"""WITH {KNOWN} SELECT id, CASE WHEN region <> 'us' THEN 'region:not-us' WHEN internship IS NULL AND coop IS NULL AND coalesce(kind, '') <> 'Co-op' AND coalesce(kind, '') NOT LIKE 'Internship%' THEN 'program:not-internship'
    WHEN p_partkey % 11 = 8 THEN 'role:recruiting' WHEN p_partkey % 11 = 10 AND p_partkey % 5 <> 0 THEN 'education:phd-only' WHEN p_partkey % 5 = 4 THEN 'authorization:citizen-only' ELSE 'scored' END AS exclusion FROM known""")
def resume_exclusions(spark, sf_dir):
    found = classify.scored(classify.classified(listings(spark, sf_dir), ("region", "years")))
    named = F.when(F.col("match.exclusion").isin("role:not-supported", "score:below-threshold"), "scored").otherwise(F.coalesce("match.exclusion", F.lit("scored")))
    return found.select("id", named.alias("exclusion"))


@query()
def resume_matches(spark, sf_dir):
    found = classify.scored(classify.classified(listings(spark, sf_dir), ("region", "years"))).filter("match.eligible")
    return found.select("id", "match.score", F.array_join("match.evidence.code", ",").alias("evidence"))


@query(f"""WITH {RUNS_SQL} SELECT count(*) AS sources, {', '.join(f"(count(*) FILTER (WHERE status = '{s}'))::BIGINT AS {s}" for s in ('succeeded', 'failed', 'blocked', 'running'))}, round(sum(jobs_seen), 2) AS jobs_seen FROM runs""")
def batch_summary(spark, sf_dir):
    return reports.batch_summary(runs(spark, sf_dir)).withColumn("jobs_seen", F.round("jobs_seen", 2))
