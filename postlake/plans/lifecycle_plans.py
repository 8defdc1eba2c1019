"""Queries over merges, reviews, links and runs, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions import urls
from postlake.operators import lifecycle, review
from postlake.plans.catalog import query
from postlake.sources.proxy import RUNS_SQL, runs, table
from postlake.sources.rich import RICH_SQL, _dealt, _sql, rich_postings, topics

# -- urls, on the pages' own urls and on ends that are hard -------------------------------------------------------------------------

ENDS = ("", "#Top", "/Apply/", "//apply", "?Id=7#x", "/apply?a=1", "///", "/APPLY//?q=/apply")
HARD = ("Not A Url#x", "https://Example.com", "  HTTPS://EXAMPLE.com/A/Apply ", "https://search.jobs.barclays/EN/job/x/12/apply", "https://search.jobs.barclays/en/other", "mailto:a@b.c", "https://www.abc.de/x", "https://a.b.co.uk/y?", "")


def _urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.concat("url", _dealt(ENDS, F.col("page_id"))), _dealt(HARD, F.col("page_id")))).alias("url"))
    return p


URLS_SQL = f"urls AS (SELECT page_id, unnest([url || {_sql(ENDS)}[page_id % {len(ENDS)} + 1], {_sql(HARD)}[page_id % {len(HARD)} + 1]]) AS url FROM pages)"
SPLIT_SQL = f"""{URLS_SQL}, split AS (SELECT *, regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u FROM urls),
  steps AS (SELECT *, lower(u.host) AS host, CASE WHEN lower(u.host) = 'search.jobs.barclays' AND regexp_matches(u.path, '(?i)^/en/job/') THEN substr(u.path, 4) ELSE u.path END AS p0, CASE WHEN u.query = '?' THEN '' ELSE u.query END AS q FROM split),
  cut AS (SELECT *, regexp_replace(p0, '(?i)/apply/*$', '') AS p1 FROM steps)"""


@query(f"""WITH {SPLIT_SQL} SELECT page_id, url, CASE WHEN host = '' THEN lower(trim(url)) ELSE lower(u.scheme) || '://' || host || CASE WHEN trim(p1, '/') = '' THEN '/' ELSE lower(rtrim(p1, '/')) END || lower(q) END AS canonical FROM cut""")
def canonical_hard_urls(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", "url", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"""WITH {URLS_SQL}, labels AS (SELECT url, string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', ''), '.') AS l FROM urls WHERE contains(url, '://'))
  SELECT CASE WHEN len(l) <= 2 THEN array_to_string(l, '.') WHEN len(l[-1]) = 2 AND len(l[-2]) <= 3 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain, count(*) AS urls FROM labels GROUP BY 1""")
def urls_by_registrable_domain(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    return _urls(spark, sf_dir).filter(F.col("url").contains("://")).groupBy(urls.registrable_domain(host).alias("domain")).agg(F.count(F.lit(1)).alias("urls"))


@query(f"""WITH {RICH_SQL}, k AS (SELECT id, 'req:' || source_id || ':' || lower(team) AS a, CASE WHEN id % 3 > 0 THEN 'ext:' || source_id || ':' || id % 50 END AS b, 'url:' || lower(official_url) AS c FROM rich),
  e AS (SELECT id, unnest(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS key FROM k)
  SELECT key, count(*) AS postings, min(id) AS first FROM e GROUP BY key HAVING count(*) > 1""")
def shared_identity_keys(spark, sf_dir):
    keys = urls.identity_keys(F.col("source_id").cast("string"), F.concat(F.lit(" "), F.upper("team")), F.when(F.col("id") % 3 > 0, (F.col("id") % 50).cast("string")).otherwise(F.lit(" ")), F.col("official_url"))
    each = rich_postings(spark, sf_dir).select("id", F.explode(keys).alias("key"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("postings"), F.min("id").alias("first")).filter("postings > 1")


@query("""WITH o AS (SELECT page_id, url, replace(replace(rtrim(base64(encode(url)), '='), '+', '-'), '/', '_') AS b FROM pages), w AS (SELECT page_id, url, unnest(['https://www.bing.com/ck/a?x=1&u=a1' || b || '&n=2', 'https://BING.com/ck?u=a2' || b, 'https://bing.com.example/?u=a1' || b, 'https://bing.com/?u=a1bm93aGVyZQ', url]) AS href,
    unnest([url, NULL, NULL, NULL, url]) AS carried FROM o) SELECT page_id, href, CASE WHEN regexp_matches(carried, '(?i)^https?://') THEN carried ELSE href END AS target FROM w""")
def unwrapped_links(spark, sf_dir):
    """Links as a search engine gives them, some of them redirects that carry a page's url."""
    b = F.translate(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"[=\r\n]", ""), "+/", "-_")
    links = [F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), b, F.lit("&n=2")), F.concat(F.lit("https://BING.com/ck?u=a2"), b), F.concat(F.lit("https://bing.com.example/?u=a1"), b), F.lit("https://bing.com/?u=a1bm93aGVyZQ"), F.col("url")]
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*links)).alias("href")).withColumn("target", urls.unwrapped(F.col("href")))


ANCHOR = r"(?is)<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))[^>]*>(.*?)</a\s*>"


def anchors(spark, sf_dir):
    """One row per anchor of a page: its place, link and text; attributes may come in any order, with any quotes."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("pos", "tag")
    each = table(spark, sf_dir, "pages").select("page_id", "url", found)
    href = F.concat(*[F.regexp_extract("tag", ANCHOR, i) for i in (1, 2, 3)])
    return each.select("page_id", "url", F.col("pos").cast("long").alias("pos"), href.alias("href"), F.trim(F.regexp_replace(F.regexp_extract("tag", ANCHOR, 4), r"<[^>]*>|\s+", " ")).alias("text"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+)[^>]*>.*?</a\s*>') AS tags FROM pages),
  e AS (SELECT page_id, generate_subscripts(tags, 1)::BIGINT - 1 AS pos, unnest(tags) AS tag FROM t)
  SELECT page_id, pos, trim(regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '"''') AS href, trim(regexp_replace(regexp_extract(tag, '(?is)^<a[^>]*>(.*)</a\s*>$', 1), '<[^>]*>|\s+', ' ', 'g')) AS text FROM e""")
def page_anchor_tags(spark, sf_dir):
    return anchors(spark, sf_dir).select("page_id", "pos", "href", "text")


LINKS = (
    "https://jobs.lever.co/acme", "https://acme.com/careers/search-results", "https://acme.com/us/en/jointalentcommunity", "https://www.linkedin.com/jobs", "https://careers.acme.com/", "https://acme.com/nursing-jobs",
    "https://acme.com/jobs/12345", "https://boards.greenhouse.io/acme?gh_jid=4", "https://acme.icims.com/jobs/login", "https://acme.jobs/search", "ftp://acme.com/jobs", "http://acme.com/about",
)
TEXTS = ("Open roles", "View all jobs", "Nursing careers", "Home", "", "Join our team", "Search open jobs")


def _links(spark, sf_dir):
    """One row per order: a link of the career page of its customer."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), n.alias("pos"), F.concat(_dealt(LINKS, n), F.when(n % 5 == 0, "#part").otherwise("")).alias("href"), _dealt(TEXTS, n).alias("text"))


LINKS_SQL = f"""links AS (SELECT o_custkey AS page, o_orderkey AS pos, {_sql(LINKS)}[o_orderkey % {len(LINKS)} + 1] AS href, {_sql(TEXTS)}[o_orderkey % {len(TEXTS)} + 1] AS text FROM orders),
  split AS (SELECT *, regexp_extract(href, '^([a-z]+)://([^/?#]*)([^#]*)$', ['scheme', 'host', 'rest']) AS u FROM links)"""
ATS_SQL = "regexp_matches(u.host, '(greenhouse\\.io|lever\\.co|icims\\.com)')"


@query(rf"""WITH {LINKS_SQL}, firsts AS (SELECT page, href, u, arg_min(text, pos) AS text, min(pos) AS pos FROM split GROUP BY page, href, u),
  scored AS (SELECT page, href, pos, CASE WHEN u.scheme NOT IN ('http', 'https') OR contains(u.host, 'linkedin.com') THEN -100 ELSE
    CASE WHEN {ATS_SQL} THEN 70 ELSE 0 END + CASE WHEN ends_with(u.host, '.jobs') THEN 45 ELSE 0 END
    + CASE WHEN regexp_matches(text, '(?i)\b(jobs?|careers?|opportunities|open (positions|roles)|join (our )?team|search roles?)\b') THEN 35 ELSE 0 END
    + CASE WHEN regexp_matches(u.rest, '(?i)/(jobs?|careers?|opportunities|positions?|openings?|search-results|search/results|job-search|open-positions|join-us)(/|$|[?#-])') THEN 25 ELSE 0 END
    + CASE WHEN regexp_matches(u.host, '^(jobs?|careers?)\.') THEN 25 ELSE 0 END
    + CASE WHEN regexp_matches(text, '(?i)\b(search|view|explore|see)\s+(all\s+)?(open\s+)?(jobs?|roles?|opportunities)\b') OR regexp_matches(u.rest, '(?i)/(search-jobs|job-search-results|viewalljobs|search)/?([?#]|$)') THEN 30 ELSE 0 END
    - CASE WHEN regexp_matches(text, '(?i)\bnursing\s+(jobs?|careers?)\b') OR contains(u.rest, '/nursing-jobs') THEN 25 ELSE 0 END
    - CASE WHEN regexp_matches(u.rest, '(?i)(talent-?community|/login)') THEN 65 ELSE 0 END
    - CASE WHEN regexp_matches(u.rest, '(?i)(/(job|jobs)/[^/?#]+(/[^/?#]+)?([?#]|$)|[?&](pid|jobid|jobseqno|gh_jid)=)') THEN 90 ELSE 0 END
    - CASE WHEN href = 'https://careers.acme.com/' THEN 10 ELSE 0 END END AS score FROM firsts)
  SELECT page, href, score, row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) AS place FROM scored WHERE score >= 35""")
def ranked_career_links(spark, sf_dir):
    score = urls.link_score(F.col("href"), F.col("text"), F.lit("https://careers.acme.com/"))
    return lifecycle.ranked_links(_links(spark, sf_dir), score).select("page", "href", "score", F.col("place").cast("long").alias("place"))


@query(rf"""WITH {LINKS_SQL} SELECT href, count(*) AS links FROM split WHERE u.scheme = 'https' AND {ATS_SQL} AND NOT regexp_matches(u.rest, '(?i)/login|talent-?community')
  AND NOT regexp_matches(u.rest, '(?i)(/(job|jobs)/[^/?#]+(/[^/?#]+)?([?#]|$)|[?&](pid|jobid|jobseqno|gh_jid)=)') GROUP BY 1""")
def public_catalogs(spark, sf_dir):
    return _links(spark, sf_dir).withColumn("href", F.regexp_replace("href", "#.*$", "")).filter(urls.is_public_catalog(F.col("href"))).groupBy("href").agg(F.count(F.lit(1)).alias("links"))


SHAPES = ("https://a.com/jobs/%d", "https://a.com/view?JobId=%d&x=1", "https://jobs.jobvite.com/acme/job/o%d", "https://a.myworkdayjobs.com/x/Engineer_JR-%d", "https://a.com/about/%d", "https://a.com/x?pid=&reqid=r%d", "https://a.com/jobdetail/us/z%d/")


@query(f"""WITH u AS (SELECT o_orderkey AS id, replace({_sql(SHAPES)}[o_orderkey % {len(SHAPES)} + 1], '%d', (1000 + o_orderkey)::VARCHAR) AS url FROM orders)
  SELECT id, coalesce(nullif(regexp_extract(url, '(?i)[?&]jobid=([^&]*)', 1), ''), nullif(regexp_extract(url, '(?i)[?&]reqid=([^&]*)', 1), ''), nullif(regexp_extract(url, 'jobdetail/[^/]+/([^/?#]+)/?$', 1), ''),
    CASE WHEN contains(url, 'jobs.jobvite.com') THEN regexp_extract(url, '/job/([^/?#]+)$', 1) WHEN contains(url, 'myworkdayjobs.com') THEN regexp_extract(url, '_([A-Z]+-?[0-9]+)$', 1) END, nullif(regexp_extract(url, '/jobs/([0-9]+)$', 1), '')) AS external_id FROM u""")
def external_ids(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("id"), urls.external_id(F.replace(_dealt(SHAPES, n), F.lit("%d"), (n + 1000).cast("string"))).alias("external_id"))


# -- merges ------------------------------------------------------------------------------------------------------------------------

PAGE_TITLES = ("Data Engineer", "Saved  Jobs 0", "events 12", "Sitemap", "Home Office Clerk", "Skip to main content.", "Software Intern")
PAGE_ENDS = ("", "/a.pdf", "?f=b.docx#x", "/hcmUI/CandidateExperience/sitemaps/1", "", "/sites/x/events/", "")


def _state(spark, sf_dir):
    """The stored postings: one per order, some of them no postings at all."""
    n = F.col("o_orderkey")
    url = F.concat(F.when(n % 2 == 0, "http").otherwise("https"), F.lit("://jobs.example/"), (n / 2).cast("long"), _dealt(PAGE_ENDS, n % 13))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), n.alias("id"), url.alias("official_url"), _dealt(PAGE_TITLES, n).alias("title"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_seen_at"))


STATE_SQL = f"""state AS (SELECT o_custkey AS source_id, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'https' END || '://jobs.example/' || o_orderkey // 2 || {_sql(PAGE_ENDS)}[o_orderkey % 13 % {len(PAGE_ENDS)} + 1] AS official_url,
  {_sql(PAGE_TITLES)}[o_orderkey % {len(PAGE_TITLES)} + 1] AS title, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS last_seen_at FROM orders),
 art AS (SELECT *, regexp_matches(trim(regexp_replace(title, '\\s+', ' ', 'g')), '(?i)^(home|sites|saved jobs(\\s*0)?|events?(\\s*[0-9]+)?|sitemap|skip to main content\\.?)$') OR regexp_matches(official_url, '(?i)\\.(pdf|docx?)([?#]|$)|/hcmUI/CandidateExperience/sitemaps(/|$)|/sites/[^/]+/events(/|$)') AS artifact FROM state)"""
SEEN = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'N')"


@query(f"WITH {STATE_SQL} SELECT id, status = 'open' AND NOT {SEEN} AND c.c_acctbal > 0 AND (c.c_mktsegment = 'BUILDING' OR artifact) AS gone FROM art JOIN customer c ON c_custkey = source_id")
def closed_postings(spark, sf_dir):
    state = _state(spark, sf_dir)
    again = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id")).distinct()
    seen = state.join(again, "id", "left_semi")
    complete = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"), (F.col("c_mktsegment") == "BUILDING").alias("complete"))
    return lifecycle.close_unseen(state, seen, complete).select("id", "gone")


@query(f"WITH {STATE_SQL} SELECT id, status = 'open' AND c_acctbal > 0 AND last_seen_at < CASE WHEN c_custkey % 2 = 0 THEN '1996-01-01' ELSE '1998-01-01' END AS gone FROM state JOIN customer ON c_custkey = source_id")
def closed_after_two_cycles(spark, sf_dir):
    cycles = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 2 == 0, "1996-01-01").otherwise("1998-01-01").alias("previous_start"))
    return lifecycle.two_cycle_close(_state(spark, sf_dir), cycles).select("id", "gone")


@query(f"""WITH {STATE_SQL}, t AS (SELECT id, source_id % 3 AS s, official_url, status FROM state)
  SELECT id, starts_with(official_url, 'http://') AND EXISTS (SELECT 1 FROM t b WHERE b.s = t.s AND b.status = 'open' AND b.official_url = replace(t.official_url, 'http://', 'https://')) AS gone FROM t""")
def closed_twins(spark, sf_dir):
    return lifecycle.close_twins(_state(spark, sf_dir).withColumn("source_id", F.col("source_id") % 3)).select("id", "gone")


MIRRORS_SQL = """i AS (SELECT l_suppkey % 50 AS source_id, l_orderkey * 10 + l_linenumber AS ordinal, lower(replace(p_name, '-', ' ')) || ' ' || lower(l_returnflag) AS t, ['#' || l_suppkey % 40, CASE WHEN l_partkey % 3 = 0 THEN 'r' || l_partkey % 7 END] AS ids,
  l_linestatus = 'O' AS own, 'https://x.example/' || l_partkey % 11 || l_linestatus AS url FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"""WITH {MIRRORS_SQL}, e AS (SELECT * FROM (SELECT source_id, ordinal, url, own, t, unnest(ids) AS id FROM i) WHERE id IS NOT NULL), c AS (SELECT source_id, t, id, arg_min(url, ordinal) AS first FROM e WHERE own GROUP BY 1, 2, 3),
  met AS (SELECT source_id, ordinal, bool_or(first = url) AS mine FROM e JOIN c USING (source_id, t, id) GROUP BY 1, 2) SELECT source_id, ordinal, url AS official_url FROM i WHERE (source_id, ordinal) NOT IN (SELECT (source_id, ordinal) FROM met WHERE NOT mine)""")
def incoming_without_mirrors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    title = F.concat(F.when(F.col("l_linestatus") == "O", F.upper("p_name")).otherwise(F.initcap("p_name")), F.lit(" - "), "l_returnflag")
    rows = rows.select(
        (F.col("l_suppkey") % 50).alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), title.alias("title"), F.concat(F.lit(" #"), F.col("l_suppkey") % 40).alias("external_id"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("R"), F.col("l_partkey") % 7)).alias("requisition_id"), F.concat(F.lit("https://x.example/"), F.col("l_partkey") % 11, "l_linestatus").alias("official_url"), (F.col("l_linestatus") == "O").alias("first_party"))
    return lifecycle.without_mirrors(rows).select("source_id", "ordinal", "official_url")


@query(f"""WITH {RICH_SQL}, touched AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O'),
  fresh AS (SELECT o_orderkey AS job_id, CASE WHEN o_totalprice > 150000 THEN 'program:coop' ELSE 'area:new' END AS topic_key FROM orders),
  ns AS (SELECT *, topic_key LIKE 'program:%' OR topic_key LIKE 'area:%' AS inside FROM topics)
  SELECT job_id, topic_key FROM ns WHERE NOT inside OR job_id NOT IN (SELECT job_id FROM touched) UNION SELECT job_id, topic_key FROM fresh WHERE job_id IN (SELECT job_id FROM touched)""")
def replaced_topics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fresh = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_totalprice") > 150000, "program:coop").otherwise("area:new").alias("topic_key"))
    return lifecycle.replace_topics(topics(spark, sf_dir), fresh, o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id")), ("program:", "area:"))


OLD_SQL = "old AS (SELECT o_orderkey AS id, o_custkey AS a, CASE WHEN o_totalprice > 50000 THEN o_orderpriority END AS b FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN o_custkey + 1 ELSE o_custkey END AS a, CASE WHEN o_totalprice > 80000 THEN o_orderpriority END AS b FROM orders)"


def _old_and_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n, price = F.col("o_orderkey").alias("id"), F.col("o_totalprice")
    old = o.filter("o_orderstatus <> 'P'").select(n, F.col("o_custkey").alias("a"), F.when(price > 50000, F.col("o_orderpriority")).alias("b"))
    return old, o.select(n, F.when(price > 200000, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("a"), F.when(price > 80000, F.col("o_orderpriority")).alias("b"))


@query(f"WITH {OLD_SQL} SELECT n.id, CASE WHEN o.id IS NULL THEN 'created' WHEN o.a IS NOT DISTINCT FROM n.a AND o.b IS NOT DISTINCT FROM n.b THEN 'unchanged' ELSE 'updated' END AS change FROM new n LEFT JOIN old o ON o.id = n.id")
def changes_by_hash(spark, sf_dir):
    return lifecycle.changes(*_old_and_new(spark, sf_dir), ["id"], ["a", "b"])


@query(f"WITH {OLD_SQL} SELECT id, a, b FROM new EXCEPT SELECT id, a, b FROM old")
def seed_delta(spark, sf_dir):
    return lifecycle.delta(*_old_and_new(spark, sf_dir))


@query(f"""WITH {OLD_SQL} SELECT n.id AS source_id, NOT (o.id IS NOT NULL AND n.a IS NOT DISTINCT FROM o.a AND n.b IS NOT DISTINCT FROM o.b) AS reset,
  CASE WHEN o.id IS NOT NULL AND n.a IS NOT DISTINCT FROM o.a AND n.b IS NOT DISTINCT FROM o.b THEN o.id * 2 END AS cursor FROM new n LEFT JOIN old o ON o.id = n.id""")
def refreshed_catalog(spark, sf_dir):
    old, new = (df.select(F.col("id").alias("source_id"), F.col("a").alias("url"), F.col("b").alias("adapter")) for df in _old_and_new(spark, sf_dir))
    stored = old.withColumns({"cursor": F.col("source_id") * 2, "next_run_at": F.lit("2026-01-01")})
    return lifecycle.refresh_catalog(stored, new).select("source_id", "reset", "cursor")


@query("""WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'junk' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS published,
    CASE WHEN o_custkey % 3 > 0 THEN '1996-01-01T00:00:00.000Z' END AS baseline, CASE WHEN o_custkey % 2 = 0 THEN '1997-06-01 12:00:00' END AS previous FROM orders)
  SELECT id, coalesce(try_cast(replace(substr(published, 1, 19), 'T', ' ') AS TIMESTAMP) >= greatest(try_cast(replace(substr(baseline, 1, 19), 'T', ' ') AS TIMESTAMP), previous::TIMESTAMP) - INTERVAL 36 HOURS, true) AS fresh FROM p""")
def published_after_baseline(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    published = F.when(n % 5 == 1, "junk").when(n % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n % 5 == 3, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(n % 5 == 4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
    fresh = lifecycle.after_baseline(published, F.when(c % 3 > 0, "1996-01-01T00:00:00.000Z"), F.when(c % 2 == 0, "1997-06-01 12:00:00"))
    return table(spark, sf_dir, "orders").select(n.alias("id"), fresh.alias("fresh"))


@query("""SELECT l_suppkey AS source_id, coalesce(e, u) AS posting, count(*) AS seen, max(o) AS ordinal FROM (SELECT l_suppkey, CASE WHEN l_partkey % 3 > 0 THEN 'e' || l_partkey % 200 END AS e, 'u' || l_partkey AS u, l_orderkey * 10 + l_linenumber AS o FROM lineitem) GROUP BY 1, 2""")
def drained_listing(spark, sf_dir):
    o = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("e"), F.col("l_partkey") % 200)).alias("external_id"), F.concat(F.lit("u"), "l_partkey").alias("official_url"), o)
    return lifecycle.drained(rows.withColumn("title", F.col("ordinal"))).select("source_id", "posting", "seen", F.col("title").alias("ordinal"))


@query("""WITH d AS (SELECT o_custkey AS s, 'team' AS key, o_orderpriority AS value, count(*) AS jobs FROM orders GROUP BY 1, 3), n AS (SELECT c_custkey AS s, 'team' AS key, '1-URGENT' AS value, 999 AS jobs FROM customer WHERE c_acctbal > 0)
  SELECT coalesce(n.s, d.s) AS source_id, coalesce(n.value, d.value) AS value, coalesce(n.jobs, d.jobs) AS jobs, n.s IS NOT NULL AS native FROM d FULL JOIN n ON n.s = d.s AND n.value = d.value""")
def source_facets(spark, sf_dir):
    derived = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id"), F.lit("team").alias("key"), F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("jobs"))
    native = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"), F.lit("team").alias("key"), F.lit("1-URGENT").alias("value"), F.lit(999).cast("long").alias("jobs"))
    return lifecycle.merged_facets(native, derived).select("source_id", "value", "jobs", "native")


# -- runs and sources --------------------------------------------------------------------------------------------------------------


def _sources(spark, sf_dir):
    """One row per customer: a source with its schedule, from its latest order."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.max("o_orderdate").alias("next_run_at"), F.count(F.lit(1)).alias("jobs"), F.min("o_orderdate").alias("checked_at"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("company"), (F.col("c_acctbal") > 0).alias("enabled"), _dealt(("healthy", "failed", "blocked", "inactive", "changed"), F.col("c_custkey")).alias("health"), F.when(F.col("c_custkey") % 9 == 0, F.lit("1998-06-01").cast("timestamp")).alias("lease_until"))
    return c.join(last, "source_id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))


SOURCES_SQL = """sources AS (SELECT c_custkey AS source_id, c_name AS company, c_acctbal > 0 AS enabled, ['healthy', 'failed', 'blocked', 'inactive', 'changed'][c_custkey % 5 + 1] AS health, CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '1998-06-01' END AS lease_until,
  (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS next_run_at, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS checked_at, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS jobs FROM customer)"""


@query(f"""WITH {SOURCES_SQL}, leased AS (SELECT * REPLACE (CASE WHEN source_id % 18 = 9 THEN TIMESTAMP '2001-06-01' ELSE lease_until END AS lease_until) FROM sources)
  SELECT source_id, company FROM leased WHERE enabled AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '2001-03-01') AND (lease_until IS NULL OR lease_until <= TIMESTAMP '2001-03-01')
  ORDER BY next_run_at NULLS FIRST, company, source_id LIMIT 30""")
def leased_sources(spark, sf_dir):
    """A batch while every second leased source is still held, and the leases of the others are past."""
    held = F.when(F.col("source_id") % 18 == 9, F.lit("2001-06-01").cast("timestamp")).otherwise(F.col("lease_until"))
    return lifecycle.lease_due(_sources(spark, sf_dir).withColumn("lease_until", held), "2001-03-01", 30).select("source_id", "company")


RECOVERY_SQL = """(SELECT *, ['workday', 'custom', 'lever'][source_id % 3 + 1] AS adapter, CASE WHEN source_id % 7 = 0 THEN 'empty_board' END AS last_error, CASE WHEN health = 'healthy' AND source_id % 2 = 0 THEN 0 ELSE jobs END AS n FROM sources)"""


@query(f"""WITH {SOURCES_SQL}, r AS (SELECT *, adapter = 'workday' OR health = 'blocked' OR coalesce(last_error = 'empty_board', false) OR n > 0 AS native, CASE WHEN n = 0 THEN 0 ELSE 10 END + CASE health WHEN 'healthy' THEN 0 WHEN 'inactive' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END AS rank FROM {RECOVERY_SQL}
    WHERE (health IN ('failed', 'blocked', 'inactive') OR (health = 'healthy' AND n = 0)) AND coalesce(next_run_at IS NULL OR next_run_at <= TIMESTAMP '2001-03-01' OR checked_at BETWEEN TIMESTAMP '2001-02-28 23:15:00' AND TIMESTAMP '2001-03-01 00:05:00', false))
  SELECT source_id, rank::INT AS rank, native, (row_number() OVER (ORDER BY source_id % 97 <> 0, native DESC, rank, checked_at NULLS FIRST, company, source_id))::INT AS place FROM r QUALIFY place <= 500""")
def recovery_queue(spark, sf_dir):
    s = _sources(spark, sf_dir)
    n = F.col("source_id")
    s = s.withColumns({"adapter": _dealt(("workday", "custom", "lever"), n), "last_error": F.when(n % 7 == 0, "empty_board"), "jobs": F.when((F.col("health") == "healthy") & (n % 2 == 0), 0).otherwise(F.col("jobs"))})
    return lifecycle.recovery_queue(s, "2001-03-01", s.filter("source_id % 97 = 0")).select("source_id", "rank", "native", "place")


def _regional(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), _dealt(("us", "non_us", "mixed", "unknown", None), F.col("o_orderkey")).alias("location_region"), F.when(F.col("o_orderkey") % 9 == 1, "1990").alias("closed_at"))


@query("""WITH j AS (SELECT o_orderkey AS id, o_custkey AS source_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, ['us', 'non_us', 'mixed', 'unknown', NULL][o_orderkey % 5 + 1] AS region, CASE WHEN o_orderkey % 9 = 1 THEN '1990' END AS closed_at FROM orders),
  p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT *, coalesce(status = 'open' AND region = 'non_us', false) AND source_id IN (FROM p) AS gone FROM j)
  SELECT 'job' AS kind, id, CASE WHEN gone THEN 'closed' ELSE status END AS state, CASE WHEN gone THEN coalesce(closed_at, '2026') ELSE closed_at END AS at FROM o
  UNION ALL SELECT 'source', c_custkey, NULL, CASE WHEN c_mktsegment = 'BUILDING' THEN '2026' ELSE '2030' END FROM customer UNION ALL SELECT 'checkpoint', c_custkey, NULL, NULL FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'""")
def policy_change(spark, sf_dir):
    """All that a new version of the crawl policy changes: due sources, dropped checkpoints, closed postings."""
    c = table(spark, sf_dir, "customer").withColumn("source_id", F.col("c_custkey"))
    sources, checkpoints, policy = c.select("source_id", F.lit("2030").alias("next_run_at")), c.filter("c_acctbal > 0").select("source_id"), c.filter("c_mktsegment = 'BUILDING'")
    due, left, jobs, _ = lifecycle.policy_changed(sources, checkpoints, _regional(spark, sf_dir), policy, "1", "2", "2026")
    none = F.lit(None).cast("string")
    of = lambda df, kind, key, state, at: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), state.alias("state"), at.alias("at"))
    return of(jobs, "job", "id", F.col("status"), F.col("closed_at")).unionByName(of(due, "source", "source_id", none, F.col("next_run_at"))).unionByName(of(left, "checkpoint", "source_id", none, none))


@query("""WITH j AS (SELECT o_orderkey AS id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS quiet FROM orders), w AS (SELECT id FROM j WHERE quiet AND id % 4 > 0),
  m AS (SELECT DISTINCT l_suppkey AS message, l_suppkey % 3 = 0 AS sent FROM lineitem), i AS (SELECT DISTINCT l_suppkey AS message, l_orderkey AS match FROM lineitem), k AS (SELECT message, match FROM i JOIN m USING (message) WHERE sent OR match NOT IN (FROM w))
  SELECT 'job' AS kind, id, (id % 5 > 0 AND NOT quiet)::INT AS n FROM j UNION ALL SELECT 'match', id, (id % 2 = 0 AND id NOT IN (FROM w))::INT FROM j
  UNION ALL SELECT 'message', message, 1 FROM m WHERE sent OR message IN (SELECT message FROM k) UNION ALL SELECT 'items', message, count(*)::INT FROM k GROUP BY 2""")
def quiet_effects(spark, sf_dir):
    """All that a walk without announcements changes: postings known, matches not eligible, items and messages gone."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = F.col("o_orderkey")
    jobs = o.select(n.alias("id"), F.col("o_custkey").alias("source_id"), (n % 5 > 0).alias("after_baseline"))
    matches = o.select(n.alias("match_id"), n.alias("job_id"), (n % 2 == 0).alias("eligible"), F.when(n % 4 == 0, "1990").alias("notified_at"))
    items = line.select(F.col("l_suppkey").alias("message_id"), F.col("l_orderkey").alias("match_id")).distinct()
    messages = items.select("message_id").distinct().withColumn("status", F.when(F.col("message_id") % 3 == 0, "sent").otherwise("queued"))
    quiet = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source_id"))
    jobs, matches, messages, items = lifecycle.quiet_walk(jobs, matches, messages, items, quiet)
    of = lambda df, kind, key, v: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), v.cast("int").alias("n"))
    counted = items.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
    return of(jobs, "job", "id", F.col("after_baseline")).unionByName(of(matches, "match", "match_id", F.col("eligible"))).unionByName(of(messages, "message", "message_id", F.lit(1))).unionByName(of(counted, "items", "message_id", F.col("n")))


@query(f"""WITH {RUNS_SQL} SELECT event_id, CASE WHEN status = 'running' AND (finished_at, event_id) < (SELECT (max(finished_at), max(event_id)) FROM runs q WHERE q.source_id = r.source_id AND q.finished_at = (SELECT max(finished_at) FROM runs x WHERE x.source_id = r.source_id))
  THEN 'superseded' ELSE status END AS status FROM runs r""")
def superseded_runs(spark, sf_dir):
    return lifecycle.supersede(runs(spark, sf_dir)).select("event_id", "status")


@query(f"""WITH {RUNS_SQL}, w AS (SELECT * FROM runs ORDER BY finished_at DESC, event_id DESC LIMIT 100)
  SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'running' AND finished_at < (SELECT max(finished_at) FROM runs) - INTERVAL 120 SECONDS) AS stale FROM w""")
def running_and_stale(spark, sf_dir):
    r = runs(spark, sf_dir)
    last = r.agg(F.date_format(F.max("finished_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]  # one row: the clock of this table
    return lifecycle.running_and_stale(r, last)


@query(f"""WITH {RUNS_SQL} SELECT source_id, strftime(max(finished_at) FILTER (WHERE status = 'succeeded'), '%Y-%m-%d %H:%M:%S') AS last_success, strftime(max(finished_at) FILTER (WHERE status = 'succeeded' AND jobs_seen > 50), '%Y-%m-%d %H:%M:%S') AS last_change FROM runs GROUP BY 1""")
def last_successes(spark, sf_dir):
    done, text = F.col("status") == "succeeded", lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return runs(spark, sf_dir).groupBy("source_id").agg(text(F.max(F.when(done, F.col("finished_at")))).alias("last_success"), text(F.max(F.when(done & (F.col("jobs_seen") > 50), F.col("finished_at")))).alias("last_change"))


ERRORS = (None, "captcha shown", "page exceeded 60 seconds", "boom", "Rejected unsafe browser listing candidate: x", "")
CODES = (200, 403, 500, 404, None, 522)


@query(f"""WITH r AS (SELECT event_id, event_id % 11 = 0 AS empty, {_sql(ERRORS)}[event_id % 6 + 1] AS error, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS jobs, CASE WHEN event_id % 3 > 0 THEN 'u' END AS final_url, [200, 403, 500, 404, NULL, 522][event_id // 6 % 6 + 1] AS code FROM events)
  SELECT event_id, CASE WHEN empty THEN 'succeeded:empty_board' WHEN starts_with(error, 'Rejected') THEN 'failed:unsafe_listing' WHEN jobs > 0 AND final_url IS NOT NULL THEN 'succeeded:jobs_recovered'
    WHEN code IN (401, 403, 429, 520, 521, 522, 523, 524) OR contains(error, 'captcha') THEN 'blocked:blocked_challenge' WHEN code >= 400 THEN 'failed:http_error' WHEN contains(error, 'exceeded 60 seconds') THEN 'failed:navigation_timeout'
    WHEN error <> '' THEN 'failed:navigation_error' ELSE 'failed:empty_board' END AS result FROM r""")
def second_try_results(spark, sf_dir):
    n = F.col("event_id")
    code = F.get(F.array(*[F.lit(c).cast("int") for c in CODES]), (F.floor(n / 6) % 6).cast("int"))
    r = lifecycle.result_class(n % 11 == 0, _dealt(ERRORS, n), F.when(n % 4 == 0, 3).otherwise(0), F.when(n % 3 > 0, "u"), code)
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", F.concat_ws(":", "r.status", "r.code").alias("result"))


@query("""WITH b AS (SELECT c_custkey AS s, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'succeeded' END AS before, '1997-01-0' || (c_custkey % 7 + 1) AS due FROM customer WHERE c_acctbal > 0),
  r AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN 'succeeded' ELSE 'blocked' END AS status, '1997-01-04' AS next FROM customer)
  SELECT r.s AS source_id, status, status = 'succeeded' OR before IS NULL AS recorded, CASE WHEN status = 'succeeded' THEN next ELSE greatest(due, next) END AS next_run_at FROM r LEFT JOIN b ON b.s = r.s""")
def admitted_results(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), F.col("c_custkey").alias("source_id")
    latest = c.filter("c_acctbal > 0").select(s, F.when(F.col("c_custkey") % 3 == 1, "failed").when(F.col("c_custkey") % 3 == 2, "succeeded").alias("status"), F.concat(F.lit("1997-01-0"), F.col("c_custkey") % 7 + 1).alias("next_run_at"))
    results = c.select(s, F.when(F.col("c_custkey") % 2 == 0, "succeeded").otherwise("blocked").alias("status"), F.lit("1997-01-04").alias("next_run_at"))
    return lifecycle.admit_results(latest, results)


# -- reviews and messages ------------------------------------------------------------------------------------------------------------


def _keys(n: Column) -> Column:
    return F.array(F.concat(F.lit("req:"), F.col("o_custkey") % 700), F.concat(F.lit("url:"), n % 9001))


KEYS_SQL = "['req:' || o_custkey % 700, 'url:' || o_orderkey % 9001]"


@query(f"""WITH c AS (SELECT o_orderkey AS id, CASE WHEN year(o_orderdate) >= 1996 THEN 0 ELSE 2 END + CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS bucket, o_orderkey % 101 AS score, strftime(o_orderdate, '%Y-%m-%d') AS seen_at, {KEYS_SQL} AS keys FROM orders),
  k AS (SELECT id, bucket, score, seen_at, unnest(keys) AS key FROM c), late AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY bucket, score DESC, seen_at DESC, id) AS n FROM k) WHERE n > 1),
  closed AS (SELECT 'req:' || c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT id, bucket::INT AS bucket, score::INT AS score FROM c WHERE id NOT IN (SELECT id FROM late) AND id NOT IN (SELECT id FROM k WHERE key IN (SELECT key FROM closed)) ORDER BY bucket, score DESC, seen_at DESC, id LIMIT 100""")
def review_queue(spark, sf_dir):
    n = F.col("o_orderkey")
    bucket = F.when(F.year("o_orderdate") >= 1996, 0).otherwise(2) + F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    c = table(spark, sf_dir, "orders").select(n.alias("id"), bucket.alias("bucket"), (n % 101).cast("int").alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen_at"), _keys(n).alias("keys"))
    closed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("req:"), "c_custkey").alias("key"))
    return review.review_feed(c, closed).select("id", "bucket", "score")


def _matches(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("match_id"), (F.col("o_custkey") % 25).alias("profile"), F.struct((-(n % 101)).alias("a"), n.alias("b")).alias("rank"), _keys(n).alias("keys"))


def _recipients(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_suppkey <= 60").select(F.col("s_nationkey").cast("long").alias("profile"), F.col("s_suppkey").alias("recipient"), (F.col("s_acctbal") > 0).alias("enabled"))


@query(f"""SELECT l_suppkey AS recipient, unnest({KEYS_SQL}) AS key, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey""".join(["WITH e AS (", ") SELECT recipient, key, strftime(min(l_shipdate), '%Y-%m-%d') AS first_sent FROM e GROUP BY 1, 2"]))
def sent_history(spark, sf_dir):
    sent = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("recipient"), F.col("l_shipdate").alias("sent_at"))
    return review.history_of(sent, _matches(spark, sf_dir)).select("recipient", "key", F.date_format("first_sent_at", "yyyy-MM-dd").alias("first_sent"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey % 25 AS profile, o_orderkey % 7 > 0 AS act FROM orders) SELECT profile, count(*) AS active, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R')) AS queued,
  (SELECT count(*) FROM supplier WHERE s_suppkey <= 60 AND s_acctbal > 0 AND s_nationkey = profile) AS recipients FROM m WHERE act GROUP BY profile""")
def alert_summary(spark, sf_dir):
    n = F.col("o_orderkey")
    matches = table(spark, sf_dir, "orders").select(n.alias("match_id"), (F.col("o_custkey") % 25).alias("profile"), (n % 7 > 0).alias("is_active"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_returnflag") == "R", "queued").otherwise("sent").alias("status"))
    return review.status_summary(matches, items, _recipients(spark, sf_dir))
