"""Queries over state that is kept up: versions, facets, cycles, drains, published tables, page directories and the text index, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import fixed, signals
from postlake.functions.text import MARKED, PLAIN
from postlake.operators import drain
from postlake.operators.merge import merge
from postlake.operators.pages import PageDirectory
from postlake.operators.text_index import TextIndex
from postlake.plans.catalog import query
from postlake.sources.proxy import POSTINGS_SQL, postings, table
from postlake.sources.publish import publish, published
from postlake.sources.shared import kept, new_folder
from postlake.streaming import cycles
from postlake.streaming.facet_counts import FacetCounts
from postlake.streaming.snapshots import merge_batch
from postlake.streaming.versions import VersionedTable


def _merged_sql(name: str, state: str, incoming: str, now: str, more: tuple[str, ...] = ()) -> str:
    """CTEs for one complete merge of incoming into state; of the columns more, never null in incoming, the last counts."""
    last, kept = "".join(f"arg_max({c}, id) AS {c}, " for c in more), "".join(f"coalesce(r.{c}, s.{c}) AS {c}, " for c in more)
    return f"""{name}_r AS (SELECT source_id, official_url, {last}arg_max(title, id) AS title, (arg_max(published_at, id) FILTER (WHERE published_at IS NOT NULL)) AS published_at FROM {incoming} GROUP BY 1, 2),
  {name} AS (SELECT {kept}coalesce(s.source_id, r.source_id) AS source_id, coalesce(s.official_url, r.official_url) AS official_url, CASE WHEN r.source_id IS NOT NULL THEN r.title ELSE s.title END AS title, coalesce(r.published_at, s.published_at) AS published_at,
    coalesce(s.first_seen_at, '{now}') AS first_seen_at, CASE WHEN r.source_id IS NOT NULL THEN '{now}' ELSE s.last_seen_at END AS last_seen_at,
    CASE WHEN r.source_id IS NOT NULL THEN 'open' WHEN s.status = 'open' AND s.source_id IN (SELECT source_id FROM {incoming}) THEN 'closed' ELSE s.status END AS status,
    coalesce(s.generation, 1) + CASE WHEN s.source_id IS NOT NULL AND r.source_id IS NOT NULL AND s.status <> 'open' THEN 1 ELSE 0 END AS generation
    FROM {state} s FULL JOIN {name}_r r ON s.source_id = r.source_id AND s.official_url = r.official_url)"""


@query(f"""WITH {POSTINGS_SQL}, s0 AS (SELECT source_id, official_url, min(title) AS title, max(published_at) AS published_at, max(status) AS status, min(first_seen_at) AS first_seen_at, min(first_seen_at) AS last_seen_at, 1 AS generation FROM postings GROUP BY 1, 2),
  i0 AS (SELECT * FROM postings WHERE employment_type <> '5-LOW'), i1 AS (SELECT * FROM postings WHERE employment_type <> '1-URGENT' AND source_id % 3 <> 1), {_merged_sql('s1', 's0', 'i0', '2026-01-01')}, {_merged_sql('s2', 's1', 'i1', '2026-02-01')}
  SELECT source_id, official_url, title, published_at, first_seen_at, last_seen_at, status, generation::BIGINT AS generation FROM s2""")
def merged_versions(spark, sf_dir):
    """Two snapshots merged into a table of versions, the first of them delivered once more after the second: the last version."""
    p = postings(spark, sf_dir).withColumn("ordinal", F.col("id"))
    state = p.groupBy("source_id", "official_url").agg(F.min("title").alias("title"), F.max("published_at").alias("published_at"), F.max("status").alias("status"), F.min("first_seen_at").alias("first_seen_at"))
    held = VersionedTable(spark, new_folder(spark, "versions"), "source_id", 16)
    held.commit(state.withColumns({"last_seen_at": F.col("first_seen_at"), "generation": F.lit(1).cast("long")}), None)
    first, second = p.filter("employment_type <> '5-LOW'"), p.filter("employment_type <> '1-URGENT' AND source_id % 3 <> 1")
    for number, batch, now in ((0, first, "2026-01-01"), (1, second, "2026-02-01"), (0, first, "2026-03-01")):
        merge_batch(held, batch, number, now)
    return held.read()


MORE = ("company", "employment_type", "location_country")
FACETS_SQL = f"""{POSTINGS_SQL}, p AS (SELECT *, country AS location_country FROM postings), s0 AS (SELECT source_id, official_url, min(company) AS company, min(employment_type) AS employment_type, min(country) AS location_country, min(title) AS title, max(published_at) AS published_at,
  max(status) AS status, min(first_seen_at) AS first_seen_at, min(first_seen_at) AS last_seen_at, 1 AS generation FROM p GROUP BY 1, 2),
  i0 AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'Contract' ELSE employment_type END AS employment_type) FROM p WHERE employment_type <> '5-LOW'), i1 AS (SELECT * FROM p WHERE employment_type <> '1-URGENT' AND source_id % 3 <> 1),
  {_merged_sql('s1', 's0', 'i0', '2026-01-01', MORE)}, {_merged_sql('s2', 's1', 'i1', '2026-02-01', MORE)},
  c AS (SELECT * FROM s2 WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY official_url ORDER BY first_seen_at DESC, company, source_id) = 1)"""


@query(f"WITH {FACETS_SQL} {' UNION ALL '.join(f"SELECT '{k}' AS key, lower({k}) AS value, count(*) AS jobs FROM c GROUP BY 2" for k in MORE)}")
def facet_counts(spark, sf_dir):
    """Facets after two merges, each followed by deltas of what it touched, one of them delivered twice."""
    p = postings(spark, sf_dir).withColumn("ordinal", F.col("id")).withColumnRenamed("country", "location_country")
    p = kept(p.select("id", "ordinal", "source_id", "official_url", *MORE, "title", "published_at", "status", "first_seen_at"))  # the state and every batch read it
    state = p.groupBy("source_id", "official_url").agg(*[F.min(c).alias(c) for c in (*MORE, "title")], F.max("published_at").alias("published_at"), F.max("status").alias("status"), F.min("first_seen_at").alias("first_seen_at"))
    folder = new_folder(spark, "facets")
    held = VersionedTable(spark, f"{folder}/postings", "source_id", 16)
    held.commit(state.withColumns({"last_seen_at": F.col("first_seen_at"), "generation": F.lit(1).cast("long")}), None)
    counts = FacetCounts(spark, folder, MORE, buckets=16)
    now = lambda: held.read().withColumn("id", F.col("source_id"))
    counts.build(now())
    first = p.filter("employment_type <> '5-LOW'").withColumn("employment_type", F.when(F.col("id") % 3 == 0, "Contract").otherwise(F.col("employment_type")))
    for number, batch, at in ((0, first, "2026-01-01"), (1, p.filter("employment_type <> '1-URGENT' AND source_id % 3 <> 1"), "2026-02-01"), (1, first, "2026-03-01")):
        touched = kept(merge(held.read(), batch, at).filter("event <> 'unchanged'").select("official_url"))
        merge_batch(held, batch, number, at)
        counts.apply(now(), touched, number)
    return counts.read().select("key", "value", "jobs")


CYCLES_SQL = """WITH RECURSIVE e AS (SELECT user_id AS s, event_id, ts AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 'u' || event_id // 1500 % 2 AS url, ['lever', 'custom'][event_id // 2500 % 2 + 1] AS adapter, event_id // 4000 AS policy,
    event_id % 7 + 2 AS next, event_type = 'purchase' AS complete FROM events),
  run AS (SELECT user_id AS s, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS url, NULL::VARCHAR AS adapter, NULL::BIGINT AS policy, false AS restarted, NULL::BIGINT AS next_page, NULL::TIMESTAMP AS cycle_start, NULL::TIMESTAMP AS previous_start, NULL::TIMESTAMP AS closes_before FROM events GROUP BY 1
    UNION ALL SELECT s, n, event_id, url, adapter, policy, fresh, CASE WHEN complete THEN 1 ELSE next END, CASE WHEN complete THEN moment ELSE began END, CASE WHEN complete THEN began ELSE before END, CASE WHEN complete THEN before END
    FROM (SELECT e.*, r.url IS NULL OR r.url <> e.url OR r.adapter <> e.adapter OR r.policy <> e.policy AS fresh, CASE WHEN fresh THEN e.moment ELSE r.cycle_start END AS began, CASE WHEN NOT fresh THEN r.previous_start END AS before FROM run r JOIN e ON e.s = r.s AND e.n = r.n + 1))"""


def segments(events):
    """What was read of the source of each user: where its next segment starts, under which url, adapter and policy."""
    n = F.col("event_id")
    part = lambda size: F.floor(n / size)
    return events.select(
        F.col("user_id").alias("source_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("u"), part(1500) % 2).alias("listing_url"), F.when(part(2500) % 2 == 0, "lever").otherwise("custom").alias("adapter"),
        part(4000).alias("policy"), (n % 7 + 2).alias("next_page"), (F.col("event_type") == "purchase").alias("complete"))


@query(CYCLES_SQL + """ SELECT s AS source_id, event_id, restarted, next_page, strftime(cycle_start, '%Y-%m-%d %H:%M:%S') AS cycle_start, strftime(previous_start, '%Y-%m-%d %H:%M:%S') AS previous_start, strftime(closes_before, '%Y-%m-%d %H:%M:%S') AS closes_before FROM run WHERE n > 0""")
def crawl_cycles(spark, sf_dir):
    """The stream of crawl segments over all events, run until nothing is left: the state of its source after each."""
    folder = new_folder(spark, "cycles")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    cycles.start(segments(source), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(f"{folder}/changes").select("source_id", "event_id", "restarted", "next_page", text("cycle_start"), text("previous_start"), text("closes_before"))


@query(f"WITH {POSTINGS_SQL} SELECT id, company, title, official_url FROM postings WHERE status = 'open'")
def published_catalog(spark, sf_dir):
    """The open postings as published, after an older catalog under the same path."""
    p, path = postings(spark, sf_dir).select("id", "company", "title", "official_url", "status"), new_folder(spark, "catalog")
    publish(p.select("id", "title"), path)
    publish(p.filter("status = 'open'").drop("status"), path)
    return published(spark, path)


ORDERED = "row_number() OVER (ORDER BY published_at DESC NULLS LAST, first_seen_at DESC, company, id)"


@query(f"WITH {POSTINGS_SQL}, o AS (SELECT id, {ORDERED} AS place, count(*) OVER () AS n FROM postings) SELECT id, place FROM o WHERE (place - 1) // 20 IN (0, 1, n // 40, (n - 1) // 20)")
def deep_pages(spark, sf_dir):
    """The first two pages, one from the middle and the last of all postings."""
    rows = postings(spark, sf_dir, titled=False).select("id", "company", "published_at", "first_seen_at")
    pages = PageDirectory(spark, new_folder(spark, "pages"), 32)
    pages.build(rows, [F.desc_nulls_last("published_at"), F.desc("first_seen_at"), F.asc("company"), F.asc("id")])
    total = sum(n for _, n in pages.manifest()["sizes"])
    numbers = sorted({1, 2, total // 40 + 1, (total - 1) // 20 + 1})
    out = pages.page(numbers[0], 20)
    for number in numbers[1:]:
        out = out.unionByName(pages.page(number, 20))
    return out.select("id", "place")


def _catalog_pages(spark, sf_dir):
    """A crawl of suppliers' catalogs, a line number a page: some passes fail, some catalogs never advance, and some change their size."""
    line = table(spark, sf_dir, "lineitem")
    job = F.struct(F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("p"), F.col("l_partkey") % 50)).alias("external_id"), F.concat_ws("/", F.lit("https://x.example"), "l_partkey").alias("official_url"), F.concat(F.lit("t"), "l_orderkey").alias("title"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", job.alias("job")))), lambda x: x["job"])
    # put together once, not once a pass
    listed = kept(line.groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").cast("long").alias("cursor")).agg(ordered.alias("jobs")))

    def crawl(open_, number):
        n, total = F.col("source_id"), F.col("source_id") % 6 + 1 + F.when((F.col("source_id") % 11 == 5) & F.lit(number >= 2), 1).otherwise(0)
        # the narrow side first: of all pages only those that the pass reads are moved
        rows = open_.join(listed.join(open_, ["source_id", "cursor"], "left_semi"), ["source_id", "cursor"], "left")
        return rows.select("source_id", ((n + number) % 5 > 0).alias("ok"), F.when(n % 7 == 3, F.col("cursor")).otherwise(F.col("cursor") + 1).alias("next_page"), total.alias("total"), (F.col("cursor") >= total).alias("complete"), F.coalesce("jobs", F.array().cast(listed.schema["jobs"].dataType)).alias("jobs"))

    return crawl


DRAIN_SQL = """pages AS (SELECT l_suppkey AS s, l_linenumber AS page, count(*) AS jobs FROM lineitem GROUP BY 1, 2),
  run AS (SELECT s_suppkey AS s, -1 AS pass, 1::BIGINT AS cursor, NULL::BIGINT AS total, 0 AS stalls, false AS done, NULL::VARCHAR AS error, NULL::BIGINT AS got FROM supplier
    UNION ALL SELECT s, pass, CASE WHEN advanced THEN next ELSE cursor END, CASE WHEN good THEN coalesce(total, t) ELSE total END, CASE WHEN stalled THEN stalls + 1 WHEN advanced THEN 0 ELSE stalls END, finished,
      CASE WHEN changed THEN 'page count changed' WHEN stalled AND stalls >= 1 THEN CASE WHEN good THEN 'did not advance' ELSE 'no result' END WHEN pass = 9 AND NOT finished THEN 'too many passes' END, CASE WHEN good THEN cursor END
    FROM (SELECT *, good AND NOT changed AND cursor >= t AS finished, good AND NOT changed AND NOT cursor >= t AND next > cursor AS advanced, NOT changed AND NOT finished AND NOT advanced AS stalled
      FROM (SELECT *, good AND total IS NOT NULL AND total <> t AS changed FROM (SELECT r.s, r.pass + 1 AS pass, r.cursor, r.total, r.stalls, r.s % 6 + 1 + CASE WHEN r.s % 11 = 5 AND r.pass + 1 >= 2 THEN 1 ELSE 0 END AS t, CASE WHEN r.s % 7 = 3 THEN r.cursor ELSE r.cursor + 1 END AS next,
        (r.s + r.pass + 1) % 5 > 0 AND p.jobs IS NOT NULL AS good FROM run r LEFT JOIN pages p ON p.s = r.s AND p.page = r.cursor WHERE NOT r.done AND r.error IS NULL AND r.pass < 9))))"""


@query(f"""WITH RECURSIVE {DRAIN_SQL}, seen AS (SELECT r.s, r.pass, l_orderkey AS k, l_partkey, CASE WHEN l_partkey % 3 > 0 THEN 'p' || l_partkey % 50 END AS e FROM run r JOIN lineitem ON l_suppkey = r.s AND l_linenumber = r.got WHERE r.s IN (SELECT s FROM run WHERE done))
  SELECT s AS source_id, coalesce(e, 'https://x.example/' || l_partkey) AS posting, arg_max('t' || k, (pass, k, coalesce(e, ''), 'https://x.example/' || l_partkey)) AS title FROM seen GROUP BY 1, 2""")
def drained_catalogs(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return drain.drain(spark, sources, _catalog_pages(spark, sf_dir), 10)[0].select("source_id", "posting", "title")


@query(f"WITH RECURSIVE {DRAIN_SQL} SELECT s AS source_id, cursor, total, stalls, done, error FROM run QUALIFY row_number() OVER (PARTITION BY s ORDER BY pass DESC) = 1")
def drain_states(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return drain.drain(spark, sources, _catalog_pages(spark, sf_dir), 10)[1]


def _signals_sql(name: str, text: str, rules, prefix: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{prefix}:{k}' END" for k, p in rules)
    return f"list_filter([{each}], lambda x: x IS NOT NULL) AS {name}"


LABELS_SQL = f"""t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title FROM documents),
  s AS (SELECT doc_id, {_signals_sql('field', 'title', [*fixed.DOMAIN, *fixed.SUPPORTING[:3]], 'title')}, {_signals_sql('domain', 'body', fixed.DOMAIN, 'body')}, {_signals_sql('supporting', 'body', fixed.SUPPORTING, 'body')},
    {', '.join(_signals_sql(f'"{area}"', 'title', rules, 'title') for area, rules in fixed.AREAS.items())} FROM t)"""


@query(f"""WITH {LABELS_SQL} SELECT doc_id, len(field) > 0 OR len(domain) >= 2 OR len(supporting) >= 3 OR (len(domain) >= 1 AND len(supporting) >= 2) AS matched, (4 * len(field) + 2 * len(domain) + len(supporting))::INT AS score,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(field, domain), supporting))), ',') AS evidence,
  array_to_string(list_filter([{', '.join(f"CASE WHEN len(\"{a}\") > 0 THEN '{a}=' || 4 * len(\"{a}\") END" for a in fixed.AREAS)}], lambda x: x IS NOT NULL), ',') AS areas FROM s""")
def document_labels(spark, sf_dir):
    """Topic of all documents, read as postings titled by their first line, and the areas of their titles."""
    none = F.lit(None).cast("string")
    fields = {n: F.split("text", "\n")[0] if n == "title" else none for n in signals.FIELDS}
    rows = table(spark, sf_dir, "documents").select("doc_id", signals.labels(fields, F.lit(None).cast("array<string>"), [F.col("text")])["topic"].alias("t"), signals.labels(fields, F.lit(None).cast("array<string>"), [none])["areas"].alias("a"))
    areas = F.array_join(F.transform("a", lambda x: F.concat(x["area"], F.lit("="), x["score"].cast("string"))), ",")
    return rows.select("doc_id", "t.matched", "t.score", F.array_join("t.evidence", ",").alias("evidence"), areas.alias("areas"))


SEARCHES = {"articles": ["the", "and"], "prefixes": ["ber", "keit"], "accents": ["ention", "st"], "rare": ["mail"], "touched": ["touched", "d"], "none": ["qqqq", "the"]}


def _searched_sql() -> str:
    of = lambda w: f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) > 0"
    each = " UNION ALL ".join(f"SELECT '{name}' AS search, doc_id FROM tokens WHERE {' AND '.join(map(of, words))}" for name, words in SEARCHES.items())
    text = "CASE doc_id % 10 WHEN 3 THEN 'Touched ' || text ELSE text END"
    return f"WITH tokens AS (SELECT doc_id, regexp_extract_all(translate(lower({text}), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents WHERE doc_id % 10 <> 4) {each}"


@query(_searched_sql())
def indexed_search(spark, sf_dir):
    """Searches of an index of all documents, after a tenth of them changed and a tenth went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = TextIndex(spark, new_folder(spark, "index"))
    index.build(docs, "doc_id", ["text"])
    changed = docs.filter("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("Touched "), "text"))
    index.touch(docs.filter("doc_id % 10 IN (3, 4)").select("doc_id"), changed, "doc_id", ["text"])
    out = None
    for name, words in SEARCHES.items():
        found = index.search(words).select(F.lit(name).alias("search"), F.col("id").alias("doc_id"))
        out = out.unionByName(found) if out is not None else found
    return out
