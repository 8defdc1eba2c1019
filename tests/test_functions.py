"""Known answers of small functions and the filter codec."""

import json

from pyspark.sql import functions as F

from postlake.functions import codec, urls
from postlake.operators import audits, lifecycle, projections, repairs
from postlake.operators.search import Filters


def test_codec_round_trip_and_odd_input():
    f = Filters(companies=("Acme, Inc.",), years=(2027,), programs=("coop",), salary_from=10.0, published_to="2026-02-01", arrangement="remote", limit=20)
    assert codec.parse(codec.serialize(f)) == f and codec.active_filters(f) == 6
    assert codec.parse("?companies=A&companies=a&areas=ai-ml,zzz&years=1999,2027&limit=500&salary_from=x&published_from=2026-13-01&other=1") == Filters(companies=("A",), areas=("ai-ml",), years=(2027,))
    assert codec.serialize(Filters()) == "" and codec.active_filters(Filters()) == 0


def test_canonical_urls(spark):
    known = {
        "https://x.com/job//apply": "https://x.com/job", "Not A Url#x": "not a url#x", "https://X.com": "https://x.com/", "https://x.com/?A=1#f": "https://x.com/?a=1", "https://x.com/apply": "https://x.com/",
        "https://search.jobs.barclays/en/job/1/apply/": "https://search.jobs.barclays/job/1", None: None,
    }
    rows = spark.createDataFrame([(u,) for u in known], "u string").select("u", urls.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == known
    assert spark.createDataFrame([("www.abc.de",)], "h string").select(urls.registrable_domain(F.col("h"))).first()[0] == "abc.de"


def test_navigation_and_baseline(spark):
    rows = [("Saved  jobs 0", "u", True), ("Engineer", "https://a/x.PDF?y", True), (None, None, False), ("Events manager", "u", False)]
    out = spark.createDataFrame(rows, "t string, u string, want boolean").select("want", lifecycle.is_navigation(F.col("t"), F.col("u")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_urls_of_listings_and_sources(spark):
    rows = [("https://search.jobs.barclays/EN/job/A/1//", "https://search.jobs.barclays/job/A/1"), ("HTTPS://X.com/En/A/#f", "https://x.com/En/A/"), ("junk", "junk"), (None, None)]
    out = spark.createDataFrame(rows, "u string, want string").select("want", urls.listing_identity_url(F.col("u")).alias("got")).collect()
    assert all(r.got == r.want for r in out)
    pairs = [("https://a.com:443/x", "https://a.com"), ("http://A.com:80", "http://a.com"), ("https://a.com:8443/", "https://a.com:8443"), ("mailto:a@b.c", None), (None, None)]
    assert all(r.got == r.want for r in spark.createDataFrame(pairs, "u string, want string").select("want", urls.origin(F.col("u")).alias("got")).collect())


def test_repairs_meet_nulls_and_empty_tables(spark):
    stored = spark.createDataFrame([(1, 1, None, None, None, None, "open"), (1, 2, "https://a.com/1", "T", "", "", "open")], "source_id int, id int, official_url string, title string, external_id string, requisition_id string, status string")
    incoming = spark.createDataFrame([(1, None, None, None, None, True), (1, "https://a.com/2", "T", "", None, True), (2, "https://a.com/1", "T", "x", "x", None)], "source_id int, official_url string, title string, external_id string, requisition_id string, first_party boolean")
    found = repairs.url_candidates(stored, incoming)
    assert repairs.url_repairs(found).count() == 0 and repairs.repair_mirrors(found).count() == 0
    assert repairs.url_repairs(repairs.url_candidates(stored.limit(0), incoming)).count() == 0


def test_records_give_way_in_steps(spark):
    rows = spark.createDataFrame([("a", "x" * 5000, "raw"), ("b", "short", "raw"), ("c", None, None), ("d" * 500, "x", "raw")], "id string, description string, raw_payload string")
    sizes = {r[0][0]: r[1] for r in rows.select("id", projections.bounded_record(rows.columns, 2100)).collect()}
    assert json.loads(sizes["a"]) == {"id": "a", "description": "x" * 2000} and json.loads(sizes["b"])["raw_payload"] == "raw" and json.loads(sizes["c"]) == {"id": "c"}
    assert rows.filter("length(id) = 500").select(projections.bounded_record(rows.columns, 100)).first()[0] is None


def test_company_tokens_and_junk_urls(spark):
    name = lambda c: spark.createDataFrame([(c,)], "c string").select(audits.company_tokens(F.col("c"))).first()[0]
    assert name("IBM United Bank of the Acme-Corp") == ["ibm", "acme"] and name("") == [] and name(None) is None
    assert spark.createDataFrame([(None, "https://a.com", "https://b.com/jobs"), ("Acme", None, None), ("Acme", "x", "y")], "c string, o string, r string").select(audits.safe_recommendation(F.col("c"), F.col("o"), F.col("r")).alias("s")).filter("s").count() == 0


def test_links_of_odd_pages(spark):
    from postlake.operators.anchors import judged, page_links, postings, resolved

    base = "https://a.example/x/y?q=1"
    cases = [("z", "https://a.example/x/z"), ("./z/../w?k#f", "https://a.example/x/w?k#f"), ("../../../z", "https://a.example/z"), ("", base), ("#f", base + "#f"), ("?k", "https://a.example/x/y?k"), ("..", "https://a.example/"), ("//B.example/", "https://B.example/"), (None, None)]
    df = spark.createDataFrame([(h, base) for h, _ in cases], "href string, base string")
    assert [r[0] for r in df.select(resolved(F.col("href"), F.col("base"))).collect()] == [u for _, u in cases]
    schema = "source_id long, company string, source_url string, ordinal long, href string, text string"
    odd = [(1, None, "https://a.example/careers", i, h, t) for i, (h, t) in enumerate([(None, "Engineer"), ("/jobs/12345", None), ("/jobs/12345", "Engineer" * 30), ("javascript:x()", "Engineer"), ("/jobs/%22x", "Engineer"), ("/jobs/%zz-cook", "Apply")])] + [(2, "C", None, 9, "/jobs/123", "Engineer")]
    found = {r["ordinal"]: r["refused"] for r in judged(spark.createDataFrame(odd, schema)).collect()}
    assert found == {0: "broken-link", 1: "text-length", 2: "text-length", 3: "no-web-link", 4: "broken-link", 5: "generic-text", 9: "no-web-link"}
    assert postings(spark.createDataFrame([], schema)).count() == 0
    html = "<A title=\"t\" HREF='/a'><b>One</b> two</A><a name=x>none</a><a href=/b>B &amp; C</a><a href=\"/c\">open"
    rows = page_links(spark.createDataFrame([(1, "https://a.example/", html), (2, None, None)], "page_id long, url string, html string")).orderBy("ordinal").collect()
    assert [(r["href"], r["text"]) for r in rows] == [("/a", "One two"), (None, "none"), ("/b", "B & C")]


def test_report_is_read_again(spark, tmp_path):
    from postlake.sources.parameters import json_rows, write_report

    rows = json_rows(spark.createDataFrame([(1, '[{"id": 3}, {"id": null, "kind": "k"}]'), (2, "[broken"), (3, None), (4, "[]")], "n long, p string"), "p", "id long, kind string")
    assert [tuple(r) for r in rows.collect()] == [(1, 3, None), (1, None, "k")]
    write_report(rows, str(tmp_path / "report"))
    write_report(rows.limit(1), str(tmp_path / "report"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "report")).collect()] == [{"id": 3, "kind": None, "n": 1}]


def test_merge_of_repeated_rows_and_unknown_words(spark):
    from postlake.operators.merge import merge

    state = spark.createDataFrame([(1, "u", "T", ["a"], "remote", "saved", "k1", "closed", "1", "1", 4, None, "1")], "source_id long, official_url string, title string, skills array<string>, arrangement string, review_state string, url_identity_key string, status string, first_seen_at string, last_seen_at string, generation long, reopened_at string, closed_at string")
    new = [(1, "u", "A", [], "hybrid", "new", "k2", 1), (1, "u", "B", None, "unknown", "new", "k3", 2), (1, "v", "C", [], "unknown", "new", "k4", 3), (1, "v", "D", None, None, "hidden", None, 4)]
    incoming = spark.createDataFrame(new, "source_id long, official_url string, title string, skills array<string>, arrangement string, review_state string, url_identity_key string, ordinal long")
    got = {r["official_url"]: r.asDict() for r in merge(state, incoming, "9").collect()}
    pick = lambda u, *c: tuple(got[u][x] for x in c)
    names = ("title", "skills", "arrangement", "review_state", "url_identity_key", "status", "generation", "reopened_at", "closed_at", "event")
    assert pick("u", *names) == ("B", ["a"], "hybrid", "saved", "k1", "open", 5, "9", None, "reopened")
    assert pick("v", *names) == ("D", [], "unknown", "new", "k4", "open", 1, None, None, "created")
