"""State that is kept up: versions, deliveries as a stream, the text index, places in large groups, and the rules of the message chain."""

import datetime
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.functions import classifiers, signals
from postlake.operators import delivery, drain
from postlake.operators.merge import merge
from postlake.operators.pages import PageDirectory
from postlake.operators.ranking import placed
from postlake.operators.text_index import TextIndex
from postlake.sources.publish import publish, published
from postlake.streaming import cycles, deliveries
from postlake.streaming.facet_counts import FacetCounts
from postlake.streaming.snapshots import merge_batch, merge_stream
from postlake.streaming.versions import Conflict, VersionedTable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
STATE = "source_id long, official_url string, title string, company string, published_at string, status string, first_seen_at string, last_seen_at string, generation long"
LISTED = "source_id long, official_url string, title string, company string, published_at string, ordinal long, complete boolean"
OLD = [(s, f"u{k}", "old", "c", None, "open" if k == 1 else "closed", "2025", "2025", 1) for s in (1, 2, 3) for k in (1, 2)]
NEW = [(1, "u2", "new", "c", "2026", 1, True), (2, "u9", "new", "c", None, 1, False)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- versions

CRASH = f"""
import os, sys
sys.path[:0] = [{ROOT!r}, {os.path.join(ROOT, "tests")!r}]
from pyspark.sql import SparkSession
from test_state import LISTED, NEW, OLD, STATE
from postlake.streaming.snapshots import merge_batch
from postlake.streaming.versions import VersionedTable
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
table = VersionedTable(spark, sys.argv[1], "source_id", 4)
table.commit(spark.createDataFrame(OLD, STATE), None)
merge_batch(table, spark.createDataFrame(NEW, LISTED), 0, "2026", "complete", before_publish=lambda: os._exit(9))
"""


def test_a_lost_driver_loses_nothing(spark, tmp_path):
    """The driver dies between the data and the manifest: the former version is whole, and the batch, coming again, is merged once."""
    path = str(tmp_path / "table")
    assert subprocess.run([sys.executable, "-c", CRASH, path], capture_output=True, timeout=300).returncode == 9
    table, new = VersionedTable(spark, path, "source_id", 4), spark.createDataFrame(NEW, LISTED)
    assert table.versions() == [0] and len(table.names("data")) == 2
    assert rows(table.read()) == rows(spark.createDataFrame(OLD, STATE))
    want = rows(merge(spark.createDataFrame(OLD, STATE), new, "2026", "complete").drop("event"))
    for _ in range(2):  # the second time it is known
        assert merge_batch(table, new, 0, "2026", "complete") == 1
        assert rows(table.read()) == want
    assert {(r.official_url, r.status, r.first_seen_at, r.generation) for r in table.read().collect() if r.source_id == 1} == {("u1", "closed", "2025", 1), ("u2", "open", "2025", 2)}
    assert rows(table.read(0)) == rows(spark.createDataFrame(OLD, STATE))
    table.vacuum(1)
    assert table.versions() == [1] and rows(table.read()) == want and len(table.names("data")) == 2  # the untouched buckets of the first


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "source_id", 4)
    assert table.read() is None
    table.commit(spark.createDataFrame(OLD, STATE), None)
    since = table.manifest()
    merge_batch(table, spark.createDataFrame(NEW, LISTED), 0, "2026", False)
    with pytest.raises(Conflict):
        table.commit(spark.createDataFrame(OLD, STATE), None, since=since)
    assert table.versions() == [0, 1] and table.read().count() == 7
    assert merge_batch(table, spark.createDataFrame([], LISTED), 5, "2027") == 1
    assert VersionedTable(spark, str(tmp_path / "empty"), "source_id", 4).commit(spark.createDataFrame([], STATE), None) == 0


def test_stream_merges_only_what_it_lists(spark, tmp_path):
    inbox = str(tmp_path / "in")
    table = VersionedTable(spark, str(tmp_path / "t"), "source_id", 8)
    table.commit(spark.createDataFrame(OLD, STATE), None)
    before = table.manifest()["buckets"]
    spark.createDataFrame(NEW, LISTED).write.parquet(inbox)
    for _ in range(2):  # the second start finds nothing new
        merge_stream(spark.readStream.schema(LISTED).parquet(inbox), table, str(tmp_path / "check"), "2026", "complete").awaitTermination(120)
    assert table.versions() == [0, 1] and rows(table.read()) == rows(merge(spark.createDataFrame(OLD, STATE), spark.createDataFrame(NEW, LISTED), "2026", "complete").drop("event"))
    touched = {str(r[0]) for r in spark.createDataFrame(NEW, LISTED).select(table.bucket()).collect()}
    assert {b for b, f in table.manifest()["buckets"].items() if before.get(b) != f} == touched


# --- deliveries

T0 = datetime.datetime(2026, 1, 1)
EVENTS = "message_id long, event_id long, at timestamp, kind string"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_a_key_of_a_stream_makes_one_frame(monkeypatch):
    """Events of a key come sorted from several frames without joining them as frames; what is null stays null, and types are those stated."""
    import pandas as pd

    class Held:
        get, update = staticmethod(lambda: None), staticmethod(lambda state: None)

    class Handle:
        registerTimer = deleteTimer = staticmethod(lambda t: None)

    monkeypatch.setattr(pd, "concat", None)
    one = deliveries.Deliveries()
    one.state, one.handle = Held(), Handle()
    frame = lambda *events: pd.DataFrame(events, columns=["event_id", "at", "kind"])
    (out,) = one.handleInputRows((7,), iter([frame((2, at(1), "claim")), frame((1, at(0), "plan"), (3, at(2), "fail:auth"))]), None)
    assert out["event_id"].tolist() == [1, 2, 3] and out["status"].tolist() == ["queued", "sending", "auth_blocked"] and out["lease_until"].isna().tolist() == [True, False, True]
    due = deliveries._frame([(7, None, at(1), "due", "sending", 1, None, at(6))])
    assert due["event_id"].isna().all() and [str(t) for t in due.dtypes[["message_id", "event_id", "at", "attempt", "retry_at"]]] == ["int64", "Int64", "datetime64[us]", "int32", "datetime64[us]"]


def test_stream_of_deliveries(spark, tmp_path):
    """Batches with a lease and a pause that run out between them; a batch that comes twice changes nothing."""
    batches = [
        [(1, 1, at(0), "plan"), (1, 2, at(1), "claim"), (2, 3, at(0), "plan"), (2, 4, at(1), "claim"), (2, 5, at(2), "fail:retryable"), (3, 6, at(2), "claim"), (4, 20, at(0), "plan"), (4, 21, at(1), "claim"), (4, 22, at(2), "fail:auth"), (4, 23, at(3), "claim")],
        [(9, 7, at(60), "plan")],  # moves the watermark past the lease of 1 and the pause of 2
        [(1, 8, at(61), "claim"), (1, 9, at(62), "sent"), (1, 10, at(63), "clear"), (2, 11, at(61), "claim"), (2, 12, at(62), "fail:permanent"), (2, 13, at(63), "retry"), (2, 14, at(64), "claim"), (2, 15, at(65), "release"), (4, 24, at(62), "retry"), (4, 25, at(62), "claim")],
        [(1, 8, at(61), "claim"), (2, 11, at(61), "claim"), (2, 15, at(65), "release")],  # again
        [(2, 16, at(66), "clear"), (2, 17, at(67), "claim"), (2, 18, at(68), "plan"), (10, 19, at(200), "plan")],
    ]
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(inbox)
        deliveries.start(spark.readStream.schema(EVENTS).parquet(inbox), out, check, "1 minute").awaitTermination(180)
    found = spark.read.parquet(out).collect()
    of = lambda m: [(r.kind, r.status, r.attempt) for r in sorted((r for r in found if r.message_id == m and r.kind != "due"), key=lambda r: r.event_id)]
    assert of(1) == [("plan", "queued", 0), ("claim", "sending", 1), ("claim", "sending", 2), ("sent", "sent", 2)]
    assert of(2) == [("plan", "queued", 0), ("claim", "sending", 1), ("fail:retryable", "retryable", 1), ("claim", "sending", 2), ("fail:permanent", "failed", 2), ("retry", "retryable", 2), ("claim", "sending", 3), ("release", "queued", 2), ("clear", None, 0), ("plan", "queued", 0)]
    assert of(3) == [] and of(4) == [("plan", "queued", 0), ("claim", "sending", 1), ("fail:auth", "auth_blocked", 1), ("retry", "retryable", 1), ("claim", "sending", 2)]
    due = sorted((r.message_id, r.at, r.status) for r in found if r.kind == "due")
    assert due == [(1, at(6), "sending"), (2, at(7), "retryable"), (4, at(67), "sending")]


def test_a_queued_best_match_keeps_its_twin_back(spark):
    when = T0
    jobs = spark.createDataFrame([(i, 1, "open", True, True, when, None, [f"k{i // 2}"]) for i in range(4)], "job_id long, generation long, status string, canonical boolean, after_baseline boolean, first_seen_at timestamp, published_at timestamp, keys array<string>")
    matches = spark.createDataFrame([(i, 7, i, 1, 50 - i, True, True) for i in range(4)], "match_id long, profile long, job_id long, generation long, score long, is_active boolean, eligible boolean")
    people = spark.createDataFrame([(7, "a", True), (7, "b", True), (7, "c", False)], "profile long, recipient string, enabled boolean")
    items = spark.createDataFrame([("m", 0, "a"), ("m", 0, "b")], "message_id string, match_id long, recipient string")
    history = spark.createDataFrame([(7, "b", "k1")], "profile long, recipient string, key string")
    found = delivery.pending(matches, jobs, people, items, history)
    assert rows(found.select("match_id", "recipient")) == [(2, "a")]  # 0 is queued and keeps 1 back; 2 beats 3, and b was told
    assert rows(delivery.pending(matches, jobs, people, items.limit(0), history.limit(0)).select("match_id", "recipient")) == [(0, "a"), (0, "b"), (2, "a"), (2, "b")]


PROFILE = "profile long, enabled boolean, mail_state string, activation timestamp, next_digest_at timestamp, lease_until timestamp"


def test_a_plan_makes_one_message_a_profile(spark):
    pending = spark.createDataFrame([(p, p * 10 + i, 9 - i % 5, T0, r) for p in (1, 2) for i in range(6) for r in (["a", "b"] if i != 5 else ["a"])], "profile long, match_id long, score long, time timestamp, recipient string")
    people = spark.createDataFrame([(1, True, "connected", None, None, None), (2, True, "blocked", None, None, None), (3, True, "connected", None, at(-5), None), (4, True, "connected", None, at(2), None)], PROFILE)
    messages, items, rests = delivery.plan(pending, people, "2026-01-01", 3)
    assert [(r.profile, r.recipients, r.matches, r.status) for r in messages.collect()] == [(1, "a, b", 3, "queued")]
    assert {(r.match_id, r.recipient) for r in items.collect()} == {(m, r) for m in (10, 11, 12) for r in "ab"}  # 15 has a set of its own
    assert {r.profile: r.next_digest_at for r in rests.collect()} == {1: T0, 2: None, 3: at(120), 4: at(2)}
    everything, _, rests = delivery.plan(pending.filter("match_id = 10"), people, "2026-01-01")
    assert everything.count() == 1 and {r.profile: r.next_digest_at for r in rests.collect()}[1] == at(120)
    assert delivery.plan(pending.limit(0), people, "2026-01-01")[0].count() == 0


def test_failures_never_end_by_attempts(spark):
    kinds = "message_id long, profile long, channel string, status string, attempt int, retry_at timestamp, lease_until timestamp, error string, sent_at timestamp"
    sending = spark.createDataFrame([(i, 1, "email", "sending", i, None, at(5), None, None) for i in (1, 4, 9)], kinds)
    out = delivery.failed(sending, spark.createDataFrame([(i, "retryable", "x" * 900) for i in (1, 4, 9)], "message_id long, kind string, reason string"), "2026-01-01")
    assert [(r.status, r.retry_at, r.attempt, len(r.error), r.lease_until) for r in out.orderBy("message_id").collect()] == [("retryable", at(5), 1, 500, None), ("retryable", at(360), 4, 500, None), ("retryable", at(360), 9, 500, None)]
    refused = delivery.failed(sending, spark.createDataFrame([(1, "auth", "no"), (4, "permanent", "no")], "message_id long, kind string, reason string"), "2026-01-01")
    again = delivery.retried(refused, 1, "2026-01-02")
    assert [(r.status, r.error) for r in again.orderBy("message_id").collect()] == [("retryable", None), ("retryable", None), ("sending", None)]
    people = spark.createDataFrame([(1, True, "connected", None, None, None)], PROFILE)
    claimed = delivery.claim(again.withColumn("scheduled_at", F.lit(T0)), people, "2026-01-03")
    assert [(r.status, r.attempt) for r in claimed.orderBy("message_id").collect()] == [("sending", 2), ("sending", 5), ("sending", 10)]
    blocked = delivery.profiles_after_failures(people, sending, spark.createDataFrame([(1, "auth", "no")], "message_id long, kind string, reason string"))
    assert blocked.first().mail_state == "blocked" and delivery.claim(again.withColumn("scheduled_at", F.lit(T0)), blocked, "2026-01-03").filter("attempt > 9").count() == 0


# --- places and the index


def test_places_in_a_group_that_spans_all_parts(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 5000).alias("v")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = placed(df, ["g"], [F.desc("v")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append((r.place, r.v))
    assert len(groups[None]) == 4500 and len(out) == 5000
    assert all([v for _, v in sorted(g)] == sorted((v for _, v in g), reverse=True) and [p for p, _ in sorted(g)] == list(range(1, len(g) + 1)) for g in groups.values())
    assert placed(df.limit(0), ["g"], [F.desc("v")]).count() == 0


def test_index_reads_a_small_share(spark, tmp_path):
    """A prefix opens the files whose range it meets, and the answer is that of a scan, before and after rows change."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    index = TextIndex(spark, str(tmp_path / "i"), 32)
    index.build(docs, "doc_id", ["text"])
    size = lambda folders: sum(os.path.getsize(os.path.join(d, f)) for p in folders for d, _, names in os.walk(p.removeprefix("file:")) for f in names)
    scan = lambda df, words: {r.doc_id for r in df.collect() if all(any(t.startswith(w) for t in _tokens(r.text)) for w in words)}
    for words in (["estr"], ["mail7"], ["the", "and"], ["ach", "zu", "te"], ["qqq"]):
        assert {r.id for r in index.search(words).collect()} == scan(docs, words)
    whole = size([f"{tmp_path}/i/data"])
    assert size(index.files_for(["estr"])[0]) < 0.1 * whole and size(index.files_for(["mail7"])[0]) < 0.1 * whole
    changed = spark.createDataFrame([(1, "Estragon ÉTÉ"), (2, None)], "doc_id long, text string")
    index.touch(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), changed, "doc_id", ["text"])
    index.touch(spark.createDataFrame([(3,)], "doc_id long"), spark.createDataFrame([(3, "estrade")], "doc_id long, text string"), "doc_id", ["text"])
    now = docs.filter("doc_id NOT IN (1, 2, 3)").unionByName(spark.createDataFrame([(1, "Estragon ÉTÉ"), (3, "estrade")], "doc_id long, text string"))
    for words in (["estr"], ["ete"], ["the", "and"]):
        assert {r.id for r in index.search(words).collect()} == scan(now, words)
    empty = TextIndex(spark, str(tmp_path / "e"))
    empty.build(docs.limit(0), "doc_id", ["text"])
    assert empty.search(["a"]).count() == 0 and index.search([]).count() == 0


def _tokens(text):
    import regex

    from postlake.functions.text import MARKED, PLAIN

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower().translate(str.maketrans(MARKED, PLAIN)))


# --- facets, published tables, deep pages, cycles, drains, signals


def test_facet_counts_equal_a_recount_after_any_merges(spark, tmp_path):
    """Chains of merges, batches that come twice, and a driver lost between the two commits."""
    counts = FacetCounts(spark, str(tmp_path), ("company", "team"), buckets=4)
    kinds = "id long, official_url string, company string, team string, status string, first_seen_at string"
    rng = np.random.default_rng(9)
    state = {(s, u): (s, f"u{u}", f"C{s % 2}", "x", "open", "2025") for s in range(3) for u in range(4)}
    frame = lambda: spark.createDataFrame([tuple(r) for r in state.values()], kinds)
    recount = lambda: rows(counts.contributions(frame()).groupBy("key", "value").agg(F.count(F.lit(1)).alias("jobs")))
    counts.build(frame())
    for batch in range(5):
        touched = set()
        for _ in range(rng.integers(0, 5)):
            s, u = int(rng.integers(3)), int(rng.integers(6))
            state[s, u] = (s, f"u{u}", f"C{rng.integers(3)}", ["x", "y", None][rng.integers(3)], ["open", "open", "closed"][rng.integers(3)], str(2026 + rng.integers(3)))
            touched.add((f"u{u}",))
        names = spark.createDataFrame(sorted(touched), "official_url string")

        def lost():
            raise RuntimeError("lost")

        if batch % 2:
            try:
                counts.apply(frame(), names, batch, between=lost)
            except RuntimeError:
                pass
        counts.apply(frame(), names, batch)
        counts.apply(frame(), names, batch)
        assert rows(counts.read().select("key", "value", "jobs")) == recount(), batch


def test_facet_counts_read_the_postings_once_a_merge(spark, tmp_path):
    """The postings of a merge are read by one job, however many commits follow from what they contribute."""
    counts, reads = FacetCounts(spark, str(tmp_path), ("company",), buckets=4), spark.sparkContext.accumulator(0)
    kinds = "id long, official_url string, company string, status string, first_seen_at string"

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame([(k, f"u{k}", f"C{k % 3}", "open", "2025") for k in range(12)], kinds).mapInArrow(counted, kinds)
    counts.build(frame)
    assert reads.value == 12
    counts.apply(frame, frame.sparkSession.createDataFrame([("u1",), ("u2",)], "official_url string"), 0)
    assert reads.value == 24


def test_an_aborted_publication_leaves_the_former_one(spark, tmp_path):
    path = str(tmp_path / "catalog")
    first = spark.range(100).withColumn("title", F.concat(F.lit("t"), "id"))
    publish(first.repartition(3), path)
    assert rows(published(spark, path)) == rows(first)
    broken = spark.range(0, 1000, 1, 4).withColumn("title", F.when(F.col("id") == 990, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="broken"):
        publish(broken, path)
    assert rows(published(spark, path)) == rows(first)
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 1  # what was written of it is gone
    publish(first.limit(0), path)
    assert published(spark, path).count() == 0 and published(spark, path).columns == ["id", "title"]


def test_deep_pages_open_few_parts(spark, tmp_path):
    df = spark.range(10_000).select("id", (F.col("id") * 7919 % 101).alias("v"))
    pages = PageDirectory(spark, str(tmp_path / "p"), 20)
    pages.build(df, [F.desc("v"), F.asc("id")])
    want = [r.id for r in df.orderBy(F.desc("v"), "id").collect()]
    for number in (1, 2, 77, 200):
        found = pages.page(number, 50).collect()
        assert [r.id for r in found] == want[(number - 1) * 50 : number * 50] and [r.place for r in found] == list(range((number - 1) * 50 + 1, number * 50 + 1))
        assert len(pages.parts_of((number - 1) * 50, 50)) <= 2
    assert pages.page(201, 50).count() == 0
    empty = PageDirectory(spark, str(tmp_path / "e"))
    empty.build(df.limit(0), [F.asc("id")])
    assert empty.page(1).count() == 0


SEGMENTS = "source_id long, event_id long, at timestamp, listing_url string, adapter string, policy long, next_page long, complete boolean"


def test_cycles_close_what_two_cycles_did_not_see(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "u", "a", 1, 2, False), (1, 2, at(10), "u", "a", 1, 0, True), (2, 3, at(0), "u", "a", 1, 5, False)],
        [(1, 4, at(20), "u", "a", 1, 0, True), (2, 5, at(20), "u", "b", 1, 3, False), (1, 2, at(10), "u", "a", 1, 0, True)],
        [(1, 6, at(30), "u", "a", 1, 0, True), (1, 7, at(40), "u", "a", 2, 0, True), (2, 8, at(40), "v", "b", 1, 4, False)],
    ]
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in batches:
        spark.createDataFrame(batch, SEGMENTS).coalesce(1).write.mode("append").parquet(inbox)
        cycles.start(spark.readStream.schema(SEGMENTS).parquet(inbox), out, check).awaitTermination(180)
    changes = spark.read.parquet(out)
    found = {r.event_id: (r.restarted, r.next_page, r.cycle_start, r.previous_start, r.closes_before) for r in changes.collect()}
    assert changes.count() == 8 and found == {
        1: (True, 2, at(0), None, None), 2: (False, 1, at(10), at(0), None), 4: (False, 1, at(20), at(10), at(0)), 6: (False, 1, at(30), at(20), at(10)), 7: (True, 1, at(40), at(40), None),
        3: (True, 5, at(0), None, None), 5: (True, 3, at(20), None, None), 8: (True, 4, at(40), None, None),
    }
    held = spark.createDataFrame([(1, "open", at(5)), (1, "open", at(15)), (1, "closed", at(1)), (2, "open", at(0))], "source_id long, status string, last_seen_at timestamp")
    assert [(r.source_id, r.gone) for r in cycles.closed_by(held, changes).filter("gone").collect()] == [(1, True)]


def test_a_drain_ends_with_its_last_source(spark):
    job = "struct<external_id:string,official_url:string,title:string>"
    script = {  # (source, pass): ok, next page, pages, complete, postings
        (1, 0): (True, 2, 2, False, [("a", "u1", "first")]), (1, 1): (False, 0, 2, False, []), (1, 2): (True, 3, 2, True, [("a", "u9", "last"), (None, "u2", "own")]),
        (2, 0): (True, 1, 3, False, [("b", "u", "t")]), (2, 1): (True, 1, 3, False, [("b", "u", "t")]), (3, 0): (True, 2, 3, False, [("c", "u", "t")]), (3, 1): (True, 3, 4, False, [("c", "u", "t")]), (4, 0): (False, 0, 0, False, []), (4, 1): (False, 0, 0, False, []),
    }
    asked = []

    def crawl(open_, number):
        sources = sorted(r.source_id for r in open_.collect())
        asked.append(sources)
        return spark.createDataFrame([(s, *script[s, number]) for s in sources], f"source_id long, ok boolean, next_page long, total long, complete boolean, jobs array<{job}>")

    found, state = drain.drain(spark, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "source_id long"), crawl)
    assert rows(found.select("source_id", "posting", "title")) == [(1, "a", "last"), (1, "u2", "own")]
    assert {r.source_id: (r.done, r.error) for r in state.collect()} == {1: (True, None), 2: (False, "did not advance"), 3: (False, "page count changed"), 4: (False, "no result")}
    assert asked == [[1, 2, 3, 4], [1, 2, 3, 4], [1]]
    assert drain.drain(spark, spark.createDataFrame([], "source_id long"), crawl)[0].count() == 0


POSTINGS = [
    ("Machine Learning Intern", "Rotations include data engineering and machine learning.", ["PyTorch", "SQL"]), ("Stage Data Science - Paris", "responsible use of AI in recruiting. Tracks: AI, analytics & ML", []),
    ("Stage Manager", "AI &amp; ML; assignments include data &amp; analytics.", None), ("Nurse Externship", None, ["Scikit learn"]), ("2027 Estágio em Finanças", "Large language models, NLP and feature engineering", []), ("Software Engineering Co-op", "", []),
    ("Campus recruiting intern program hiring", "ai", ["ml"]), (None, None, None), ("ＭＡＣＨＩＮＥ　ＬＥＡＲＮＩＮＧ", "mail email, main: said", ["bi", "Hugging Face"]), ("Praktikant:in Werkstudent", "Disciplines such as quantitative statistics, informatics. Data.", []),
]


def test_signals_equal_the_expressions(spark):
    """One automaton pass and a pattern after the other: the same labels, on small postings and on whole documents."""
    small = spark.createDataFrame([(i, *r) for i, r in enumerate(POSTINGS)], "id long, title string, body string, skills array<string>")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.concat(F.lit("Rotations in ML, ai, data: "), "text").alias("body"), F.array(F.lit("data science")).alias("skills"))
    for df in (small, docs):
        fields = {n: F.col("title") if n in ("title", "team") else F.lit(None).cast("string") for n in signals.FIELDS}
        got = df.select("id", signals.labels(fields, F.col("skills"), [F.col("body")]).alias("l")).select("id", "l.*")
        want = df.select("id", classifiers.programs(F.col("title")).alias("program"), classifiers.ai_data_topic(fields, F.col("skills"), [F.col("body")]).alias("topic"), classifiers.areas(fields, F.col("skills"), [F.col("body")]).alias("areas"))
        assert rows(got) == rows(want)
    assert any(r.areas for r in want.collect())


def test_words_that_a_pattern_needs():
    for pattern, matches in ((r"\b(?:natural language processing|nlp)\b", ["natural language processing", "nlp"]), (r"co(?:\s*-\s*|\s+)op", ["co-op", "co op"]), (r"(?:praktik(?:um|ant)|praktyk)", ["praktikum", "praktyk"])):
        words = signals.needed_words(pattern)
        assert words and all(any(w in m for w in words) for m in matches)
    assert signals.needed_words(r"[a-z]+|x") == signals.needed_words(r"(?:long word)?") == set()
    for rules in signals.Labels().matcher.sets.values():
        assert all(words for words in rules.words)
