"""Queries over the chain from reviews to sent messages, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators import delivery, review
from postlake.plans.catalog import query
from postlake.sources.proxy import table
from postlake.sources.rich import _dealt, _sql
from postlake.sources.shared import new_folder
from postlake.streaming import deliveries

# -- relations: a posting an order, a profile a nation's number, a recipient a supplier ---------------------------------------------------


def _order(spark, sf_dir) -> tuple[DataFrame, Column, Column]:
    return table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")


def _url(n: Column) -> Column:
    return F.concat(F.lit("https://jobs.example/"), n)


def _jobs(spark, sf_dir) -> DataFrame:
    o, n, c = _order(spark, sf_dir)
    return o.select(
        n.alias("job_id"), (n % 3 + 1).alias("generation"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), (n % 11 > 0).alias("canonical"), (n % 13 > 0).alias("student"),
        (n % 5 > 0).alias("after_baseline"), _url(n).alias("official_url"), F.when(n % 4 == 0, F.concat(_url(n), F.lit("/Apply"))).alias("apply_url"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.date_add("o_orderdate", 1).cast("timestamp")).alias("published_at"), F.array(F.concat(F.lit("req:"), c % 900), F.concat(F.lit("url:"), n % 9001)).alias("keys"))


def _matches(spark, sf_dir) -> DataFrame:
    o, n, c = _order(spark, sf_dir)
    return o.select(n.alias("match_id"), (c % 25).alias("profile"), n.alias("job_id"), (n % 3 + 1 - F.when(n % 17 == 0, 1).otherwise(0)).alias("generation"), (n % 101).alias("score"), (n % 7 > 0).alias("is_active"), (n % 2 == 0).alias("eligible"), F.lit(None).cast("timestamp").alias("notified_at"))


def _profiles(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    at = lambda v: F.lit(v).cast("timestamp")
    return table(spark, sf_dir, "nation").select(
        n.alias("profile"), (n % 6 > 0).alias("enabled"), F.when(n % 8 == 3, "blocked").otherwise("connected").alias("mail_state"), F.when(n % 2 == 0, at("1993-01-01")).alias("activation"),
        F.when(n % 5 == 1, at("2026-01-01 00:01:00")).when(n % 5 == 2, at("2026-01-01 00:01:01")).alias("next_digest_at"), F.when(n % 9 == 4, at("2026-01-01 00:00:30")).alias("lease_until"))


def _recipients(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("profile"), F.col("s_suppkey").alias("recipient"), (F.col("s_acctbal") > 0).alias("enabled"))


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), F.col("l_orderkey") % 1000).alias("message_id"), F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("recipient")).distinct()


def _messages(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("n")).distinct()
    return ids.select(F.concat(F.lit("m"), n).alias("message_id"), F.when(n % 3 == 0, "sent").otherwise("queued").alias("status"))


def _history(spark, sf_dir) -> DataFrame:
    """What was told: the keys of the postings of first lines of small quantity, to their suppliers."""
    told = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' AND l_quantity < 4 AND l_linenumber = 1").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("recipient")).distinct()
    keys = _jobs(spark, sf_dir).select("job_id", F.explode("keys").alias("key")).join(_matches(spark, sf_dir).select("job_id", "profile"), "job_id")
    return told.join(keys, "job_id").select("profile", "recipient", "key").distinct()


CHAIN_SQL = f"""jobs AS (SELECT o_orderkey AS job_id, o_orderkey % 3 + 1 AS generation, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_orderkey % 11 > 0 AS canonical, o_orderkey % 13 > 0 AS student, o_orderkey % 5 > 0 AS after_baseline,
    'https://jobs.example/' || o_orderkey AS official_url, CASE WHEN o_orderkey % 4 = 0 THEN 'https://jobs.example/' || o_orderkey || '/Apply' END AS apply_url, o_orderdate::TIMESTAMP AS first_seen_at,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::TIMESTAMP + INTERVAL 1 DAY END AS published_at, ['req:' || o_custkey % 900, 'url:' || o_orderkey % 9001] AS keys FROM orders),
  matches AS (SELECT o_orderkey AS match_id, o_custkey % 25 AS profile, o_orderkey AS job_id, o_orderkey % 3 + 1 - CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS generation, o_orderkey % 101 AS score, o_orderkey % 7 > 0 AS is_active, o_orderkey % 2 = 0 AS eligible FROM orders),
  profiles AS (SELECT n_nationkey::BIGINT AS profile, n_nationkey % 6 > 0 AS enabled, CASE WHEN n_nationkey % 8 = 3 THEN 'blocked' ELSE 'connected' END AS mail_state, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '1993-01-01' END AS activation,
    CASE n_nationkey % 5 WHEN 1 THEN TIMESTAMP '2026-01-01 00:01:00' WHEN 2 THEN TIMESTAMP '2026-01-01 00:01:01' END AS next_digest_at, CASE WHEN n_nationkey % 9 = 4 THEN TIMESTAMP '2026-01-01 00:00:30' END AS lease_until FROM nation),
  recipients AS (SELECT s_nationkey::BIGINT AS profile, s_suppkey AS recipient FROM supplier WHERE s_acctbal > 0),
  items AS (SELECT DISTINCT 'm' || l_orderkey % 1000 AS message_id, l_orderkey AS match_id, l_suppkey AS recipient FROM lineitem),
  messages AS (SELECT DISTINCT 'm' || l_orderkey % 1000 AS message_id, CASE WHEN l_orderkey % 1000 % 3 = 0 THEN 'sent' ELSE 'queued' END AS status FROM lineitem),
  history AS (SELECT DISTINCT profile, l_suppkey AS recipient, unnest(keys) AS key FROM lineitem JOIN jobs ON job_id = l_orderkey JOIN matches USING (job_id) WHERE l_returnflag = 'N' AND l_quantity < 4 AND l_linenumber = 1)"""

# -- reviews -------------------------------------------------------------------------------------------------------------------------

VERDICTS = ("approve", "reject", "maybe", "approve", "reject", "approve", None, "approve", "reject", "approve", "reject")
RATIONALES = ("fits", "late", " \t", "fits\n", "near", None, "ok", "seen", "far", "new", "x", "y")


def _reviews(spark, sf_dir) -> DataFrame:
    """Two reviews a posting: one by id, one by url; with odd decisions, reasons and verified urls."""
    o, n, c = _order(spark, sf_dir)
    k, r = F.col("k").cast("long"), F.col("review")
    rows = o.select(n, c, F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("review", n * 2 + k)
    seen = F.when(r % 5 == 0, F.concat(F.lit("HTTPS://Jobs.Example/"), n)).when(r % 5 == 1, F.concat(_url(n), F.lit("/Apply"))).when(r % 5 == 2, _url(n + 1)).when(r % 5 == 3, F.concat(F.lit(" "), _url(n))).when(r % 35 == 4, F.lit("ftp://x")).otherwise(_url(n))
    return rows.select("review", (c % 25).alias("profile"), F.when(k == 0, n.cast("string")).alias("job_id"), F.when(k == 1, _url(n)).alias("official_url"), _dealt(VERDICTS, r).alias("decision"), _dealt(RATIONALES, F.floor(r / 7)).alias("rationale"), seen.alias("verified_url"))


REVIEWS_SQL = f"""reviews AS (SELECT o_orderkey * 2 + k AS review, o_custkey % 25 AS profile, o_orderkey AS job, {_sql(VERDICTS)}[(o_orderkey * 2 + k) % 11 + 1] AS decision, {_sql(RATIONALES)}[(o_orderkey * 2 + k) // 7 % 12 + 1] AS rationale,
    CASE (o_orderkey * 2 + k) % 5 WHEN 1 THEN 'https://jobs.example/' || o_orderkey || '/Apply' WHEN 2 THEN 'https://jobs.example/' || o_orderkey + 1 ELSE CASE WHEN (o_orderkey * 2 + k) % 35 <> 4 THEN 'https://jobs.example/' || o_orderkey END END AS verified FROM orders, (VALUES (0), (1)) v(k)),
  targets AS (SELECT m.match_id, m.profile, j.job_id, j.official_url, j.apply_url, j.after_baseline AND (p.activation IS NULL OR j.first_seen_at > p.activation) AS is_new,
    EXISTS (SELECT 1 FROM (SELECT unnest(j.keys) AS key) x WHERE (m.profile, x.key) IN (SELECT (profile, key) FROM history)) AS notified
    FROM matches m JOIN jobs j ON j.job_id = m.job_id AND j.generation = m.generation JOIN profiles p ON p.profile = m.profile WHERE m.is_active AND j.status = 'open' AND j.canonical AND j.student),
  bad AS (SELECT review, coalesce(decision NOT IN ('approve', 'reject'), true) OR coalesce(trim(rationale, ' ' || chr(9) || chr(10)), '') = '' OR verified IS NULL AS bad FROM reviews),
  judged AS (SELECT r.review, r.profile, r.decision, CASE WHEN NOT bad THEN t.match_id END AS match_id, CASE WHEN bad THEN 'invalid_review_payload' WHEN t.match_id IS NULL THEN 'job_match_not_found' WHEN NOT is_new THEN 'job_is_not_new_after_source_baseline'
    WHEN notified THEN 'posting_identity_already_notified' WHEN verified <> official_url AND (apply_url IS NULL OR verified <> apply_url) THEN 'verified_url_does_not_match_official_url' END AS reason
    FROM reviews r JOIN bad USING (review) LEFT JOIN targets t ON t.job_id = r.job AND t.profile = r.profile)"""


def _judged(spark, sf_dir) -> DataFrame:
    found = delivery.targets(_matches(spark, sf_dir), _jobs(spark, sf_dir), _profiles(spark, sf_dir), _history(spark, sf_dir))
    return delivery.decided(_reviews(spark, sf_dir), found)


@query(f"WITH {CHAIN_SQL}, {REVIEWS_SQL} SELECT * FROM judged")
def review_decisions(spark, sf_dir):
    return _judged(spark, sf_dir)


EFFECTS_SQL = f"""{CHAIN_SQL}, {REVIEWS_SQL}, last AS (SELECT match_id, arg_max(decision, review) AS decision, bool_or(decision = 'reject') AS rejected FROM judged WHERE reason IS NULL GROUP BY 1),
  m2 AS (SELECT m.* EXCLUDE (eligible), CASE WHEN is_active AND decision IS NOT NULL THEN decision = 'approve' ELSE eligible END AS eligible FROM matches m LEFT JOIN last USING (match_id)),
  i2 AS (SELECT * FROM items i WHERE NOT (match_id IN (SELECT match_id FROM last WHERE rejected) AND message_id IN (SELECT message_id FROM messages WHERE status <> 'sent')))"""


@query(f"""WITH {EFFECTS_SQL} SELECT 'match' AS kind, match_id::VARCHAR AS id, (eligible)::INT AS n FROM m2
  UNION ALL SELECT 'items', message_id, count(*)::INT FROM i2 GROUP BY 2 UNION ALL SELECT 'message', message_id, 1 FROM messages WHERE status = 'sent' OR message_id IN (SELECT message_id FROM i2)
  UNION ALL SELECT 'due', profile::VARCHAR, (coalesce(next_digest_at = TIMESTAMP '2026-01-01', false) OR (coalesce(next_digest_at > TIMESTAMP '2026-01-01', true) AND profile IN (SELECT profile FROM judged WHERE reason IS NULL AND decision = 'approve')))::INT FROM profiles""")
def review_effects(spark, sf_dir):
    """Everything that accepted reviews change: eligibility, items of unsent messages, messages left empty, digests due."""
    matches, messages, items, people = delivery.apply_reviews(_matches(spark, sf_dir), _messages(spark, sf_dir), _items(spark, sf_dir), _profiles(spark, sf_dir), _judged(spark, sf_dir), "2026-01-01")
    of = lambda df, kind, key, n: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), n.cast("int").alias("n"))
    due = F.coalesce(F.col("next_digest_at") == F.lit("2026-01-01").cast("timestamp"), F.lit(False))
    counted = items.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
    return of(matches, "match", "match_id", F.col("eligible")).unionByName(of(counted, "items", "message_id", F.col("n"))).unionByName(of(messages, "message", "message_id", F.lit(1))).unionByName(of(people, "due", "profile", due))


# -- plans ---------------------------------------------------------------------------------------------------------------------------

PENDING_SQL = f"""{CHAIN_SQL}, live AS (SELECT m.*, j.keys, j.canonical, coalesce(j.published_at, j.first_seen_at) AS time FROM matches m JOIN jobs j ON j.job_id = m.job_id AND j.generation = m.generation WHERE m.is_active AND m.eligible AND j.status = 'open' AND j.after_baseline),
  claims AS (SELECT match_id, row_number() OVER (PARTITION BY profile, key ORDER BY score DESC, time DESC, match_id) AS n FROM (SELECT *, unnest(keys) AS key FROM live)),
  best AS (SELECT * FROM live WHERE canonical AND match_id NOT IN (SELECT match_id FROM claims WHERE n > 1)),
  told AS (SELECT DISTINCT match_id, recipient FROM (SELECT match_id, profile, unnest(keys) AS key FROM best) JOIN history USING (profile, key)),
  pending AS (SELECT profile, match_id, score, time, recipient FROM best JOIN recipients USING (profile) WHERE (match_id, recipient) NOT IN (SELECT (match_id, recipient) FROM items) AND (match_id, recipient) NOT IN (SELECT (match_id, recipient) FROM told)),
  sets AS (SELECT profile, match_id, score, time, string_agg(recipient, ', ' ORDER BY recipient::VARCHAR) AS recipients FROM pending GROUP BY 1, 2, 3, 4)"""


def _pending(spark, sf_dir) -> DataFrame:
    return delivery.pending(_matches(spark, sf_dir), _jobs(spark, sf_dir), _recipients(spark, sf_dir), _items(spark, sf_dir), _history(spark, sf_dir))


@query(f"WITH {PENDING_SQL} SELECT profile, recipients, match_id, n AS place, ((n - 1) // 5)::BIGINT AS message FROM (SELECT *, row_number() OVER (PARTITION BY profile, recipients ORDER BY score DESC, time DESC, match_id) AS n FROM sets)")
def digest_plan(spark, sf_dir):
    return delivery.numbered(_pending(spark, sf_dir), 5).select("profile", "recipients", "match_id", "place", "message")


@query(f"""WITH {PENDING_SQL}, ready AS (SELECT profile FROM profiles WHERE enabled AND mail_state = 'connected' AND (next_digest_at IS NULL OR next_digest_at <= TIMESTAMP '2026-01-01 00:01:00') AND (lease_until IS NULL OR lease_until <= TIMESTAMP '2026-01-01')),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, time DESC, match_id) AS n FROM sets WHERE profile IN (SELECT profile FROM ready)) WHERE n <= 9),
  own AS (SELECT t.*, row_number() OVER (PARTITION BY t.profile ORDER BY t.n) AS k FROM top t JOIN top l ON l.profile = t.profile AND l.n = 1 AND l.recipients = t.recipients),
  sent AS (SELECT profile, recipients, string_agg(match_id, ',' ORDER BY n) AS matches, count(*) AS n FROM own WHERE k <= 8 GROUP BY 1, 2)
  SELECT p.profile, s.recipients, s.matches, CASE WHEN p.profile NOT IN (SELECT profile FROM ready) THEN strftime(p.next_digest_at, '%Y-%m-%d %H:%M:%S') WHEN coalesce((SELECT count(*) FROM top t WHERE t.profile = p.profile), 0) > coalesce(s.n, 0) THEN '2026-01-01 00:00:00' ELSE '2026-01-01 02:00:00' END AS next_digest
  FROM profiles p LEFT JOIN sent s USING (profile)""")
def planned_digests(spark, sf_dir):
    """One planning of all profiles: the message of each, with its matches best first, and when the profile is due next."""
    messages, items, rests = delivery.plan(_pending(spark, sf_dir), _profiles(spark, sf_dir), "2026-01-01", 8)
    scored = items.select("message_id", "match_id").distinct().join(_matches(spark, sf_dir).select("match_id", "score"), "match_id").join(_jobs(spark, sf_dir).select(F.col("job_id").alias("match_id"), F.coalesce("published_at", "first_seen_at").alias("time")), "match_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.unix_micros("time")).alias("b"), "match_id"))), lambda x: x["match_id"].cast("string"))
    named = scored.groupBy("message_id").agg(F.array_join(listed, ",").alias("matches"))
    own = messages.select("message_id", "profile", "recipients").join(named, "message_id")
    return rests.join(own, "profile", "left").select("profile", "recipients", "matches", F.date_format("next_digest_at", "yyyy-MM-dd HH:mm:ss").alias("next_digest"))


# -- delivery ------------------------------------------------------------------------------------------------------------------------

STATUSES = ("queued", "retryable", "sending", "sent", "failed", "auth_blocked", "queued")
KINDS = ("auth", "retryable", "permanent")


def _mail(spark, sf_dir) -> DataFrame:
    """One message an event, at any point of its delivery."""
    n, at = F.col("event_id"), F.col("ts")
    return table(spark, sf_dir, "events").select(
        n.alias("message_id"), (F.col("user_id") % 25).alias("profile"), F.when(n % 10 > 0, "email").otherwise("push").alias("channel"), _dealt(STATUSES, n).alias("status"), at.alias("scheduled_at"), (F.floor(n / 7) % 6).cast("int").alias("attempt"),
        F.when(n % 7 == 1, at).alias("retry_at"), F.when(n % 7 == 2, at).alias("lease_until"), F.lit("before").alias("error"), F.lit(None).cast("timestamp").alias("sent_at"))


MAIL_SQL = f"""mail AS (SELECT event_id AS message_id, user_id % 25 AS profile, CASE WHEN event_id % 10 > 0 THEN 'email' ELSE 'push' END AS channel, {_sql(STATUSES)}[event_id % 7 + 1] AS status, ts AS scheduled_at, (event_id // 7 % 6)::INT AS attempt,
    CASE WHEN event_id % 7 = 1 THEN ts END AS retry_at, CASE WHEN event_id % 7 = 2 THEN ts END AS lease_until, 'before' AS error FROM events)"""


def _claimed_sql(of: str, at: str, most: int) -> str:
    t = f"TIMESTAMP '{at}'"
    return f"""(WITH free AS (SELECT message_id FROM (SELECT m.message_id, row_number() OVER (PARTITION BY m.profile ORDER BY scheduled_at, m.message_id) AS n FROM {of} m JOIN profiles p ON p.profile = m.profile AND p.enabled AND p.mail_state = 'connected'
      WHERE m.channel = 'email' AND (m.status = 'queued' OR (m.status = 'retryable' AND m.retry_at <= {t}) OR (m.status = 'sending' AND m.lease_until <= {t}))) WHERE n <= {most})
    SELECT m.* REPLACE (CASE WHEN f.message_id IS NOT NULL THEN 'sending' ELSE status END AS status, CASE WHEN f.message_id IS NOT NULL THEN {t} + INTERVAL 5 MINUTES ELSE lease_until END AS lease_until, CASE WHEN f.message_id IS NOT NULL THEN attempt + 1 ELSE attempt END AS attempt,
      CASE WHEN f.message_id IS NULL THEN error END AS error) FROM {of} m LEFT JOIN free f ON f.message_id = m.message_id)"""


def _failed_sql(of: str, at: str) -> str:
    t, kind = f"TIMESTAMP '{at}'", f"{_sql(KINDS)}[message_id % 3 + 1]"
    return f"""(SELECT * REPLACE (CASE WHEN hit THEN CASE {kind} WHEN 'auth' THEN 'auth_blocked' WHEN 'retryable' THEN 'retryable' ELSE 'failed' END ELSE status END AS status, CASE WHEN hit THEN 'refused' ELSE error END AS error, CASE WHEN NOT hit THEN lease_until END AS lease_until,
      CASE WHEN NOT hit THEN retry_at WHEN {kind} = 'retryable' THEN {t} + INTERVAL 1 MINUTE * [5, 15, 60, 360][greatest(least(attempt, 4), 1)] END AS retry_at) FROM (SELECT *, status = 'sending' AND message_id % 4 > 0 AS hit FROM {of}))"""


SHOWN = "message_id, status, attempt, strftime(retry_at, '%Y-%m-%d %H:%M:%S') AS retry_at, strftime(lease_until, '%Y-%m-%d %H:%M:%S') AS lease_until, error"


def _shown(messages: DataFrame) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return messages.select("message_id", "status", "attempt", text("retry_at"), text("lease_until"), "error")


@query(f"WITH {CHAIN_SQL}, {MAIL_SQL}, c AS {_claimed_sql('mail', '2024-01-15', 4)} SELECT {SHOWN} FROM c")
def claimed_messages(spark, sf_dir):
    return _shown(delivery.claim(_mail(spark, sf_dir), _profiles(spark, sf_dir), "2024-01-15"))


def _failures(messages: DataFrame) -> DataFrame:
    hit = messages.filter("status = 'sending' AND message_id % 4 > 0")
    return hit.select("message_id", _dealt(KINDS, F.col("message_id")).alias("kind"), F.lit("refused").alias("reason"))


@query(f"WITH {MAIL_SQL}, f AS {_failed_sql('mail', '2024-01-15')} SELECT {SHOWN} FROM f")
def failed_messages(spark, sf_dir):
    mail = _mail(spark, sf_dir)
    return _shown(delivery.failed(mail, _failures(mail), "2024-01-15"))


@query(f"""WITH {CHAIN_SQL}, {MAIL_SQL}, a AS {_claimed_sql('mail', '2024-01-15', 100)}, b AS {_failed_sql('a', '2024-01-15 00:01:00')},
  c AS (SELECT * REPLACE (CASE WHEN s THEN 'sent' ELSE status END AS status, CASE WHEN NOT s THEN retry_at END AS retry_at, CASE WHEN NOT s THEN lease_until END AS lease_until, CASE WHEN NOT s THEN error END AS error) FROM (SELECT *, status = 'sending' AND message_id % 8 = 0 AS s FROM b)),
  d AS (SELECT * REPLACE (CASE WHEN s THEN 'queued' ELSE status END AS status, CASE WHEN s THEN TIMESTAMP '2024-01-15 00:02:00' ELSE retry_at END AS retry_at, CASE WHEN NOT s THEN lease_until END AS lease_until, CASE WHEN NOT s THEN error END AS error, CASE WHEN s THEN greatest(attempt - 1, 0) ELSE attempt END AS attempt) FROM (SELECT *, status = 'sending' AND message_id % 8 = 4 AS s FROM c)),
  e AS (SELECT * REPLACE (CASE WHEN s THEN 'retryable' ELSE status END AS status, CASE WHEN s THEN TIMESTAMP '2024-01-15 00:03:00' ELSE retry_at END AS retry_at, CASE WHEN NOT s THEN error END AS error) FROM (SELECT *, profile = 1 AND channel = 'email' AND status IN ('auth_blocked', 'failed') AS s FROM d)),
  f AS {_claimed_sql('(SELECT * EXCLUDE (hit, s) FROM e)', '2024-01-15 00:10:00', 100)} SELECT {SHOWN} FROM f WHERE NOT (profile = 2 AND status <> 'sent')""".replace("FROM (SELECT *, status = 'sending' AND message_id % 8 = 4 AS s FROM c)", "FROM (SELECT * EXCLUDE (s), status = 'sending' AND message_id % 8 = 4 AS s FROM c)").replace("FROM (SELECT *, profile = 1", "FROM (SELECT * EXCLUDE (s), profile = 1"))
def message_chain(spark, sf_dir):
    """Claimed, refused in three ways, sent, given back, retried, claimed again (retried ones among them), and one profile's backlog cleared."""
    people = _profiles(spark, sf_dir)
    mail = delivery.claim(_mail(spark, sf_dir), people, "2024-01-15", 100)
    mail = delivery.failed(mail, _failures(mail), "2024-01-15 00:01:00")
    mail = delivery.sent(mail, mail.filter("message_id % 8 = 0"), "2024-01-15 00:02:00")
    mail = delivery.released(mail, mail.filter("message_id % 8 = 4"), "2024-01-15 00:02:00")
    mail = delivery.claim(delivery.retried(mail, 1, "2024-01-15 00:03:00"), people, "2024-01-15 00:10:00", 100)
    matches = _matches(spark, sf_dir)
    return _shown(delivery.cleared(mail, _items(spark, sf_dir).withColumn("message_id", F.lit(0).cast("long")), matches, 2)[0])


# -- the stream ----------------------------------------------------------------------------------------------------------------------

EVENTS = ("plan", "claim", "fail", "claim", "release", "claim", "retry", "fail", "claim", "sent", "clear", "claim", "fail", "plan", "retry")


def delivery_events(events: DataFrame) -> DataFrame:
    """What happened to the message of each user."""
    n = F.col("event_id")
    failure = F.when(F.col("event_type") == "error", "fail:auth").when(F.col("event_type") == "purchase", "fail:permanent").otherwise("fail:retryable")
    kind = F.when((n % 15 == 9) & (n % 4 > 0), "claim").otherwise(_dealt(EVENTS, n))
    return events.select(F.col("user_id").alias("message_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.when(kind == "fail", failure).otherwise(kind).alias("kind"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS m, event_id, ts AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE WHEN event_id % 15 = 9 AND event_id % 4 > 0 THEN 'claim' WHEN {_sql(EVENTS)}[event_id % 15 + 1] <> 'fail' THEN {_sql(EVENTS)}[event_id % 15 + 1] WHEN event_type = 'error' THEN 'fail:auth' WHEN event_type = 'purchase' THEN 'fail:permanent' ELSE 'fail:retryable' END AS kind FROM events),
  run AS (SELECT user_id AS m, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS moment, NULL::VARCHAR AS kind, false AS did, NULL::VARCHAR AS status, 0 AS attempt, NULL::TIMESTAMP AS retry_at, NULL::TIMESTAMP AS lease_until FROM events GROUP BY 1
    UNION ALL SELECT m, n, event_id, moment, kind, did,
      CASE WHEN NOT did THEN status WHEN kind = 'plan' OR kind = 'release' THEN 'queued' WHEN kind = 'clear' THEN NULL WHEN kind = 'claim' THEN 'sending' WHEN kind = 'sent' THEN 'sent' WHEN kind = 'fail:auth' THEN 'auth_blocked' WHEN kind = 'fail:permanent' THEN 'failed' ELSE 'retryable' END,
      CASE WHEN NOT did THEN attempt WHEN kind IN ('plan', 'clear') THEN 0 WHEN kind = 'claim' THEN attempt + 1 WHEN kind = 'release' THEN greatest(0, attempt - 1) ELSE attempt END,
      CASE WHEN NOT did THEN retry_at WHEN kind IN ('release', 'retry') THEN moment WHEN kind = 'claim' THEN retry_at WHEN kind = 'fail:retryable' THEN moment + INTERVAL 1 MINUTE * [5, 15, 60, 360][greatest(1, least(attempt, 4))] END,
      CASE WHEN NOT did THEN lease_until WHEN kind = 'claim' THEN moment + INTERVAL 5 MINUTES WHEN kind = 'retry' THEN lease_until END
    FROM (SELECT e.*, r.status, r.attempt, r.retry_at, r.lease_until, coalesce(CASE WHEN e.kind = 'plan' THEN r.status IS NULL WHEN e.kind = 'clear' THEN r.status <> 'sent' WHEN e.kind = 'claim' THEN r.status = 'queued' OR (r.status = 'retryable' AND r.retry_at <= e.moment) OR (r.status = 'sending' AND r.lease_until <= e.moment)
        WHEN e.kind = 'retry' THEN r.status IN ('auth_blocked', 'failed') ELSE r.status = 'sending' END, false) AS did FROM run r JOIN e ON e.m = r.m AND e.n = r.n + 1))
  SELECT m AS message_id, event_id, kind, status, attempt, strftime(retry_at, '%Y-%m-%d %H:%M:%S') AS retry_at, strftime(lease_until, '%Y-%m-%d %H:%M:%S') AS lease_until FROM run WHERE did""")
def delivery_states(spark, sf_dir):
    """The stream of deliveries over all events, run until nothing is left: a row an event that changed its message."""
    folder = new_folder(spark, "deliveries")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the source takes no single file
    deliveries.start(delivery_events(source), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(f"{folder}/changes").filter("kind <> 'due'").select("message_id", "event_id", "kind", "status", "attempt", text("retry_at"), text("lease_until"))
