"""Postings, sources and crawl runs as read from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str, titled: bool = True) -> DataFrame:
    """One row per order: a posting of the customer's career site, titled by its lowest part; untitled ones read no lines and parts."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    sites = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = t("orders").join(sites, F.col("o_custkey") == F.col("c_custkey"))
    title = []
    if titled:
        first_part = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
        titles = first_part.join(t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title")), "p_partkey").select("l_orderkey", "title")
        rows = rows.join(titles, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        title = [F.coalesce("title", F.lit("")).alias("title")]
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("c_name").alias("company"), "country", "region",
        *title, F.col("o_orderpriority").alias("employment_type"),
        F.format_string("https://jobs.example/%d/%s", F.col("o_custkey") % 500, F.col("o_orderpriority")).alias("official_url"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_seen_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published_at"),
        F.col("o_totalprice").alias("salary_min"), (F.col("o_totalprice") + 5000.0).alias("salary_max"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a crawl run of the source user_id."""
    e = table(spark, sf_dir, "events")
    kinds = e.withColumn("n", (F.col("event_id") + F.col("user_id")) % 4)
    status = F.when(F.col("n") == 0, "succeeded").when(F.col("n") == 1, "failed").when(F.col("n") == 2, "blocked").otherwise("running")
    return kinds.select("event_id", F.col("user_id").alias("source_id"), status.alias("status"), F.col("ts").alias("finished_at"), F.col("value").alias("jobs_seen"), F.get_json_object("props", "$.k").cast("long").alias("k"))


#: Wordings that the listings take in turn, by p_partkey modulo their number.
TITLES = ("Machine Learning Intern", "Internal Auditor", "Backend Developer Co-op", "Werkstudent Data Science", "Nurse Extern", "2027 Estágio em Finanças", "Firmware Engineer", "Stage Manager 2026", "AI Recruiting Intern", "Fraud Analytics Internship", "PhD Research Scientist Intern")
TYPES = ("FULL_TIME", '["Part time","Temp"]', "Intern; Regular", "Co-Op (Fixed Term)", "R244285", None, "[broken")
LOCATIONS = ("Chicago, IL", "Toronto, Ontario, Canada", "Remote", "East Syracuse, NY, 13057 USA", "Vancouver, BC V6B 1A1", "Albuquerque, New Mexico", "21 Locations", "São Paulo, Brazil", "CA")
BODIES = ("We train Python and SQL. Master's students welcome.", "Fall 2027 intern program; graduation in Spring 2030 required.", "Rotations include data engineering and machine learning.", None, "Must be a U.S. citizen.")
CAREER_URLS = ("https://boards.greenhouse.io/a", "https://jobs.lever.co/a", "https://a.example/search-results", "https://careers.example/jobs", "https://A.WD5.MYWORKDAYJOBS.com/x", None)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: a raw listing with title, employment_type, location, body, url, skills and published_at."""
    def dealt(wordings: tuple[str | None, ...]) -> Column:
        return F.get(F.array(*[F.lit(w).cast("string") for w in wordings]), (F.col("p_partkey") % len(wordings)).cast("int"))

    skills = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("PyTorch"), F.lit("SQL"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), dealt(TITLES).alias("title"), dealt(TYPES).alias("employment_type"), dealt(LOCATIONS).alias("location"), dealt(BODIES).alias("body"),
        dealt(CAREER_URLS).alias("url"), skills.alias("skills"), F.when(F.col("p_partkey") % 3 == 0, "2026-08-07").alias("published_at"))


RUNS_SQL = """
runs AS (
  SELECT event_id, user_id AS source_id, ts AS finished_at, value AS jobs_seen, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE (event_id + user_id) % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'blocked' ELSE 'running' END AS status
  FROM events)
"""
#: The same relations for the oracle.
POSTINGS_SQL = """
postings AS (
  SELECT o_orderkey AS id, o_custkey AS source_id, c_name AS company, n_name AS country, r_name AS region,
    coalesce((SELECT p_name || ' ' || p_type FROM part WHERE p_partkey = f.k), '') AS title, o_orderpriority AS employment_type,
    'https://jobs.example/' || (o_custkey % 500) || '/' || o_orderpriority AS official_url,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status,
    strftime(o_orderdate, '%Y-%m-%d') AS first_seen_at,
    CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS published_at,
    o_totalprice AS salary_min, o_totalprice + 5000.0 AS salary_max
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1) f ON l_orderkey = o_orderkey)
"""
