"""Postings with titles, arrays and topics, as read from the star-schema tables, and the same relations for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.sources.proxy import table

#: Wordings that titles and types are put together from, by the order's key.
ROLES = ("Data Engineer", "Nurse Extern", "Software Intern", "Surgical Tech Externship", "Regular Analyst", "Élève Ingénieur", "Product Co-op", "Radiology Extern", "Internal Auditor", "Machine Learning Intern")
JOINS = (" - ", "/", " (", ", ", " – ", " | ", ": ")
TIMES = ("2026", "Summer 2027", "12027", "Fall", "regular", "Winter 2027/Spring 2028", "", "summertime", "2100", "1999")
TYPES = ("Full-Time", "Intern", "Co-Op (Fixed Term)", "regular", "Part_Time", "Contract", "Phoenix", None)
SKILLS = (("Python", "SQL"), ("sql", " Spark "), (), ("R",), None)


#: Lines of a part of topics.
PART = 500_000


def _dealt(values, n: Column) -> Column:
    kind = "array<string>" if any(isinstance(v, tuple) for v in values) else "string"
    lit = lambda v: F.lit(None).cast(kind) if v is None else F.array(*map(F.lit, v)).cast(kind) if isinstance(v, tuple) else F.lit(v)
    return F.get(F.array(*map(lit, values)), (n % len(values)).cast("int"))


def generation(n: Column) -> Column:
    return (n % 2 + 1).cast("int")


def rich_postings(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per order, with every column that a filter or a projection reads; no title needs another table.

    orders may be given with columns more, which stay: what is joined to orders moves fewer bytes than what is joined to postings.
    """
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sites = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = (t("orders") if orders is None else orders).join(sites, F.col("o_custkey") == F.col("c_custkey"))
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return rows.select(
        n.alias("id"), F.col("o_custkey").alias("source_id"), F.col("c_name").alias("company"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.concat(F.lit("City "), n % 40).alias("city"),
        F.concat_ws(", ", F.concat(F.lit("City "), n % 40), "n_name").alias("location"), F.concat(_dealt(ROLES, n), _dealt(JOINS, n), _dealt(TIMES, n + F.col("o_custkey"))).alias("title"),
        _dealt(TYPES, n + F.col("o_custkey") % 3).alias("employment_type"), F.format_string("https://jobs.example/%d/%s", F.col("o_custkey") % 500, F.col("o_orderpriority")).alias("official_url"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), day.alias("first_seen_at"), F.when(F.col("o_orderpriority") != "5-LOW", day).alias("published_at"),
        F.when(n % 3 > 0, F.date_format(F.date_add("o_orderdate", 900), "yyyy-MM-dd")).alias("valid_through"), F.when(n % 4 == 0, "remote").when(n % 4 == 1, "hybrid").otherwise("onsite").alias("arrangement"),
        F.when(n % 5 == 0, "saved").otherwise("new").alias("review_state"), F.col("c_mktsegment").alias("department"), F.col("o_orderpriority").alias("team"), _dealt(SKILLS, n).alias("skills"),
        F.array(F.when(n % 2 == 0, "English").otherwise("Français")).alias("languages"), F.col("o_totalprice").alias("salary_min"), (F.col("o_totalprice") + 5000.0).alias("salary_max"),
        F.when(n % 6 > 0, F.concat(F.lit("Summary "), n)).alias("summary"), F.concat(F.lit("Résumé of team "), "o_orderpriority").alias("description"), generation(n).alias("open_generation"), *more,
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, topic_key), distinct: two topics stated by each line of an order."""
    kind = F.when(F.col("l_returnflag") == "A", "program:internship").when(F.col("l_returnflag") == "R", "program:coop").when(F.col("l_linestatus") == "O", "year:2027").otherwise("ai-data")
    area = F.when(F.col("l_linenumber") == 1, "area:ai-ml").when(F.col("l_linenumber") == 2, "area:data-analytics").otherwise("area:software-engineering")
    lines = table(spark, sf_dir, "lineitem")
    # dealt by posting in parts of bounded size, so that no task holds the repeats of a whole split, and what goes on by posting moves no more
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // PART)
    return lines.select(F.col("l_orderkey").alias("job_id"), F.explode(F.array(kind, area)).alias("topic_key")).repartition(parts, "job_id").distinct()


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: its score for the profile, its generation and whether it still stands."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("job_id"), (n % 101).cast("int").alias("score"), (n % 7 > 0).alias("is_active"), (n % 3 + 1).cast("int").alias("open_generation"))


def _sql(values) -> str:
    one = lambda v: "NULL" if v is None else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, tuple) else f"'{v}'"
    return "[" + ", ".join(map(one, values)) + "]"


RICH_SQL = f"""
rich AS (
  SELECT o_orderkey AS id, o_custkey AS source_id, c_name AS company, n_name AS country, r_name AS region, 'City ' || (o_orderkey % 40) AS city, 'City ' || (o_orderkey % 40) || ', ' || n_name AS location,
    {_sql(ROLES)}[o_orderkey % {len(ROLES)} + 1] || {_sql(JOINS)}[o_orderkey % {len(JOINS)} + 1] || {_sql(TIMES)}[(o_orderkey + o_custkey) % {len(TIMES)} + 1] AS title,
    {_sql(TYPES)}[(o_orderkey + o_custkey % 3) % {len(TYPES)} + 1] AS employment_type, 'https://jobs.example/' || (o_custkey % 500) || '/' || o_orderpriority AS official_url,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS first_seen_at, CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS published_at,
    CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate::DATE + 900, '%Y-%m-%d') END AS valid_through, CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'onsite' END AS arrangement,
    CASE WHEN o_orderkey % 5 = 0 THEN 'saved' ELSE 'new' END AS review_state, c_mktsegment AS department, o_orderpriority AS team, {_sql(SKILLS)}[o_orderkey % {len(SKILLS)} + 1] AS skills,
    [CASE WHEN o_orderkey % 2 = 0 THEN 'English' ELSE 'Français' END] AS languages, o_totalprice AS salary_min, o_totalprice + 5000.0 AS salary_max,
    CASE WHEN o_orderkey % 6 > 0 THEN 'Summary ' || o_orderkey END AS summary, 'Résumé of team ' || o_orderpriority AS description, (o_orderkey % 2 + 1)::INT AS open_generation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY official_url ORDER BY first_seen_at DESC, company, id) AS nth FROM rich WHERE status = 'open') WHERE nth = 1),
topics AS (SELECT DISTINCT l_orderkey AS job_id, unnest([CASE WHEN l_returnflag = 'A' THEN 'program:internship' WHEN l_returnflag = 'R' THEN 'program:coop' WHEN l_linestatus = 'O' THEN 'year:2027' ELSE 'ai-data' END,
  CASE l_linenumber WHEN 1 THEN 'area:ai-ml' WHEN 2 THEN 'area:data-analytics' ELSE 'area:software-engineering' END]) AS topic_key FROM lineitem),
matches AS (SELECT o_orderkey AS job_id, (o_orderkey % 101)::INT AS score, o_orderkey % 7 > 0 AS is_active, (o_orderkey % 3 + 1)::INT AS open_generation FROM orders)
"""
