"""Queries on keys and groups beyond those of the small tables."""

import os

import duckdb
from oracle import connect, same
from pyspark.sql import functions as F

import postlake.plans.audit_plans  # noqa: F401
from postlake.plans import lifecycle_plans, search_plans, state_plans  # noqa: F401
from postlake.operators import classify, lifecycle, projections
from postlake.plans.catalog import QUERIES, SQL
from postlake.sources import rich
from postlake.sources.proxy import listings

TABLES = "/root/testdata/sf0.001"


def moved(folder, table: str, **columns: str) -> str:
    """A folder with a table of sf0.001 whose columns are replaced by expressions."""
    changes = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    duckdb.sql(f"COPY (SELECT * REPLACE ({changes}) FROM '{TABLES}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return os.fspath(folder)


def test_identities_of_numbers_with_more_than_six_digits(spark, tmp_path):
    folder = moved(tmp_path, "orders", o_orderkey="o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 12000000 WHEN o_orderkey % 3 = 1 THEN 999200 ELSE 0 END")
    same(QUERIES["verified_identities"](spark, folder), SQL["verified_identities"], connect(folder))


def test_labels_of_a_table_in_one_file_are_made_by_many_tasks(spark):
    rows = listings(spark, TABLES)
    assert rows.rdd.getNumPartitions() == 1
    labelled = classify.classified(rows, ("region",))
    assert labelled.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    sizes = labelled.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * -(-rows.count() // labelled.rdd.getNumPartitions())


def test_labels_that_a_query_filters_by_are_made_after_the_deal(spark):
    for name, label in (("job_areas", "data science"), ("resume_matches", "clearance")):
        plan = QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("REPARTITION_BY_NUM")
        assert label in above and label not in below, name


def test_a_pass_of_a_drain_reads_pages_that_were_put_together_once(spark):
    crawl = state_plans._catalog_pages(spark, TABLES)
    open_ = spark.sql("SELECT id AS source_id, 1L AS cursor FROM range(10)")
    assert not [f for f in crawl(open_, 0).inputFiles() if "lineitem" in f]


def test_matches_are_looked_up_by_one_move_of_narrow_rows(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 1), (2L, 2), (3L, 1), (4L, NULL) AS t(id, open_generation)")
    topics_ = spark.sql("SELECT * FROM VALUES (1L, 'area:b'), (1L, 'area:a'), (2L, 'year:2027') AS t(job_id, topic_key)")
    found = spark.sql("SELECT * FROM VALUES (1L, 1, true, 5, 'x'), (1L, 1, true, 7, 'y'), (1L, 2, true, 9, 'z'), (2L, 2, false, 8, 'x'), (3L, 1, true, NULL, 'x'), (4L, NULL, true, 3, 'x') AS t(job_id, open_generation, is_active, score, evidence)")
    got = projections.looked_up(rows, topics_, found).orderBy("id").collect()
    assert [tuple(r)[2:] for r in got] == [(["a", "b"], 7, "y"), (None, None, None), (None, None, None), (None, None, None)]
    plan = QUERIES["posting_detail_view"](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert not any("security_clearance" in part for part in plan[1:])  # put together after the joins


def test_topics_come_in_parts_that_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(rich, "PART", 100)
    assert rich.topics(spark, TABLES).rdd.getNumPartitions() == spark.read.parquet(f"{TABLES}/lineitem.parquet").count() // 100


def test_a_held_lease_keeps_its_source_out_of_the_batch_and_a_past_one_does_not(spark, monkeypatch):
    rule, batch = lifecycle.lease_due, lambda: {r.source_id for r in QUERIES["leased_sources"](spark, TABLES).collect()}
    taken = batch()
    monkeypatch.setattr(lifecycle, "lease_due", lambda sources, *rest: rule(sources.withColumn("lease_until", F.lit(None).cast("timestamp")), *rest))
    kept_out = batch() - taken
    assert kept_out and all(s % 18 == 9 for s in kept_out)
    assert len(taken) == 30 and any(s % 18 == 0 for s in taken)
