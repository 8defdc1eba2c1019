"""Labels of raw listings: one projection over rows dealt evenly to all tasks, ready for the snapshot merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import classifiers as C


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


#: Columns that others are made from.
NEEDS = {"kind": ("program", "type"), "years": ("program", "type", "kind")}
ALL = ("program", "type", "region", "topic", "areas", "kind", "years")


def dealt(rows: DataFrame) -> DataFrame:
    """rows, evenly over at least two tasks a core: narrow tables come in few files, and labels cost far more than a row's way to another task.

    The number of the task is asked for, as a filter on a label would else be made before the rows are dealt, in the few tasks of the scan.
    """
    spark = rows.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    return rows.withColumn("_task", F.spark_partition_id()).filter("_task >= 0").drop("_task")


def classified(listings: DataFrame, labels: tuple[str, ...] = ALL) -> DataFrame:
    """listings with the named label columns; of ``id, title, employment_type, location, body, skills, published_at``."""
    fields = {name: F.col("title") if name == "title" else _none() for name in ("title", "department", "team", "businessUnit", "jobFamily", "jobFunction")}
    made = {
        "program": lambda: C.programs(F.col("title")), "type": lambda: C.employment_type(F.col("employment_type")),
        "region": lambda: C.region(F.col("location"), _none(), _none(), _none(), _none("array<string>")),
        "topic": lambda: C.ai_data_topic(fields, F.col("skills"), [F.col("body")]), "areas": lambda: C.areas(fields, F.col("skills"), [F.col("body")]),
        "kind": lambda: C.effective_program(F.col("type"), F.col("program.internship"), F.col("program.coop")),
        "years": lambda: C.recruiting_years(F.col("title"), F.col("body"), C.in_united_states(_none(), F.col("location")), F.col("published_at"), F.col("kind.keys")),
    }
    listings = dealt(listings)
    wanted = {*labels, *(n for x in labels for n in NEEDS.get(x, ()))}
    for step in (ALL[:5], ALL[5:6], ALL[6:]):
        listings = listings.withColumns({name: made[name]() for name in step if name in wanted})
    return listings


def scored(labelled: DataFrame, target_year: int = 2027) -> DataFrame:
    """labelled rows of :func:`classified` with the column match: eligible, score, evidence, exclusion."""
    own = {
        "title": F.col("title"), "description": F.col("body"), "qualifications": F.col("body"), "skills": F.col("skills"), "program_keys": F.col("kind.keys"), "region": F.col("region"),
        "recruiting_years": F.col("years.year"), "published_at": F.col("published_at"),
    }
    return labelled.withColumn("match", C.resume_match(lambda name: own[name] if name in own else _none(), target_year))
