"""Facets of the canonical postings in one pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.titles import SEASONS, has_any, padded, plain_type

KEYS = ("company", "country", "region", "employment_type")
ARRAYS = ("skills", "languages")
# The employment types that the facet shows, without _, -, / and spaces.
SHOWN_TYPES = (
    "fulltime", "fulltimeemployee", "modifiedfulltime", "parttime", "temporary", "contractor", "contract", "intern", "internship", "regular", "permanent", "seasonal", "casual", "freelance",
    "apprentice", "apprenticeship", "fixedterm", "fixedtermcontract", "employeeregularpermanent",
)


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.trim(value).alias("label"))


def _pairs(array: str) -> Column:
    return F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda v: _pair(array, v))


def own_values(found: DataFrame, keys=KEYS, arrays=(), derived: bool = False) -> DataFrame:
    """(key, label, official_url) of what the postings themselves state: columns, arrays and, derived, words of the title."""
    each = [F.array(*[_pair(k, F.col(k).cast("string")) for k in keys])]
    each += [_pairs(a) for a in arrays]
    if derived:
        title = padded(F.col("title"))
        words = F.split(title, " +")
        each.append(F.array(*[F.when(has_any(title, [s]), _pair("seasons", F.lit(s))) for s in SEASONS], F.when(has_any(title, ["regular"]), _pair("programs", F.lit("regular")))))
        each.append(F.transform(F.filter(words, lambda w: w.rlike("^20[0-9][0-9]$|^2100$")), lambda w: _pair("years", w)))
    rows = found.select(F.explode(F.concat(*each)).alias("p"), "official_url").filter("p is not null").select("p.*", "official_url")
    shown = (F.col("key") != "employment_type") | plain_type(F.col("label")).isin(*SHOWN_TYPES)
    return rows.filter(shown) if derived else rows


def topic_values(found: DataFrame, topics: DataFrame) -> DataFrame:
    """(key, label, official_url) of program and year topics."""
    t = topics.filter(F.startswith("topic_key", F.lit("program:")) | F.col("topic_key").rlike("^year:[0-9]{4}$"))
    t = t.select(F.col("job_id").alias("id"), F.when(F.startswith("topic_key", F.lit("year:")), "years").otherwise("programs").alias("key"), F.substring_index("topic_key", ":", -1).alias("label"))
    return t.join(found.select("id", "official_url"), "id").select("key", "label", "official_url")


def counted(rows: DataFrame, most: int = 100) -> DataFrame:
    """(key, value, jobs): per key the values with most distinct urls, named by their smallest spelling."""
    rows = rows.filter("label <> ''")
    values = rows.groupBy("key", F.lower("label").alias("norm")).agg(F.min("label").alias("value"), F.countDistinct("official_url").alias("jobs"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("jobs"), F.lower("value"), "value"))
    return values.withColumn("n", nth).filter(F.col("n") <= most).select("key", "value", "jobs")


def facets(found: DataFrame, keys=KEYS, most: int = 100) -> DataFrame:
    return counted(own_values(found, keys), most)


def all_facets(found: DataFrame, topics: DataFrame, keys=KEYS, arrays=ARRAYS, most: int = 100) -> DataFrame:
    """Columns, arrays, programs, seasons and years as one union that is grouped once."""
    return counted(own_values(found, keys, arrays, derived=True).unionByName(topic_values(found, topics)), most)


def season_values(spark) -> DataFrame:
    """The seasons as a relation of one column."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{s}')" for s in SEASONS) + " AS seasons(value)")


def season_facet(found: DataFrame, seasons: DataFrame) -> DataFrame:
    """(value, jobs): of each of seasons(value) the distinct urls whose title has it as a word."""
    words = found.select("official_url", F.explode(F.array_distinct(F.split(padded(F.col("title")), " +"))).alias("value"))
    return words.join(F.broadcast(seasons), "value").groupBy("value").agg(F.countDistinct("official_url").alias("jobs"))  # four rows
