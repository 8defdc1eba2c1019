"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at rows that the level before left undecided. A row whose
length is unique is settled without a hash, one whose (length, prefix hash) is
unique without reading on, and only the rest get a full hash and a shuffle on
it; the text of settled rows never moves. What a level leaves undecided is known
to the next through a bitmap of ``slots`` bits, sized by the number of rows up to 64 MB:
a slot that two keys share costs a needless hash, never a wrong answer.

Defined cases: a null text counts as empty; a null id ranks below all others;
of rows that repeat both text and id one stays; an empty table gives an empty
result; texts are hashed whole, however long; columns of any other name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, maybe_in, packed, slots_for


def _undecided(rows: DataFrame, key: Column, slots: int) -> DataFrame:
    """Mark rows whose key may occur again."""
    rows = rows.withColumn("_key", key)
    again = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return maybe_in(rows, F.col("_key"), again, F.col("_key"), "_alive", slots).drop("_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, keep_rows: bool = False, prefix_chars: int = 256, slots: int | None = None) -> DataFrame:
    """One row per row of docs: ``id_col``, keep_id, group_size, kept, the columns of extra (expressions over the
    text as ``_text``), and with keep_rows ``row``, the whole input row as a struct.

    Of equal texts the row with the largest id stays.
    """
    carried = [*(extra or {}), *(["row"] if keep_rows else [])]
    n_rows = docs.count()
    slots = slots or slots_for(n_rows)
    rows = packed(docs, id_col, text_col).withColumnsRenamed({id_col: "_id", text_col: "_text"})
    rows = rows.withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    rows = rows if keep_rows else rows.drop("row")
    rows = rows.withColumn("_len", F.length("_text").cast("long"))

    by_length = _undecided(rows, F.col("_len"), slots)
    settled = ["_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carried]
    marked = _undecided(by_length.filter("_alive").drop("_alive"), F.xxhash64("_len", F.substring("_text", 1, prefix_chars)), slots)
    lone = by_length.filter("not _alive").withColumns(extra or {}).select(*settled)
    lone = lone.unionByName(marked.filter("not _alive").withColumns(extra or {}).select(*settled))

    rest = marked.filter("_alive").withColumns(extra or {}).select("_id", F.sha2("_text", 256).alias("_full"), *carried)
    groups = rest.groupBy("_full", "_id").agg(F.count(F.lit(1)).alias("n")).groupBy("_full").agg(F.max("_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # every id has a window of its own, and the join splits large groups, so a group of copies spreads over all tasks
    first = F.row_number().over(Window.partitionBy("_full", "_id").orderBy(F.lit(1)))
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_first") == 1)
    rest = join_hot(rest.withColumn("_first", first), groups, "_full", groups.select("_full", F.col("group_size").alias("_n")), n_rows, ["_id"]).select("_id", "keep_id", "group_size", kept.alias("kept"), *carried)
    return lone.unionByName(rest).withColumnRenamed("_id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text another kept row has."""
    out = exact_dedup(docs, id_col, text_col, keep_rows=True).filter("kept")
    return out.select("row.*").toDF(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, extra={"text_sha256": F.sha2("_text", 256)})
