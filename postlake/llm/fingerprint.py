"""Threshold-scaled document fingerprints.

A fingerprint keeps every 48-bit shingle hash below one fixed fraction of the
hash range, so the sketches of any two documents, however unequal, are samples
by the same rule: their union is the sketch of both texts' shingles, and the share of one
in the other estimates containment. A text none of whose hashes falls
below the fraction keeps its smallest one, so only a text without words has
an empty fingerprint.

A hash kept that way is no sample by the common rule: containment does not count it
(null where nothing else is known), and likeness only against another text of that kind.

Shingles are five successive lower-cased words, or all words where there are
fewer. Everything is a projection by built-in functions.

Defined cases: a null text counts as empty; two empty fingerprints are alike
(1.0), an empty and a filled one are not (0.0); the next document of a repeated
id is the row with the smallest text start of the next id; a null id comes first;
texts are read whole, however long; an empty table gives an empty result; columns of any other
name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

HASH_BITS = 48
DIGITS = HASH_BITS // 4
MARGIN = " \t\n\x0b\x0c\r"


def sketch(df: DataFrame, text: str, out: str, words: int = 5, one_in: int = 8) -> DataFrame:
    """df with out, the sorted retained hashes (array<bigint>) of the column text.

    Each step is a column of its own, so no lambda repeats the work of an earlier one.
    """
    w = F.split(F.lower(F.btrim(text, F.lit(MARGIN))), r"[\x20\x09-\x0D]+")
    df = df.withColumn("_w", F.transform(F.when(F.length(F.btrim(text, F.lit(MARGIN))) > 0, w).otherwise(F.array().cast("array<string>")), lambda x: F.xxhash64(x)))
    heads = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - (words - 1), F.lit(1)))
    full = lambda h, i: F.xxhash64(h, *[F.get("_w", i + k) for k in range(1, words)]).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    df = df.withColumn("_s", F.transform(heads, full)).drop("_w")
    df = df.withColumn("_k", F.filter("_s", lambda h: h < (1 << HASH_BITS) // one_in))
    kept = F.when(F.size("_k") > 0, F.array_sort(F.array_distinct("_k"))).when(F.size("_s") > 0, F.array(F.array_min("_s"))).otherwise(F.col("_k"))
    return df.withColumn(out, kept).drop("_s", "_k")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def within(s: Column, one_in: int = 8) -> Column:
    """The hashes below the fraction: all of a sketch but the one kept for a text that has none there."""
    return F.filter(s, lambda h: h < (1 << HASH_BITS) // one_in)


def likeness(a: Column, b: Column, one_in: int = 8) -> Column:
    """Estimated Jaccard likeness, 0 to 1. A smallest hash kept beyond the fraction counts only against another such."""
    x, y = within(a, one_in), within(b, one_in)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise((a == b).cast("double"))


def containment(a: Column, b: Column, one_in: int = 8) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a, null if a has no hash below the fraction to judge by."""
    x = within(a, one_in)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(x) > 0, F.size(F.array_intersect(x, within(b, one_in))) / F.size(x))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), DIGITS, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, prev_id, prev_chars) of every distinct id of docs(id, text): the id before in ascending order, the first after the last.

    Ids are dealt out by range; each range looks back within itself, and its first id to the last of the range
    before, found among one row per range.
    """
    ids = docs.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows"))
    ids = written(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("id")
    local = ids.withColumn("before", F.lag(F.struct("id", "n")).over(own))
    ends = ids.groupBy("part").agg(F.max(F.struct("id", "n")).alias("end"))
    chain = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(chain), F.last("end").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    # one row per range of ids
    local = local.join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "end"))
    return local.select("id", "rows", F.col("before.id").alias("prev_id"), F.col("before.n").alias("prev_chars"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, one_in: int = 8) -> DataFrame:
    """One row per row of docs: id_col, n_chars, fingerprint (hex digits, 12 a hash)."""
    df = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return sketch(df, "text", "f", words, one_in).select(F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), as_text(F.col("f")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, one_in: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document.

    Texts move once, by id; what goes to the row before is the start it needs and the sketch.
    """
    df = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    hop = neighbours(df)
    repeated = not hop.filter("rows > 1").isEmpty()
    df = sketch(df, "text", "f", words, one_in)
    right = df.join(hop.withColumnRenamed("id", "its_id"), F.col("id").eqNullSafe(F.col("its_id")))
    right = right.select("prev_id", F.expr("substring(text, 1, int(prev_chars div 4))").alias("start"), F.col("f").alias("next_f"))
    if repeated:
        right = right.groupBy("prev_id").agg(F.min(F.struct("start", "next_f")).alias("s")).select("prev_id", "s.*")
    both = df.join(right, F.col("id").eqNullSafe(F.col("prev_id")))
    n = F.length("text")
    both = both.select("id", n.cast("long").alias("n_chars"), "f", "next_f", F.expr("concat(substring(text, 1, length(text) - int(length(text) div 4)), substring(start, 1, int(length(text) div 4)))").alias("edited"))
    both = sketch(both, "edited", "e", words, one_in)
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e"), one_in).alias("near_edited"), likeness(F.col("f"), F.col("next_f"), one_in).alias("near_next"),
        containment(F.col("f"), F.col("e"), one_in).alias("share_in_edited"), containment(F.col("e"), F.col("f"), one_in).alias("share_of_edited"),
        containment(F.col("f"), F.col("next_f"), one_in).alias("share_in_next"), containment(F.col("next_f"), F.col("f"), one_in).alias("share_of_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
