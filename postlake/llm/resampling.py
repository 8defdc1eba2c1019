"""Target-distribution importance resampling by hashed n-grams over an integer word dictionary.

Features of a text are its runs of one to three words, each in the bucket that the CRC of its bytes names. Documents
whose buckets are commoner in the target than in the corpus weigh more, and a seeded Gumbel draw without
replacement takes a share of them.

A task maps the distinct words of a batch to ids and writes runs as tuples of ids: a run of k words is the id of
its first k - 1 words beside the id of the last. Each distinct tuple of the batch is spelled out and hashed once: the CRC of the
shorter run goes on over a space and the last word, which is the CRC of the whole run's bytes. The buckets are then joined back
to every place where the tuple stands. Dictionaries live within a batch: shuffling all distinct tuples of a corpus would
move several times its size. What crosses tasks are the counts of ``buckets`` buckets, whatever the input.

The buckets of each document are written once to the shared folder and read twice: for the corpus' counts and for the weights.
The draw sorts narrow rows by range and adds to a row's place in its part the rows of the parts before, so no task ranks all.

Defined cases: a null text has no words; a null id is hashed as empty text and ranks behind equal scores; rows that
repeat an id each count, with one random number between them; ties go to the smaller id, then to the table's order; an
empty corpus gives an empty result; with an empty target the gains come from the corpus alone; texts are read whole; of
other columns, also of clashing names, none is read.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_texts, packed, pick, table, text_batches, written

LONGEST = 3
#: Words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z are lower-cased.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def run_buckets(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, offsets of each text's features, buckets of all features, those of a text together)."""
    words, n_words = [], []
    for text in texts:
        own = text.translate(_TO_WORDS).split()
        words += own
        n_words.append(len(own))
    id_of: dict[bytes, int] = {}
    ids = np.fromiter((id_of.setdefault(w, len(id_of)) for w in words), np.int64, len(words))
    n = np.array(n_words, dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sum(np.maximum(n - k, 0) for k in range(LONGEST)))))
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(words)) - (np.cumsum(n) - n)[owner]

    out = np.empty(offsets[-1], dtype=np.int64)
    goes_to = offsets[:-1].copy()
    spaced = [b" " + w for w in id_of]
    run, crcs, starts = ids, [crc32(w) for w in id_of], np.arange(len(words))
    for k in range(LONGEST):
        if k:
            starts = np.flatnonzero(place + k < n[owner])
            tuples, dense = np.unique(run[starts] * len(spaced) + ids[starts + k], return_inverse=True)
            crcs = [crc32(spaced[last], crcs[before]) for before, last in zip(*(x.tolist() for x in np.divmod(tuples, max(1, len(spaced)))))]
            run = np.zeros(len(words), dtype=np.int64)
            run[starts] = dense
        out[goes_to[owner[starts]] + place[starts]] = (np.array(crcs, dtype=np.int64) % buckets)[run[starts]]
        goes_to += np.maximum(n - k, 0)
    return n, offsets, out


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(rows: DataFrame, buckets: int) -> DataFrame:
    """rows(text, ...) without its text, with n_words, n_features and the buckets of all features as packed integers."""
    at = rows.columns.index("text")
    rest = [(f.name, f.dataType) for f in rows.schema if f.name != "text"]

    def make():
        def f(*columns):
            n, offsets, found = run_buckets([(t or "").encode() for t in columns[at].to_pylist()], buckets)
            data = found.astype(_kind(buckets))
            held = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return [*columns[:at], *columns[at + 1 :], pa.array(n, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(held, pa.binary())]

        return f

    return map_texts(rows, make, [*rest, ("n_words", "long"), ("n_features", "long"), ("buckets", "binary")])


def totals(featured: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds. A task sends one row a bucket; as many rows as there are buckets come to the driver."""

    def count(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=_kind(buckets)), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in featured.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, with one more feature in every bucket; rounded down."""
    s_all, t_all, extra = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + extra) / ((s + 1.0) * (t_all + extra)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def gumbel(id_text: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, keep_rows: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_features, weight, score, and rank (from 1) of the drawn, null for the rest.

    With keep_rows the drawn rows alone, with ``row``, the whole input row as a struct.
    """
    spark = docs.sparkSession
    rows = (packed(docs, id_col, text_col) if keep_rows else pick(docs, id_col, text_col)).withColumnsRenamed({id_col: "id", text_col: "text"})
    held = written(features(rows.withColumn("text", F.col("text").cast("string")), buckets).withColumn("nth", F.monotonically_increasing_id()))
    gain = gains(totals(held, buckets), totals(features(pick(target, target_text_col).toDF("text"), buckets), buckets))
    kind = held.schema["id"].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            sums = np.concatenate(([0], np.cumsum(gain[np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=_kind(buckets))])))
            ends = np.concatenate(([0], np.cumsum(batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(sums[ends]), pa.int64())], names=["id", "nth", "n_features", "enough", "weight"])

    narrow = text_batches(held.select("id", "nth", "n_features", (F.col("n_words") >= least_words).alias("enough"), "buckets"))
    scored = narrow.mapInArrow(weigh, f"id {kind}, nth long, n_features long, enough boolean, weight long")
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)))
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("id"), F.asc("nth")]
    in_order = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row a part of the sort
    parts = in_order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("enough").alias("enough")).orderBy("part").collect()
    before = np.cumsum([0, *[r.n for r in parts]]).tolist()
    drawn = percent * sum(r.enough for r in parts) // 100
    forget(scored)
    starts = spark.createDataFrame([(r.part, b) for r, b in zip(parts, before)], "part long, before long")
    rank = F.col("before") + place + 1
    out = in_order.withColumn("part", part).join(F.broadcast(starts), "part")
    out = out.withColumn("rank", F.when(F.col("enough") & (rank <= drawn), rank))
    if keep_rows:
        out = out.filter(F.col("rank").isNotNull()).join(held.select("nth", "row"), "nth")
    else:
        forget(held)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", *(["row"] if keep_rows else []))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all columns."""
    return resample(docs, target, keep_rows=True, **options).select("row.*").toDF(*docs.columns)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
