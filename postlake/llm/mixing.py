"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is q
whole times its size and a remainder repeats every document q times, and the
remainder is fitted by choosing how many documents of each length are taken
once more: first the same share of every length, then a bounded knapsack
over changes of these counts makes the taken words meet the budget exactly, or as
nearly as any choice can. Which documents of a length are taken follows a
seeded hash of id and text, so reruns agree.

Only counts reach the fitting step: one group holds one source's distinct
lengths, not its documents. Documents are then chosen by hash bucket, so that a
length that a third of all rows share is spread over ``buckets`` groups.

Defined cases: a null text has size 0; null sources form one source that comes
last; a source or table without words takes nothing; repeated rows each count; of equal
seeded hashes the smaller id goes first; texts are counted whole; an empty table gives an empty
result; columns of any other name pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(_source, source, source_size), one row per source, with its target.

    Resharing an excess by weight until no target is above its limit ends at min(limit, t * weight) with the
    one t that spends the budget: sorted by limit / weight, the first sources stop at their limits and the rest
    share what is left. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_limit", F.col("source_size").cast("double") * max_repeats)
    by = Window.orderBy(F.col("_limit") / F.col("_w"), "_source")
    s = s.withColumns({
        "_budget": F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * share,
        "_spent": F.coalesce(F.sum("_limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # the level at which this and all later sources would share: the first one below its own limit is the level
    s = s.withColumn("_level", (F.col("_budget") - F.col("_spent")) / F.col("_rest"))
    free = F.col("_level") * F.col("_w") <= F.col("_limit")
    s = s.withColumn("_t", F.min(F.when(free, F.struct(F.col("_limit") / F.col("_w"), F.col("_source"), F.col("_level")))).over(Window.partitionBy())["_level"])
    return s.withColumn("target", F.least("_limit", F.coalesce(F.col("_t") * F.col("_w"), F.col("_limit")))).select("_source", "source", "source_size", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take (0 to counts): of all choices within budget one with most words.

    The same share of every length first, then whole documents from long to short while they fit, then
    the bounded knapsack for what is left.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if 0 < lengths[i] <= left and take[i] < counts[i]:
            n = min(int(counts[i] - take[i]), left // int(lengths[i]))
            take[i] += n
            left -= n * int(lengths[i])
    return _knapsack(lengths, counts, take, left) if left else take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: int) -> np.ndarray:
    """Bounded-knapsack dynamic programme over changes of take that use up as much of left as can be.

    Each length may change by at most ``most`` documents either way; most grows until the budget is met, or nothing
    more could be gained. Meeting it is: left is down to its remainder by the lengths' common divisor. And no more can be
    gained once most is above three times the longest length: the changes to a best choice can be ordered so that their partial
    sums stay within that many values, and where a partial sum comes twice, the changes between cancel out and can be left off.
    """
    usable = [int(i) for i in np.argsort(lengths, kind="stable") if lengths[i] > 0 and counts[i] > 0]
    least = left % math.gcd(*[int(lengths[i]) for i in usable])
    # no length above all that could be added or given back takes part in a gain, but as something given back
    limit = 3 * int(lengths[usable[-1]]) + 1
    best, most = (left, take), 2
    while best[0] > least:
        reach, base, layers, done = 1, 0, [], []
        for i in usable:
            size, down, up = int(lengths[i]), min(int(take[i]), most), min(int(counts[i] - take[i]), most)
            free, step = down + up, 1
            base += down * size
            done.append((i, down))
            while free > 0:  # binary splitting of the bounded count
                m = min(step, free)
                layers.append((i, m, reach))
                reach |= reach << (m * size)
                free -= m
                step *= 2
            if reach >> (base + left - least) & 1:
                break
        at = (reach & ((1 << (base + left + 1)) - 1)).bit_length() - 1
        if base + left - at < best[0]:
            change = take.copy()
            for i, down in done:
                change[i] -= down
            gained = base + left - at
            for i, m, before in reversed(layers):
                if not before >> at & 1:
                    change[i] += m
                    at -= m * int(lengths[i])
            best = (gained, change)
        if most > limit or all(most >= max(take[i], counts[i] - take[i]) for i in usable):
            break
        most *= 4
    return best[1]


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = min(MAX_REPEATS, int(target // source_size)) if source_size else 0
    budget = 0 if whole == MAX_REPEATS else round(target) - whole * source_size
    take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget)
    return pd.DataFrame({"_source": pdf["_source"], "size": pdf["size"], "target": target, "source_size": source_size, "whole": whole, "once_more": take})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, seed: int = 20, buckets: int = 1024, keep_rows: bool = False) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, and with keep_rows ``row``, the input row."""
    rows = packed(docs, id_col, text_col, source_col).withColumnsRenamed({id_col: "_id", text_col: "_text", source_col: "source"})
    # the hash is of id and text: rows that share an id, or have none, spread over the buckets as well
    rows = rows.select(
        "_id", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
        F.xxhash64(F.lit(seed), "_id", "_text").alias("_h"), *(["row"] if keep_rows else []),
    ).withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))

    counted = rows.groupBy("_source", "source", "size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    lengths = counted.groupBy("_source", "source", "size").agg(F.sum("n").alias("n"))
    aimed = targets(lengths.groupBy("_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    plan = lengths.select("_source", "size", "n").join(aimed.select("_source", "source_size", "target"), "_source")
    plan = plan.groupBy("_source").applyInPandas(_fit_source, "_source string, size long, target double, source_size long, whole long, once_more long")

    before = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counted.select("_source", "size", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    cuts = cuts.join(plan, ["_source", "size"])
    nth = F.row_number().over(Window.partitionBy("_source", "size", "_bucket").orderBy("_h", "_id"))
    chosen = rows.withColumn("_nth", nth).join(cuts, ["_source", "size", "_bucket"])
    taken = F.col("size") * (F.col("whole") + F.when(F.col("_before") + F.col("_nth") <= F.col("once_more"), 1).otherwise(0))
    return chosen.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if keep_rows else []))


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each document as many times as its words are taken. A document without words isn't."""
    out = mix(docs, keep_rows=True).withColumn("_times", F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)).filter("_times > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("_times"))).alias("row")).select("row.*").toDF(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
