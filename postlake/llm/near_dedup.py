"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values,
its minimum and its maximum, so half the hash evaluations of plain MinHash
fill the bands. Documents that agree on a band share a bucket.

Equal shingle sets are one node. Components, not pairs, are asked for, so buckets
are settled in steps, and each step compares only nodes of different components:

1. The leader of every bucket with its members.
2. In small buckets, all pairs that are left. In crowded ones, a few pivots of the
   bucket's largest component with the nodes outside it, for some rounds.
3. What is still open in crowded buckets, block against block; before, members that
   cannot link are dropped: two texts share at most the shingles that more than one
   text has.

No pair of a bucket that could join two components is left out, and a link inside
a component cannot change it. Every link is confirmed on full sets. A task returns
a spanning forest of the links it finds, so links grow with members, not with pairs.

A pair at the threshold shares no band with a probability of about two in a million
(``_bands``). Components come from alternating star contractions, all as joins
and grouped minima over written tables; nothing is collected. Joins on a bucket, a
leader or a set of copies split large keys (``join_hot``).

Defined cases: null or wordless texts have no shingles and link with nothing;
a null id takes part and never names a component of known ids; rows that
repeat an id and a text are linked; of each component exactly one row is kept,
whatever ids it repeats; long texts are hashed whole, a text at a time; columns
of any other name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, light, maybe_in, pick, slots_for, text_batches, written
from .shingles import mix, shingle_sets

SLICE_BYTES = 1_000_000


def _bands(percent: int) -> tuple[int, int]:
    """(bands, rows): with s the threshold, (1 - s ** rows) ** bands stays below 3e-6; bands * rows is even."""
    rows = 6 if percent >= 85 else 5
    s = percent / 100
    bands = 1
    while (1 - s**rows) ** bands > 3e-6 or bands * rows % 2:
        bands += 1
    return bands, rows


def _slices(column):
    """Texts as UTF-8, a few megabytes at a time."""
    part, size = [], 0
    for t in column:
        part.append((t.as_py() or "").encode())
        size += len(part[-1])
        if size >= SLICE_BYTES or len(part) >= 5000:
            yield part
            part, size = [], 0
    if part:
        yield part


def min_max(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation a * x + b of the 64-bit numbers."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
    for i in range(0, len(values), 4096):
        v = a[:, None] * values[None, i : i + 4096] + b[:, None]
        v ^= v >> np.uint64(29)
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate((low, high))


def row_key(key: Column, text: Column) -> Column:
    """A digest of a row's id and text: rows that share it are copies of each other."""
    return F.md5(F.concat(F.xxhash64(key.isNull(), key).cast("string"), F.lit(" "), F.coalesce(text.cast("string"), F.lit(""))))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, seed: int = 11) -> DataFrame:
    """(id, row, n_shingles, digest, bands): row is the row key, digest names the shingle set, bands holds one hash a band; both null without shingles."""
    bands, rows = _bands(percent)
    narrow = text_batches(pick(docs, id_col, text_col).toDF("id", "text")).select("id", row_key(F.col("id"), F.col("text")).alias("row"), "text")
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, bands * rows // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows // 2, dtype=np.uint64)

    def run(batches):
        for batch in light(batches):
            sizes, digests, keys = [], [], []
            for part in _slices(batch.column(2)):
                for s in shingle_sets(part, words):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                    if not len(s):
                        keys.append(None)
                        continue
                    signature = min_max(s, a, b).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
                    keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "row", "n_shingles", "digest", "bands"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, row string, n_shingles long, digest string, bands array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, nodes: DataFrame, slots: int) -> DataFrame:
    """(node, set): the full shingle set of each node (node, id, digest), read again from one of its documents."""
    narrow = text_batches(pick(docs, id_col, text_col).toDF("id", "text"))
    some = maybe_in(narrow, F.xxhash64("id"), nodes, F.xxhash64("id"), "_asked", slots).filter("_asked").select("text")

    def run(batches):
        for batch in light(batches):
            for part in _slices(batch.column(0)):
                sets = [s for s in shingle_sets(part, words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "set"])

    sets = some.mapInArrow(run, "digest string, set binary").join(nodes.select("digest", "node"), "digest")
    return sets.groupBy("node").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold. Many pairs may share their a, as a leader does."""
    per_a = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    both = join_hot(text_batches(pairs), sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a", per_a, pairs.count(), ["b"])
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches):
        for batch in light(batches):
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def star(edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star contraction of total edges (a, b): same components, flatter trees, a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
    large = join_hot(both, least.select("u", "m"), "u", least, 2 * total, ["v"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    high = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = high.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    small = join_hot(high, low.select("u", "m"), "u", low, total, ["v"]).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("u", "m"))
    return small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """A written table of edges after one contraction; edges may repeat and come in either order."""
    plain = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    out = written(star(plain, plain.count()))
    forget(plain)
    return out


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with label the smallest node of its component, for every node with an edge except the labels themselves."""
    before, now = None, _print(edges)
    while now != before:
        flat = written(star(edges, now[0]))
        forget(edges)
        edges, before, now = flat, now, _print(flat)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def with_label(members: DataFrame, edges: DataFrame) -> DataFrame:
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def unshared(sets: DataFrame) -> DataFrame:
    """(node, lone): how many shingles of each node no other node of sets has."""

    def run(batches):
        for batch in light(batches):
            for node, s in zip(batch["node"], batch["set"]):
                values = np.frombuffer(s.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node.as_py(), dtype=np.int64)), pa.array(values)], names=["node", "shingle"])

    each = text_batches(sets.select("node", "set")).mapInArrow(run, "node long, shingle long")
    single = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))


def may_link(percent: int):
    """No link is possible where the smaller count of shareable shingles (``rest``) is too small; exact, never a guess."""
    most = F.least("x.rest", "y.rest")
    return 100 * most >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles") - most)


def open_entries(members: DataFrame, total: int) -> DataFrame:
    """members (bucket, node, n_shingles, label) of the buckets with several components, with main (the label of most
    members) and, of the bucket, how many members and shingles it has and how many of them stand outside main."""
    by_label = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    most = F.max(F.struct("n", "label", "weight"))
    by_bucket = by_label.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("_n"), F.sum("weight").alias("all_weight")).filter("_n > most.n")
    main = by_bucket.select("bucket", "_n", F.col("most.label").alias("main"), F.col("_n").alias("all_n"), (F.col("_n") - F.col("most.n")).alias("open_n"), "all_weight", (F.col("all_weight") - F.col("most.weight")).alias("open_weight"))
    return join_hot(members, main.drop("_n"), "bucket", main, total, ["node"])


def pivot_pairs(members: DataFrame, total: int, pivots: int, seed: int) -> DataFrame | None:
    """(a, b): seeded pivots of the main component of a bucket, with every node that a bucket has outside it; None if there is none."""
    outside = written(open_entries(members, total).filter("label <> main").select("node", "main").distinct())
    n_outside = outside.count()
    if not n_outside:
        return None
    slot = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(pivots))
    chosen = members.groupBy("label", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(F.lit(seed + 1), "node"), "node"))["node"].alias("a")).select(F.col("label").alias("main"), "a")
    per_main = outside.groupBy("main").agg(F.count(F.lit(1)).alias("_n"))
    pairs = written(join_hot(outside, chosen, "main", per_main, n_outside, ["node"]).select("a", F.col("node").alias("b")).distinct())
    forget(outside)
    return pairs


def forest(labels: np.ndarray):
    """(find, unite) over the distinct labels: unite says whether two labels were still apart."""
    root = {x: x for x in np.unique(labels).tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def unite(x, y):
        x, y = find(x), find(y)
        root[x] = y
        return x != y

    return find, unite


def block_links(members: DataFrame, sets: DataFrame, percent: int, total: int, block: int = 512, block_shingles: int = 200_000) -> DataFrame:
    """Confirmed links (a, b) of crowded buckets: members outside their bucket's largest component against all members.

    Both sides come in blocks of about ``block`` rows and ``block_shingles`` shingles, so no task holds a bucket. A task
    returns a spanning forest over the components it meets: fewer links than it has members.
    """
    rows = open_entries(members, total)
    number = lambda side: F.greatest(F.ceil(F.col(f"{side}_n") / block), F.ceil(F.col(f"{side}_weight") / block_shingles)).cast("int")
    mine = lambda side: F.pmod(F.xxhash64("node"), number(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), number(side) - 1))
    one = rows.select("bucket", "node", "label", mine("all").alias("block"), every("open").alias("chunk"), F.lit(False).alias("asks"))
    other = rows.filter("label <> main").select("bucket", "node", "label", every("all").alias("block"), mine("open").alias("chunk"), F.lit(True).alias("asks"))
    dealt = one.union(other).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        nodes, labels = np.array(table["node"]), np.array(table["label"])
        asks = np.array(table["asks"].to_pylist())
        values = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table["set"]]
        held = np.flatnonzero(~asks)
        out = []
        if len(held):
            _, unite = forest(labels)
            sizes = np.array([len(values[i]) for i in held])
            flat, owner = np.concatenate([values[i] for i in held]), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in np.flatnonzero(asks):
                low, high = np.searchsorted(flat, values[i], "left"), np.searchsorted(flat, values[i], "right")
                some = high > low
                at = np.concatenate([owner[x:y] for x, y in zip(low[some], high[some])]) if some.any() else owner[:0]
                shared = np.bincount(at, minlength=len(held))
                near = (100 * shared >= percent * (len(values[i]) + sizes - shared)) & (labels[held] != labels[i])
                met, first = np.unique(labels[held][near], return_index=True)
                out += [(nodes[i], nodes[held[j]]) for x, j in zip(met.tolist(), np.flatnonzero(near)[first].tolist()) if unite(int(labels[i]), x)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("bucket", "block", "chunk").applyInArrow(run, "a long, b long")


def links(entries: DataFrame, sets: DataFrame, percent: int, crowd: int = 16, pivots: tuple = (8, 16)) -> DataFrame:
    """Contracted edges (a, b) with the components of all confirmed links among entries (bucket, size, node, n_shingles)."""
    crowded = entries.filter(F.col("size") >= crowd).select("node").distinct()
    counted = unshared(sets.join(crowded, "node", "left_semi"))
    # counted among all members of crowded buckets, and so a bound for pairs within these alone
    lone = F.when(F.col("size") >= crowd, F.coalesce("lone", F.lit(0))).otherwise(0)
    members = entries.join(counted, "node", "left").withColumn("rest", F.col("n_shingles") - lone)
    members = written(members.filter(100 * F.col("rest") >= percent * F.col("n_shingles")).select("bucket", "size", "node", "n_shingles", "rest"))
    # the leader is the member with the smallest share of shingles that no other has: the likeliest original
    lead = members.groupBy("bucket").agg(F.min(F.struct(-F.col("rest") / F.col("n_shingles"), "node", "n_shingles", "rest")).alias("x"), F.count(F.lit(1)).alias("_n"))
    total = members.count()

    led = join_hot(members.withColumn("y", F.struct("node", "n_shingles", "rest")), lead.select("bucket", "x"), "bucket", lead, total, ["node"])
    led = led.filter("x.node <> y.node").filter(may_link(percent))
    pairs = written(led.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    edges = contracted(confirmed(pairs, sets, percent))
    forget(pairs)

    # at most crowd - 1 members a bucket
    few = written(with_label(members.filter(F.col("size") < crowd), edges))
    x, y = few.alias("x"), few.alias("y")
    left = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))).filter(may_link(percent))
    pairs = written(left.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    more = contracted(edges.union(confirmed(pairs, sets, percent)))
    forget(pairs, few, edges)
    edges = more

    crowds = members.filter(F.col("size") >= crowd).select("bucket", "node", "n_shingles")
    for round_, n in enumerate([*pivots, 0]):
        labelled = written(with_label(crowds, edges))
        pairs = pivot_pairs(labelled, total, n or 1, 100 * round_)
        if pairs is None:  # every bucket is within one component
            break
        found = confirmed(pairs, sets, percent) if n else block_links(labelled, sets, percent, total)
        more = contracted(edges.union(found))
        forget(pairs, labelled, edges)
        edges = more
    forget(members)
    return edges


def judged(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per row of docs: id, row (its key), n_shingles, component_id, keeps (the key is the one its component keeps; null without shingles)."""
    rows = written(signatures(docs, id_col, text_col, words, percent))
    n_rows = rows.count()
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("best")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(best, F.count(F.lit(1)).alias("_n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumns({"id": F.col("best.id"), "node": F.monotonically_increasing_id()}))
    entries = nodes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    entries = written(join_hot(entries, shared.select("bucket", F.col("_n").alias("size")), "bucket", shared, n_rows * _bands(percent)[0], ["node"]))
    asked = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", "id", "digest")
    sets = written(full_sets(docs, id_col, text_col, words, asked, slots_for(n_rows)))

    edges = links(entries, sets, percent)
    labels = components(edges)
    named = nodes.select("node", "digest", "best", "_n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = named.groupBy("label").agg(F.min("best").alias("least"), F.count(F.lit(1)).alias("_n"))
    named = written(join_hot(named.drop("_n"), per_label.select("label", "least"), "label", per_label, n_rows, ["node"]).select("digest", "least"))
    forget(sets, entries)
    linked = join_hot(rows.filter("digest is not null"), named, "digest", nodes.select("digest", "_n"), n_rows, ["row"])
    linked = linked.select("id", "row", "n_shingles", F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("keeps"))
    alone = rows.filter("digest is null").select("id", "row", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("boolean").alias("keeps"))
    return linked.union(alone)


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable over links), kept (one row a component).

    Linked: 100 * shared shingles >= percent * shingles of either.
    """
    rows = judged(docs, id_col, text_col, words, percent)
    # a window for each component's kept key alone: all other rows are spread by themselves
    apart = F.when(F.col("keeps"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("row", "_apart").orderBy(F.lit(1)))
    out = rows.withColumn("_apart", apart).withColumn("_number", number)
    kept = F.coalesce(F.col("keeps"), F.lit(True)) & (F.col("_number") == 1)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component; only rows that may be among the others are shuffled."""
    found = judged(docs, id_col, text_col, words, percent).filter("keeps is not null")
    gone = written(found.groupBy(F.col("row").alias("_gone")).agg(F.first("keeps").alias("_keeps"), F.count(F.lit(1)).alias("_n")).filter("not _keeps or _n > 1").drop("_n"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = lambda name: F.col(f"c{docs.columns.index(name)}")
    marked = maybe_in(plain.withColumn("_row", row_key(at(id_col), at(text_col))), F.xxhash64("_row"), gone, F.xxhash64("_gone"), "_asked", slots_for(gone.count()))
    stays = marked.filter("not _asked").drop("_asked", "_row")
    asked = marked.filter("_asked").drop("_asked")
    again = written(gone.filter("_keeps").select("_gone"))  # of rows that repeat an id and a text, one
    copies = asked.join(again, F.col("_row") == F.col("_gone")).drop("_gone").dropDuplicates(["_row"])
    asked = asked.join(gone, F.col("_row") == F.col("_gone"), "left_anti").unionByName(copies).drop("_row")
    return stays.unionByName(asked).toDF(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dups(docs, words=3, percent=85)
