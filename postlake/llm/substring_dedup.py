"""Passages of many words that repeat across documents, by compact windows over min-hashes.

A document is the sequence of its five-word shingle hashes. Under each of a few
hash functions the Cartesian tree of that sequence groups all
subsequences of at least the minimum length by the position of their smallest hash:
a compact window (left, position, right). Two passages that share most shingles share
the smallest hash under most functions. Windows of one hash value are matched with
the first document that has it (a star, never all pairs), the matched windows are
aligned and joined as intervals by document pair and offset, and regions met under
enough functions go to verification on the shingles themselves: matched stretches of
at least ``min_words`` words and ``percent`` likeness remain. The first document of a value may
have it in another context, so windows that no verified passage covers are matched a
second time, with the last document among those. What is then still uncovered is compared with
every window of its value, on the shingles around both, in pairs of blocks of bounded size: no partner is
left out, and a window needs only one, so passages do not grow with the square.

Values that occur once are dropped before windows are shuffled, by a bitmap, so unique
text costs one number per window. Joins on a value, and on a passage that many documents
repeat, split large keys (``join_hot``).

Defined cases: null or short texts have no passages; repeats inside one document are
not repeats across documents; rows that repeat an id and a text are one document, and
texts that share an id are told apart but reported under that id; texts are read whole, a
long one by itself; columns of any other name are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, light, maybe_in, pick, slots_for, text_batches, written
from .shingles import mix, word_hashes

SLICE_BYTES = 1_000_000
SEEDS = np.random.default_rng(99).integers(0, 1 << 63, 16, dtype=np.uint64)
#: Windows of a text that its row stands for in sizing the bitmap.
WINDOWS = 32
#: Windows of a block of one value; a task holds two blocks.
BLOCK = 8192


def sequences(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): shingle hashes of all texts one after another, and where each text's begin (one more at the end)."""
    h, owner, _, _ = word_hashes(texts)
    words = np.bincount(owner, minlength=len(texts)) if len(h) else np.zeros(len(texts), dtype=np.int64)
    full = np.maximum(words - n + 1, 0)
    starts = np.concatenate(([0], np.cumsum(full)))
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), starts
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + h[i : len(h) - n + 1 + i])
    inside = owner[: len(out)] == owner[n - 1 :]
    return out[inside], starts


def minima(s: np.ndarray, starts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, text numbers) of the elements that are the smallest of some t successive ones of a text."""
    at, o, _ = smallest(s, starts, t)
    pos = np.empty(len(at), dtype=np.int64)
    for i in range(0, len(at), 20_000):
        some = at[i : i + 20_000]
        pos[i : i + 20_000] = some + s[some[:, None] + np.arange(t)].argmin(axis=1)
    return pos, o


def smallest(s: np.ndarray, starts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, text numbers, values): where another smallest of t successive elements of a text begins, and that value."""
    none = np.zeros(0, dtype=np.int64)
    if len(s) < t:
        return none, none, s[:0]
    low, width = s, 1
    while width * 2 <= t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < t:
        low = np.minimum(low[: len(s) - t + 1], low[t - width : len(s) - width + 1])
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    valid = np.flatnonzero(owner[: len(low)] == owner[t - 1 :])
    if not len(valid):
        return none, none, s[:0]
    v, o = low[valid], owner[valid]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
    return valid[new], o[new], v[new]


def extents(pos: np.ndarray, owner: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each minimum the first and last position before a smaller one: the node's span in the Cartesian tree.

    To the left one of the same value ends it, too.
    """
    n = len(pos)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begins = np.concatenate(([True], owner[1:] != owner[:-1]))
    ends = np.concatenate((begins[1:], [True]))
    before = _nearest(np.where(begins, n, np.arange(n) - 1), values, np.greater)
    after = _nearest(np.where(ends, n, np.arange(n) + 1), values, np.greater_equal)
    p = np.append(pos, 0)
    return np.where(before < n, p[before] + 1, starts[owner]), np.where(after < n, p[after] - 1, starts[owner + 1] - 1)


def _nearest(to: np.ndarray, values: np.ndarray, passes) -> np.ndarray:
    """Follow to, from its first neighbour on, while passes(value there, own value); n stands for the end of the text.

    What lies before to[i] passes for i, so i goes on where to[to[i]] points, for all i at once.
    """
    n = len(values)
    to = np.append(to, n)
    going = np.flatnonzero(to[:n] < n)
    for _ in range(64):
        going = going[passes(values[to[going]], values[going])]
        if not len(going):
            return to[:n]
        to[going] = to[to[going]]
        going = going[to[going] < n]
    order = going if to[going[0]] < going[0] else going[::-1]
    for i in order.tolist():  # long rising rows
        while to[i] < n and passes(values[to[i]], values[i]):
            to[i] = to[to[i]]
    return to[:n]


def _slices(*columns):
    part, size = [], 0
    for row in zip(*columns):
        text = (row[-1].as_py() or "").encode()
        part.append((*[x.as_py() for x in row[:-1]], text))
        size += len(text)
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, percent: int = 80, words: int = 5, functions: int = 4, enough: int = 2) -> DataFrame:
    """One row per repeated passage and document that has it: id_col, start_word, end_word (from 0, end excluded),
    n_words, first_<id_col> and first_start_word (where it is first seen), similarity, kept (it is the first).
    """
    t = min_words - words + 1
    rows = text_batches(pick(docs, id_col, text_col).toDF("id", "text")).withColumn("doc", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()

    def values_of(batches):
        for batch in light(batches):
            for part in _slices(batch.column(0)):
                s, starts = sequences([x[-1] for x in part], words)
                for k in range(functions):
                    m = mix(s ^ SEEDS[k])
                    _, _, v = smallest(m, starts, t)
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64))], names=["v"])

    def windows_of(batches):
        for batch in light(batches):
            for part in _slices(batch["id"], batch["doc"], batch["text"]):
                s, starts = sequences([x[-1] for x in part], words)
                named = [pa.array([x[i] for x in part], ty) for i, ty in enumerate((batch.schema.field("id").type, pa.int64()))]
                for k in range(functions):
                    m = mix(s ^ SEEDS[k])
                    pos, owner = minima(m, starts, t)
                    left, right = extents(pos, owner, m[pos], starts)
                    base = starts[owner]
                    yield pa.RecordBatch.from_arrays([
                        *[x.take(pa.array(owner)) for x in named],
                        pa.array(np.full(len(pos), 1 << k, dtype=np.int32)), pa.array(m[pos].view(np.int64)),
                        *[pa.array((x - base).astype(np.int32)) for x in (pos, left, right)],
                    ], names=["id", "doc", "f", "v", "p", "l", "r"])

    once = rows.select("text").mapInArrow(values_of, "v long").groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    windows = rows.select("id", "doc", "text").mapInArrow(windows_of, f"id {kind}, doc long, f int, v long, p int, l int, r int")
    windows = maybe_in(windows, F.col("v"), once, F.col("v"), "_again", slots_for(WINDOWS * docs.count())).filter("_again").drop("_again")
    windows = written(windows, free=True)
    found = _verified(rows, windows, F.min, kind, min_words, percent, words, enough)
    # what no verified passage covers, in blocks of 64 words, meets another document
    held = found.select("doc", "b0", "b1").union(found.select("first_doc", "a0", "a1"))
    held = held.select("doc", F.explode(F.expr("sequence(int(b0 div 64), int((b1 - 1) div 64))")).alias("block")).distinct()
    rest = windows.withColumn("block", F.expr("int(p div 64)")).join(held, ["doc", "block"], "left_anti").drop("block")
    rest = written(rest, free=True)
    more = _verified(rows, rest, F.max, kind, min_words, percent, words, enough)
    forget(rest)
    found = found.union(more)
    # and what is uncovered after that, word by word, meets all windows of its value
    held = found.select("doc", "b0", "b1").union(found.select("first_doc", "a0", "a1")).distinct()
    held = held.withColumn("block", F.explode(F.expr("sequence(int(b0 div 64), int((b1 - 1) div 64))"))).withColumnRenamed("doc", "its")
    w = windows.withColumn("block", F.expr("int(p div 64)"))
    left = written(w.join(held, (w["doc"] == held["its"]) & (w["block"] == held["block"]) & F.expr("p >= b0 AND p < b1"), "left_anti").select("doc", "f", "p", "v"), free=True)
    mates = _mates(windows, left)
    forget(windows, left)
    last = _verified(rows, _all_met(rows, mates, kind, min_words, percent, words), None, kind, min_words, percent, words, 1)
    forget(mates)
    found = found.union(last)
    copies = found.select("id", "b0", "b1", "first_id", "a0", "like")
    firsts = found.select(F.col("first_id").alias("id"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), "first_id", "a0", F.lit(1.0).alias("like")).distinct()
    spans = copies.unionByName(firsts)
    # overlapping spans of one document with one first document become one passage
    w = Window.partitionBy("id", "first_id").orderBy("b0", "b1")
    spans = spans.withColumn("start", (F.col("b0") > F.coalesce(F.max("b1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    spans = spans.withColumn("island", F.sum("start").over(w))
    merged = spans.groupBy("id", "first_id", "island").agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("a0").alias("a0"), F.max("like").alias("like"))
    return merged.select(
        F.col("id").alias(id_col), F.col("b0").alias("start_word"), F.col("b1").alias("end_word"), (F.col("b1") - F.col("b0")).alias("n_words"),
        F.col("first_id").alias(f"first_{id_col}"), F.col("a0").alias("first_start_word"), F.round("like", 6).alias("similarity"), F.col("id").eqNullSafe(F.col("first_id")).alias("kept"),
    )


def _verified(rows: DataFrame, windows: DataFrame, which, kind: str, min_words: int, percent: int, words: int, enough: int) -> DataFrame:
    """(id, doc, first_id, first_doc, b0, b1, a0, a1, like): passages of windows verified against one document of each value.

    which (F.min or F.max) chooses that document; without it windows are met already, each beside the window a.
    """
    met = windows
    if which:
        per_value = windows.groupBy("v").agg(which(F.struct("id", "doc", "p", "l", "r")).alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        met = join_hot(windows, per_value.select("v", "a"), "v", per_value, windows.count(), ["doc", "p"]).filter("doc <> a.doc")
    met = met.withColumns({"left": F.least(F.expr("p - l"), F.expr("a.p - a.l")), "right": F.least(F.expr("r - p"), F.expr("a.r - a.p"))}).filter(F.col("left") + F.col("right") + words >= min_words)
    # offsets in two overlapping rows of bins, so that no passage is cut by the edge of both
    met = met.withColumn("bin", F.explode(F.expr("array(2 * floor((p - a.p) / 64), 2 * floor((p - a.p + 32) / 64) + 1)")))
    regions = met.groupBy("id", "doc", F.col("a.id").alias("first_id"), F.col("a.doc").alias("first_doc"), "bin").agg(
        F.bit_count(F.bit_or("f")).alias("functions"), F.min(F.expr("p - left")).alias("b0"), F.max(F.expr("p + right + 1")).alias("b1"),
        F.min(F.expr("a.p - left")).alias("a0"), F.max(F.expr("a.p + right + 1")).alias("a1"),
    ).filter(F.col("functions") >= enough)
    wide = lambda x, y: [(F.floor(F.col(x) / 64) * 64).cast("int").alias(x), (F.ceil(F.col(y) / 64) * 64).cast("int").alias(y)]
    regions = written(regions.select("id", "doc", "first_id", "first_doc", *wide("b0", "b1"), *wide("a0", "a1")).distinct(), free=True)
    asked = regions.select("doc", F.col("b0").alias("x0"), F.col("b1").alias("x1")).union(regions.select("first_doc", "a0", "a1")).distinct()
    asked = asked.groupBy("doc").agg(F.collect_list("x0").alias("x0"), F.collect_list("x1").alias("x1"))

    def cuts_of(batches):
        for batch in light(batches):
            for part in _slices(batch["doc"], batch["x0"], batch["x1"], batch["text"]):
                s, starts = sequences([x[-1] for x in part], words)
                s = (s >> np.uint64(32)).astype(np.uint32)  # enough to compare two passages
                cuts = [(doc, x0, x1, s[a + x0 : min(a + x1, e)].tobytes()) for (doc, lows, highs, _), a, e in zip(part, starts[:-1].tolist(), starts[1:].tolist()) for x0, x1 in zip(lows, highs)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in cuts], ty) for i, ty in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc", "x0", "x1", "s"])

    texts = maybe_in(rows.select("doc", "text"), F.col("doc"), asked, F.col("doc"), "_asked", slots_for(rows.count())).filter("_asked").select("doc", "text").join(asked, "doc")
    cut = text_batches(texts.select("doc", "x0", "x1", "text")).mapInArrow(cuts_of, "doc long, x0 int, x1 int, s binary").dropDuplicates(["doc", "x0", "x1"])
    cut = written(cut, free=True)
    # many documents may repeat one passage of their first
    named = regions.withColumn("first_cut", F.concat_ws(":", "first_doc", "a0", "a1"))
    per_cut = named.groupBy("first_cut").agg(F.count(F.lit(1)).alias("_n"))
    pairs = join_hot(named, cut.select(F.concat_ws(":", "doc", "x0", "x1").alias("first_cut"), F.col("s").alias("a")), "first_cut", per_cut, regions.count(), ["doc", "b0"])
    pairs = pairs.join(cut.select("doc", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("s").alias("b")), ["doc", "b0", "b1"])

    def verified(batches):
        for batch in light(batches):
            out = []
            for n in range(len(batch)):
                a, b = (np.frombuffer(batch[c][n].as_buffer(), dtype=np.uint32) for c in ("a", "b"))
                for x, y, u, w, like in stretches(a, b, min_words - words + 1, percent):
                    b0, a0 = batch["b0"][n].as_py(), batch["a0"][n].as_py()
                    out.append((n, b0 + x, b0 + y + words - 1, a0 + u, a0 + w + words - 1, like))
            index = pa.array([x[0] for x in out], pa.int64())
            got = [batch[c].take(index) for c in ("id", "doc", "first_id", "first_doc")]
            numbers = [pa.array([x[i] for x in out], pa.int64()) for i in range(1, 5)] + [pa.array([x[5] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(got + numbers, names=["id", "doc", "first_id", "first_doc", "b0", "b1", "a0", "a1", "like"])

    pairs = text_batches(pairs.select("id", "doc", "first_id", "first_doc", "b0", "a0", "a", "b"))
    out = written(pairs.mapInArrow(verified, f"id {kind}, doc long, first_id {kind}, first_doc long, b0 long, b1 long, a0 long, a1 long, like double"), free=True)
    forget(regions, cut)
    return out


def _mates(windows: DataFrame, left: DataFrame) -> DataFrame:
    """(id, doc, f, v, p, l, r, blocks, open): every window whose value a window of left has, if two documents have it; open: it is of left."""
    counts = windows.groupBy("v").agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").drop("low", "high")
    asked = counts.join(left.select("v").distinct(), "v")
    few = asked.select("v", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    total = windows.count()
    some = maybe_in(windows, F.col("v"), few, F.col("v"), "_of", slots_for(total)).filter("_of").drop("_of")
    some = join_hot(some, few, "v", asked, total, ["doc", "p"]).join(left.select("doc", "f", "p", F.lit(True).alias("open")), ["doc", "f", "p"], "left")
    return written(some.withColumn("open", F.coalesce("open", F.lit(False))), free=True)


def _all_met(rows: DataFrame, mates: DataFrame, kind: str, min_words: int, percent: int, words: int) -> DataFrame:
    """(f, id, doc, p, l, r, a): every open window of mates beside one window of its value, of each pair of blocks, that is alike around it.

    Compared are the shingles within a shortest passage to both sides, of every open window with all windows of its value.
    """
    t = min_words - words + 1
    each = mates.groupBy("doc").agg(F.collect_list(F.struct("f", "v", "p", "l", "r", "blocks", "open")).alias("w"))
    texts = maybe_in(rows, F.col("doc"), mates, F.col("doc"), "_asked", slots_for(rows.count())).filter("_asked").drop("_asked")
    texts = texts.join(each, "doc").select("id", "doc", "w", "text")

    def around_of(batches):
        names = ("f", "v", "p", "l", "r", "blocks", "open")
        for batch in light(batches):
            done = 0
            for part in _slices(batch["text"]):
                some = batch.slice(done, len(part))
                done += len(part)
                s, starts = sequences([x[-1] for x in part], words)
                s = (s >> np.uint64(32)).astype(np.uint32)
                w = some["w"].flatten()
                of = np.repeat(np.arange(len(part)), some["w"].value_lengths().to_numpy())
                p, l, r = (w.field(n).to_numpy() for n in ("p", "l", "r"))
                base = starts[of]
                lows, highs = base + np.maximum(l, p - t + 1), base + np.minimum(r, p + t - 1) + 1
                cuts = pa.array([s[x:y].tobytes() for x, y in zip(lows.tolist(), highs.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([some["id"].take(pa.array(of)), some["doc"].take(pa.array(of)), *[w.field(n) for n in names], cuts], names=["id", "doc", *names, "s"])

    around = text_batches(texts).mapInArrow(around_of, f"id {kind}, doc long, f int, v long, p int, l int, r int, blocks int, open boolean, s binary")
    around = around.withColumn("own", F.pmod(F.xxhash64(F.lit(23), "doc", "p"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    pair = ["v", "x", "y"]
    around = around.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")
    around = around.repartition(*pair).sortWithinPartitions(*pair, "id", "doc", "p")

    def alike_of(batches):
        for some, starts in _runs(light(batches), pair):
            at, other = alike(some, starts, t, percent)
            if len(at):
                b, a = some.take(pa.array(at)), some.take(pa.array(other))
                names = ["id", "doc", "p", "l", "r"]
                yield pa.RecordBatch.from_arrays([b["f"], *[b[n] for n in names], *[a[n] for n in names]], names=["f", *names, *[f"a_{n}" for n in names]])

    found = text_batches(around).mapInArrow(alike_of, f"f int, id {kind}, doc long, p int, l int, r int, a_id {kind}, a_doc long, a_p int, a_l int, a_r int")
    one, two = F.struct("id", "doc", "p", "l", "r"), F.struct(*[F.col(f"a_{n}").alias(n) for n in ("id", "doc", "p", "l", "r")])
    ordered = F.struct("id", "doc") < F.struct(F.col("a_id").alias("id"), F.col("a_doc").alias("doc"))
    return found.select("f", F.when(ordered, two).otherwise(one).alias("b"), F.when(ordered, one).otherwise(two).alias("a")).select("f", "b.*", "a")


def _runs(batches, keys: list[str], least: int = 4096):
    """(rows, starts) of whole keys, of about least rows at a time and where each key begins, from batches that are sorted by keys."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts = _starts(rows, keys)
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last), starts[:-1]
        held, size = [rows.slice(last)], len(rows) - last
    if size:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield rows, _starts(rows, keys)


def _starts(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    k = np.stack([rows[c].to_numpy(zero_copy_only=False) for c in keys])
    return np.flatnonzero(np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(axis=0))))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ... in one array."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _fewest(s: np.ndarray, least: int) -> int:
    """The fewest distinct shingles of least successive ones."""
    order = np.argsort(s, kind="stable")
    before = np.full(len(s), -1)
    same = s[order[1:]] == s[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    begin = np.arange(max(1, len(s) - least + 1))[:, None]
    return int((before[np.minimum(begin + np.arange(min(len(s), least)), len(s) - 1)] < begin).sum(axis=1).min())


def alike(rows: pa.RecordBatch, starts: np.ndarray, least: int, percent: int) -> tuple[list[int], list[int]]:
    """(rows, partners): of each open row the first row of another document, in its pair of blocks, that has an alike stretch.

    A pair of blocks begins at each of starts. Rows with the same shingles and reach are one kind, and kinds are compared. A kind that has c
    shingles in common with others and needs d of them shares one of its c - d + 1 rarest with each partner, so only those are looked up;
    what is found so, reaches far enough to both sides together and shares d goes to :func:`_has_stretch`, many pairs at a time, or,
    where shingles repeat, to :func:`stretches`.
    """
    if len(rows) < 2:
        return [], []
    is_open, doc, own, p, l, r = (rows[c].to_numpy(zero_copy_only=False) for c in ("open", "doc", "own", "p", "l", "r"))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    asked = np.logical_or.reduceat(is_open, starts) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
    low, high = np.minimum(p - l, least), np.minimum(r - p, least)
    one = np.minimum.reduceat(own, starts) == np.maximum.reduceat(own, starts)
    offsets = np.frombuffer(rows["s"].buffers()[1], dtype=np.int32)[rows["s"].offset : rows["s"].offset + len(rows) + 1]
    flat = np.frombuffer(rows["s"].buffers()[2], dtype=np.uint32)
    at = (offsets // 4).tolist()
    # kinds: rows of a group and block with the same shingles and reach
    members: dict[tuple, list[int]] = {}
    chosen = np.flatnonzero(asked[group]).tolist()
    columns = (x.tolist() for x in (group, own, low, high))
    keys = list(zip(*columns))
    for i in chosen:
        members.setdefault((*keys[i], flat[at[i] : at[i + 1]].tobytes()), []).append(i)
    kinds = list(members.values())
    if not kinds:
        return [], []
    rep = np.array([k[0] for k in kinds])
    wants = np.array([bool(is_open[k].any()) for k in kinds])
    s = lambda k: flat[at[rep[k]] : at[rep[k] + 1]]
    size = np.diff(offsets // 4)[rep]
    # every (group, shingle) of a kind, once, by number; those of one kind alone are out
    total = len(kinds)
    of = np.repeat(np.arange(total), size)
    code = group[rep][of].astype(np.uint64) << np.uint64(32) | flat[_spread((offsets // 4)[rep], size)]
    order = np.argsort(code, kind="stable")
    code, of = code[order], of[order]
    number = np.cumsum(np.concatenate(([True], code[1:] != code[:-1]))) - 1
    places = np.empty(len(number), dtype=np.int64)
    places[order] = number
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    once = np.concatenate(([True], (number[1:] != number[:-1]) | (of[1:] != of[:-1])))
    number, of, first = number[once], of[once], (order - begin[of])[once]
    distinct = np.bincount(of, minlength=total)
    many = np.bincount(number)
    shared = many[number] > 1
    number, of, first = number[shared], of[shared], first[shared]
    common = np.bincount(of, minlength=total)
    fewest = np.minimum(size, least)
    for k in np.flatnonzero(wants & (distinct < size) & (common > 0)).tolist():
        fewest[k] = _fewest(s(k), least)  # an alike stretch may hold shingles that repeat
    need = np.maximum(1, -(-percent * fewest // 100))
    there = number * total + of
    plain = distinct == size
    asked = np.flatnonzero(wants & (common >= need))
    pairs = [a * total + b for a, b in _partners(asked, number, of, there, many, common, need, (low[rep], high[rep]), own[rep], one[group[rep]], least)]
    itself = np.array([k for k in np.flatnonzero(wants & one[group[rep]]).tolist() if len(kinds[k]) > 1], dtype=np.int64)
    pairs = np.unique(np.concatenate([*pairs, itself * total + itself]))
    a, b = pairs // total, pairs % total
    # a kind needs one partner: its first is tested, then the next two, four and so on of those that still wait
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    waits, waiting, found, others, reached = {k: [i for i in kinds[k] if is_open[i]] for k in np.unique(a).tolist()}, wants.copy(), [], [], 1
    while len(a):
        now = rank < reached
        for x, y in _parts(size[a[now]], 1 << 20):
            i, j = a[now][x:y], b[now][x:y]
            fits = i == j
            fits[~fits] = _long_enough(i[~fits], j[~fits], places, begin, size, there, plain, least, percent)
            i, j = i[fits], j[fits]
            sure = i == j
            told = plain[i] & plain[j] & (size[i] < 2 * least) & ~sure
            sure[told] = _has_stretch(i[told], j[told], places, begin, size, there, first, least, percent)
            fits = sure | ~told
            for k, partner, exact in zip(i[fits].tolist(), j[fits].tolist(), sure[fits].tolist()):
                if not waits[k] or not exact and next(stretches(s(partner), s(k), least, percent), None) is None:
                    continue
                row = kinds[partner][0]
                other = next((x for x in kinds[partner] if doc[x] != doc[row]), None)
                met = [(i, row if doc[i] != doc[row] else other) for i in waits[k]]
                found += [i for i, x in met if x is not None]
                others += [x for _, x in met if x is not None]
                waits[k] = [i for i, x in met if x is None]
                waiting[k] = bool(waits[k])
        left = ~now & waiting[a]
        a, b, rank, reached = a[left], b[left], rank[left], 2 * reached + 1
    return found, others


def _partners(asked, number, of, there, many, common, need, reach, own, one, least, most: int = 1 << 21):
    """Arrays of kinds that were asked and of partners that share enough; at most about ``most`` look-ups are held at a time.

    number and of: shingle and kind, sorted by both (``there`` in one number); many and common: kinds of a shingle, shingles of a kind.
    """
    if not len(asked):
        return
    total = len(common)
    first = np.searchsorted(number, np.arange(len(many)))
    by_kind = np.lexsort((many[number], of))
    its, begin = number[by_kind], np.concatenate(([0], np.cumsum(common)[:-1]))
    rare = common[asked] - need[asked] + 1
    at = its[_spread(begin[asked], rare)]
    kind = np.repeat(asked, rare)
    for x, y in _parts(many[at], most):
        n = many[at[x:y]]
        a, b = np.repeat(kind[x:y], n), of[_spread(first[at[x:y]], n)]
        low, high = (np.minimum(c[a], c[b]) for c in reach)
        fits = (a != b) & (one[a] | (own[a] != own[b])) & (low + high >= least - 1)
        pairs = np.unique(a[fits] * total + b[fits])
        a, b = pairs // total, pairs % total
        for u, w in _parts(common[a], most):
            n = common[a[u:w]]
            asks = its[_spread(begin[a[u:w]], n)] * total + np.repeat(b[u:w], n)
            hit = _among(asks, there)
            enough = np.bincount(np.repeat(np.arange(w - u), n), weights=hit, minlength=w - u) >= need[a[u:w]]
            yield a[u:w][enough], b[u:w][enough]


def _among(asks: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether each of asks is in there, which is sorted."""
    return there[np.minimum(np.searchsorted(there, asks), len(there) - 1)] == asks


def _long_enough(a, b, places, begin, size, there, plain, least: int, percent: int, gap: int = 12) -> np.ndarray:
    """Whether kind a can have a stretch that kind b has, before :func:`stretches` tells: shared shingles without wider gaps
    over least places, and, where no shingle of a repeats, percent of some least places or more shared.
    """
    width = int(size[a].max(initial=1))
    at = np.arange(width)
    inside = at < size[a][:, None]
    hit = np.zeros(inside.shape, dtype=bool)
    asks = places[(begin[a][:, None] + at)[inside]] * len(size) + np.repeat(b, size[a])
    hit[inside] = _among(asks, there)
    last = np.maximum.accumulate(np.where(hit, at, -width - gap), axis=1)
    before = np.concatenate((np.full((len(a), 1), -width - gap), last[:, :-1]), axis=1)
    start = np.maximum.accumulate(np.where(hit & (at - before > gap), at, -1), axis=1)
    long_ = (hit & (at - start + 1 >= least)).any(axis=1)
    if width < least:
        return long_
    level = np.concatenate((np.zeros((len(a), 1), dtype=np.int64), np.cumsum(100 * hit - percent, axis=1)), axis=1)
    dense = (level[:, least:] >= np.minimum.accumulate(level, axis=1)[:, : width + 1 - least]).any(axis=1)
    return long_ & (dense | ~plain[a])


def _has_stretch(a, b, places, begin, size, there, first, least: int, percent: int, gap: int = 12) -> np.ndarray:
    """Whether :func:`stretches` finds one of kind a in kind b, for many pairs at once.

    No shingle repeats in a or b, and a has fewer than 2 * least: of the parts of a only one at a time is long enough.
    first says where in its kind each of there begins.
    """
    out = np.zeros(len(a), dtype=bool)
    if not len(a):
        return out
    width = int(size[a].max())
    at = np.arange(width, dtype=np.int32)
    inside = at < size[a][:, None]
    asks = places[(begin[a][:, None] + at)[inside]] * len(size) + np.repeat(b, size[a])
    found = np.minimum(np.searchsorted(there, asks), len(there) - 1)
    where = np.full(inside.shape, -1, dtype=np.int32)
    where[inside] = np.where(there[found] == asks, first[found], -1)
    pair, length, cut_at, none = np.arange(len(a)), size[b], gap, np.int32(1 << 20)
    while len(pair):
        # the part without wider gaps, or after a cut the side of it, that is long enough
        hit = where >= 0
        last = np.maximum.accumulate(np.where(hit, at, -none), axis=1)
        before = np.concatenate((np.full((len(pair), 1), -none), last[:, :-1]), axis=1)
        if cut_at is not None:
            opens = hit & (at - before > cut_at)
        else:
            gaps = np.where(hit & (before >= 0), at - before, 0)
            opens = hit & ((before < 0) | (at == gaps.argmax(axis=1)[:, None]))
        cut_at = None
        start = np.maximum.accumulate(np.where(opens, at, -1), axis=1)
        ends = np.where(hit & (at - start + 1 >= least), at, -1).max(axis=1)
        keep = ends >= 0
        pair, where, start, y, length = pair[keep], where[keep], start[keep], ends[keep] + 1, length[keep]
        if not len(pair):
            break
        x = start[np.arange(len(pair)), y - 1]
        where = np.where((at >= x[:, None]) & (at < y[:, None]), where, -1)
        hit = where >= 0
        count = hit.sum(axis=1)
        ahead = np.where(hit, where - at, none)
        offset = np.sort(ahead, axis=1)[np.arange(len(pair)), count // 2]
        near = hit & (np.abs(ahead - offset[:, None]) <= 64)
        u = np.maximum(0, np.minimum(np.where(near, where, none).min(axis=1), x + offset))
        w = np.minimum(length, np.maximum(np.where(near, where, -none).max(axis=1) + 1, y + offset))
        shared = (hit & (where >= u[:, None]) & (where < w[:, None])).sum(axis=1)
        good = 100 * shared >= percent * (w - u + y - x - shared)
        out[pair[good]] = True
        keep = ~good & (count < y - x)
        pair, where, length = pair[keep], where[keep], length[keep]
    return out


def _parts(sizes: np.ndarray, most: int):
    """(start, stop) of successive stretches of sizes that add up to about ``most`` each."""
    which = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(which, prepend=-1)).tolist() if len(sizes) else []
    yield from zip(cuts, [*cuts[1:], len(sizes)])


def stretches(a: np.ndarray, b: np.ndarray, least: int, percent: int, gap: int = 12):
    """(start, stop in b, start, stop in a, likeness) of the stretches of b whose shingles a has.

    A stretch breaks where more than ``gap`` successive shingles are missing, and one that is not percent alike as
    sets breaks at its widest gap, until its parts are alike or shorter than ``least``.
    """
    if len(a) == 0 or len(b) < least:
        return
    order = a.argsort(kind="stable")
    ordered = a[order]
    at = np.minimum(ordered.searchsorted(b), len(a) - 1)
    hit = (ordered[at] == b).nonzero()[0]
    if len(hit) == 0 or hit[-1] - hit[0] + 1 < least:
        return
    where = order[at]
    cuts = ((hit[1:] - hit[:-1]) > gap).nonzero()[0] + 1
    cuts = [0, *cuts.tolist(), len(hit)]
    open_parts = [hit[x:y] for x, y in zip(cuts, cuts[1:])]
    while open_parts:
        part = open_parts.pop()
        x, y = int(part[0]), int(part[-1]) + 1
        if y - x < least:
            continue
        # repeated shingles may match far off: the bulk of the alignment decides where the stretch lies in a
        there = where[part]
        ahead = there - part
        offset = int(np.sort(ahead)[len(part) // 2])
        near = there[np.abs(ahead - offset) <= 64]
        u, w = max(0, min(int(near.min()), x + offset)), min(len(a), max(int(near.max()) + 1, y + offset))
        p, q = _distinct(a[u:w]), _distinct(b[x:y])
        union = len(_distinct(np.concatenate((p, q))))
        shared = len(p) + len(q) - union
        if 100 * shared >= percent * union:
            yield x, y, u, w, shared / union
        elif len(part) < y - x:
            cut = int((part[1:] - part[:-1]).argmax()) + 1
            open_parts += [part[:cut], part[cut:]]


def _distinct(s: np.ndarray) -> np.ndarray:
    """The distinct values of a short array, in order."""
    s = np.sort(s)
    new = np.empty(len(s), dtype=bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
