"""Toxicity by a gapped-subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share, each
weighted by decay ** span, so inserted characters and gaps lower the
likeness instead of destroying it. Landmark words span the kernel's feature
space (Nyström), a linear support vector machine separates insulting words there,
and, the decision being linear in the subsequences, it is folded back into one
weight per subsequence: a word costs a few table look-ups however many landmarks.

Only documents carry labels, so a toxic document is a bag of words at least
one of which is an insult. The fit starts from the few words that explain most
toxic documents and no clean ones, and then lets the machine name the most
insulting word of each document that is still unexplained. A document's score
is the logistic of its most insulting word's margin.

The fit reads a bounded sample of labelled rows (``max_toxic``, ``max_clean``) and, of their words,
``n_negative`` clean ones drawn by seed and ``n_hard`` near misses a round; where no word explains a toxic
document it starts from ``n_start`` words. Scoring is one pass over whole texts without a shuffle, and without a bound.

Defined cases: null or empty texts have no words and get the score of no insult;
without labelled rows of both kinds every score is the share of toxic rows (0.5
without any); a long text is scored whole; repeated rows each give theirs; columns of any other
name are left out; an empty table gives an empty result; every row gives one row.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, light, pick, text_batches

LETTERS, SPAN, DECAY = 32, 6, 0.7
DIMS = LETTERS**3
#: Words, with a mark before and after, that are longer than this are scored by overlapping windows.
WINDOW, STEP = 16, 5
FIRST, LAST = "\x02", "\x03"
#: Every (second, third) offset of a subsequence within the span.
OFFSETS = [(b, c) for c in range(2, SPAN) for b in range(1, c)]
EDGES = re.compile(r"^[^0-9a-zß-\U0010ffff]+|[^0-9a-zß-\U0010ffff]+$")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def words_of(text: str | None) -> set[str]:
    """The distinct words: lower case, without marks at the edges; letters spelled out one by one make one word."""
    if not text:
        return set()
    text = text.lower()
    found = {w if w.isalpha() else EDGES.sub("", w) for w in set(text.split())}
    found.update(re.sub(r"\s", "", m) for m in SPACED.findall(text))
    found.discard("")
    return found


def units(word: str) -> list[str]:
    word = FIRST + word + LAST
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW + STEP, STEP)]


def codes(words: list[str], n: int) -> np.ndarray:
    """(words, n) letter codes of words of n characters; 0 to 25 letters, then four classes for all else and the two marks."""
    p = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n).astype(np.int64)
    return np.where((p >= 97) & (p <= 122), p - 97, np.where(p <= 3, 28 + p, 26 + p % 4))


def subsequences(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (words, k) and their weights (k,) for words of n characters."""
    c = codes(words, n)
    at = [(i, i + b, i + e, DECAY ** (e + 1)) for b, e in OFFSETS for i in range(n - e)]
    if not at:
        return np.zeros((len(words), 0), dtype=np.int64), np.zeros(0)
    i, j, k, w = (np.array(x) for x in zip(*at))
    return (c[:, i] * LETTERS + c[:, j]) * LETTERS + c[:, k], w


def by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups.items()


def margins(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin of each word: its largest window's. The norm takes every occurrence as a feature of its own."""
    parts = [(i, u) for i, w in enumerate(words) for u in units(w)]
    out = np.full(len(words), bias)
    best = np.full(len(parts), bias)
    for n, at in by_length([u for _, u in parts]):
        for start in range(0, len(at), 20_000):
            some = at[start : start + 20_000]
            f, w = subsequences([parts[i][1] for i in some], n)
            if f.shape[1]:
                best[some] = (weight[f] @ w) / np.sqrt(w @ w) + bias
    if len(parts):
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, [i for i, _ in parts], best)
    return out


def phi(words: list[str]) -> np.ndarray:
    """Normalised feature vectors, dense: for landmarks and training words only."""
    out = np.zeros((len(words), DIMS), dtype=np.float32)
    for n, at in by_length(words):
        f, w = subsequences([words[i] for i in at], n)
        if f.shape[1]:
            np.add.at(out, (np.repeat(at, f.shape[1]), f.ravel()), np.tile(w / np.sqrt(w @ w), len(at)))
    return out


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps on all rows."""
    x = np.hstack([z.astype(np.float32), np.ones((len(z), 1), dtype=np.float32)])
    cost, y = cost.astype(np.float32), y.astype(np.float32)
    lam = 1e-4
    gram = sum(x[i : i + 2000].T @ (x[i : i + 2000] * cost[i : i + 2000, None]) for i in range(0, len(x), 2000))
    rate = 1.0 / (2 * np.linalg.norm(gram, 2) + lam)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (lam * v - 2 * x.T @ (cost * slack * y))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with one character inserted, at two places: what the machine is to see through."""
    out = []
    for w in words:
        for at in rng.integers(1, max(2, len(w)), 2).tolist():
            out.append(w[:at] + "*.-_x"[int(rng.integers(5))] + w[at:])
    return out


def explain(bags: list[tuple[frozenset[str], int]], least: int) -> tuple[set[str], list[int]]:
    """A small set of words that are in toxic and hardly in clean bags and cover the toxic ones; the uncovered bags."""
    clean, toxic = Counter(), Counter()
    for words, y in bags:
        (toxic if y else clean).update(words)
    n_clean = max(1, sum(1 for _, y in bags if not y))
    apt = {w for w, k in toxic.items() if k >= least and clean[w] <= 0.002 * n_clean and len(w) >= 3}
    left = {i: words & apt for i, (words, y) in enumerate(bags) if y}
    chosen: set[str] = set()
    while True:
        seen = Counter(w for words in left.values() for w in words)
        if not seen:
            break
        word, k = min(seen.items(), key=lambda x: (-x[1], -toxic[x[0]], x[0]))
        if k < least:
            break
        chosen.add(word)
        left = {i: words for i, words in left.items() if word not in words}
    return chosen, sorted(left)


def fit(bags: list[tuple[frozenset[str], int]], n_landmarks: int = 384, n_negative: int = 5_000, n_hard: int = 1500, n_start: int = 200, rounds: int = 3, seed: int = 5) -> dict:
    """The folded weights of the machine and the logistic curve from margin to score."""
    bags = list({frozenset(b): y for b, y in bags}.items())
    n_toxic = sum(y for _, y in bags)
    if not n_toxic or n_toxic == len(bags):
        return {"constant": n_toxic / len(bags) if bags else 0.5}
    rng = np.random.default_rng(seed)
    good, open_bags = explain(bags, least=3 if n_toxic >= 40 else 2)
    clean_words = sorted(set().union(*(b for b, y in bags if not y)))
    clean_set = set(clean_words)
    hard: list[str] = []
    weight, bias = np.zeros(DIMS), -1.0
    for r in range(rounds + 1):
        bad = [clean_words[i] for i in rng.permutation(len(clean_words))[:n_negative]] + 3 * hard
        bad = [u for w in bad for u in units(w)]  # near misses come up to three times and weigh so
        pos = [u for w in sorted(good) for u in units(w)]
        pos += [u for w in disguised([w for w in sorted(good) if len(w) >= 5], rng) for u in units(w)]
        if not pos:
            words = sorted(set().union(*(b for b, y in bags if y)) - clean_set)
            pos = [u for w in words[:n_start] for u in units(w)] or [FIRST + LAST]
        near = [u for w in hard for u in units(w)][: n_landmarks // 3]
        marks = list(dict.fromkeys([*[pos[i] for i in rng.permutation(len(pos))[: n_landmarks // 3]], *near, *bad]))[:n_landmarks]
        base = phi(marks)
        k = base @ base.T
        value, vector = np.linalg.eigh(k.astype(np.float64))
        keep = value > 1e-6 * value[-1]
        root = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
        parts = [half[i : i + 256] for half in (pos, bad) for i in range(0, len(half), 256)]
        z = np.vstack([phi(part) @ base.T for part in parts]) @ root  # a few hundred words at a time
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(bad))])
        cost = np.where(y > 0, 0.5 / len(pos), 0.5 / max(1, len(bad))) * len(y)
        w, bias = svm(z, y, cost)
        weight = base.T @ (root @ w).astype(np.float32)
        if r < rounds:
            scored = clean_words
            m = margins(scored, weight, bias)
            hard = list(dict.fromkeys([*[scored[i] for i in np.argsort(-m)[:n_hard] if m[i] > -0.9], *hard]))[: 2 * n_hard]
            for i in open_bags:  # the machine names the insult of a document that no word explains yet
                own = sorted(bags[i][0] - clean_set)
                if own:
                    mm = margins(own, weight, bias)
                    if mm.max() > 0:
                        good.add(own[int(mm.argmax())])
    model = {"weight": weight.astype(np.float32), "bias": bias}
    top = np.array([max(margins(sorted(b), weight, bias), default=bias) if b else min(bias, -1.0) for b, _ in bags])
    label = np.array([y for _, y in bags])
    a, b = 2.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve with a little shrinkage
        p = 1 / (1 + np.exp(-(a * top + b)))
        q = p * (1 - p) + 1e-6
        g = np.array([((p - label) * top).sum() + 0.1 * (a - 2), (p - label).sum() + 0.1 * b])
        h = np.array([[(q * top * top).sum() + 0.1, (q * top).sum()], [(q * top).sum(), q.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return model | {"a": max(a, 0.1), "b": b, "none": float(min(bias, -1.0))}


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def bounded_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_toxic: int, max_clean: int, seed: int = 5) -> DataFrame:
    """(words, y): the distinct words, joined by spaces, of at most max_toxic and max_clean labelled documents outside the held-out fold, by seeded hash."""
    train = pick(labels, id_col, "toxic").toDF("_id", "_y").filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    order = [F.xxhash64(F.lit(seed), "_id"), "_id", "_y"]
    some = train.filter("_y = 1").orderBy(*order).limit(max_toxic).unionByName(train.filter("_y = 0").orderBy(*order).limit(max_clean))
    texts = pick(docs, id_col, text_col).toDF("_id", "_text").join(F.broadcast(some), "_id")  # at most max_toxic + max_clean rows

    def run(batches):
        for batch in batches:
            for text, y in zip(batch["_text"], batch["_y"]):
                bag = sorted(words_of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(bag)]), pa.array([y.as_py()], pa.int32())], names=["words", "y"])

    return texts.select("_text", F.col("_y").cast("int").alias("_y")).mapInArrow(run, "words string, y int").distinct()


def fitted(bags: DataFrame) -> dict:
    """The machine of :func:`fit`, made by one task from the bounded sample; only its weights reach the driver."""

    def run(batches):
        rows = sorted((y, words) for batch in batches for words, y in zip(batch["words"].to_pylist(), batch["y"].to_pylist()))
        model = fit([(frozenset(map(sys.intern, words.split())), y) for y, words in rows])
        weight = model.pop("weight", np.zeros(0)).astype(np.float32).tobytes()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.binary()), pa.array([list(model)], pa.list_(pa.string())), pa.array([[float(v) for v in model.values()]], pa.list_(pa.float64()))], names=["weight", "names", "numbers"])

    row = bags.repartition(1).mapInArrow(run, "weight binary, names array<string>, numbers array<double>").head()
    if row is None:
        return fit([])
    model = dict(zip(row.names, row.numbers))
    return model | ({"weight": np.frombuffer(bytes(row.weight), dtype=np.float32)} if row.weight else {})


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, max_toxic: int = 1500, max_clean: int = 3000, cache_words: int = 60_000) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted, or with keep_rows the input row and its score as ``_score``."""
    model = fitted(bounded_bags(docs, labels, id_col, text_col, max_toxic, max_clean))
    plain = text_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = plain if keep_rows else plain.select(F.col(f"c{at_id}").alias("id"), F.col(f"c{at_text}").alias("text"))
    at_text = at_text if keep_rows else 1

    def run(batches):
        known: dict[str, float] = {}
        for batch in light(batches):
            scores = np.full(len(batch), model.get("constant", 0.0))
            if "weight" in model:
                column = batch.column(at_text)
                for start in range(0, len(batch), 200):
                    bags = [words_of(t.as_py()) for t in column.slice(start, 200)]
                    if len(known) > cache_words:
                        known.clear()
                    new = sorted(set().union(*bags) - known.keys())
                    known.update(zip(new, margins(new, model["weight"], model["bias"]).tolist()))
                    top = np.array([max(map(known.__getitem__, b), default=model["none"]) for b in bags])
                    scores[start : start + len(bags)] = 1 / (1 + np.exp(-np.clip(model["a"] * top + model["b"], -50, 50)))
            columns = [*batch.columns, pa.array(scores)] if keep_rows else [batch.column(0), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names if keep_rows else ["id"]), "_score"])
        known.clear()
        give_back()

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields]
    out = plain.mapInArrow(run, ", ".join([*(kinds if keep_rows else kinds[:1]), "_score double"]))
    if keep_rows:
        return out
    # a null id is in the learning part, for no row can be learned from it
    fold = F.coalesce(held_out(F.col("id")), F.lit(False))
    return out.select(F.col("id").alias(id_col), fold.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows scored 0.5 or more."""
    return score(docs, labels, keep_rows=True).filter("_score < 0.5").drop("_score").toDF(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
