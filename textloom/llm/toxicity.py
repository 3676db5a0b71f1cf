"""Toxicity by a classifier chain.

Categories are predicted one after another; the linear (logistic) model of each gets the
probabilities of the earlier ones as further inputs. In training those inputs are
out-of-fold predictions, so a later model learns from what an earlier one says of
texts it hasn't seen.

The categories, in order, come from the labels table: ``low_quality`` (quality 0),
``abusive`` (toxic 1 in text of quality 1) and ``toxic`` (toxic 1), which sees the
probabilities of both. A document is rejected if its probability of ``toxic`` reaches a threshold, which is chosen on the out-of-fold
predictions where none is given.

Inputs are the presence of words and of words' first four and five letters (which
stand in for stems, in any language). Which of them count is chosen by their
two-proportion z-score, computed over the labelled sample on the executors. Training uses
at most ``SAMPLE`` labelled documents, the ones first by a hash of their id; scoring
reads every whole text.

Defined cases: null and empty texts have no inputs and get the models' base
probabilities; a category with one class only is predicted as its share; without any
labelled row nothing is rejected and probabilities are zero; null labels and labels
without a document are not used; repeated labels count each, repeated documents get a
row each; null ids are scored; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, stored, tidied

#: Labelled documents that the chain is fitted on, at most.
SAMPLE = 12_000
#: Inputs chosen for each category, at most.
INPUTS = 256
LEAST_Z, LEAST_DOCS = 4.0, 5
FOLDS = 5
CATEGORIES = ("low_quality", "abusive", "toxic")

WORDS = re.compile(r"[^\W\d_]+")


def inputs_of(word: str) -> tuple[int, ...]:
    """Hashed inputs of a word: itself and its beginnings."""
    w = word.encode()
    out = [zlib.crc32(w)]
    if len(word) >= 4:
        out.append(zlib.crc32(b"4" + word[:4].encode()))
    if len(word) >= 6:
        out.append(zlib.crc32(b"5" + word[:5].encode()))
    return tuple(out)


class Reader:
    """Chosen inputs that a text has; words are looked up once and remembered, up to a limit."""

    LIMIT = 200_000

    def __init__(self, chosen: np.ndarray | None = None):
        self.place = None if chosen is None else {int(h): k for k, h in enumerate(chosen)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def read(self, text: str | None) -> set[int]:
        if len(self.seen) > self.LIMIT:
            self.seen = {}
        seen, place, out = self.seen, self.place, set()
        for word in set(WORDS.findall((text or "").lower())):
            found = seen.get(word)
            if found is None:
                found = inputs_of(word)
                if place is not None:
                    found = tuple(place[h] for h in found if h in place)
                seen[word] = found
            if found:
                out.update(found)
        return out


# --- the chain ---------------------------------------------------------------------------


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the bias; L2-penalised, by accelerated gradient steps."""
    n, d = x.shape
    share = y.mean() if n else 0.0
    w = np.zeros(d + 1)
    w[-1] = np.log((share + 1e-6) / (1 - share + 1e-6))
    if share in (0.0, 1.0):
        return w
    v = np.ones(d, x.dtype) / max(1, np.sqrt(d))
    for _ in range(20):  # the largest curvature, by power iteration
        u = x.T @ (x @ v)
        size = np.sqrt(u @ u)
        v = u / max(size, 1e-12)
    step = 1 / (0.25 * (size + n) + penalty)
    look, old, t = w.copy(), w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ look[:-1].astype(x.dtype) + look[-1])))
        e = p - y
        g = np.concatenate([x.T @ e.astype(x.dtype) + penalty * look[:-1], [e.sum()]])
        w = look - step * g
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, old = w + (before - 1) / t * (w - old), w
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def best_threshold(p: np.ndarray, y: np.ndarray, low: float = 0.2, high: float = 0.8) -> float:
    """Where F1 is best, between ``low`` and ``high``; the middle of the best stretch."""
    grid = np.linspace(low, high, 61)
    f1 = np.array([2 * (y[p >= t]).sum() / max(1.0, (p >= t).sum() + y.sum()) for t in grid])
    good = grid[f1 >= f1.max() - 1e-12]
    return float(np.median(good)) if y.any() else 0.5


class Chain:
    """Models of all categories over binary inputs and the earlier categories' probabilities."""

    def __init__(self, chosen: np.ndarray, weights: list[np.ndarray], threshold: float):
        self.chosen, self.weights, self.threshold = chosen, weights, threshold

    @staticmethod
    def fit(chosen: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray, threshold: float | None = None) -> "Chain":
        """Without a threshold, the one of best F1 over the out-of-fold predictions of ``toxic`` is taken."""
        weights, earlier = [], np.zeros((len(x), 0), x.dtype)
        for k in range(y.shape[1]):
            full = np.hstack([x, earlier])
            out = np.zeros(len(x))
            for f in np.unique(fold):
                rest = fold != f
                out[~rest] = probability(full[~rest], fit_logistic(full[rest], y[rest, k]) if rest.any() else np.zeros(full.shape[1] + 1))
            weights.append(fit_logistic(full, y[:, k]))
            earlier = np.hstack([earlier, out[:, None].astype(x.dtype)])
        k = CATEGORIES.index("toxic")
        return Chain(chosen, weights, best_threshold(earlier[:, k], y[:, k]) if threshold is None else threshold)

    def predict(self, x: np.ndarray) -> np.ndarray:
        earlier = np.zeros((len(x), 0), x.dtype)
        for w in self.weights:
            earlier = np.hstack([earlier, probability(np.hstack([x, earlier]), w)[:, None].astype(x.dtype)])
        return earlier


def dense(found: list[set[int]], width: int) -> np.ndarray:
    x = np.zeros((len(found), width), np.float32)
    for k, f in enumerate(found):
        x[k, list(f)] = 1
    return x


# --- the corpus --------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float | None = None) -> Chain:
    spark = docs.sparkSession
    small_batches(spark)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND low_quality IS NOT NULL AND toxic IS NOT NULL")
        .withColumn("abusive", ((F.col("toxic") == 1) & (F.col("low_quality") == 0)).cast("int"))
    )
    chosen_ids = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).withColumn("fold", F.pmod(F.shiftright("h", 8), F.lit(FOLDS)).cast("int"))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen_ids.drop("h")), "doc_id"), "toxicity-sample")  # ``sample`` rows at most
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CATEGORIES]).first()
    n, sizes = total["n"], np.array([total[c] for c in CATEGORIES], float)

    def tally(batches):
        reader, count = Reader(), {}
        for batch in batches:
            marked = np.stack([batch.column(c).to_numpy() for c in CATEGORIES], axis=1)
            for text, m in zip(batch.column("text").to_pylist(), marked.tolist()):
                add = [1, *m]
                for h in reader.read(text):
                    c = count.get(h)
                    if c is None:
                        count[h] = add.copy()
                    else:
                        for i, a in enumerate(add):
                            c[i] += a
        keys = list(count)
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            c = np.array([count[h] for h in part], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *map(pa.array, c.T.copy())], ["input", "n", *CATEGORIES])

    counts = rows.select("text", *CATEGORIES).mapInArrow(tidied(tally), "input long, n long, " + ", ".join(f"{c} long" for c in CATEGORIES))
    counts = stored(counts.groupBy("input").agg(*[F.sum(c).alias(c) for c in ("n", *CATEGORIES)]).where(F.col("n") >= LEAST_DOCS), "toxicity-counts")
    chosen: set[int] = set()
    for c, size in zip(CATEGORIES, sizes):
        if 0 < size < n:
            share = F.col("n") / n
            z = (F.col(c) / size - (F.col("n") - F.col(c)) / (n - size)) / F.sqrt(share * (1 - share) * (1 / size + 1 / (n - size)) + F.lit(1e-12))
            best = counts.select("input", F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "input").limit(INPUTS)
            chosen.update(r["input"] for r in best.collect())
    inputs = np.array(sorted(chosen), np.int64)

    def narrow(batches):
        reader = Reader(inputs)
        for batch in batches:
            found = [sorted(reader.read(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *[batch.column(c) for c in ("fold", *CATEGORIES)]], ["found", "fold", *CATEGORIES])

    got = rows.select("text", "fold", *CATEGORIES).mapInArrow(tidied(narrow), "found array<int>, fold int, " + ", ".join(f"{c} int" for c in CATEGORIES)).collect() if n else []
    got.sort()
    x = dense([set(r["found"]) for r in got], len(inputs))
    y = np.array([[r[c] for c in CATEGORIES] for r in got], float).reshape(-1, len(CATEGORIES))
    if not len(got):
        return Chain(inputs, [np.array([*np.zeros(len(inputs) + k), -50.0]) for k in range(len(CATEGORIES))], 0.5)
    return Chain.fit(inputs, x, y, np.array([r["fold"] for r in got]), threshold)


def score(docs: DataFrame, chain: Chain, keep: bool = False) -> DataFrame:
    """doc_id, p_<category> and rejected; with ``keep`` the document's own columns before them."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred weights
    extra = [f"p_{c}" for c in CATEGORIES] + ["rejected"]
    source = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shown = [f for f in source.schema.fields if keep or f.name != "text"]

    def run(batches):
        model = shared.value
        reader = Reader(model.chosen)
        for batch in batches:
            p = model.predict(dense([reader.read(t) for t in batch.column("text").to_pylist()], len(model.chosen))).astype(np.float64)
            more = [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(p[:, CATEGORIES.index("toxic")] >= model.threshold)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in shown], *more], [*[f.name for f in shown], *extra])

    from pyspark.sql import types as T

    schema = T.StructType([*shown, *[T.StructField(f"p_{c}", T.DoubleType()) for c in CATEGORIES], T.StructField("rejected", T.BooleanType())])
    return source.mapInArrow(tidied(run), schema)
