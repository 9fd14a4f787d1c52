"""Toxicity categories by a classifier chain.

Categories are predicted one after the other.  The linear model of each sees a text's word and prefix rates and the
probabilities of the categories before it.  While a chain is trained these probabilities are out-of-fold predictions, so
later models learn from errors such as they will meet; the models used afterwards are fitted on all training rows.
Scoring is one pass over the texts and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm.common import stored

WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 18
PREFIXES = (4, 5, 6, 7)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SLOTS


class Words:
    """Slots of words (the whole word and its prefixes; -1: none), kept for a bounded number of words."""

    def __init__(self, live: np.ndarray | None = None, most: int = 400_000):
        self.live, self.most = live, most
        self.place: dict[str, int] = {}
        self.slots = np.zeros((1024, 1 + len(PREFIXES)), np.int64)

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, slot, value) of the features: logarithms of occurrences in a thousand words."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = set(chain.from_iterable(words)).difference(self.place)
        if len(self.place) + len(new) > self.most:
            self.place, new = {}, set(chain.from_iterable(words))
        k = len(self.place)
        while k + len(new) > len(self.slots):
            self.slots = np.concatenate([self.slots, np.zeros_like(self.slots)])
        if new:
            flat = np.fromiter((s for w in new for s in self._slots(w)), np.int64).reshape(len(new), -1)
            if self.live is not None:
                flat = np.where((flat >= 0) & self.live[flat], flat, -1)
            self.slots[k : k + len(new)] = flat
            self.place |= {w: k + i for i, w in enumerate(new)}
        lengths = np.array([len(w) for w in words])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64)
        slots = self.slots[at]
        text = np.repeat(np.arange(len(texts)), lengths)
        on = slots >= 0
        keys, counts = np.unique((text[:, None] * SLOTS + slots)[on], return_counts=True)
        row = keys // SLOTS
        return row, keys % SLOTS, np.log1p(1000 * counts / lengths[row])

    @staticmethod
    def _slots(word: str) -> list[int]:
        return [_slot(f"w{word}"), *(_slot(f"p{word[:n]}") if len(word) > n else -1 for n in PREFIXES)]


@dataclass
class Linear:
    weights: np.ndarray  # by slot
    earlier: np.ndarray  # by category before
    bias: float

    def probabilities(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(row, self.weights[slot] * value, len(earlier)) + earlier @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(features: tuple, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 80) -> Linear:
    """Weighted logistic regression with a penalty on absolute weights, by proximal Adagrad.

    A feature counts by how much likelier it is in rows of one kind than in the others (a smoothed ratio of the shares of
    rows that have it), so that few labelled rows don't drown it in common words.
    """
    row, slot, value = features
    n = len(y)
    used, col = np.unique(slot, return_inverse=True)
    some = np.bincount(col, (y * weight)[row], len(used)) / max(weight.mean(), 1e-12)
    none = np.bincount(col, ((1 - y) * weight)[row], len(used)) / max(weight.mean(), 1e-12)
    total = weight / max(weight.mean(), 1e-12)
    ratio = np.log((some + 1) / (y @ total + 2)) - np.log((none + 1) / ((1 - y) @ total + 2))
    value = value * ratio[col]
    w, e, b = np.zeros(len(used)), np.zeros(earlier.shape[1]), float(np.log((y @ weight + 1) / ((1 - y) @ weight + 1)))
    sums, e_sums, b_sum = np.full(len(used), 1e-4), np.full(len(e), 1e-4), 1e-4
    scale = weight / weight.sum()
    for _ in range(steps):
        z = np.bincount(row, w[col] * value, n) + earlier @ e + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * scale
        grad, e_grad, b_grad = np.bincount(col, error[row] * value, len(used)), earlier.T @ error, error.sum()
        sums += grad**2
        e_sums += e_grad**2
        b_sum += b_grad**2
        rate = 0.5 / np.sqrt(sums)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * 1e-4)
        e = e - 0.5 * e_grad / np.sqrt(e_sums)
        b -= 0.5 * b_grad / np.sqrt(b_sum)
    weights = np.zeros(SLOTS)
    weights[used] = w * ratio
    return Linear(weights, e, b)


@dataclass
class ChainModel:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]


def fit_chain(texts: list[str], labels: dict[str, list[int]], weight: np.ndarray, folds: int = 3) -> ChainModel:
    """Fit the categories in the order of `labels`; each threshold gives the best F1 out of fold."""
    row, slot, value = Words().rates(texts)
    known, counts = np.unique(slot, return_counts=True)
    often = np.zeros(SLOTS, bool)
    often[known[counts >= 3]] = True
    on = often[slot]
    row, slot, value = row[on], slot[on], value[on]
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % folds for t in texts])  # copies share a fold
    earlier = np.zeros((len(texts), 0))
    models, thresholds = [], []
    for y in labels.values():
        y = np.array(y, float)
        out = np.zeros(len(texts))
        for k in range(folds):
            there, here = fold != k, fold == k
            new = np.cumsum(there) - 1
            some = there[row]
            part = fit_linear((new[row[some]], slot[some], value[some]), earlier[there], y[there], weight[there])
            out[here] = part.probabilities(row, slot, value, earlier)[here]
        models.append(fit_linear((row, slot, value), earlier, y, weight))
        thresholds.append(_threshold(out, y, weight))
        earlier = np.column_stack([earlier, out])
    return ChainModel(list(labels), models, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1, but none under 0.5: with few labelled rows, out-of-fold predictions say little."""
    order = np.argsort(-p, kind="stable")
    hit, taken = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    score = 2 * hit / np.maximum(taken + y @ weight, 1e-9)
    last = np.append(p[order][1:] < p[order][:-1], True)  # between ties there is no threshold
    best = int(np.where(last, score, -1).argmax())
    return max(0.5, float((p[order][best] + (p[order][best + 1] if best + 1 < len(p) else 0.0)) / 2)) if len(p) else 0.5


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 2400) -> ChainModel:
    """Fit a chain on at most `sample` labelled rows, half of them with a category and half without where there are enough.

    categories: name -> condition over the columns of labels, in the order of the chain; null counts as false.  Rows of
    the sample are those with the least hashes of doc_id and text; each stands for as many rows as its half has.  They are
    found on rows without texts, whose texts (null ones take no part) are then read in one scan; one task fits the
    chain.  Labels of the same doc_id, and documents with the same one, count for each pair.  Without labelled texts, or
    for empty tables, nothing is in any category.
    """
    spark = documents.sparkSession
    flags = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in categories.items()}
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(f"flag_{k}") for k, c in enumerate(flags.values())])
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    narrow = texts.select("doc_id", "digest").join(known, "doc_id").withColumn("key", F.xxhash64("doc_id", "digest"))
    names = [f"flag_{k}" for k in range(len(flags))]
    rows = stored(narrow.withColumn("any", F.greatest(*names) if len(names) > 1 else F.col(names[0])), "toxicity-labelled")
    halves = [rows.where(F.col("any") == some).orderBy("key", *names).limit(sample // 2) for some in (0, 1)]
    picked = stored(halves[0].union(halves[1]), "toxicity-sample")
    n = picked.groupBy("any").agg(F.count("*").alias("taken")).join(rows.groupBy("any").agg(F.count("*").alias("of")), "any")
    picked = stored(picked.join(n, "any").withColumn("weight", F.col("of") / F.col("taken")).select("doc_id", "digest", *names, "weight"), "toxicity-sample")
    # The sample is bounded; so is what a scan of the texts sends on.
    found = texts.join(F.broadcast(picked), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest", *names])

    ordered = list(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not got:
            return
        model = fit_chain([r[0] for r in got], {n: [r[2 + k] for r in got] for k, n in enumerate(ordered)}, np.array([r[1] for r in got]))
        used = [np.flatnonzero(m.weights) for m in model.models]
        columns = [
            pa.array(range(len(used)), pa.int32()),
            pa.array([u.astype("<i4").tobytes() for u in used]),
            pa.array([m.weights[u].astype("<f8").tobytes() for m, u in zip(model.models, used, strict=True)]),
            pa.array([m.earlier.tolist() for m in model.models], pa.list_(pa.float64())),
            pa.array([float(m.bias) for m in model.models]),
            pa.array(model.thresholds, pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["place", "slots", "weights", "earlier", "bias", "threshold"])

    schema = "place int, slots binary, weights binary, earlier array<double>, bias double, threshold double"
    made = found.select("text", "weight", *names).repartition(1).mapInArrow(run, schema).orderBy("place").collect()  # a row for each category
    if not made:
        return ChainModel(ordered, [Linear(np.zeros(SLOTS), np.zeros(k), -40.0) for k in range(len(ordered))], [0.5] * len(ordered))
    models = []
    for r in made:
        weights = np.zeros(SLOTS)
        weights[np.frombuffer(bytes(r["slots"]), "<i4")] = np.frombuffer(bytes(r["weights"]), "<f8")
        models.append(Linear(weights, np.array(r["earlier"], float), r["bias"]))
    return ChainModel(ordered, models, [r["threshold"] for r in made])


def classify(documents: DataFrame, model: ChainModel) -> DataFrame:
    """documents with, for each category, its probability `<category>_score` and the decision `<category>`.

    Columns of these names are replaced.  Null texts and texts without letters have score 0 in each category and no
    category; equal texts get equal results.
    """
    # Slots and categories are fixed in number, whatever the corpus.
    shared = documents.sparkSession.sparkContext.broadcast(model)
    made = [x for c in model.categories for x in (f"{c}_score", c)]
    fields = [f for f in documents.schema.fields if f.name not in made]
    kept = documents.select(*[documents[f.name] for f in fields])
    loaded: list[Words] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chained = shared.value
        if not loaded:
            loaded.append(Words(reduce(np.logical_or, [m.weights != 0 for m in chained.models])))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = some.column(some.schema.get_field_index("text")).to_pylist()
                features = loaded[0].rates(texts)
                empty = np.array([not t or not WORD.search(t) for t in texts])
                earlier = np.zeros((len(texts), 0))
                columns = []
                for one, threshold in zip(chained.models, chained.thresholds, strict=True):
                    p = np.where(empty, 0.0, one.probabilities(*features, earlier))
                    columns += [pa.array(p), pa.array((p > threshold) & ~empty)]
                    earlier = np.column_stack([earlier, p])
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], [*some.schema.names, *made])

    extra = [T.StructField(x, T.DoubleType() if x.endswith("_score") else T.BooleanType()) for x in made]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *extra]))


def categories() -> dict[str, Column]:
    """The chain of the query, over given labels: low quality, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
