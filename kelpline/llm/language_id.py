"""Language of each word by a linear-chain conditional random field, and of each text by its words.

A word's features are its own form (the learned lexicon), its prefixes and suffixes, and its character n-grams, hashed
into one table of weights.  Labels of neighbouring words are tied by learned transition weights.  Forward-backward runs
over all words of a batch at once: sequences are cut into runs, a run's transfer matrices are multiplied step by step for
all runs together, and the runs of a text are then chained.  Training follows the gradient of the log-likelihood of whole
sequences: texts of a bounded sample, laid end to end in random order, so that transitions see switches of language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm.common import stored

#: Letters are those of Unicode category L; marks within a word belong to it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SLOTS = 1 << 16
RUN = 32


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed slot) of every feature of lower-cased words.

    A word is taken with a mark at either end.  Features are its n-grams of 1 to 3 signs, its first and last 4 and 5 with
    the mark (shorter affixes are n-grams with a mark already), and the whole word.
    """
    signs = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(signs))
    start, end = (ends - lengths)[owner], ends[owner]
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    owners, slots = [np.arange(len(words))], [(whole * np.uint64(31) + np.uint64(7)) % np.uint64(SLOTS)]
    h = np.zeros(len(signs), np.uint64)
    for n in range(1, 6):
        h = h[: len(signs) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + signs[n - 1 :]
        on = at[: len(h)] + n <= end[: len(h)]
        if n > 3:
            on &= (at[: len(h)] == start[: len(h)]) | (at[: len(h)] + n == end[: len(h)])
        owners.append(owner[: len(h)][on])
        mixed = h[on] + np.uint64(n)
        slots.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(SLOTS))
    return np.concatenate(owners), np.concatenate(slots).astype(np.int64)


def _scores(weights: np.ndarray, owner: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, w[slots], n) for w in weights.T], axis=1)


def forward_backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginals (words, labels) of sequences given end to end; emit: log scores, trans: log weights (from, to)."""
    n, labels = emit.shape
    runs = -(-lengths // RUN)
    run_of_text = np.repeat(np.arange(len(lengths)), runs)
    first_run = np.cumsum(runs) - runs
    place = np.arange(len(run_of_text)) - first_run[run_of_text]
    starts = (np.cumsum(lengths) - lengths)[run_of_text] + place * RUN
    sizes = np.minimum(RUN, lengths[run_of_text] - place * RUN)
    # Step by step over the places of a run, for all runs at once: arrays are (place, run, label).
    at = starts + np.arange(RUN)[:, None]
    live = np.arange(RUN)[:, None] < sizes
    at = np.where(live, at, 0)
    w = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(trans - trans.max())
    w_runs = w[at]
    # The product of a run's matrices: from the label before it to its last label.  Only full runs are followed by others.
    full = np.flatnonzero(place + 1 < runs[run_of_text])
    product = np.broadcast_to(np.eye(labels), (len(full), labels, labels)).copy()
    for k in range(RUN if len(full) else 0):
        product = (product.reshape(-1, labels) @ t).reshape(-1, labels, labels)
        product *= w_runs[k, full][:, None, :]
        if k % 8 == 7:
            product /= product.sum(axis=(1, 2), keepdims=True)
    where = np.zeros(len(sizes), np.int64)
    where[full] = np.arange(len(full))
    ahead = np.ones((len(sizes), labels)) / labels  # label distribution before each run
    behind = np.ones((len(sizes), labels))  # weight of all that follows each run
    # The last run of a text has its own backward pass first: what precedes needs the weight of all its words.
    last = np.flatnonzero(place + 1 == runs[run_of_text])
    x = np.ones((len(last), labels))
    for k in range(RUN - 1, -1, -1):
        y = (x * w_runs[k, last]) @ t.T
        x = np.where(live[k, last][:, None], y / y.sum(axis=1, keepdims=True), x)
    entry = np.ones((len(sizes), labels))
    entry[last] = x
    for k in range(1, int(runs.max(initial=0))):
        i = (first_run + k)[runs > k]
        x = (ahead[i - 1, None, :] @ product[where[i - 1]])[:, 0]
        ahead[i] = x / x.sum(axis=1, keepdims=True)
        i = (first_run + runs - 1 - k)[runs > k]
        behind[i] = entry[i + 1]
        x = (product[where[i]] @ behind[i][:, :, None])[:, :, 0]
        entry[i] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((RUN, len(sizes), labels))
    x = ahead
    for k in range(RUN):
        x = (x @ t) * w_runs[k]
        x /= x.sum(axis=1, keepdims=True)
        alpha[k] = x
    x = behind
    for k in range(RUN - 1, -1, -1):
        alpha[k] *= x
        y = (x * w_runs[k]) @ t.T
        y /= y.sum(axis=1, keepdims=True)
        x = y if live[k].all() else np.where(live[k][:, None], y, x)
    alpha /= alpha.sum(axis=2, keepdims=True)
    out = np.empty((n, labels))
    out[at[live]] = alpha[live]
    return out


class Model:
    """labels, weights (SLOTS, labels) and transitions; scores of words are kept for `cache` distinct words."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, cache: int = 400_000):
        self.labels, self.weights, self.trans, self.cache = labels, weights, trans, cache
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(labels)), np.float32)

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        new = list(set(chain.from_iterable(texts)).difference(self.place))
        if len(self.place) + len(new) > self.cache:
            self.place = {}
            new = list(set(chain.from_iterable(texts)))
        if new:
            got = _scores(self.weights, *features(new), len(new))
            k = len(self.place)
            while k + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[k : k + len(new)] = got
            self.place |= {w: k + i for i, w in enumerate(new)}
        get = self.place.__getitem__
        return self.scores[np.fromiter(map(get, chain.from_iterable(texts)), np.int64)].astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The label with most of a text's words (by marginals) and its share of them; `und` without letters."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        names, shares = ["und"] * len(texts), [0.0] * len(texts)
        on = [i for i, x in enumerate(words) if x]
        if on:
            lengths = np.array([len(words[i]) for i in on])
            marginals = forward_backward(self.emissions([words[i] for i in on]), self.trans, lengths)
            share = np.add.reduceat(marginals, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            for i, row in zip(on, share, strict=True):
                names[i], shares[i] = self.labels[int(row.argmax())], float(min(1.0, row.max()))
        return names, shares

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a code-switched text with its likeliest language."""
        words = WORD.findall(text.lower())
        if not words:
            return []
        marginals = forward_backward(self.emissions([words]), self.trans, np.array([len(words)]))
        return list(zip(words, (self.labels[k] for k in marginals.argmax(axis=1)), strict=True))


def fit(texts: list[str], langs: list[str], epochs: int = 20, seed: int = 3) -> Model:
    """Maximum likelihood by Adagrad over sequences of about ten texts each."""
    labels = sorted(set(langs))
    words = [WORD.findall(t.lower()) for t in texts]
    keep = [i for i, x in enumerate(words) if x]
    vocabulary = {w: k for k, w in enumerate(sorted({w for i in keep for w in words[i]}))}
    if not labels or not vocabulary:
        return Model(labels or ["und"], np.zeros((SLOTS, max(1, len(labels)))), np.zeros((max(1, len(labels)),) * 2))
    owner, flat = features(list(vocabulary))
    rng = np.random.default_rng(seed)
    code = {x: k for k, x in enumerate(labels)}
    weights, trans = np.zeros((SLOTS, len(labels))), np.zeros((len(labels),) * 2)
    w_sum, t_sum = np.full(SLOTS, 1e-3), np.full_like(trans, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(keep)
        rows = np.concatenate([[vocabulary[w] for w in words[i]] for i in order])
        gold = np.concatenate([np.full(len(words[i]), code[langs[i]]) for i in order])
        sizes = [sum(len(words[i]) for i in order[k : k + 10]) for k in range(0, len(order), 10)]
        emit = _scores(weights, owner, flat, len(vocabulary))[rows]
        marginals = forward_backward(emit, trans, np.array(sizes))
        error = marginals.copy()
        error[np.arange(len(gold)), gold] -= 1
        by_word = np.stack([np.bincount(rows, error[:, k], len(vocabulary)) for k in range(len(labels))], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, k], SLOTS) for k in range(len(labels))], axis=1) / len(gold) + 1e-7 * weights
        # Expected transitions, from the marginals of neighbours and the current weights.
        inner = np.ones(len(gold), bool)
        inner[np.cumsum([0, *sizes[:-1]])] = False
        i = np.flatnonzero(inner)
        w = np.exp(emit[i] - emit[i].max(axis=1, keepdims=True))
        pair = marginals[i - 1][:, :, None] * np.exp(trans - trans.max())[None] * w[:, None, :]
        pair *= (marginals[i] / np.maximum(pair.sum(axis=1), 1e-300))[:, None, :]
        t_grad = pair.sum(axis=0)
        np.subtract.at(t_grad, (gold[i - 1], gold[i]), 1)
        t_grad = t_grad / len(gold) + 1e-4 * trans
        w_sum += (grad**2).sum(axis=1)
        t_sum += t_grad**2
        weights -= 0.5 * grad / np.sqrt(w_sum)[:, None]
        trans -= 0.1 * t_grad / np.sqrt(t_sum)
    return Model(labels, weights.astype(np.float32), trans)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, sample: int = 800) -> Model:
    """Learn from at most `sample` rows that are not held out, dealt evenly over all languages, one of each at least.

    The rows with the least hashes of doc_id and text are taken, so the sample does not depend on partitions.  Rows without
    text or lang take no part, repeated rows count once; without any row the model knows only `und`.
    """
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One scan without texts finds the rows; of each language the first are kept before and after the shuffle.
    keyed = rows.select("doc_id", "lang", F.xxhash64("text").alias("digest"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest"))
    first = stored(keyed.withColumn("place", place).where(F.col("place") <= sample), "language-sample")
    n_langs = first.select("lang").distinct().count()
    if not n_langs:
        return fit([], [])
    first = F.broadcast(first.where(F.col("place") <= max(1, sample // n_langs)).drop("place"))  # `sample` rows, or one for each language
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.lang") == F.col("f.lang")) & (F.xxhash64("d.text") == F.col("f.digest"))
    picked = rows.alias("d").join(first.alias("f"), same).select("d.text", "d.lang", "d.doc_id").distinct().select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = fit([t for t, _ in rows], [x for _, x in rows])
        columns = [pa.array([model.labels]), pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.trans.astype("<f8").tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, ["labels", "weights", "trans"])

    # The sample is bounded, so one task fits it; the driver gets weights of a fixed size.
    made = picked.repartition(1).mapInArrow(run, "labels array<string>, weights binary, trans binary").first()
    n = len(made["labels"])
    weights = np.frombuffer(bytes(made["weights"]), "<f4").reshape(SLOTS, n)
    return Model(list(made["labels"]), weights, np.frombuffer(bytes(made["trans"]), "<f8").reshape(n, n))


def languages(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and score; a column of one of these names is replaced.

    lang_pred: the learned language of most of the text's words; `und` with score 0 if the text is null or has no
    letter.  score: that language's share of the words, by their marginals.  Equal texts get equal results.
    """
    labels, weights, trans = model.labels, model.weights, model.trans
    shared = documents.sparkSession.sparkContext.broadcast((labels, weights, trans))  # SLOTS rows: a fixed size
    fields = [f for f in documents.schema.fields if f.name not in ("lang_pred", "score")]
    kept = documents.select(*[documents[f.name] for f in fields])
    loaded: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = loaded[0] if loaded else Model(*shared.value)
        loaded[:] = [here]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                names, shares = here.predict(some.column(some.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(names), pa.array(shares, pa.float64())], [*some.schema.names, "lang_pred", "score"]
                )

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)
