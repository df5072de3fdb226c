"""Toxicity by averaged subword-bag embeddings and a linear softmax.

A text is the set of its words; a word is the bag of itself and its character n-grams, hashed to buckets.
Bucket embeddings are averaged over the text and classified by a softmax; both are trained together, in
numpy, on a bounded sample of labelled rows. An unseen misspelling shares most n-grams with the word it
comes from. Afterwards every bucket is worth one number, so that scoring is a mean of numbers.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, whole_text

WORDS = re.compile(r"\w+")


def word_grams(word: str, grams: tuple[int, ...]) -> list[str]:
    """The marked word and its n-grams."""
    marked = f"<{word}>"
    return [marked] + [marked[i : i + n] for n in grams for i in range(len(marked) - n + 1)]


def bucket(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def bag(text: str, buckets: int, grams: tuple[int, ...], known: dict[str, int]) -> list[int]:
    """The buckets of a text's distinct words, in order of appearance. ``known`` is a cache of n-grams."""
    found = []
    for word in dict.fromkeys(WORDS.findall(text.lower())):
        for gram in word_grams(word, grams):
            at = known.get(gram)
            if at is None:
                at = bucket(gram, buckets)
                if len(gram) <= 8:
                    known[gram] = at
            found.append(at)
    return found


@dataclass(frozen=True)
class Settings:
    sample: int = 4000  #: labelled rows to train on, chosen by hash; the bound of what reaches the driver
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (3, 4)
    dims: int = 6
    epochs: int = 8
    batch: int = 250
    least_steps: int = 300
    rate: float = 0.3
    seed: int = 3


@dataclass(frozen=True)
class Model:
    """``worth[b]``: what bucket b adds to the log odds of "toxic", per bucket of the text."""

    worth: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def scorer(self):
        return Scorer(self)


class Scorer:
    MOST_WORDS = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, complex] = {}
        self.grams: dict[str, float] = {}

    def _gram(self, gram: str) -> float:
        worth = float(self.model.worth[bucket(gram, len(self.model.worth))])
        if len(gram) <= 8:
            self.grams[gram] = worth
        return worth

    def _learn(self, word: str) -> complex:
        """Sum of worths as the real part, number of buckets as the imaginary: one addition for both."""
        known = self.grams
        total, grams = 0.0, word_grams(word, self.model.grams)
        for gram in grams:
            worth = known.get(gram)
            total += self._gram(gram) if worth is None else worth
        made = complex(total, len(grams))
        if len(word) <= 40:
            self.words[word] = made
        return made

    def score(self, text: str) -> float:
        if len(self.words) > self.MOST_WORDS:
            self.words.clear()
        if len(self.grams) > self.MOST_WORDS:
            self.grams.clear()
        known = self.words
        total = sum([known.get(w) or self._learn(w) for w in dict.fromkeys(WORDS.findall(text.lower()))], 0j)
        odds = self.model.bias + total.real / weight(total.imag)
        return 1.0 / (1.0 + math.exp(-min(max(odds, -30.0), 30.0)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> Model:
    """``bags``: (buckets, counts) of each text. Adagrad on minibatches, in a fixed order by the seed."""
    draw = np.random.default_rng(settings.seed)
    table = draw.normal(0, 0.1, (settings.buckets, settings.dims))
    softmax = draw.normal(0, 0.1, (settings.dims, 2))
    rate = float(labels.mean()) if len(labels) else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    bias = np.log(np.array([1 - rate, rate]))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(settings.buckets), float(bias[1] - bias[0]), settings.grams)
    sizes = np.array([len(ids) for ids, _ in bags])
    # Every fifth text is kept back to calibrate the score on.
    use = np.flatnonzero((sizes > 0) & (np.arange(len(sizes)) % 5 != 4))
    kept_back = np.flatnonzero((sizes > 0) & (np.arange(len(sizes)) % 5 == 4))
    if not len(use):
        return Model(np.zeros(settings.buckets), float(bias[1] - bias[0]), settings.grams)
    table_sq = np.full(settings.buckets, 1e-8)
    softmax_sq, bias_sq = np.full_like(softmax, 1e-8), np.full_like(bias, 1e-8)
    wanted = np.eye(2)[labels.astype(int)]
    # Small samples go in smaller batches and more often, so that they too are learnt.
    size = min(settings.batch, max(16, len(use) // 16))
    for _ in range(max(settings.epochs, settings.least_steps * size // len(use))):
        order = draw.permutation(use)
        for start in range(0, len(order), size):
            chosen = order[start : start + size]
            ids = np.concatenate([bags[k][0] for k in chosen])
            share = np.concatenate([bags[k][1] / weight(bags[k][1].sum()) for k in chosen])
            heads = np.concatenate([[0], np.cumsum(sizes[chosen])[:-1]])
            mean = np.add.reduceat(table[ids] * share[:, None], heads, axis=0) * SCALE
            logits = mean @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            guess = np.exp(logits)
            guess /= guess.sum(axis=1, keepdims=True)
            wrong = (guess - wanted[chosen]) / len(chosen)
            to_mean = wrong @ softmax.T * SCALE
            to_softmax, to_bias = mean.T @ wrong, wrong.sum(axis=0)
            rows, inverse = np.unique(ids, return_inverse=True)
            spread = np.repeat(to_mean, sizes[chosen], axis=0) * share[:, None]
            to_rows = np.stack(
                [np.bincount(inverse, spread[:, d], len(rows)) for d in range(settings.dims)], axis=1
            )
            # One rate for a bucket's whole vector.
            table_sq[rows] += (to_rows**2).mean(axis=1)
            table[rows] -= settings.rate * to_rows / np.sqrt(table_sq[rows])[:, None]
            softmax_sq += to_softmax**2
            softmax -= settings.rate * to_softmax / np.sqrt(softmax_sq)
            bias_sq += to_bias**2
            bias -= settings.rate * to_bias / np.sqrt(bias_sq)
    worth = SCALE * (table @ (softmax[:, 1] - softmax[:, 0]))
    shift = float(bias[1] - bias[0])
    if len(set(labels[kept_back].tolist())) == 2:
        odds = np.array([shift + (worth[bags[k][0]] * bags[k][1]).sum() / weight(bags[k][1].sum()) for k in kept_back])
        slope, more = calibrated(odds, labels[kept_back])
        worth, shift = worth * slope, shift * slope + more
    return Model(worth, shift, settings.grams)


#: Averages over thousands of buckets are small; this brings them to the size of the softmax weights.
SCALE = 100.0
#: Neutral buckets that every average holds besides the text's own, so that few words prove little.
PADDING = 500


def weight(n):
    return n + PADDING


def calibrated(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the log odds fit the labels: Newton steps on a slightly ridged likelihood."""
    x = np.stack([odds, np.ones(len(odds))], axis=1)
    found, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        slope = x.T @ (p - labels) + 0.01 * (found - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        found -= np.clip(step, -1.0, 1.0)
    return float(max(found[0], 1e-3)), float(found[1])


def held_out(id_column) -> F.Column:
    """Ids whose labels are never learnt from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Model:
    """Train on at most ``settings.sample`` labelled rows that are not held out.

    NULL ids and labels other than 0 and 1 are left out; labels without a document teach nothing. With no
    label of one class, every text gets the same score.
    """
    known = labels.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label_column}`").alias("_toxic"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out("_id"))
    chosen = known.orderBy(F.xxhash64(F.lit(settings.seed), "_id"), "_id", "_toxic").limit(settings.sample)
    texts = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_toxic", "_text")

    def work():
        known: dict[str, int] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            buckets, counts = [], []
            if len(known) > 400_000:
                known.clear()
            for text in batch.column(2).to_pylist():
                found = np.array(bag(text, settings.buckets, settings.grams, known), np.int64)
                ids, number = np.unique(found, return_counts=True)
                buckets.append(ids.astype("<i4").tobytes())
                counts.append(number.astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(batch.column(1)).cast(pa.int32()), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
                ["_id", "_toxic", "buckets", "counts"],
            )

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    made = in_batches(rows, f"_id {kind}, _toxic int, buckets binary, counts binary", work)
    # Documents that share an id come along; the bound holds for rows too.
    found = sorted(made.limit(settings.sample).collect(), key=lambda r: (str(r["_id"]), r["buckets"]))
    bags = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in found]
    return train(bags, np.array([r["_toxic"] for r in found], np.int64), settings)


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``score``, ``predicted``) of every whole text, one row per row.

    Only the text counts. NULL, empty and wordless texts get the score of the bias alone. Equal texts get
    equal scores. Ids may be NULL or repeated; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))

    def work():
        scorer = model.scorer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [scorer.score(text) for text in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_id", "score"])

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    scored = in_batches(rows, f"_id {kind}, score double", work)
    return scored.select(
        F.col("_id").alias(id_column), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
