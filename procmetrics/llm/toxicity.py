"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import documents, fold, offsets_of, split_words, text_slices
from procmetrics.llm.subwords import labelled_sample, mean_over_ngrams, word_ngrams

SIZES, BUCKETS, DIMS, WINDOW = (3, 4, 5), 1 << 17, 8, 2
#: The bound of the training sample: so many documents of each label.
PER_LABEL = 1000
#: Rows from which on a label weighs about as much as any other in the line.
EVEN = 100


@dataclass
class Model:
    """Softmax margin (toxic less not) of each n-gram's embedding, and the line that turns a window's mean margin into a logit."""

    margin: np.ndarray
    slope: float
    bias: float


def window_means(values: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of every window of words of each text (one shorter window in a shorter text); its first word; windows of each text."""
    total, starts = offsets_of_values(values), offsets_of(counts)
    made = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    at = np.arange(int(made.sum())) + np.repeat(starts[:-1] - offsets_of(made)[:-1], made)
    ends = np.minimum(at + window, np.repeat(starts[1:], made))
    return (total[ends] - total[at]) / np.maximum(ends - at, 1), at, made


def offsets_of_values(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(values)])


def _top(means: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The highest window of each text that has any."""
    full = np.flatnonzero(made)
    out = np.zeros(len(made))
    if len(full):
        out[full] = np.maximum.reduceat(means, offsets_of(made)[full])
    return out


def train(sample: list[tuple[str, int]], folds: int = 3, **how) -> Model:
    """A model of (text, 0 or 1), its line fitted to scores of texts that the scoring part had not seen, fold by fold.

    Without both labels the model gives 0 for every text.
    """
    labels = np.array([int(y) for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, -20.0)
    of = np.empty(len(labels), np.int64)
    for y in (0, 1):  # as many of each label in each fold
        of[labels == y] = np.arange(int((labels == y).sum())) % folds
    unseen = np.zeros(len(labels))
    if min(np.bincount(labels)) >= 2 * folds:
        for k in range(folds):
            margin = fit([sample[n] for n in np.flatnonzero(of != k)], **how)
            mine = np.flatnonzero(of == k)
            unseen[mine] = _tops(margin, pa.array([sample[n][0] for n in mine], pa.string()))
        margin = fit(sample, **how)
    else:
        margin = fit(sample, **how)
        unseen = _tops(margin, pa.array([t for t, _ in sample], pa.string()))
    return Model(margin.astype(np.float32), *_line(unseen, labels))


def _tops(margin: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The highest window margin of each text; 0 for a text without words."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    word, bucket = word_ngrams(coded.dictionary, SIZES, BUCKETS)
    value = mean_over_ngrams(word, margin[bucket], len(coded.dictionary))
    means, _, made = window_means(value[coded.indices.to_numpy()] if len(words) else np.array([]), counts)
    return _top(means, made)


def fit(sample: list[tuple[str, int]], epochs: int = 12, rate: float = 0.3, seed: int = 1) -> np.ndarray:
    """Learns embeddings and softmax together; gives the margin of each n-gram.

    A few words make a text toxic, and an average over a long text would drown them; so the bag that is averaged is a window of
    words. In each round a toxic text teaches by its window of highest score, a clean text by its highest and one other. The first
    round's scores are the log odds of the n-grams.
    """
    labels = np.array([int(y) for _, y in sample])
    random = np.random.default_rng(seed)
    words, counts = split_words(pa.array([t for t, _ in sample], pa.string()))
    coded = words.dictionary_encode()
    codes, n_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    word, bucket = word_ngrams(coded.dictionary, SIZES, BUCKETS)
    order = np.argsort(word, kind="stable").astype(np.int32)
    word, bucket = word[order], bucket[order]
    del order, words
    grams = np.bincount(word, minlength=n_words)
    gram_at = offsets_of(grams)

    doc = np.repeat(np.arange(len(sample)), counts)
    pairs = np.unique(doc * n_words + codes)
    odds = []
    for y in (1, 0):
        mine = pairs[labels[pairs // n_words] == y] % n_words
        seen = np.bincount(bucket, weights=np.bincount(mine, minlength=n_words)[word], minlength=BUCKETS)
        odds.append(np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS)))
    margin = odds[0] - odds[1]

    vectors = random.normal(0, 0.05, (BUCKETS, DIMS))
    vectors[:, 0] += 0.02 * margin  # the first axis begins as the log odds
    softmax, bias = np.zeros((DIMS, 2)), np.zeros(2)
    softmax[0] = -5.0, 5.0
    g_vectors, g_softmax, g_bias = np.full((BUCKETS, DIMS), 1e-3), np.full((DIMS, 2), 1e-1), np.full(2, 1e-1)
    for _ in range(epochs):
        means, at, made = window_means(mean_over_ngrams(word, margin[bucket], n_words)[codes], counts)
        first = offsets_of(made)
        best, other = [], []
        for k in np.flatnonzero(made):
            best.append(first[k] + int(np.argmax(means[first[k] : first[k + 1]])))
            other.append(random.integers(first[k], first[k + 1]))
        full = np.flatnonzero(made)
        chosen = np.concatenate([best, np.array(other)[labels[full] == 0]]).astype(np.int64)
        target = np.concatenate([labels[full], np.zeros(int((labels[full] == 0).sum()), np.int64)])
        shuffle = random.permutation(len(chosen))
        ends = np.minimum(at + WINDOW, np.repeat(offsets_of(counts)[1:], made))
        for lo in range(0, len(shuffle), 256):
            some = shuffle[lo : lo + 256]
            begin, size = at[chosen[some]], (ends - at)[chosen[some]]
            tokens = codes[np.arange(int(size.sum())) + np.repeat(begin - offsets_of(size)[:-1], size)]
            n = grams[tokens]
            rows = bucket[np.arange(int(n.sum())) + np.repeat(gram_at[tokens] - offsets_of(n)[:-1], n)]
            window = np.repeat(np.repeat(np.arange(len(some)), size), n)
            weight = 1.0 / (np.repeat(n, n) * size[window])
            x = np.stack([np.bincount(window, weights=vectors[rows, d] * weight, minlength=len(some)) for d in range(DIMS)], axis=1)
            logits = x @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            step, slide = x.T @ p, p @ softmax.T
            touched, where = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(where, weights=slide[window, d] * weight, minlength=len(touched)) for d in range(DIMS)], axis=1)
            g_vectors[touched] += grad**2
            vectors[touched] -= rate * grad / np.sqrt(g_vectors[touched])
            g_softmax += step**2
            softmax -= rate * step / np.sqrt(g_softmax)
            g_bias += p.sum(axis=0) ** 2
            bias -= rate * p.sum(axis=0) / np.sqrt(g_bias)
        margin = vectors @ (softmax[:, 1] - softmax[:, 0])

    return margin


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the top window's margin; Newton steps with a light ridge.

    A label of n rows weighs n / (n + EVEN) in all: labels of many rows the same, since how many the sample has is its bound's doing; labels
    of few by their rows, since these say little of how scores overlap.
    """
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, weight = np.zeros(2), 1 / (np.bincount(y, minlength=2) + EVEN)[y]
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, z.T @ (weight * (p - y)) + 1e-2 * w), -3, 3)
    return float(w[0] / scale), float(w[1])


def score_slice(model: Model, texts: pa.Array) -> np.ndarray:
    logit = model.slope * _tops(model.margin, texts) + model.bias
    empty = ~pc.match_substring_regex(pc.fill_null(texts, ""), r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    return 1 / (1 + np.exp(-np.clip(np.where(empty, min(model.bias, 0.0), logit), -40, 40)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row; of the whole text. Null and empty texts have no window and get the bias alone. Repeated rows stay repeated; an empty table gives none."""

    def run(batches):
        for part in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score_slice(model, part.column("text")), pa.float64())], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels outside fold 1 of 3, scores of all documents. Of several labels of a document the highest holds."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").where(~held_out).join(labels, "doc_id")
    model = train(labelled_sample(known, docs, "doc_id", "text", "toxic", PER_LABEL))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
