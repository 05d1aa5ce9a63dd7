"""Language identification of words in context by a linear-chain conditional random field (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmetrics.llm.common import cut, documents, fold, offsets_of, shared_dir, small_batches, split_words, text_slices, trim
from procmetrics.llm.subwords import labelled_sample, mean_over_ngrams, word_ngrams
from procmetrics.operators.transforms import small

SIZES, BUCKETS, CHAIN = (1, 2, 3, 4), 1 << 16, 64
#: The bound of the training sample: so many documents of each language.
PER_LABEL = 300
UNDETERMINED = "und"
#: Bytes of text that a task labels at once, and how many of its chains (of one text too); their states take some 10 kB each.
SLICE, LOT = 1 << 20, 1024
#: Tables of up to so many bytes as files are broadcast.
BROADCAST = 8 << 20


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # bucket x label: affixes and inner n-grams
    lexicon: dict[bytes, np.ndarray]  # words of the sample: log odds of each label
    trust: np.ndarray  # of the lexicon, by label
    switch: np.ndarray  # label x label transition scores
    start: np.ndarray


def _lettered(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)


def _odds(lexicon: dict[bytes, np.ndarray], words: pa.Array, n_labels: int) -> np.ndarray:
    none = np.zeros(n_labels)
    found = [lexicon.get(w, none) for w in words.cast(pa.binary()).to_pylist()]
    return np.array(found).reshape(len(found), n_labels)


def emissions(model: Model, words: pa.Array) -> np.ndarray:
    """Score of each label for each distinct word; 0 for words without letters, which then follow their neighbours."""
    word, bucket = word_ngrams(words, SIZES, BUCKETS)
    value = np.stack([mean_over_ngrams(word, model.grams[bucket, k], len(words)) for k in range(len(model.labels))], axis=1)
    return np.where(_lettered(words)[:, None], value + model.trust * _odds(model.lexicon, words, len(model.labels)), 0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, switch: np.ndarray, start: np.ndarray):
    """Marginals (chains x places x labels) of chains padded to a common length, and what gradients need: scaled forward and backward terms.

    Terms are scaled at each place, so products never vanish. Beyond a chain's end the marginals mean nothing.
    """
    n, places, _ = scores.shape
    move = np.exp(switch)
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    ahead, behind = np.empty_like(local), np.ones_like(local)
    state = np.exp(start) * local[:, 0]
    ahead[:, 0] = state / state.sum(axis=1, keepdims=True)
    for t in range(1, places):
        state = (ahead[:, t - 1] @ move) * local[:, t]
        ahead[:, t] = state / state.sum(axis=1, keepdims=True)
    for t in range(places - 2, -1, -1):
        state = (local[:, t + 1] * behind[:, t + 1]) @ move.T
        behind[:, t] = np.where((t + 1 < lengths)[:, None], state / state.sum(axis=1, keepdims=True), 1)
    marginal = ahead * behind
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal, ahead, behind, local, move


def _chains(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text in chains of CHAIN (the last shorter): chain and place of each word, chain lengths, text of each chain."""
    within = np.arange(len(codes)) - np.repeat(offsets_of(counts)[:-1], counts)
    per_text = -(-counts // CHAIN)
    chain = np.repeat(offsets_of(per_text)[:-1], counts) + within // CHAIN
    return chain, within % CHAIN, np.bincount(chain, minlength=int(per_text.sum())), np.repeat(np.arange(len(counts)), per_text)


def train(sample: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, chains: int = 6000, seed: int = 1) -> Model:
    """Fits the field to (text, language) by likelihood, with Adagrad.

    chains bounds what is learned from: so many chains of CHAIN words, however large the sample is.
    Texts are of one language; to learn transitions, training chains are put together from runs of words of different texts (16 words
    on average), each word labelled by its text. The lexicon holds words seen twice or more. Ordered input gives the same model.
    """
    labels = sorted({y for _, y in sample})
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    random = np.random.default_rng(seed)
    words, counts = split_words(pa.array([t for t, _ in sample], pa.string()))
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    label = np.repeat([labels.index(y) for _, y in sample], counts) if len(codes) else np.array([], np.int64)
    seen = np.bincount(codes * k + label, minlength=len(distinct) * k).reshape(-1, k)
    share = (seen + 0.1) / (seen.sum(axis=0) + 0.1 * max(1, len(distinct)))
    odds = np.log(share) - np.log(share).mean(axis=1, keepdims=True)
    common = np.flatnonzero(seen.sum(axis=1) >= 2)
    names = distinct.cast(pa.binary()).to_pylist()
    lexicon = {names[w]: odds[w].astype(np.float32) for w in common}
    odds[seen.sum(axis=1) < 2] = 0
    model = Model(labels, np.zeros((BUCKETS, k)), lexicon, np.full(k, 0.1), np.zeros((k, k)), np.zeros(k))
    if not len(codes):
        return model
    lettered = _lettered(distinct)
    word, bucket = word_ngrams(distinct, SIZES, BUCKETS)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    grams = np.bincount(word, minlength=len(distinct))
    gram_at = offsets_of(grams)

    edges, by_label = offsets_of(counts), [np.flatnonzero([y == name for _, y in sample]) for name in labels]
    runs = np.empty((chains, CHAIN), np.int64)
    for c in range(chains):
        filled = 0
        while filled < CHAIN:
            mine = by_label[random.integers(k)]
            text = mine[random.integers(len(mine))]
            if not counts[text]:
                if not any(counts[m].any() for m in by_label):
                    return model
                continue
            n = min(CHAIN - filled, 1 + random.geometric(1 / 16))
            begin = edges[text] + random.integers(counts[text])
            n = min(n, edges[text + 1] - begin)
            runs[c, filled : filled + n] = np.arange(begin, begin + n)
            filled += n

    g_grams, g_trust, g_switch, g_start = np.full((BUCKETS, k), 1e-4), np.full(k, 1.0), np.full((k, k), 1.0), np.full(k, 1.0)
    lengths = np.full(128, CHAIN)
    for _ in range(epochs):
        for lo in range(0, chains, 128):
            at = runs[lo : lo + 128]
            types, where = np.unique(codes[at], return_inverse=True)
            where = where.reshape(at.shape)
            n = grams[types]
            rows = bucket[np.arange(int(n.sum())) + np.repeat(gram_at[types] - offsets_of(n)[:-1], n)]
            owner = np.repeat(np.arange(len(types)), n)
            value = np.stack([np.bincount(owner, weights=model.grams[rows, j], minlength=len(types)) for j in range(k)], axis=1) / np.maximum(n, 1)[:, None]
            value = np.where(lettered[types][:, None], value + model.trust * odds[types], 0)
            marginal, ahead, behind, local, move = forward_backward(value[where], lengths[: len(at)], model.switch, model.start)
            truth = np.eye(k)[label[at]]
            error = (truth - marginal) * lettered[codes[at]][:, :, None]
            joint = ahead[:, :-1, :, None] * move * (local[:, 1:] * behind[:, 1:])[:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            moved = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:]) - joint.sum(axis=(0, 1))
            slope = np.stack([np.bincount(where.ravel(), weights=error[:, :, j].ravel(), minlength=len(types)) for j in range(k)], axis=1)
            step = (slope / np.maximum(n, 1)[:, None])[owner]
            touched, place = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(place, weights=step[:, j], minlength=len(touched)) for j in range(k)], axis=1)
            g_grams[touched] += grad**2
            model.grams[touched] += rate * grad / np.sqrt(g_grams[touched])
            for value_, gradient, square in ((model.trust, (slope * odds[types]).sum(axis=0), g_trust), (model.switch, moved, g_switch), (model.start, (truth[:, 0] - marginal[:, 0]).sum(axis=0), g_start)):
                square += gradient**2
                value_ += rate * gradient / np.sqrt(square)
    return model


def word_marginals(model: Model, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, how many each text has, whether a word has a letter, and each word's probability of each label."""
    words, counts = split_words(texts)
    k = len(model.labels)
    if not len(words) or not k:
        return words, counts, _lettered(words), np.zeros((len(words), k))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    value, lettered = emissions(model, coded.dictionary), _lettered(coded.dictionary)
    chain, place, lengths, _ = _chains(codes, counts)
    ends, marginal = offsets_of(lengths), np.empty((len(codes), k))
    for lo in range(0, len(lengths), LOT):  # chains don't depend on each other, so a long text is done in parts
        some = slice(ends[lo], ends[min(lo + LOT, len(lengths))])
        mine, scores = (chain[some] - lo, place[some]), np.zeros((len(lengths[lo : lo + LOT]), CHAIN, k))
        scores[mine] = value[codes[some]]
        marginal[some] = forward_backward(scores, lengths[lo : lo + LOT], model.switch, model.start)[0][mine]
    return words, counts, lettered[codes], marginal


def predict_slice(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of each label among the lettered words of each text (by summed marginals), whether there is any, and how often the likeliest label changes from one such word to the next."""
    _, counts, lettered, marginal = word_marginals(model, texts)
    k, text = len(model.labels), np.repeat(np.arange(len(counts)), counts)
    if not k:
        return np.zeros((len(counts), 0)), np.zeros(len(counts), bool), np.zeros(len(counts), np.int64)
    own, of = marginal[lettered], text[lettered]
    share = np.stack([np.bincount(of, weights=own[:, j], minlength=len(counts)) for j in range(k)], axis=1)
    best = own.argmax(axis=1)
    turns = (best[1:] != best[:-1]) & (of[1:] == of[:-1])
    return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300), np.bincount(of, minlength=len(counts)) > 0, np.bincount(of[1:][turns], minlength=len(counts))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, n_switches): the label that most words of the whole text have, its share, and how often labels change from word to word.

    'und', 0 and 0 without a letter. Null texts count as without a letter, as does everything if nothing could be learned. Repeated
    rows stay repeated; an empty table gives none. id_col may be any column, also a struct of whole rows.
    """

    def run(batches):
        for part in text_slices(batches, "text", SLICE):
            share, lettered, turns = predict_slice(model, part.column("text"))
            best = share.argmax(axis=1) if model.labels else np.zeros(len(share), np.int64)
            names = [model.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
            score = np.where(lettered, share.max(axis=1, initial=0), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(turns.astype(np.int64))], names=["id", "lang_pred", "score", "n_switches"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_switches", T.LongType())])
    return _texts(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def label_words(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, words array<struct<word, label, share>>) of every row: each word of the whole text with its likeliest label and that label's probability.

    Words without a letter have a null label, as all have if nothing could be learned; null and empty texts have no words. Repeated rows
    stay repeated; an empty table gives none.
    """

    def run(batches):
        for part in text_slices(batches, "text", SLICE):
            words, counts, lettered, marginal = word_marginals(model, part.column("text"))
            best = marginal.argmax(axis=1) if model.labels else np.zeros(len(words), np.int64)
            labels = pa.array(np.array([*model.labels, UNDETERMINED], object)[best] if len(words) else [], pa.string(), mask=~(lettered & bool(model.labels)))
            shares = pa.array(marginal.max(axis=1, initial=0), pa.float64(), mask=~lettered)
            found = pa.StructArray.from_arrays([words.cast(pa.string()), labels, shares], names=["word", "label", "share"])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets_of(counts).astype(np.int32)), found)], names=["id", "words"])

    kind = df.schema[id_col].dataType.simpleString()
    return _texts(df, id_col, text_col).mapInArrow(run, f"id {kind}, words array<struct<word:string,label:string,share:double>>").withColumnRenamed("id", id_col)


def learn(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model of the documents outside fold 2 of 4 that have a language."""
    known = docs.select("doc_id", "lang").where(fold(F.col("doc_id"), 4) != 2)
    try:
        return train(labelled_sample(known, docs, "doc_id", "text", "lang", per_label))
    finally:
        trim()  # here of the driver


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = documents(spark, sf_dir)
    found = predict(docs, learn(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "n_switches")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents for which operator 6 finds a language, so all with letters; all their columns.

    Any share of the words will do, so that texts mixed of many languages stay. If no language could be learned, as where no row outside
    fold 2 has one, every document with a letter stays. Null and empty texts go; repeated rows stay repeated; nulls in other columns
    do no harm, and these may have any names. Only ids and texts pass through Python; what goes is joined away, by id and hash of the
    text, so whole rows aren't shuffled while that is small. An empty table gives an empty one.
    """
    model = learn(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("key")
    found = predict(docs.select(key, F.col("text").alias("text")), model, "key").where(F.col("lang_pred") == UNDETERMINED)
    with small_batches(docs.sparkSession):
        gone = cut(found.select(F.col("key.id").alias("gone_id"), F.col("key.h").alias("gone_h")).distinct(), shared_dir(docs.sparkSession, "language"))
    gone = small(gone, BROADCAST)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"]), "left_anti")
