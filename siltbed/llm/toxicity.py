"""Toxicity with a convolutional text classifier, and thresholds by language.

Words (runs of letters and digits, in lower case) are sums of hashed embeddings
of the whole word and of its first 3 to 8 bytes. Filters of widths 1, 2 and
3 run over the words; each filter's largest activation in the text feeds a
logistic output. Training is stochastic gradient descent (Adagrad) in numpy, in one task
of an executor, on about ``TOXIC`` and ``CLEAN`` labelled texts, whole and of any
length; a gradient reaches the words at the largest activations.

A part of the sample that training leaves out gives a threshold for each language,
predicted from the text by a language model of the same sample, and one for all.
The score is the network's probability, shifted on the log-odds scale so that
the threshold of the text's language falls on ``CUT``.

Null and empty texts have no words and get the score of a text without
activations. Without both labels among the training rows every score is 0. An
empty table gives an empty result. Very long texts are learnt and scored whole: in training
a text is a list of word numbers, in scoring the longest are chunks of their own.
Of several labels of an id the largest counts. Null ids count as empty strings and have
no label. Equal texts tie: they get equal scores, and at a threshold the score itself is
rejected. Repeated rows get repeated results; extra columns are
ignored by the query and kept, unless they are named like a result, by ``classify``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm import langid
from siltbed.llm.arrays import LOWER, HashTable, chunks, mix, offsets_of, powers, sum_by
from siltbed.llm.worker import Shared, in_one_task, per_worker

#: Bound of the training sample: about so many texts of each label.
TOXIC, CLEAN = 4000, 8000
ROWS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 4, (1, 2, 3)
PREFIXES = (0, 3, 4, 5, 6, 7, 8)  # bytes; 0: the whole word
#: Passes over the sample (least and most), and texts to see in all.
EPOCHS, SEEN = (5, 20), 48_000
#: Shares of word features and of words that a pass leaves out.
DROPPED, THINNED = 0.4, 0.35
BATCH, RATE, DECAY = 32, 0.1, 1e-5
CUT = 0.7
#: Toxic texts of a language that its own threshold takes.
LEAST_TOXIC = 8

_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def held_out(key: str, of: int = 3, rest: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of == rest


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word (one column for each prefix), and offsets by text."""
    low = LOWER[data]
    if len(low):
        high = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3) & (low[1:] != 0x97)) + 1
        low[high] += 0x20  # capital letters of Latin-1
    part = _PART[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    edge = np.zeros(len(low), bool)
    edge[1:] = part[:-1]
    starts = np.flatnonzero(part & (~edge | cut[:-1]))
    edge = np.zeros(len(low), bool)
    edge[:-1] = part[1:]
    ends = np.flatnonzero(part & (~edge | cut[1:])) + 1
    p, q = powers(len(low))
    acc = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(low)], out=acc[1:])
    out = np.empty((len(starts), len(PREFIXES)), np.int32)
    for k, n in enumerate(PREFIXES):
        stop = np.minimum(ends, starts + n) if n else ends
        h = (acc[stop] - acc[starts]) * q[starts] + (stop - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - 17)
    return out, np.searchsorted(starts, offsets)


class Words:
    """Texts as numbers of distinct words, and the embedding rows of these."""

    def __init__(self, texts: pa.Array):
        known, rows, self.texts, n = HashTable(), [], [], 0
        for _, _, data, at in chunks(texts, 1 << 19):
            found, by_text = word_rows(data, at)
            keys = np.full(len(found), np.uint64(1))
            for k in range(found.shape[1]):
                keys = mix(keys + found[:, k].astype(np.uint64))
            keys[keys == 0] = 1
            fresh, where = np.unique(keys, return_index=True)
            new = known.get(fresh) < 0
            known.put(fresh[new], np.arange(n, n + new.sum()))
            rows.append(found[where[new]])
            n += int(new.sum())
            numbers = known.get(keys).astype(np.int32)
            self.texts += [numbers[a:b] for a, b in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True)]
        self.rows = np.concatenate(rows) if rows else np.zeros((0, len(PREFIXES)), np.int32)


@dataclass
class Network:
    embedding: np.ndarray  # ROWS x DIM
    kernels: list[np.ndarray]  # by width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """The embedding of each word."""
        out = self.embedding[rows[:, 0]].copy()
        for k in range(1, rows.shape[1]):
            out += self.embedding[rows[:, k]]
        return out

    def activations(self, vectors: np.ndarray, by_text: np.ndarray, want_places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest activation of each filter in each text (at least 0), and the word at which its window starts (-1: none)."""
        n_texts, most = len(by_text) - 1, max(WIDTHS) - 1
        n = np.diff(by_text)
        words = np.zeros((len(vectors) + most * n_texts, DIM), vectors.dtype)
        place = np.arange(len(vectors)) + most * np.repeat(np.arange(n_texts), n)
        words[place] = vectors
        best = np.zeros((n_texts, FILTERS * len(WIDTHS)), vectors.dtype)
        at = np.full(best.shape, -1, np.int64) if want_places else None
        some = np.flatnonzero(n)
        if not len(some):
            return best, at
        begin = (by_text[:-1] + most * np.arange(n_texts))[some]
        begin[0] = 0  # texts without words have no window, also in front
        for i, (width, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            value = words @ kernel[0] + self.bias[part]
            for k in range(1, width):
                value[:-k] += words[k:] @ kernel[k]
            empty = np.ones(len(words), bool)
            empty[place] = False
            value[empty] = -1.0  # windows start at words only
            top = np.maximum.reduceat(value, begin, axis=0)
            best[some, part] = np.maximum(top, 0)
            if want_places:
                owner = np.repeat(np.arange(len(some)), np.diff(np.append(begin, len(words))))
                where, f = np.nonzero((value == top[owner]) & (value > 0))
                pair, first = np.unique(owner[where] * FILTERS + f, return_index=True)
                back = np.full(len(words), -1, np.int64)
                back[place] = np.arange(len(vectors))
                at[some[pair // FILTERS], i * FILTERS + pair % FILTERS] = back[where[first]]
        return best, at

    def logits(self, rows: np.ndarray, by_text: np.ndarray) -> np.ndarray:
        best, _ = self.activations(self.vectors(rows), by_text)
        return best.astype(np.float64) @ self.out + self.out_bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Adagrad:
    def __init__(self, like: np.ndarray):
        self.seen = np.full(like.shape, 1e-6, np.float32)

    def step(self, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.seen += grad * grad
        value -= rate * grad / np.sqrt(self.seen)

    def step_rows(self, value: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        rows, total = sum_by(rows, grad)
        self.seen[rows] += total * total
        value[rows] -= rate * total / np.sqrt(self.seen[rows])


@dataclass
class Gradient:
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    rows: np.ndarray  # embedding rows, repeated, and the gradient of each
    by_row: np.ndarray


def gradient(net: Network, rows: np.ndarray, at_word: np.ndarray, by_text: np.ndarray, y: np.ndarray) -> Gradient:
    """Of the mean log loss of texts: words ``at_word`` of the distinct ones with embedding ``rows``, texts ``by_text``, labels ``y``."""
    vectors = net.vectors(rows)
    best, at = net.activations(vectors[at_word], by_text, True)
    error = (_sigmoid(best.astype(np.float64) @ net.out + net.out_bias) - y) / len(y)
    back = (error[:, None] * net.out).astype(vectors.dtype)
    bias, kernels, hit_rows, by_row = np.zeros_like(net.bias), [], [], []
    for i, width in enumerate(WIDTHS):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        text, f = np.nonzero(at[:, part] >= 0)
        g, begin = back[text, i * FILTERS + f], at[text, i * FILTERS + f]
        bias[part] = np.bincount(f, weights=g, minlength=FILTERS)
        kernel = np.zeros_like(net.kernels[i])
        for k in range(width):
            inside = begin + k < by_text[text + 1]
            word, gk, fk = at_word[begin[inside] + k], g[inside], f[inside]
            np.add.at(kernel[k].T, fk, gk[:, None] * vectors[word])
            hit_rows.append(rows[word].reshape(-1))
            by_row.append(np.repeat(gk[:, None] * net.kernels[i][k].T[fk], rows.shape[1], axis=0))
        kernels.append(kernel)
    return Gradient(kernels, bias, best.T @ error, float(error.sum()), np.concatenate(hit_rows), np.concatenate(by_row))


def fit_network(words: Words, texts: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """A network of the texts numbered ``texts``, whose labels are ``y``."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(FILTERS * len(WIDTHS), 0.02, np.float32), np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))) * np.tile([1, 1, 1, -1], FILTERS * len(WIDTHS) // 4), 0.0,
    )
    net.out_bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    emb, outs = _Adagrad(net.embedding), _Adagrad(net.out.astype(np.float32))
    kernels, bias = [_Adagrad(k) for k in net.kernels], _Adagrad(net.bias)
    epochs = int(np.clip(SEEN // max(1, len(texts)), *EPOCHS))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.01
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            seen = [words.texts[i] for i in texts[batch]]
            seen = [x[rng.random(len(x)) >= THINNED] for x in seen]  # one sign must do where a text has several
            kept = rng.random(len(PREFIXES)) >= DROPPED  # what is learnt must not hang on the whole word alone
            kept[rng.integers(len(PREFIXES))] = True
            distinct, at_word = np.unique(np.concatenate(seen), return_inverse=True)
            grad = gradient(net, words.rows[distinct][:, kept], at_word, offsets_of(np.array([len(x) for x in seen])), y[batch])
            for step, kernel, g in zip(kernels, net.kernels, grad.kernels, strict=True):
                step.step(kernel, g + DECAY * kernel, rate * 0.3)
            bias.step(net.bias, grad.bias, rate * 0.1)
            outs.step(net.out, grad.out.astype(np.float32) + DECAY * net.out, rate * 0.3)
            net.out_bias -= rate * grad.out_bias
            if len(grad.rows):
                emb.step_rows(net.embedding, grad.rows, grad.by_row, rate)
    return net


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The log-odds that cut best between the labels: the most F1, in the middle of the gap it falls in."""
    order = np.argsort(-z)
    z, y, weight = z[order], y[order], weight[order]
    found, wrong = np.cumsum(y * weight), np.cumsum((1 - y) * weight)
    f1 = 2 * found / (found + wrong + (y * weight).sum())
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


@dataclass
class ToxicityModel:
    network: Network | None
    language: langid.LanguageModel
    cuts: np.ndarray  # log-odds by language, and for all

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(offsets) - 1)
        z = self.network.logits(*word_rows(data, offsets))
        best, _ = self.language.predict(data, offsets)
        return _sigmoid(z - self.cuts[best] + np.log(CUT / (1 - CUT)))


def _fit_language(texts: pa.Array, languages: list[str | None], seed: int) -> langid.LanguageModel:
    """A language model of at most ``langid.PER_LANGUAGE`` of the texts in each language."""
    rng, taken = np.random.default_rng(seed), {}
    known = []
    for i in rng.permutation(len(languages)):
        la = languages[i]
        taken[la] = taken.get(la, 0) + 1
        if la is not None and taken[la] <= langid.PER_LANGUAGE:
            known.append(int(i))
    return langid.fit(texts.take(pa.array(known, pa.int64())), [languages[i] for i in known])


def fit(texts: pa.Array, y: np.ndarray, languages: list[str | None], clean_weight: float = 1.0, seed: int = 11) -> ToxicityModel:
    """A model of labelled texts and their languages; ``clean_weight`` is how many clean texts each sampled one stands for."""
    language = _fit_language(texts, languages, seed)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, language, np.zeros(len(language.languages) + 1))
    words = Words(texts)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        held[own[: len(own) // 5]] = len(own) >= 10
    network = fit_network(words, np.flatnonzero(~held), y[~held], seed)
    at = np.flatnonzero(held if held.any() else ~held)
    z, best = np.zeros(len(at)), np.zeros(len(at), np.int64)
    for i, j, data, offsets in chunks(texts.take(pa.array(at)), 1 << 19):
        z[i:j] = network.logits(*word_rows(data, offsets))
        best[i:j] = language.predict(data, offsets)[0]
    weight = np.where(y[at] == 1, 1.0, clean_weight)
    cuts = np.full(len(language.languages) + 1, _threshold(z, y[at], weight))
    for k in range(len(language.languages)):
        own = best == k
        if y[at][own].sum() >= LEAST_TOXIC and (1 - y[at][own]).sum():
            cuts[k] = _threshold(z[own], y[at][own], weight[own])
    return ToxicityModel(network, language, cuts)


def sample_labels(marks: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[DataFrame, float]:
    """About ``toxic`` and ``clean`` rows of (k, y), picked by a hash of k, and how many clean rows each of its own stands for
    (for each toxic one that its own stands for)."""
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("k")), F.lit(scale))
    share = {v: min(1.0, most / counts[v]) if counts.get(v) else 1.0 for v, most in ((0, clean), (1, toxic))}
    return marks.filter(place < F.when(F.col("y") == 1, int(scale * share[1])).otherwise(int(scale * share[0]))), share[1] / share[0]


def train(docs: DataFrame, marks: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ToxicityModel:
    """A model of a bounded sample of the labels (k, y), with the texts of ``docs``.

    The sample of ids, some 12,000, is broadcast to the scan of the texts, so no text is shuffled for it.
    """
    chosen, weight = sample_labels(marks)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null").join(F.broadcast(chosen), "k")
    rows = rows.select(F.col("k").cast("string").alias("k"), "t", "l", "y")
    return in_one_task(rows, ["k", "t", "l", "y"], lambda table: fit(table["t"].combine_chunks(), table["y"].to_numpy(), table["l"].to_pylist(), weight))


def classify(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with score and predicted of every whole text."""
    results = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + results)
    shared = Shared(docs.sparkSession, model)  # tables of fixed size

    def run(batches):
        held = per_worker("toxicity", shared.key, lambda: shared.value)
        for batch in batches:
            for i, j, data, at in chunks(batch.column(0), 1 << 20):
                score = held.scores(data, at)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=schema.names)

    return docs.select(F.col(text).alias("__text"), *kept).mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model of the labelled rows among ``docs`` that are not held out; of a document's labels the largest counts."""
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.max("toxic").cast("int").alias("y"))
    return train(docs, marks.filter(~held_out("k")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return classify(rows, model, keep=["doc_id", "held_out"])
