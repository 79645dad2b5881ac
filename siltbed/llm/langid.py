"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes, letters
in lower case, runs of other ASCII characters as one mark between words), hashed to
``BUCKETS`` rows each; a linear softmax over the mean gives the language. Both are
trained by stochastic gradient descent in numpy on about ``PER_LANGUAGE`` whole
texts of each language, picked by a hash of id and text, in one task of an
executor; a temperature and the rejection threshold are set on a part of them
that training leaves out. A text is held there by the counts of its distinct
n-gram rows, whose number has a bound, however long it is. Prediction adds up one
row of class weights for each n-gram of the whole text. The model has a row of
weights for each label: labels are languages, not keys of the data.

A text that is null or has no letter is ``und`` with score 0. ``rejected`` marks
predictions below the threshold; they keep their language. Without labelled
rows there is no language to predict: all texts are ``und`` with score 0 and
rejected. An empty table gives an empty result. Null ids count as empty strings.
Very long texts are learnt and judged whole, a chunk of texts at a time, the
longest as a chunk of its own. Ties between languages go to the first in code
point order. Repeated rows are sampled together and get repeated results. Extra
columns pass through; those named like a result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import LOWER, chunks, offsets_of
from siltbed.llm.scratch import materialize
from siltbed.llm.worker import Shared, in_one_task, per_worker

#: Bound of the training sample: about so many texts of a language.
PER_LANGUAGE = 1500
BUCKETS, DIM = 1 << 16, 16
SIZES = (2, 3, 4)
EPOCHS, RATE, BATCH = 6, 0.5, 16
#: Share of accepted predictions that should be right.
PRECISION = 0.995
UNKNOWN = "und"

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def held_out(key: str, of: int = 4, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of == rest


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text between two marks, letters lower-cased, other ASCII runs as one mark; bytes and offsets."""
    n = np.diff(offsets)
    out = np.full(len(data) + 2 * len(n), 0x20, np.uint8)
    text = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(data)) + 2 * text + 1] = _FOLD[data]
    high = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[:-1] == 0xC3) & (out[1:] != 0x97)) + 1
    out[high] += 0x20  # capital letters of Latin-1
    begin = offsets + 2 * np.arange(len(offsets))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
    keep[begin[:-1]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By size, the bucket of every n-gram and offsets by text."""
    data, offsets = fold(data, offsets)
    wide = data.astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, acc = [], wide
    for k in range(1, max(SIZES)):
        acc = (acc[:-1] << np.uint32(8)) | wide[k:]
        if k + 1 in SIZES:
            inside = text[: len(acc)] == text[k:]
            h = (acc[inside] * np.uint32(0x9E3779B1)) ^ (acc[inside] >> np.uint32(15))
            rows = (h * np.uint32(0x85EBCA77 + 2 * k)) >> np.uint32(16)
            out.append((rows.astype(np.int64) + BUCKETS * SIZES.index(k + 1), np.searchsorted(text[: len(acc)][inside], np.arange(len(offsets)))))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # of each n-gram row, by language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for rows, at in ngrams(data, offsets):
            for c in range(len(self.languages)):
                total[:, c] += np.diff(np.concatenate([[0.0], np.cumsum(self.weights[c][rows], dtype=np.float64)])[at])
            n += np.diff(at)
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its probability, by text."""
        if not self.languages:
            return np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        p = _softmax(self.logits(data, offsets) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-gram rows of each text, and the share of each among all of the text's."""
    out = []
    for _, _, data, at in chunks(column, 1 << 19):
        sizes = ngrams(data, at)
        for i in range(len(at) - 1):
            rows, n = np.unique(np.concatenate([r[o[i] : o[i + 1]] for r, o in sizes]), return_counts=True)
            out.append((rows.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: pa.Array, languages: list[str], seed: int = 7) -> LanguageModel:
    """A model of labelled texts."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((0, BUCKETS * len(SIZES)), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    at = {name: k for k, name in enumerate(names)}
    y = np.array([at[x] for x in languages])
    held_bags = bags(texts)
    order = rng.permutation(len(y))
    held, used = order[: max(1, len(order) // 10)], order[len(order) // 10 :]
    used = used[[len(held_bags[i][0]) > 0 for i in used]] if len(used) else used
    emb = rng.normal(0, 0.1, (BUCKETS * len(SIZES), DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    share = np.bincount(y[used], minlength=len(names)) + 1
    weight = (share.sum() / len(names) / share).astype(np.float32)
    step, steps = 0, EPOCHS * max(1, len(used) // BATCH)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            if not len(batch):
                continue
            mean = np.stack([held_bags[i][1] @ emb[held_bags[i][0]] for i in batch])
            p = _softmax(mean @ out + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[y[batch]][:, None]
            rate = RATE * (1 - step / max(1, steps)) + 0.01
            back = (-rate * (p @ out.T)).astype(np.float32)
            out -= rate * (mean.T @ p)
            bias -= rate * 0.1 * p.mean(axis=0)
            for i, b in zip(batch, back, strict=True):
                rows, part = held_bags[i]
                emb[rows] += part[:, None] * b  # a text's rows are distinct
            step += 1
    model = LanguageModel(names, np.ascontiguousarray((emb @ out).T), bias.astype(np.float64), 1.0, 0.0)
    return _calibrate(model, texts.take(pa.array(held)), y[held])


def _calibrate(model: LanguageModel, texts: pa.Array, y: np.ndarray) -> LanguageModel:
    """Sets the temperature of least log loss, and the least threshold above which the wanted share is right."""
    z = np.concatenate([model.logits(data, at) for _, _, data, at in chunks(texts, 1 << 19)])
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0)}
    model.temperature = min(losses, key=losses.get)
    p = _softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    share = np.cumsum(right[order]) / (np.arange(len(order)) + 1)
    good = np.flatnonzero(share >= PRECISION)
    model.threshold = float(min(top[order][good[-1]], 0.9)) if len(good) else 0.9
    return model


def sample(labelled: DataFrame, label: str, per_label: int, key: str, text: str, seed: str = "sample") -> DataFrame:
    """About ``per_label`` rows of each label, picked by a hash of id and text.

    The shares by label are a stored table: Spark sends it to the scan while its
    size allows and shuffles otherwise.
    """
    shares = materialize(labelled.groupBy(F.col(label).alias("__label")).agg(F.least(F.lit(1.0), F.lit(per_label) / F.count("*")).alias("__share")), "label-shares")
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(text)), F.lit(scale))
    return labelled.join(shares, F.col(label) == F.col("__label")).filter(place < F.col("__share") * scale).select(*labelled.columns)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of a bounded sample of the labelled rows of ``docs``."""
    labelled = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = sample(labelled, "l", per_language, "k", "t")
    return in_one_task(rows, ["k", "t", "l"], lambda table: fit(table["t"].combine_chunks(), table["l"].to_pylist()))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred, score and rejected of every whole text."""
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in results}]
    schema = T.StructType([docs.schema[c] for c in kept] + results)
    shared = Shared(docs.sparkSession, model)  # rows and languages of a fixed number

    def run(batches):
        held = per_worker("langid", shared.key, lambda: shared.value)
        names = np.array([*held.languages, UNKNOWN], object)
        for batch in batches:
            spoken = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, at in chunks(batch.column(0)):
                best, p = held.predict(data, at)
                best, p = np.where(spoken[i:j], best, -1), np.where(spoken[i:j], p, 0.0)
                rejected = (best < 0) | (p < held.threshold)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[2:]), pa.array(names[best], pa.string()), pa.array(p), pa.array(rejected)], names=schema.names)

    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(text).alias("__text"), spoken.alias("__spoken"), *kept).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out("doc_id")))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"])
