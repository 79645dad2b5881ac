"""Language-model scoring by prediction by partial matching over byte contexts.

The model is a trie of byte contexts of up to ``ORDER`` bytes, counted over every
training text. A context predicts a symbol with the share of its count; what it
hasn't seen escapes to the context that is one byte shorter, with the weight of
one count for each distinct symbol (method C), and there the symbols that the longer
context has are excluded. Below order 0 all byte values not
seen are equally likely. A text's score is log10 of the probability of its
lower-cased bytes and of an end symbol.

Every gram counts, however rare. The trie is a set of tables, one for each order, and grows with
the corpus. A symbol's probability depends on its gram of ``ORDER`` + 1 bytes alone, so it is
worked out by joins once for each distinct gram of the texts. The most frequent of these grams, ``NODES``
at most, are looked up in a table that is sent along, the others by a join. The unigram base
counts every word exactly in the same way: words with at least one in ``HEAVY`` of all tokens, of
which there are at most ``HEAVY``, are sent along.

Null and empty texts have the end token alone. Very long texts are scored whole, as a chunk
of their own. A null id counts as an empty string. Repeated rows are separate
documents. Grams that tie in frequency are sent along or joined together; either way gives the same
probability. With no training text the base has N = V = 0 and the model is uniform;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import LOWER, HashTable, blank_words, chunks, offsets_of, ragged, span_hashes
from siltbed.llm.scratch import cleared, materialize
from siltbed.llm.worker import Shared, per_worker, release_memory

ORDER, NODES, HEAVY = 5, 1 << 20, 1 << 18
#: Byte values that UTF-8 never has: the end of a text, and what stands before its start.
END, BEFORE = 0xFE, 0xFF
#: Values a symbol can have.
ALPHABET = 255
#: Distinct grams that a task holds before it passes them on.
_HELD = 1 << 21
#: Bytes of text worked on at once: a symbol takes some hundred bytes meanwhile.
_CHUNK = 1 << 20
_UPPER, _LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def held_out(key: str, of: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of == rest


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text (its bytes and the end) the symbol below its ``order`` preceding bytes, as one number, and offsets by text."""
    n = np.diff(offsets)
    flat = np.full(int(n.sum()) + len(n) * (order + 1), BEFORE, np.uint8)
    begin = offsets_of(n + order + 1)[:-1] + order
    flat[ragged(begin, n)] = LOWER[data]
    flat[begin + n] = END
    wide = flat.astype(np.uint64)
    out = wide.copy()
    for k in range(1, order + 1):
        out[k:] |= wide[:-k] << np.uint64(8 * k)
    return out[ragged(begin, n + 1)], offsets_of(n + 1)


def gather(docs: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts of ``docs``."""

    def compact(parts):
        values, at = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
        return values, np.bincount(at, weights=np.concatenate([b for _, b in parts]), minlength=len(values)).astype(np.int64)

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0), _CHUNK):
                values, n = np.unique(grams(data, at, order)[0], return_counts=True)
                parts.append((values, n))
                size += len(values)
                if size > _HELD:
                    parts = [compact(parts)]
                    size = len(parts[0][0])
                    if size > _HELD // 2:
                        yield _rows(*parts[0])
                        parts, size = [], 0
        if parts:
            yield _rows(*compact(parts))
        del parts
        release_memory()  # idle workers must leave it to the joins

    def _rows(values, n):
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["gram", "n"])

    partial = docs.select(F.col(text).alias("__text")).mapInArrow(run, "gram long, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


class Trie:
    """The model in one memory, for counts that fit there (scoring joins tables instead). Counts by order: of each (context, symbol), and of each context how often it occurs, the symbols kept of it, what they sum to, and what they sum to one order below."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.order = len(nodes) - 1
        self.grams, self.counts, self.contexts, self.totals, self.kinds, self.kept, self.below = [], [], [], [], [], [], []
        for k, (values, n, contexts, totals) in enumerate(nodes):
            self.contexts.append(self._table(contexts))
            self.totals.append(totals.astype(np.float64))
            at = self.contexts[k].get(self._key(values >> np.uint64(8)))
            self.kinds.append(np.bincount(at, minlength=len(contexts)).astype(np.float64))
            self.kept.append(np.bincount(at, weights=n, minlength=len(contexts)))
            if k:
                shorter = self.grams[k - 1].get(self._key(values & np.uint64((1 << (8 * k)) - 1)))
                self.below.append(np.bincount(at, weights=self.counts[k - 1][shorter], minlength=len(contexts)))
            else:
                self.below.append(np.zeros(len(contexts)))
            self.grams.append(self._table(values))
            self.counts.append(n.astype(np.float64))
        self.top = np.log10(n / (self.totals[-1][at] + self.kinds[-1][at]))

    @staticmethod
    def _key(values: np.ndarray) -> np.ndarray:
        return (values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def _table(self, values: np.ndarray) -> HashTable:
        table = HashTable(max(1, len(values)))
        table.put(self._key(values), np.arange(len(values)))
        return table

    def log10(self, symbols: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol after its context."""
        at = self.grams[-1].get(self._key(symbols))
        out = np.where(at >= 0, self.top[at], 0.0) if len(self.top) else np.zeros(len(symbols))
        left = np.flatnonzero(at < 0)
        longer = np.full(len(left), -1)
        for k in range(self.order, -1, -1):
            value = symbols[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            context = self.contexts[k].get(self._key(value >> np.uint64(8)))
            there = context >= 0
            total, kinds, kept = np.zeros(len(left)), np.zeros(len(left)), np.zeros(len(left))
            total[there], kinds[there], kept[there] = self.totals[k][context[there]], self.kinds[k][context[there]], self.kept[k][context[there]]
            missing = total - kept  # what of the context is not among its kept symbols
            if k < self.order:
                cut = longer >= 0
                total[cut] -= self.below[k + 1][longer[cut]]
                kinds[cut] -= self.kinds[k + 1][longer[cut]]
            known = self.grams[k].get(self._key(value))
            hit = known >= 0
            out[left[hit]] += np.log10(self.counts[k][known[hit]] / (total[hit] + kinds[hit]))
            escape = ~hit & (missing + kinds > 0)
            out[left[escape]] += np.log10((missing[escape] + kinds[escape]) / (total[escape] + kinds[escape]))
            left, longer = left[~hit], context[~hit]
        if len(left):
            seen = self.kinds[0][0] if len(self.kinds[0]) else 0
            out[left] -= np.log10(max(1.0, ALPHABET - seen))
        return out


def _low(value: Column, size: int) -> Column:
    """The last ``size`` bytes of grams."""
    return value.bitwiseAND(F.lit((1 << (8 * size)) - 1))


def levels(counted: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """By order, (v, n) of every gram of (gram, n) rows."""
    out = [counted.select(F.col("gram").alias("v"), "n")]
    for k in range(order - 1, -1, -1):
        out.insert(0, materialize(out[0].groupBy(_low(F.col("v"), k + 1).alias("v")).agg(F.sum("n").alias("n")), f"ppm-grams-{k}"))
    return out


def contexts(by_order: list[DataFrame], k: int) -> DataFrame:
    """Of each context of order ``k``: how often it occurs, its distinct symbols, and what these sum to one order below."""
    rows = by_order[k].withColumn("context", F.shiftrightunsigned("v", 8))
    if k:
        below = by_order[k - 1].select(F.col("v").alias("low"), F.col("n").alias("n_below"))
        rows = rows.withColumn("low", _low(F.col("v"), k)).join(_few(below, k), "low")
    else:
        rows = rows.withColumn("n_below", F.lit(0).cast("long"))
    return rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n_below").alias("below"))


def _few(df: DataFrame, size: int) -> DataFrame:
    """``df``, sent whole where its keys have at most two bytes: there are few, and a key can have a large share of the rows."""
    return F.broadcast(df) if size <= 2 else df


def chances(seen: DataFrame, more: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, chance, size) of every gram of ``seen`` (gram, n), the training counts, and of ``more``: log10 of its probability, and how frequent it is (an eighth of log2)."""
    by_order = levels(seen, order)
    top = contexts(by_order, order).select("context", "total", "kinds")
    known = seen.withColumn("context", F.shiftrightunsigned("gram", 8)).join(top, "context")
    known = known.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("chance"))
    zero = F.lit(0).cast("long")
    rows = more.join(seen.select("gram"), "gram", "left_anti")
    rows = rows.select("gram", "n", F.lit(0.0).alias("chance"), F.lit(False).alias("found"), zero.alias("cut_total"), zero.alias("cut_kinds"))
    for k in range(order, -1, -1):
        rows = rows.withColumn("v", _low(F.col("gram"), k + 1)).withColumn("context", F.shiftrightunsigned("v", 8))
        rows = rows.join(_few(contexts(by_order, k), k), "context", "left").fillna(0, ["total", "kinds", "below"])
        if k < order:
            rows = rows.join(_few(by_order[k].select("v", F.col("n").alias("count")), k + 1), "v", "left")
        else:
            rows = rows.withColumn("count", F.lit(None).cast("long"))
        kinds = F.col("kinds") - F.col("cut_kinds")
        space = F.col("total") - F.col("cut_total") + kinds
        step = F.when(F.col("found"), 0.0).when(F.col("count").isNotNull(), F.log10(F.col("count") / space)).when(kinds > 0, F.log10(kinds / space)).otherwise(0.0)
        if not k:
            step = step - F.when(F.col("found") | F.col("count").isNotNull(), 0.0).otherwise(F.log10(F.greatest(F.lit(1), ALPHABET - F.col("kinds"))))
        rows = rows.select(
            "gram", "n", (F.col("chance") + step).alias("chance"), (F.col("found") | F.col("count").isNotNull()).alias("found"),
            F.col("below").alias("cut_total"), F.col("kinds").alias("cut_kinds"),
        )
    return known.unionByName(rows.select("gram", "n", "chance")).select("gram", "chance", F.floor(F.log2("n") * 8).cast("int").alias("size"))


def train(docs: DataFrame, text: str = "text", order: int = ORDER, nodes: int = NODES) -> list[tuple[np.ndarray, ...]]:
    """By order, all grams and contexts with their counts, in the driver: for texts whose model fits there. ``nodes`` cuts nothing; ``score`` doesn't come here."""

    def held(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.toArrow()
        values = rows["v"].to_numpy().view(np.uint64)
        by = np.argsort(values)
        return values[by], rows["n"].to_numpy()[by]

    by_order = levels(materialize(gather(docs, text, order), "ppm-grams"), order)
    return [(*held(rows), *held(rows.groupBy(F.shiftrightunsigned("v", 8).alias("v")).agg(F.sum("n").alias("n")))) for rows in by_order]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all texts of ``docs``."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER_ASCII)
    words = docs.select(F.explode(F.regexp_extract_all(lower, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("c"))


class Unigrams:
    """Counts of frequent words by hash."""

    def __init__(self, words: list[str], counts: np.ndarray):
        raw = [w.encode() for w in words]
        at = offsets_of(np.array([len(w) for w in raw], np.int64))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        self.counts = counts
        self.table = HashTable(max(1, len(raw)))
        if raw:
            self.table.put(span_hashes(flat, at[:-1], at[1:]), np.arange(len(raw)))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Count of each word, -1 if it isn't held."""
        at = self.table.get(span_hashes(data, starts, ends))
        return np.where(at >= 0, self.counts[at], -1) if len(self.counts) else np.full(len(starts), -1)


class Chances:
    """log10 of the probability of frequent grams."""

    def __init__(self, values: np.ndarray, chance: np.ndarray):
        self.chance = chance
        self.table = HashTable(max(1, len(values)))
        self.table.put(Trie._key(values), np.arange(len(values)))

    def look_up(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each gram, 0 if it isn't held, and whether it is."""
        at = self.table.get(Trie._key(symbols))
        return (np.where(at >= 0, self.chance[at], 0.0) if len(self.chance) else np.zeros(len(symbols))), at >= 0


def _score_batches(batches, model, names, order):
    held_grams, words, counts, space, ends_seen = model.value
    frequent, unigrams = per_worker("ppm", model.key, lambda: (Chances(*held_grams), Unigrams(words, counts)))
    for batch in batches:
        for i, j, data, at in chunks(batch.column(0), _CHUNK):
            symbols, by_text = grams(data, at, order)
            chance, there = frequent.look_up(symbols)
            score = np.diff(np.concatenate([[0.0], np.cumsum(chance)])[by_text])
            rare_at = offsets_of((~there).astype(np.int64))[by_text]
            low = LOWER[data]
            starts, ends, by = blank_words(low, at)
            c = unigrams.look_up(low, starts, ends)
            held = c >= 0
            base = np.concatenate([[0.0], np.cumsum(np.where(held, np.log10((np.maximum(c, 0) + 1) / space), 0.0))])
            known = offsets_of(held.astype(np.int64))
            rare = offsets_of((~held).astype(np.int64))[by]
            raw = low.tobytes()
            tail = [raw[a:b].decode() for a, b in zip(starts[~held].tolist(), ends[~held].tolist(), strict=True)]
            columns = [
                pa.array(np.diff(by) + 1), pa.array(np.diff(known[by]) + (ends_seen > 0)), pa.array(np.diff(base[by]) + np.log10((ends_seen + 1) / space)),
                pa.array(score), pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(tail, pa.string())),
                pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(symbols[~there].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([*(x.slice(i, j - i) for x in batch.columns[1:]), *columns], names=names)
    release_memory()


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, nodes: int = NODES, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(key))
    with cleared(spark) as scope:
        seen = materialize(gather(training, text, order), "ppm-grams")
        rated = scope.keep(materialize(chances(seen, gather(docs.filter(held_out(key)), text, order), order), "ppm-chances"))
    least, room = 1 << 30, nodes
    for size, n in sorted(rated.groupBy("size").count().collect(), reverse=True):  # at most 8 * 64 sizes
        room -= n
        if room < 0:
            break
        least = size
    held = rated.filter(F.col("size") >= least).toArrow()  # at most ``nodes``
    held_grams = held["gram"].to_numpy().view(np.uint64), held["chance"].to_numpy()
    counts = materialize(word_counts(training, text), "ppm-words")
    n_ends = training.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + n_ends, v + (n_ends > 0)
    space = float(n + v + 1)
    frequent = counts.filter(F.col("c") * heavy >= n).toArrow()  # at most ``heavy`` words, of the mean length of all tokens at most
    model = Shared(spark, (held_grams, frequent["word"].to_pylist(), frequent["c"].to_numpy(), space, n_ends))
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("rare", T.ArrayType(T.StringType())), ("rare_grams", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(a, b) for a, b in fields)])
    scored = docs.select(F.col(text).alias("__text"), F.col(key).alias("doc_id"), held_out(key).alias("held_out")).mapInArrow(lambda b: _score_batches(b, model, schema.names, order), schema)
    scored = materialize(scored.withColumn("row_id", F.monotonically_increasing_id()), "ppm-scores")
    rare = scored.select("row_id", F.explode("rare").alias("word"))
    found = rare.join(counts.filter(F.col("c") * heavy < n), "word", "left")
    chance = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(space))
    rare_grams = scored.select("row_id", F.explode("rare_grams").alias("gram")).join(rated.filter(F.col("size") < least), "gram")
    more = found.select("row_id", chance.alias("base"), "c", F.lit(0.0).alias("chance")).unionByName(rare_grams.select("row_id", F.lit(0.0).alias("base"), F.lit(None).cast("long").alias("c"), "chance"))
    more = more.groupBy("row_id").agg(F.sum("base").alias("rare_base"), F.count("c").alias("rare_known"), F.sum("chance").alias("rare_score"))
    out = scored.drop("rare", "rare_grams").join(more, "row_id", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
