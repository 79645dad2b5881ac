"""Near-duplicates by fast similarity sketching, banding and exact verification.

A text's sketch has ``SKETCH`` coordinates. In round i each shingle is thrown
into one bin with a value that starts at i; a bin keeps the least value, and
rounds go on while a bin is empty. Rounds from ``SKETCH`` on aim at one bin each, so
twice as many rounds fill every coordinate; large sets are done after one or
two. Two texts agree in a coordinate with the probability of their similarity,
with the concentration of independent coordinates.

Texts with equal sets are one class. Classes that share a band of ``ROWS``
coordinates are candidates. First each class is tied to the hub of one of its
buckets that the sketches hold similar, which settles groups of copies
with a link for each member instead of all pairs; then the pairs of classes in a bucket
that are still in different components are compared, inside the join and in one
bucket they share, by the bits of a longer sketch (of the candidates only), and
what remains is verified. Large buckets are compared block by block. At the
threshold a pair is missed with probability (1 - 0.8**ROWS)**BANDS, below 10**-7,
and the sketches reject it with about 10**-8. Links are confirmed on full sets.

Documents are told apart by id and text; rows that repeat both are the same
document and get the same result. Texts without words (or null) have an empty
set, no links and themselves as component; an empty table gives an empty result. Very long
texts have their whole sets, as a chunk of their own. Null ids are never a component's id
unless all of its ids are null. Where buckets tie as to the hub, the smaller number is it. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import chunks, mix, text_buffers
from siltbed.llm.components import components
from siltbed.llm.scratch import materialize
from siltbed.llm.shingles import overlap, set_keys, shingle_sets

SKETCH, ROWS = 128, 4
BANDS = SKETCH // ROWS
#: Coordinates of which two bits may differ between the sketches of linked texts (of 128, at 0.8 about 19 do).
MAX_BITS_APART = 43
#: Coordinates of the longer sketch, its longs that are compared first, and how many coordinates may differ in these and in all.
WIDE, FIRST_LONGS, MAX_FIRST_APART, MAX_WIDE_APART = 2048, 16, 126, 390
#: Members of a bucket compared in one piece.
BLOCK = 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUND = np.uint64(0xA0761D6478BD642F)


def sketches(values: np.ndarray, by_text: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """A row of ``size`` coordinates for each text; texts without shingles keep the empty value."""
    n = len(by_text) - 1
    out = np.full((n, size), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n), np.diff(by_text))
    live = values
    for i in range(2 * size):
        if not len(live):
            break
        r = mix(live + np.uint64((int(_ROUND) * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        place = ((r >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else i - size
        np.minimum.at(flat, row * size + place, (np.uint64(i) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
        rows = row[np.flatnonzero(np.append(True, row[1:] != row[:-1]))]
        open_rows = np.zeros(n, bool)
        open_rows[rows] = (out[rows] == _EMPTY).any(axis=1)
        keep = open_rows[row]
        if not keep.all():
            live, row = live[keep], row[keep]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band of each text."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(ROWS):
        acc = mix(acc * _ROUND + parts[:, :, k])
    return acc.view(np.int64)


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a long."""
    two = mix(sketch) & np.uint64(3)
    return (two.reshape(len(sketch), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _lists(flat: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    at = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(flat).reshape(-1)))


def features(docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's key (set_a, set_b), bands and bits of every row."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for batch in batches:
            for i, j, data, at in chunks(batch.column(2)):
                values, by_text = shingle_sets(data, at, words)
                a, b = set_keys(values, by_text)
                sketch = sketches(values, by_text)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(np.diff(by_text)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(band_keys(sketch)), _lists(sketch_bits(sketch))], names=schema.names)

    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("__text")).mapInArrow(run, schema)


def _apart(a: str, b: str, column: str, longs: int) -> Column:
    """Coordinates, of the first ``longs`` longs, whose two bits differ."""
    total = F.lit(0)
    for k in range(longs):
        x = F.col(f"{a}.{column}")[k].bitwiseXOR(F.col(f"{b}.{column}")[k])
        total = total + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketch bits allow a link."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (_apart(a, b, "bits", SKETCH // 32) <= MAX_BITS_APART)


def _wide_alike(a: str, b: str) -> Column:
    """Whether the longer sketches allow a link."""
    apart = F.expr(f"aggregate(zip_with({a}.wide, {b}.wide, (p, q) -> bit_count(((p ^ q) | shiftrightunsigned(p ^ q, 1)) & 6148914691236517205L)), 0, (s, v) -> s + v)")
    return (_apart(a, b, "wide", FIRST_LONGS) <= MAX_FIRST_APART) & (apart <= MAX_WIDE_APART)


def wide_sketches(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` (vid, text) with the bits of their longer sketches."""

    def run(batches):
        for batch in batches:
            for i, j, data, at in chunks(batch.column(1), 1 << 19, 512):
                wide = sketch_bits(sketches(*shingle_sets(data, at, words), WIDE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), _lists(wide)], names=["vid", "text", "wide"])

    return texts.mapInArrow(run, "vid long, text string, wide array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. ``texts`` has vid and text."""

    def run(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(vid: int, column: pa.Array, k: int) -> np.ndarray:
            if vid in held:
                held.move_to_end(vid)
                return held[vid]
            held[vid] = shingle_sets(*text_buffers(column.slice(k, 1)), words)[0]
            if len(held) > 64:
                held.popitem(last=False)
            return held[vid]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = np.zeros(len(a), bool)
            for k in range(len(a)):
                both, either = overlap(shingles(a[k], batch.column(2), k), shingles(b[k], batch.column(3), k))
                linked[k] = 100 * both >= percent * either
            yield batch.select([0, 1]).filter(pa.array(linked))

    left = texts.select(F.col("vid").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("vid").alias("a"), F.col("text").alias("text_a"))
    return pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _rest(members: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a bucket, lie in different components and look alike."""
    placed = members.join(roots, members.vid == roots.vertex, "left").select("key", "vid", F.coalesce("root", "vid").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")
    # a member's block in its bucket, and each pair of blocks it takes part in
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = placed.join(mixed, "key").withColumn("pieces", pieces).withColumn("block", F.pmod(F.xxhash64("vid"), F.col("pieces")).cast("int"))
    rows = rows.join(classes.select("vid", "n_shingles", "bits", "bands"), "vid").join(texts.select("vid", "wide"), "vid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vid", "root", "n_shingles", "bits", "bands", "wide")
    x, y = rows.alias("x"), rows.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    fresh = (F.col("x.vid") < F.col("y.vid")) & (F.col("x.root") != F.col("y.root")) & ((F.col("x.block") != F.col("y.block")) | (F.col("x.low") == F.col("x.high")))
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")  # in one of the buckets they share
    return x.join(y, same & fresh & _alike("x", "y", percent) & _wide_alike("x", "y") & once).select(F.col("x.vid").alias("a"), F.col("y.vid").alias("b"))


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and leader of every row of ``docs``; the leader (doc_id and text_hash, null ids last) is null for empty sets."""
    rows = materialize(features(docs, words, text, key), "near-rows")
    sets = rows.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"), F.count("*").alias("members")
    )
    classes = materialize(sets.withColumn("vid", F.monotonically_increasing_id()), "near-classes")
    roots = _roots(docs, classes, words, percent, text, key)
    named = classes.join(roots, classes.vid == roots.vertex, "left").select("set_a", "set_b", "least_id", "first", F.coalesce("root", "vid").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("first").alias("leader"))
    answer = named.join(ids, "root").select("set_a", "set_b", "component_id", "leader")
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(answer, ["set_a", "set_b"], "left")
    some = F.col("n_shingles") > 0
    return out.select("doc_id", "text_hash", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("leader")).alias("leader"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row of ``docs``."""
    return grouped(docs, words, percent, text, key).drop("leader").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _roots(docs: DataFrame, classes: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    """(vertex, root) of the classes that are linked with another."""
    bands = classes.select("vid", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("vid").alias("low"), F.max("vid").alias("top"), F.count("*").alias("n")).filter("low < top").select("key", "n")
    members = materialize(bands.join(shared, "key"), "near-members")
    small = classes.select("vid", "n_shingles", "bits")
    involved = members.select("vid").distinct().join(classes.select("vid", "first"), "vid").select("vid", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    source = docs.select(F.col(key).alias("__doc"), F.xxhash64(text).alias("__text_hash"), F.col(text).alias("text"))
    texts = source.join(involved, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))).select("vid", "text")
    # the sketches are work, not bytes: as many tasks as there are shuffle partitions, whatever their size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = materialize(wide_sketches(texts.dropDuplicates(["vid"]).repartition(parts, "vid"), words), "near-texts")
    # the text that a group of copies comes from shares more and larger buckets than any copy; it makes the best hub
    weight = members.groupBy("vid").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "vid").groupBy("key").agg(F.max_by("vid", F.struct("weight", -F.col("vid"))).alias("hub"), F.max("weight").alias("weight"))
    spokes = members.select("key", "vid").join(hubs, "key").filter("vid != hub").select("vid", "hub", "weight").distinct()
    tied = spokes.join(small.alias("x"), spokes.vid == F.col("x.vid")).join(small.alias("y"), spokes.hub == F.col("y.vid")).filter(_alike("x", "y", percent))
    best = tied.groupBy(spokes.vid.alias("v")).agg(F.max_by(spokes.hub, F.struct(spokes.weight, -spokes.hub)).alias("hub"))
    first = best.select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
    links = materialize(verify(first, texts, words, percent), "near-links")
    roots = components(links)
    more = materialize(verify(_rest(members, roots, classes, texts, percent), texts, words, percent), "near-links")
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def drop_copies(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last; under one id that of the smallest hash of the
    text; of rows that repeat both the last one as JSON. Rows without words all stay."""
    rows = materialize(grouped(docs, words, percent, text, key).filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.any_value("leader").alias("leader"), F.count("*").alias("n")), "near-documents")
    first = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("text_hash") == F.col("leader.text_hash"))
    gone = rows.filter(~first | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    out = docs.join(gone, same, "left_anti")
    repeated = rows.filter(first & (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    if not repeated.limit(1).count():
        return out
    again = docs.join(repeated, same, "left_semi").select(F.xxhash64(text).alias("__hash"), F.struct(*docs.columns).alias("__row"))
    again = again.groupBy(F.col(f"__row.{key}").alias("__id"), "__hash").agg(F.max_by("__row", F.to_json("__row")).alias("__row"))
    return out.unionByName(again.select("__row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                               else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
    from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
sets as (select doc_id, md5(string_agg(s, chr(10) order by s)) as k from shingles group by doc_id),
classes as (select k, min(doc_id) as rep from sets group by k),
reps as (select shingles.doc_id, s from shingles join classes on shingles.doc_id = classes.rep),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from reps a join reps b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reached as (select rep as a, rep as b from classes union select reached.a, both_ways.b from reached join both_ways on reached.b = both_ways.a),
roots as (select a, min(b) as root from reached group by a)
select words.doc_id, coalesce(sizes.n, 0)::bigint as n_shingles, coalesce(roots.root, words.doc_id) as component_id, words.doc_id = coalesce(roots.root, words.doc_id) as kept
from words left join sizes using (doc_id) left join sets using (doc_id) left join classes using (k) left join roots on roots.a = classes.rep
"""
