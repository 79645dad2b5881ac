"""Mixing sources to target weights over fixed-length blocks.

Each source's documents, in a pseudorandom order, form one stream of words
that is cut into blocks of ``block`` words. Output slots of one block each are
grouped into shards. Every slot of a shard draws its source, so a shard's source
counts are multinomial; the draws that exceed a source's number of slots
corpus-wide (a deviation of the order of the square root) pass to the sources
that were drawn too rarely, so corpus totals meet the targets exactly. A
source's i-th slot takes the block whose rank in the source's pseudorandom
permutation is i modulo the number of blocks, by a join on that index.

All order and randomness come from md5 of ids, blocks and slot numbers, so
reruns and recomputed partitions agree. Running totals are taken in buckets of
the hash, or of shard numbers, first and over bucket totals second: no task holds a
whole source. The buckets grow in number with the rows.

Null and empty texts have size 0 and are never taken; an empty table has no
sources. A very long text spans as many blocks as it needs, and at most those. A null source is a
source of its own. Repeated rows are separate documents; null ids count as empty strings in the
order. Documents whose hashes tie stand in the order of id and size. Extra columns are
ignored by ``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.llm.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words to a block, slots to a shard, and the largest share of a source that a mix takes.
BLOCK, SHARD_SLOTS, MOST = 128, 1024, 3
#: Rows to a bucket of a running total, about; least hex digits of the hash that name one; shards to one.
_BUCKET_ROWS, _BUCKET, _BUCKET_SHARDS = 1 << 16, 3, 1 << 12
#: Draws to a cell of the lookup from draws to sources.
_CELLS = 1024


def sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """row_id (the column ``row``, or made here), doc_id, source, size and order hash of every row."""
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col(key).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit("document "), ident)).alias("order_hash"),
    )


def targets(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source: its index, source_size, target words, blocks and slots.

    Water-filling: ordered by how soon they reach the limit, sources are held at
    it as long as an equal level over the rest would exceed it.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked = by.withColumn("sidx", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("sidx") - 1) % 3 + 1).cast("long"))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = W.orderBy(F.col("source_size") / F.col("weight"), "sidx").rowsBetween(W.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum(MOST * F.col("source_size")).over(earlier), F.lit(0))).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("rest_weight"),
    )
    wide = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    level = level.withColumn("held", MOST * wide("source_size", "rest_weight") <= wide("weight", "rest"))
    free = [F.max(F.when(~F.col("held"), F.col(c))).over(every).alias(f"free_{c}") for c in ("rest", "rest_weight")]
    shared = level.select("*", *free)  # the first free source has the most left, of words and of weight
    out = shared.select(
        "source", "sidx", "source_size", "documents",
        F.when(F.col("held"), (MOST * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("free_rest")).cast("double") / F.col("free_rest_weight").cast("double")).alias("target"),
    )
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("blocks", blocks).withColumn("slots", slots)


def by_hash(column: str, rows: int) -> Column:
    """A bucket of a hash in hex digits, for a table of so many rows."""
    digits = _BUCKET
    while rows >> 4 * digits > _BUCKET_ROWS:
        digits += 1
    return F.substring(column, 1, digits)


def running(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its group in ``order``; ``bucket`` never falls in that order."""
    at = df.withColumn("__bucket", bucket).withColumn("__value", value)
    inner = W.partitionBy(*group, "__bucket").orderBy(*order)
    within = F.sum("__value").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__value")
    totals = at.groupBy(*group, "__bucket").agg(F.sum("__value").alias("__total"))
    before = F.coalesce(F.sum("__total").over(W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*group, "__bucket", before.alias("__before"))
    return at.withColumn("__within", within).join(totals, [*group, "__bucket"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__bucket", "__value", "__within", "__before")


def locate(df: DataFrame, position: str, intervals: DataFrame, width: int) -> DataFrame:
    """``df`` joined with the interval [lo, hi) that holds ``position``: an equality join on cells of ``width`` positions."""
    cells = intervals.filter("hi > lo").withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    keyed = df.withColumn("__cell", F.floor(F.col(position) / width))
    return keyed.join(cells, "__cell").filter(F.col(position).between(F.col("lo"), F.col("hi") - 1)).drop("__cell")


def draw(spark: SparkSession, sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """A row for each output slot: shard, sidx and the slot's number among those of its source.

    ``sources`` is what ``targets`` returns, stored; only its total number of slots comes to the driver.
    """
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    width = max(1, total // _CELLS)
    ends = F.sum("slots").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = sources.select("sidx", "slots", (ends - F.col("slots")).alias("lo"), ends.alias("hi"))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("slot "), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    drawn = locate(spark.range(total).withColumn("__at", chance % max(1, total)), "__at", spans.select("sidx", "lo", "hi"), width)
    counts = drawn.groupBy((F.col("id") / shard_slots).cast("long").alias("shard"), "sidx").agg(F.count("*").alias("n"))
    counts = running(counts, ["sidx"], F.floor(F.col("shard") / _BUCKET_SHARDS), ["shard"], F.col("n"), "first")
    counts = materialize(counts.join(sources.select("sidx", "slots"), "sidx"), "mix-counts")
    stay = F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("first")))
    kept = counts.withColumn("stay", stay).filter("stay > 0").select("shard", "sidx", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("stay") - 1)).alias("number"))
    # what was drawn beyond a source's slots goes, in order, to the sources with too few draws
    got = counts.groupBy("sidx").agg(F.sum("n").alias("got"))
    short = sources.join(got, "sidx", "left").select("sidx", F.coalesce("got", F.lit(0)).alias("got"), F.greatest(F.lit(0), F.col("slots") - F.coalesce("got", F.lit(0))).alias("gap"))
    gaps = F.sum("gap").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, W.currentRow))
    short = short.select(F.col("sidx").alias("to"), "got", (gaps - F.col("gap")).alias("lo"), gaps.alias("hi"))
    over = counts.withColumn("extra", F.col("n") - stay).filter("extra > 0").withColumn("__hash", F.md5(F.concat_ws(" ", F.lit("extra"), "shard", "sidx"))).withColumn("__one", F.lit(0))
    over = running(over, ["__one"], by_hash("__hash", total // shard_slots), ["__hash", "shard", "sidx"], F.col("extra"), "__first")
    over = over.select("shard", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("extra") - 1)).alias("e"))
    moved = locate(over, "e", short, width).select("shard", F.col("to").alias("sidx"), (F.col("got") + F.col("e") - F.col("lo")).alias("number"))
    return kept.unionByName(moved)


def place(sized: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document with words, its source's index and its first word's place in the source's stream."""
    keyed = sized.filter("size > 0").join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = sources.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    return running(keyed, ["sidx"], by_hash("order_hash", rows), ["order_hash", "doc_id", "size"], F.col("size"), "start")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The part of a document in each block: row_id, sidx, block, its place in the source's stream, first word in the document and number of words."""
    last = F.col("start") + F.col("size") - 1
    each = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    low = F.greatest(F.col("block") * block, F.col("start"))
    high = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    return each.select("row_id", "sidx", "block", low.alias("at"), (low - F.col("start")).alias("first_word"), (high - low).alias("words"))


def permuted(placed: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """sidx, block and the block's rank in its source's pseudorandom permutation; there are ``rows`` blocks."""
    begun = F.sequence(F.ceil(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    some = F.ceil(F.col("start") / block) <= F.floor((F.col("start") + F.col("size") - 1) / block)
    blocks = placed.filter(some).select("sidx", F.explode(begun).alias("block"))
    blocks = blocks.withColumn("__hash", F.md5(F.concat_ws(" ", F.lit("block"), "sidx", "block")))
    return running(blocks, ["sidx"], by_hash("__hash", rows), ["__hash", "block"], F.lit(1).cast("long"), "rank").drop("__hash")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sized documents, sources, pieces, taken blocks) of a mix.

    Taken blocks are (sidx, block, shards): the shards of the slots that take the block, repeats included.
    """
    spark = docs.sparkSession
    sized = materialize(sizes(docs, text, source, key, row), "mix-sizes")
    sources = materialize(targets(sized, block), "mix-sources")
    placed = materialize(place(sized, sources, block), "mix-placed")
    slots = draw(spark, sources, shard_slots).join(sources.select("sidx", "blocks"), "sidx")
    by_rank = slots.groupBy("sidx", (F.col("number") % F.col("blocks")).alias("rank")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # MOST of them at most
    blocks = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    taken = permuted(placed, blocks, block).join(by_rank, ["sidx", "rank"]).select("sidx", "block", "shards")
    return sized, sources, pieces(placed, block), taken


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document appears once for each of up to three times that parts of it
    are taken, with the words that are taken at least so often, and with its text as it stands where that is all of them.
    A column n_chars is set to the length of the new text."""
    stored = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-documents")
    ids = stored.select(F.col("__row").alias("row_id"), text, source, key)
    sized, _, parts, taken = mix(ids, text, source, key, block, row="row_id")
    each = parts.join(taken, ["sidx", "block"]).withColumn("__round", F.explode(F.sequence(F.lit(1), F.size("shards"))))
    spans = F.sort_array(F.collect_list(F.struct("first_word", "words")))  # the pieces of one document
    picks = each.groupBy(F.col("row_id").alias("__picked"), "__round").agg(spans.alias("__spans"), F.sum("words").alias("__taken"))
    words = stored.join(picks, F.col("__row") == F.col("__picked")).withColumn("__words", F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
    part = F.expr("array_join(flatten(transform(__spans, p -> slice(__words, int(p.first_word) + 1, int(p.words)))), '')")
    out = words.withColumn(text, F.when(F.size("__words") == F.col("__taken"), F.col(text)).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def shards(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as packed blocks: (shard, source, block, words) for each slot, with up to ``block`` words of the source's stream."""
    stored = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(key).alias("doc_id")), "mix-documents")
    _, sources, parts, taken = mix(stored, block=block, shard_slots=shard_slots, row="row_id")
    words = stored.select("row_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("__words"))
    own = parts.join(words, "row_id").withColumn("__own", F.expr("slice(__words, int(first_word) + 1, int(words))"))
    packed = own.groupBy("sidx", "block").agg(F.sort_array(F.collect_list(F.struct("at", "__own"))).alias("__parts"))  # ``block`` words
    slots = taken.select("sidx", "block", F.explode("shards").alias("shard"))
    out = slots.join(packed, ["sidx", "block"]).join(sources.select("sidx", "source"), "sidx")
    return out.select("shard", "source", "block", F.expr("flatten(transform(__parts, p -> p.__own))").alias("words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized, sources, parts, taken = mix(docs)
    words = parts.join(taken, ["sidx", "block"]).groupBy("row_id").agg(F.sum(F.col("words") * F.size("shards")).alias("taken"))
    base = sized.join(sources.select(F.col("source").alias("__source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__source")))
    return base.join(words, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ORACLE_SQL = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('document ' || coalesce(doc_id::varchar, '')) as order_hash
  from documents),
ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as sidx
  from sized group by source),
weighed as (select *, ((sidx - 1) % 3 + 1)::bigint as weight from ranked),
level as (
  select *,
         sum(source_size) over () - coalesce(sum({MOST} * source_size) over (order by source_size / weight, sidx rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, sidx rows between unbounded preceding and 1 preceding), 0) as rest_weight
  from weighed),
marked as (select *, {MOST} * source_size * rest_weight <= weight * rest as held from level),
shared as (
  select *, max(rest) filter (where not held) over () as free_rest, max(rest_weight) filter (where not held) over () as free_weight from marked),
aimed as (
  select source, sidx, source_size,
         case when held then ({MOST} * source_size)::double else (weight * free_rest)::double / free_weight::double end as target,
         ceil(source_size / {BLOCK})::bigint as blocks
  from shared),
sources as (select *, case when source_size > 0 then round(target * blocks / source_size) else 0 end::bigint as slots from aimed),
placed as (
  select sized.doc_id, size, sidx, sum(size) over (partition by sidx order by order_hash, sized.doc_id, size rows unbounded preceding) - size as start
  from sized join sources on sized.source is not distinct from sources.source where size > 0),
blocks as (select sidx, unnest(range(blocks)) as block, blocks, slots from sources),
ranked_blocks as (
  select *, row_number() over (partition by sidx order by md5('block ' || sidx || ' ' || block), block) - 1 as rank from blocks),
times as (select sidx, block, slots // blocks + case when rank < slots % blocks then 1 else 0 end as n from ranked_blocks),
parts as (
  select doc_id, sidx, size, start, unnest(range((start // {BLOCK})::bigint, ((start + size - 1) // {BLOCK})::bigint + 1)) as block from placed),
got as (
  select doc_id, sum(n * (least((block + 1) * {BLOCK}, start + size) - greatest(block * {BLOCK}, start))) as taken
  from parts join times using (sidx, block) group by doc_id)
select sized.doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from sized join sources on sized.source is not distinct from sources.source left join got on got.doc_id = sized.doc_id
"""
