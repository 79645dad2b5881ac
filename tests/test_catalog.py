"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from siltbed.operators import resolve, rotation
from siltbed.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)


def test_bloom_queries(spark):
    docs = {r["key"] for r in catalog.documents(spark, DATA).select("key").collect()}
    told = {r["key"]: r["may_contain"] for r in catalog.bloom_membership(spark, DATA).collect()}
    assert all(told[k] for k in told if k in docs) and sum(told[k] for k in told if k not in docs) <= 0.1 * len(told)
    from siltbed.functions.bloom import BloomFilter

    rows = {r["run"]: r for r in catalog.bloom_codec(spark, DATA).collect()}
    for run, row in rows.items():
        keys = [r["key"].encode() for r in catalog.documents(spark, DATA).filter(F.col("run") == run).collect()]
        assert len(keys) == row["n_keys"] and BloomFilter.decode(bytes(row["encoded"])).may_contain(keys).all()


def test_every_run_is_returned(spark):
    data = "/root/testdata/sf0.01"
    runs = {}
    for r in sorted(catalog.change_log(spark, data).collect(), key=lambda r: r["seq"]):
        runs[r["seq"] // 1000, r["key"]] = (r["seq"], r["value"], r["deleted"])
    got = catalog.run_scan(spark, data).collect()
    assert len(got) == len(runs) and {(r["run_pos"], r["key"]): (r["seq"], r["value"], r["deleted"]) for r in got} == runs
    assert len({p for p, _ in runs}) >= 10

    keys = {}
    for r in catalog.documents(spark, data).select("run", "key").collect():
        keys.setdefault(r["run"], []).append(r["key"].encode())
    from siltbed.functions.bloom import BloomFilter

    filters = {r["run"]: r for r in catalog.bloom_codec(spark, data).collect()}
    assert filters.keys() == keys.keys() and len(keys) > 1
    for run, own in keys.items():
        assert filters[run]["n_keys"] == len(own) and bytes(filters[run]["encoded"]) == BloomFilter.of(own, 0.01).encode()

    blocks = {}
    for r in catalog.block_layout(spark, data).collect():
        blocks.setdefault(r["run"], []).append((r["first_key"], r["block_no"]))
    found = catalog.index_floor_lookup(spark, data).collect()
    assert {r["run"] for r in found} == keys.keys() == blocks.keys()
    for r in found:
        first, number = max((b for b in blocks[r["run"]] if b[0] <= r["key"]), default=(None, None))
        assert (r["first_key"], r["block_no"]) == (first, number)


def test_floor_lookup_by_run(spark):
    from siltbed.operators.layout import floor_lookup

    index = spark.createDataFrame([("x", "b", 0), (None, "d", 1)], "run string, first_key string, block_no long")
    probes = spark.createDataFrame([(r, k) for r in ("x", None, "y") for k in ("a", "c", "e")], "run string, key string")
    got = sorted(((r["run"], r["key"], r["block_no"]) for r in floor_lookup(index, probes, ("run",)).collect()), key=str)
    assert got == sorted([("x", "a", None), ("x", "c", 0), ("x", "e", 0), (None, "a", None), (None, "c", None), (None, "e", 1), ("y", "a", None), ("y", "c", None), ("y", "e", None)], key=str)


def test_point_get_filter_reaches_the_scan(spark):
    plan = catalog.point_get(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan and plan.rindex("Filter") > plan.rindex("Aggregate")


def test_rotation_counts_writes(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(25)], "seq long")
    for most, runs in ((10, 3), (1, 25), (0, 25), (-5, 25)):
        assert rotation.rotate(df, most).agg({"run_no": "max"}).first()[0] == runs - 1


def test_floor_lookup_on_edges(spark):
    from siltbed.operators.layout import floor_lookup

    index = spark.createDataFrame([("b", 0), ("d", 1)], "first_key string, block_no long")
    probes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("z",), ("b",)], "key string")
    got = sorted((r["key"], r["block_no"]) for r in floor_lookup(index, probes).collect())
    assert got == [("a", None), ("b", 0), ("b", 0), ("c", 0), ("d", 1), ("z", 1)]


def test_blocks_close_before_they_overflow(spark):
    from siltbed.operators.layout import blocks

    df = spark.createDataFrame([("r", "a", 20), ("r", "b", 20), ("r", "c", 500), ("r", "d", 8), ("r", "e", 20)], "run string, key string, size long")
    got = [(r["first_key"], r["records"], r["raw_bytes"]) for r in blocks(df, ["run"], 32).orderBy("block_no").collect()]
    assert got == [("a", 1, 24), ("b", 1, 24), ("c", 1, 504), ("d", 2, 32)]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_blocks_in_any_batches(spark, batch):
    """Against a fold over each run's records, whatever the size of the batches."""
    from siltbed.operators import layout

    rng = random.Random(batch)
    rows = [(rng.choice(["x", "y", None]), f"k{i:05}", rng.choice([17, 40, 90, 700])) for i in range(500)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["run"], r["block_no"]): (r["first_key"], r["records"], r["raw_bytes"]) for r in layout.blocks(spark.createDataFrame(rows, "run string, key string, size int"), ["run"], 200).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = {}
    for run in ("x", "y", None):
        number, first, n, filled = 0, None, 0, 4
        for _, key, size in sorted(r for r in rows if r[0] == run):
            if n and filled + size > 200:
                want[run, number] = (first, n, filled)
                number, n, filled = number + 1, 0, 4
            first, n, filled = first if n else key, n + 1, filled + size
        want[run, number] = (first, n, filled)
    assert got == want


def test_places_over_many_ranges(spark):
    rows = [(f"{i * 7919 % 5000:05}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, v long").repartition(16)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["place"], r["key"]) for r in resolve.ranked(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert got == [(k + 1, f"{k:05}") for k in range(5000)]
    assert resolve.ranked(df.limit(0)).count() == 0


def test_filters_by_byte_range(spark):
    """Filters larger than a range, of hot and small runs, against one built at once."""
    from siltbed.functions import udfs
    from siltbed.functions.bloom import BloomFilter

    rows = [("hot", f"k{i}") for i in range(90_000)] + [("cold", "a"), ("cold", "b"), (None, "c")]
    df = spark.createDataFrame(rows, "run string, key string").repartition(6)
    got = {r["run"]: r for r in udfs.filters_by_run(df, "run", 0.01).collect()}
    for run in ("hot", "cold", None):
        keys = [k.encode() for r, k in rows if r == run]
        assert got[run]["n_keys"] == len(keys) and bytes(got[run]["encoded"]) == BloomFilter.of(keys, 0.01).encode()
