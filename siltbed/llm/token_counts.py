"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch are held as one ragged array of symbols. Every
round finds, for each sequence, its lowest-ranked adjacent pair and replaces
all its occurrences at once (left to right where they overlap); what survives
when no sequence has a mergeable pair are its tokens. A pair that a merge
creates ranks above that merge, so a round never has to be undone. Sequences of
more than ``LONG`` bytes would need a round over all their symbols for each rank in
them: there the places of each rank are kept, and a round touches these alone.

Null texts count as empty. Empty texts have 0 tokens; an empty table gives an
empty result. Very long texts are counted whole, as a chunk of their own, and a
pre-token may be as long as its text. Of pairs of one rank that overlap the left
one is merged. Rows are kept as they are: repeated rows give repeated results, and
columns other than the text pass through unless their name is one of the results,
which then replaces them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import HashTable, chunks, offsets_of, text_buffers
from siltbed.llm.pretokens import BatchEncoder, class_table, default_path, parse_merges, tokenizer_file
from siltbed.llm.worker import Shared, per_worker

_NEVER = np.int64(1 << 40)
#: Bytes of a sequence from which the places of each rank are kept.
LONG = 256


class RankMerger:
    """Merges of a byte-level tokenizer, applied to many sequences in step."""

    def __init__(self, merges: list[tuple[int, int, int]], byte_ids: np.ndarray):
        table = np.array(merges, np.int64).reshape(-1, 3)
        self.byte_ids, (self.left, self.right, self.result) = byte_ids, table.T
        self.pairs = HashTable(max(1, len(table)))
        keys, first = np.unique(self._key(table[:, 0], table[:, 1]), return_index=True)
        self.pairs.put(keys, first)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token count of each piece, and all tokens one piece after the other."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if (lengths > LONG).any():
            long = np.repeat(lengths > LONG, lengths)
            done.append(self._merge_long(owner[long], symbols[long]))
            owner, symbols = owner[~long], symbols[~long]
        while len(symbols):
            rank = np.full(len(symbols), _NEVER)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            got = self.pairs.get(self._key(symbols[inside], symbols[inside + 1]))
            rank[inside[got >= 0]] = got[got >= 0]
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, begins)
            size = np.diff(np.append(begins, len(symbols)))
            live = np.repeat(lowest < _NEVER, size)
            if not live.all():
                done.append((owner[~live], symbols[~live]))
                rank, owner, symbols, size, lowest = rank[live], owner[live], symbols[live], size[lowest < _NEVER], lowest[lowest < _NEVER]
                if not len(symbols):
                    break
            take = rank == np.repeat(lowest, size)
            at = np.flatnonzero(take)
            fresh = np.append(True, (np.diff(at) > 1) | (rank[at[1:]] != rank[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # a pair like (a, a) overlaps itself
            symbols[at] = self.result[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        who = np.concatenate([a for a, _ in done]) if done else np.zeros(0, np.int64)
        what = np.concatenate([b for _, b in done]) if done else np.zeros(0, np.int64)
        return np.bincount(who, minlength=len(pieces)), what[np.argsort(who, kind="stable")].astype(np.int32)


    def _merge_long(self, owner: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of the symbols of long sequences, with its sequences: rank by rank, at the places that have the rank."""
        n = len(symbols)
        after = np.append(np.where(owner[1:] == owner[:-1], np.arange(1, n), n), n)  # n: none
        before = np.append(-1, np.where(owner[1:] == owner[:-1], np.arange(n - 1), -1))
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.pairs.get(self._key(symbols[at], symbols[after[at]]))
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, own in zip(rank[np.append(0, cuts)].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(own)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            at = at[(symbols[at] == self.left[r]) & (symbols[after[at]] == self.right[r])]
            if not len(at):
                continue
            if self.left[r] == self.right[r]:
                fresh = np.append(True, after[at[:-1]] != at[1:])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            symbols[at], alive[gone] = self.result[r], False
            after[at] = after[gone]
            follows = after[at] < n
            before[after[at[follows]]] = at[follows]
            left = before[at]
            note(np.union1d(left[left >= 0], at))
        return owner[alive], symbols[alive]


def byte_ids(words: list[bytes]) -> np.ndarray:
    """Token id of every single byte."""
    at = {w: i for i, w in reversed(list(enumerate(words))) if len(w) == 1}
    return np.array([at[bytes([b])] for b in range(256)], np.int64)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """``keep`` columns of ``df`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""
    spark = df.sparkSession
    model = Shared(spark, tokenizer_file(path))  # the size of the vocabulary
    keep = [c for c in (keep or df.columns) if c not in ("n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def counter():
        words, merges, specials = parse_merges(model.value)
        merger = RankMerger(merges, byte_ids(words))
        return BatchEncoder(class_table(), specials, lambda pieces: (merger.merge(pieces)[0], np.zeros(0, np.int32)))

    def run(batches):
        encoder = per_worker("token-counts", model.key, counter)
        for batch in batches:
            column = batch.column(0)
            _, offsets = text_buffers(column)
            n = np.zeros(len(column), np.int64)
            for i, j, data, at in chunks(column):
                n[i:j] = encoder.counts(data, at)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=schema.names)

    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, default_path(), keep=["doc_id"])
