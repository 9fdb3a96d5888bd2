"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item is lost in the signature of a long document, so items are partitioned by size: class u holds the items with
more than u / 2 and at most u distinct shingles. For each class documents are looked at in windows of 2 * u shingles that
start every u shingles; an item inside then always lies in a window of bounded size, where its containment bounds the
Jaccard similarity from below (0.19 for a share of 0.8). Each window has HASHES minima, taken from minima
of blocks that all classes share; an item is a candidate where any of its minima equals a window's. Over the windows of a
document that holds 0.8 of an item, at least 11 of the minima agree on average, however the shingles are spread, so a
candidate is missed with a chance of about 1e-5. Every candidate is verified: the share of the item's distinct
shingles that the whole document holds.

Windows, signatures and the check stay inside one Arrow batch; nothing is shuffled. The items' signatures go to every task
in slices of at most SLICE shingles, so the benchmark may be of any size: each slice is one pass over the documents.

Words are lower-cased (A-Z) and split at white space; shingles have five words. Results for odd input: null or empty texts and items,
and those with fewer than five words, contain nothing and are contained in nothing; a text of any length is taken whole; equal rows
give equal rows; empty tables give an empty table; other columns of the documents are kept by `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bytes_text as B
from .common import counted, map_arrow, raw_bytes, sliced, text_key

WORDS = 5
PERCENT = 80          # of the item's shingles
HASHES = 64
BLOCK = 16            # shingles of the smallest size class and of a block
TEXT = 4_000_000      # bytes of text worked on at once
SLICE = 1_000_000     # item shingles (8 bytes each) sent to a task at once
_RANDOM = np.random.default_rng(9161)
_FACTOR = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64)


def size_class(n: int) -> int:
    """BLOCK, 2 * BLOCK, 4 * BLOCK, ...: the least that n fits into."""
    return BLOCK << max(0, (-(-n // BLOCK) - 1).bit_length())


def row_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, offsets of the rows' shingles)."""
    data, ends = raw_bytes(column)
    hashes, starts = B.words(data, ends)
    runs = B.shingles(hashes, WORDS)
    per = np.maximum(np.diff(starts) - WORDS + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(per)])
    pick = np.repeat(starts[:-1] - offsets[:-1], per) + np.arange(offsets[-1])
    return runs[pick], offsets


def block_minima(runs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes x blocks, offsets of the rows' blocks): minima over BLOCK shingles; rows start blocks of their own."""
    blocks = -(-np.diff(offsets) // BLOCK)
    ends = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(offsets[:-1] - ends[:-1] * BLOCK, blocks) + np.arange(ends[-1]) * BLOCK
    out = np.empty((HASHES, ends[-1]), np.uint64)
    for h in range(HASHES if len(at) else 0):
        np.minimum.reduceat(runs * _FACTOR[h] + _SHIFT[h], at, out=out[h])
    return out, ends


def merged(minima: np.ndarray, ends: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima over `fold` neighbouring blocks of a row."""
    blocks = -(-np.diff(ends) // fold)
    after = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(ends[:-1] - after[:-1] * fold, blocks) + np.arange(after[-1]) * fold
    return (np.minimum.reduceat(minima, at, axis=1) if len(at) else minima[:, :0]), after


class ItemIndex:
    """Signatures of the items by size class, and their exact sets."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for n, own in enumerate(sets):
            by.setdefault(size_class(len(own)), []).append(n)
        for u, rows in by.items():
            lows = np.array([(sets[n][None, :] * _FACTOR[:, None] + _SHIFT[:, None]).min(1) for n in rows])  # items x hashes
            order = np.argsort(lows, axis=0)
            maybe = np.zeros((HASHES, 65_536), bool)  # a minimum's top bits: most windows end here
            for h in range(HASHES):
                maybe[h, (lows[:, h] >> np.uint64(48)).astype(np.int64)] = True
            self.classes[u] = (np.take_along_axis(lows, order, 0).T.copy(), np.array(rows)[order].T.copy(), maybe)

    def candidates(self, runs: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs with an equal minimum in some window."""
        out: set[tuple[int, int]] = set()
        minima, ends = block_minima(runs, offsets)
        for u in sorted(self.classes):
            lows, items, maybe = self.classes[u]
            own, after = merged(minima, ends, u // BLOCK)
            if own.shape[1] == 0:
                continue
            windows = own.copy()
            windows[:, :-1] = np.minimum(own[:, :-1], own[:, 1:])
            last = after[1:][np.diff(after) > 0] - 1  # a row's last block has no neighbour in the row
            windows[:, last] = own[:, last]
            row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(after))
            for h in range(HASHES):
                some = np.flatnonzero(maybe[h][(windows[h] >> np.uint64(48)).astype(np.int64)])
                left, right = (np.searchsorted(lows[h], windows[h, some], side) for side in ("left", "right"))
                for w, a, b in zip(some[left < right], left[left < right], right[left < right], strict=True):
                    out.update((int(row_of[w]), int(i)) for i in items[h, a:b])
        return out

    def matches(self, runs: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, shingles held, shingles of the item), verified, for shares of PERCENT or more."""
        out, held_row, held = [], -1, None
        for row, item in sorted(self.candidates(runs, offsets)):
            if row != held_row:
                held_row, held = row, np.unique(runs[offsets[row]:offsets[row + 1]])
            own = self.sets[item]
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            n = int((held[at] == own).sum())
            if 100 * n >= PERCENT * len(own):
                out.append((row, item, n, len(own)))
        return out


def item_slices(benchmark: DataFrame, item_id: str, text_col: str) -> list[ItemIndex]:
    """Indexes over slices of the items; a slice holds SLICE shingles on average, and its size is checked."""
    key = benchmark.schema[item_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, offsets = row_shingles(batch.column(1))
        sets = [np.unique(runs[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "elements"])

    items = map_arrow(benchmark.select(F.col(item_id).alias("id"), text_col), f"id {key}, n bigint, elements binary", run).where("n > 0").distinct()
    items, _ = counted(items)
    total = items.agg(F.sum("n")).first()[0] or 0
    slices = -(-total // SLICE)
    out = []
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("id", "elements"), F.lit(slices)) == k)
        if (size := part.agg(F.sum("n")).first()[0] or 0) > 4 * SLICE:
            raise ValueError(f"a slice of the benchmark holds {size} shingles")
        rows = part.orderBy("id", "elements").collect()  # at most 4 * SLICE shingles of 8 bytes
        out.append(ItemIndex([r[0] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows]))
    return out


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
              keyed: bool = False) -> DataFrame:
    """(id, item_id, n_shared, n_shingles, containment) of all pairs with a share of PERCENT or more; keyed: with k_text too."""
    spark = docs.sparkSession
    id_key, hashed = text_key(id_col, text_col)
    own = docs.select(id_key.alias("id"), hashed, text_col)
    key, other = docs.schema[id_col].dataType, benchmark.schema[item_id].dataType
    schema = f"id {key.simpleString()}, k_text bigint, item {other.simpleString()}, n_shared bigint, n_shingles bigint"
    found, item_type = None, to_arrow_type(other)
    for index in item_slices(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            for part in sliced(batch, 2, TEXT):
                hits = sent.value.matches(*row_shingles(part.column(2)))
                rows = pa.array([h[0] for h in hits], pa.int64())
                items = pa.array([sent.value.ids[h[1]] for h in hits], item_type)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), items, pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())],
                    names=["id", "k_text", "item", "n_shared", "n_shingles"])

        one = map_arrow(own, schema, run)
        found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    share = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    return found.select(F.col("id").alias(id_col), *["k_text"] * keyed, F.col("item").alias(item_id), "n_shared", "n_shingles", share)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    bad = contained(docs, benchmark, id_col, text_col, item_id, item_text, keyed=True).select(F.col(id_col).alias("bad_id"), F.col("k_text").alias("bad_text")).distinct()
    id_key, hashed = text_key(id_col, text_col)
    return docs.join(bad, id_key.eqNullSafe(bad["bad_id"]) & (hashed == bad["bad_text"]), "left_anti")
