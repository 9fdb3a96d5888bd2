"""Rows beside the tile they lie in, streamed through one task a share at a time.

A tile (cells of a grid, outlines of a block) is too wide to stand in every row that reads it.  So rows and tiles are
dealt out by the same key and sorted with the tile in front; a task holds one tile and one batch of rows, whatever the
number of rows that lie in it.  Rows may be unfolded behind the exchange, so what is cut from them is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tile with very many rows is dealt out over this many shares.
SALT = 8


def packed(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The struct ``_tile`` as bytes: a nested column, null in nearly all rows, would have its size taken anew for each row on the way to Python."""
    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            held = batch.select(["_tile"])
            rows = []
            for k in range(batch.num_rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held.schema) as out:
                    out.write_batch(held.slice(k, 1))
                rows.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(rows, pa.binary())], names=[*keys, "_tile"])

    kinds = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in keys)
    return tiles.select(*keys, "_tile").mapInArrow(run, f"{kinds}, _tile binary")


def beside(rows: DataFrame, tiles: DataFrame, deal: list[str], unfold: Callable[[DataFrame], DataFrame],
           ready: Callable[[pa.StructScalar], object], work: Callable[[object, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(tile, rows)`` over the rows of each share, in batches; ``tile`` is None where the share has none.

    ``tiles``: the columns of ``deal`` and ``_tile``, made by :func:`packed`; ``ready`` turns that struct into what ``work`` reads.  ``unfold`` may
    cut rows into more; it keeps the columns of ``deal`` and ``_tile`` and the order, and leaves every row that brings a tile at least once.
    """
    both = rows.withColumn("_tile", F.lit(None).cast("binary")).unionByName(tiles, allowMissingColumns=True)
    dealt = both.repartition(*deal).sortWithinPartitions(*deal, F.col("_tile").isNull())

    def run(batches):  # noqa: ANN001, ANN202 - nested, so that workers need not import this module
        last = tile = None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in deal:
                ids = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change |= ids[1:] != ids[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                share = tuple(batch.column(c)[a].as_py() for c in deal)
                if share != last:
                    last, tile = share, None
                part = batch.slice(a, b - a)
                brings = part.column("_tile").is_valid()
                if pc.any(brings).as_py():
                    if tile is None:
                        held = part.column("_tile")[pc.index(brings, True).as_py()].as_buffer()
                        tile = ready(pa.ipc.open_stream(held).read_next_batch().column("_tile")[0])
                    part = part.filter(pc.invert(brings))
                if part.num_rows:
                    yield work(tile, part)

    return unfold(dealt).mapInArrow(run, schema)
