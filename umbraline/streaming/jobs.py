"""Event rollups, admission windows, freshness, generations, live positions, idempotent intake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import allow_listed, event_rollup
from ..operators.progress import match_positions, upcoming_exposure

EVENT_LINE = "ts timestamp, area string, outcome string, delivery string, duration_ms double, status_code int, route_count int"


def parse_event_lines(lines: DataFrame, schema: str = EVENT_LINE) -> DataFrame:
    """JSON lines (column value) to event rows; fields outside the schema never get in."""
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*").filter(F.col("ts").isNotNull())


def rollup_stream(events: DataFrame, kind: str = "route", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Append-mode counts per window once the watermark passes it."""
    return event_rollup(allow_listed(events.withWatermark("ts", late), kind), every)


def _forget_at(state: GroupState, at_ms: int) -> None:
    """Let the state go once the watermark passes ``at_ms``; a time-out has to lie ahead of the watermark."""
    state.setTimeoutTimestamp(max(int(at_ms), state.getCurrentWatermarkMs() + 1))


def _admit(window_ms: int, limit: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # State: where the client's current window began and how many requests it holds.
        start, used = state.get if state.exists else (None, 0)
        # Requests per millisecond, folded batch by batch: memory follows the trigger interval, not the traffic.
        per_ms: dict[int, int] = {}
        for batch in batches:
            for at, n in batch.groupby("at_ms")["n"].sum().items():
                per_ms[at] = per_ms.get(at, 0) + int(n)
        out = []
        for at, n in sorted(per_ms.items()):
            if start is None or at - start >= window_ms:
                start, used = at, 0
            admitted = max(0, min(n, limit - used))
            used += n
            out.append((key[0], at, start, n, admitted, n - admitted))
        if start is not None:
            state.update((int(start), int(used)))
            _forget_at(state, start + window_ms)
        yield pd.DataFrame(out, columns=["client", "at_ms", "window_start_ms", "requests", "admitted", "refused"])

    return step


def _count_per_ms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby(["client", "at_ms"], as_index=False).size().rename(columns={"size": "n"})


def admission_stream(events: DataFrame, window_ms: int = 60_000, limit: int = 30, late: str = "10 minutes") -> DataFrame:
    """Exact per-client windows that begin at the client's first request.

    Requests (client, ts) are counted per client and millisecond on the map
    side, before the shuffle to the state, so a flood from one client travels
    as its distinct milliseconds.  A late request counts in the open window; one
    behind the watermark is left out.  A client's state leaves when the
    watermark passes the end of its window: the next request would open a new
    window anyway, so forgetting changes no answer.
    """
    kind = dict(events.dtypes)["client"]
    flat = events.select("client", F.unix_millis("ts").alias("at_ms")).mapInPandas(_count_per_ms, f"client {kind}, at_ms bigint, n bigint")
    # A millisecond on: rows at the watermark itself would go.
    timed = flat.withColumn("ts", F.timestamp_millis(F.col("at_ms") + 1)).withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(
        _admit(window_ms, limit), f"client {kind}, at_ms bigint, window_start_ms bigint, requests bigint, admitted bigint, refused bigint",
        "start bigint, used bigint", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_counts(events: DataFrame, window: str = "60 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Requests per gate in a sliding window (to the second; the batch form is exact to the millisecond)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "gate").agg(F.count(F.lit(1)).alias("requests")).select(
        F.col("w.end").alias("window_end"), "gate", "requests")


def _keep_good(fresh_ms: int, stale_ms: int, slice_rows: int = 1 << 16):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Batches are folded one by one: good attempts to their distinct milliseconds, reads to two numbers each.
        good: set[int] = {state.get[0]} if state.exists else set()
        times, requests = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            read = batch["is_read"].eq(True)
            good.update(batch.loc[~read & batch["ok"].eq(True), "at_ms"].astype(int))
            times.append(batch.loc[read, "at_ms"].to_numpy(np.int64))
            requests.append(batch.loc[read, "request_id"].to_numpy(np.int64))
        at, request = np.concatenate(times), np.concatenate(requests)
        marks = np.array(sorted(good), dtype=np.int64)
        if len(marks):
            state.update((int(marks[-1]),))
            _forget_at(state, marks[-1] + stale_ms)
        order = np.lexsort((request, at))
        for first in range(0, len(order), slice_rows):
            part = order[first:first + slice_rows]
            # Within one millisecond an attempt counts before the reads.
            last = np.searchsorted(marks, at[part], side="right") - 1
            age = at[part] - marks[last] if len(marks) else np.full(len(part), stale_ms)
            age = np.where(last < 0, stale_ms, age)
            status = np.select([age < fresh_ms, age < stale_ms], ["available", "stale"], "unavailable")
            yield pd.DataFrame({"feed": key[0], "request_id": request[part], "at_ms": at[part], "state": status})

    return step


def freshness_stream(log: DataFrame, fresh_ms: int = 300_000, stale_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """State of the feed at each read, from one log of attempts and reads.

    ``log``: feed string, at_ms, is_read, ok, request_id.  Rows behind the
    watermark are left out.  Of earlier triggers only the newest good attempt is
    known, so a read older than that one finds no attempt.  A feed's state leaves
    when the watermark passes the stale limit of its last good attempt; with or
    without it, every later read says unavailable.
    """
    # A millisecond on: rows at the watermark itself would go.
    timed = log.withColumn("ts", F.timestamp_millis(F.col("at_ms") + 1)).withWatermark("ts", late)
    return timed.groupBy("feed").applyInPandasWithState(
        _keep_good(fresh_ms, stale_ms), "feed string, request_id bigint, at_ms bigint, state string", "good bigint", "append", GroupStateTimeout.EventTimeTimeout)


def latest_generation_stream(requests: DataFrame, key: list[str], order: str = "generation") -> DataFrame:
    """Newest request per task; run in update mode."""
    fields = [c for c in requests.columns if c not in (*key, order)]
    return requests.groupBy(*key).agg(F.max(F.struct(order, *fields)).alias("b")).select(*key, "b.*")


def track_positions(positions: DataFrame, segs: DataFrame, routes: DataFrame, spans: DataFrame, sink: str, checkpoint: str):
    """Start the live position job: each micro-batch meets the static route tables and is appended to ``sink``."""

    def emit(batch: DataFrame, _: int) -> None:
        placed = match_positions(batch, segs, routes)
        upcoming_exposure(placed, spans, at="along_m").write.mode("append").parquet(sink)

    return positions.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_stream(observations: DataFrame, table: str, checkpoint: str, key: str = "observation_id", late: str = "1 day"):
    """Append observations once: repeats inside the watermark drop out, ids already stored are left alone."""

    def append(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = batch.join(spark.read.parquet(table).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(table)

    once = observations.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
