"""Keyed streams in event time: rows wait until the watermark has passed them, timers hand them on in order.

Rows of a key arrive in any order across micro-batches. They wait in list state; a timer at the oldest
one fires when no older row can be on its way any more, and all rows the watermark has passed are worked
on in order. So the result depends on the rows alone, not on how they were cut into batches. A row older
than one already worked on is late: it comes out marked as such and changes nothing.

A key's state is dropped by a timer once nothing has happened for a while, so state is bounded by the keys
in use. Waiting rows are bounded by the watermark delay, however many rows a key has over time.

The functions take a watermarked column ``at`` and pass it on as plain microseconds: Spark keeps the
watermark but does not drop late rows before they are seen here. They need the RocksDB state store.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sourcemark.functions import text as tx
from sourcemark.operators.lifecycle import NEEDS_EVIDENCE, NEEDS_REASON, TERMINAL, TRANSITIONS
from sourcemark.operators.worktrack import IN_FLIGHT, STREAM_SECONDS, VISIBILITY_SECONDS

# The processors travel inside the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
# How long a key's state outlives its last row.
LINGER_SECONDS = 7 * 24 * 3600
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Timers and list state exist in this state store only; a setting of streams started later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


class InOrder(StatefulProcessor):
    """Rows (moment, tie, ...) of a key, handed to ``work`` in order; what it keeps is ``known``.

    ``known`` begins with the moment and tie of the last row worked on.
    """

    row = "moment bigint, tie bigint"
    known = "moment bigint, tie bigint"
    output: tuple[str, ...] = ()
    # A row is worked on when the watermark is this far past it.
    hold = 0

    def __init__(self, linger: int = LINGER_SECONDS):
        self.linger = linger * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("known", self.known)

    def close(self) -> None:
        pass

    # What differs between streams.

    def work(self, key: Any, known: tuple | None, ready: list[tuple], passed: int) -> tuple[tuple | None, list[tuple]]:
        """What is known after the rows ``ready``, and output; ``passed`` is the watermark."""
        raise NotImplementedError

    def late(self, key: Any, row: tuple) -> tuple:
        """The output for a row that came too late."""
        raise NotImplementedError

    def due(self, known: tuple) -> int | None:
        """When to look again although no row waits."""
        return None

    # What they share.

    def _known(self) -> tuple | None:
        held = self.state.get()
        return None if held is None else tuple(held)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        # Whole numbers stay whole next to missing ones.
        return pd.DataFrame(rows, columns=list(self.output), dtype=object)

    def _wake(self, moment: int) -> None:
        """A timer for the first millisecond past ``moment``."""
        self.handle.registerTimer(moment // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self._known()
        new, late = [], []
        names = [part.split()[0] for part in self.row.split(", ")]
        for frame in rows:
            for values in frame[names].itertuples(index=False, name=None):
                # Plain values: what pandas makes of whole numbers, flags and nulls is no state.
                row = tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in values)
                if known is not None and row[:2] < known[:2]:
                    late.append(self.late(key[0], row))
                else:
                    new.append(row)
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new) + self.hold)
        # A frame costs as much as the work on a key: none is made for nothing.
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] + self.hold < passed]
        rest = rows[len(ready) :]
        before = self._known()
        known, out = self.work(key[0], before, ready, passed) if rows or before is not None else (None, [])
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if known is not None and not rest and known[0] + self.linger < passed:
            known = None
            self.state.clear()
        elif known is not None and known != before:
            self.state.update(known)
        if rest and ready:
            self._wake(rest[0][0] + self.hold)
        if known is not None:
            again = self.due(known) if known != before else None
            if again is not None and again >= passed:
                self._wake(again)
            # One timer at a time looks whether the state is idle: it is set first, and again when it came too early.
            if before is None or not ready:
                self._wake(known[0] + self.linger)
        if out:
            yield self._frame(out)


class _Follow(InOrder):
    """One row's readings: a frame per change, then one closing frame and silence until the state is dropped."""

    row = "moment bigint, tie bigint, status string, payload string"
    known = "moment bigint, tie bigint, payload string, began bigint, seq bigint, closed boolean"
    output = ("id", "seq", "payload", "frame")

    def __init__(self, silent: bool, linger: int):
        super().__init__(linger)
        self.silent = silent

    def due(self, known: tuple) -> int | None:
        return known[3] + STREAM_SECONDS * SECOND if self.silent and not known[5] else None

    def late(self, key: Any, row: tuple) -> tuple:
        return key, None, row[3], "late"

    def work(self, key, known, ready, passed):
        out: list[tuple] = []
        for moment, tie, status, payload in ready:
            _, _, last, began, seq, closed = known or (None, None, None, moment, 0, False)
            over = moment >= began + STREAM_SECONDS * SECOND
            if over and self.silent and not closed:
                out.append((key, seq, last, "timeout"))
                closed = True
            if not closed:
                if status is not None and (known is None or payload != last):
                    out.append((key, seq, payload, "status"))
                ending = "gone" if status is None else "done" if status not in IN_FLIGHT else "timeout" if over else None
                if ending:
                    out.append((key, seq, payload, ending))
                    closed = True
                last, seq = payload, seq + 1
            known = moment, tie, last, began, seq, closed
        # Silence: all readings before the deadline are in, and none has closed the feed.
        if self.silent and known is not None and not known[5] and known[3] + STREAM_SECONDS * SECOND < passed:
            out.append((key, known[4], known[2], "timeout"))
            known = (*known[:5], True)
        return known, out


FEED_OUTPUT = "id bigint, seq bigint, payload string, frame string"


def stream_status_feed(readings: DataFrame, silent: bool = True, linger: int = LINGER_SECONDS) -> DataFrame:
    """Readings (id, at, tie, status, payload; ``at`` watermarked) → frames: ``status`` on first sight and on every
    change, then ``done``, ``gone`` or ``timeout``, 300 seconds after first sight.

    A ``silent`` feed is closed by a timer at its deadline, whether or not it is read again; otherwise the first
    reading past the deadline closes it, as in the batch operator. ``tie`` orders readings of one moment. ``seq``
    counts the readings before. Late readings come out as ``late``.
    """
    rows = readings.select("id", micros("at").alias("moment"), F.col("tie").cast("bigint").alias("tie"), "status", "payload")
    return rows.groupBy("id").transformWithStateInPandas(_Follow(silent, linger), FEED_OUTPUT, "append", "eventTime")


class _Move(InOrder):
    """Requests of one application, each judged on the state the last one left."""

    row = (
        "moment bigint, tie bigint, to_state string, mover string, said boolean, backed boolean, "
        "initial_state string, last_position bigint"
    )
    known = "moment bigint, tie bigint, state string, position bigint"
    output = ("application_id", "request_id", "from_state", "to_state", "allowed", "position", "late")
    permitted = frozenset(TRANSITIONS)

    def late(self, key: Any, row: tuple) -> tuple:
        return key, row[1], None, row[2], None, None, True

    def work(self, key, known, ready, passed):
        out: list[tuple] = []
        for moment, tie, to_state, mover, said, backed, initial, last in ready:
            state, position = (initial, last) if known is None else known[2:]
            allowed = (
                state not in TERMINAL
                and (state, mover, to_state) in self.permitted
                and (to_state != NEEDS_REASON or said)
                and (to_state != NEEDS_EVIDENCE or backed)
            )
            position += int(allowed)
            out.append((key, tie, state, to_state, allowed, position if allowed else None, False))
            known = moment, tie, to_state if allowed else state, position
        return known, out


MOVES_OUTPUT = (
    "application_id bigint, request_id bigint, from_state string, to_state string, allowed boolean, position bigint, late boolean"
)


def stream_moves(requests: DataFrame, linger: int = LINGER_SECONDS) -> DataFrame:
    """Requested moves (``at`` watermarked, in any order) → the log they append, refused and late ones included.

    ``requests``: application_id, request_id, at, to_state, mover, reason, screening_id, and the stored
    application's initial_state and last_position, which are read where no state is held: on an application's
    first request, and on the first one after its state was dropped.
    """
    rows = requests.select(
        "application_id",
        micros("at").alias("moment"),
        F.col("request_id").cast("bigint").alias("tie"),
        "to_state",
        "mover",
        (tx.strip(F.coalesce(F.col("reason"), F.lit(""))) != "").alias("said"),
        (F.coalesce(F.col("screening_id").cast("string"), F.lit("")) != "").alias("backed"),
        "initial_state",
        F.col("last_position").cast("bigint").alias("last_position"),
    )
    return rows.groupBy("application_id").transformWithStateInPandas(_Move(linger), MOVES_OUTPUT, "append", "eventTime")


class _Watch(InOrder):
    """Claims without another update in time; an update is settled once all that could follow it in time are in."""

    row = "moment bigint, tie bigint, status string"
    output = ("id", "claimed_at", "late")
    hold = VISIBILITY_SECONDS * SECOND

    def late(self, key: Any, row: tuple) -> tuple:
        return key, row[0], True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # The next update after the last one that is settled now may still be waiting.
        self.following = sorted(tuple(r)[:2] for r in self.waiting.get())
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def work(self, key, known, ready, passed):
        out = []
        for n, (moment, tie, status) in enumerate(ready):
            followed = n + 1 < len(self.following) and self.following[n + 1][0] <= moment + self.hold
            if status == "processing" and not followed:
                out.append((key, moment, False))
            known = moment, tie
        return known, out


STALLED_OUTPUT = "id bigint, claimed_at bigint, late boolean"


def stream_stalled(updates: DataFrame, linger: int = LINGER_SECONDS) -> DataFrame:
    """Status updates (id, at, tie, status; ``at`` watermarked, in any order) → claims not followed by another
    update within 900 seconds, also if none ever follows; late updates come out marked.
    """
    rows = updates.select("id", micros("at").alias("moment"), F.col("tie").cast("bigint").alias("tie"), "status")
    found = rows.groupBy("id").transformWithStateInPandas(_Watch(linger), STALLED_OUTPUT, "append", "eventTime")
    return found.withColumn("claimed_at", F.timestamp_micros("claimed_at"))
