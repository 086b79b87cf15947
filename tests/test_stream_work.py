"""What streams do beside their results: nothing for keys without output, many files for many rows."""

import pandas as pd
from pyspark.sql import functions as F

from sourcemark.plans import live
from sourcemark.streaming import timed


class Held(list):
    """List and value state of one key, and its timers, without a state store."""

    value = None

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Value()

    def appendList(self, rows):
        self.extend(rows)

    def registerTimer(self, at):
        pass

    def get(self):
        return iter(list(self))


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_no_frame_is_made_for_nothing():
    work = timed._Move(10)
    work.init(Held())
    rows = pd.DataFrame([(5, 1, "screening", "system", False, False, "applied", 0)], columns=[c.split()[0] for c in work.row.split(", ")])
    assert list(work.handleInputRows((1,), iter([rows]), Clock())) == []
    assert list(work.handleExpiredTimer((1,), Clock(), None)) == []


def test_large_parts_come_in_several_files_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "_FILE_ROWS", 10)
    rows = spark.range(200).select("id", F.col("id").alias("tie"), F.timestamp_micros(F.col("id") * F.col("id") * 1_000_000).alias("at"))
    seen = []
    stream = live._arrivals(spark, rows, "id", "tie", 5)

    def look(batch, number):
        seen.append((batch.count(), batch.agg(F.min("at"), F.max("at")).first(), len({f for f, in batch.select(F.input_file_name()).distinct().collect()})))

    stream.writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 5 and sum(n for n, _, _ in seen) == 201
    assert all(files == 5 for _, _, files in seen[:4]) and seen[4][0] == 1
    # No part begins earlier than the one before it ended, but for the delay.
    for (_, before, _), (_, after, _) in zip(seen, seen[1:], strict=False):
        assert (before[1] - after[0]).total_seconds() <= 5
