"""Pointer gestures: offsets of moves from where their pointer went down, in streams and in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["user_id", "pointer"]
OUT = "event_id long, user_id long, pointer int, dx double, dy double"


def from_events(events: DataFrame) -> DataFrame:
    """event_id, user_id, ts, op, pointer, px, py: an event table as pointer events."""
    op = F.when(F.col("event_type").isin("view", "signup"), "down").when(F.col("event_type").isin("click", "purchase"), "move").otherwise("up")
    v = F.col("value").cast("double")
    return events.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "ts", op.alias("op"), (F.col("event_id") % 2).cast("int").alias("pointer"), v.alias("px"), (v * 0.5).alias("py"))


def offsets(pointers: DataFrame) -> DataFrame:
    """Batch form: a move counts if the last down or up before it, of the same pointer, was a down."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.last(F.when(F.col("op") != "move", F.struct("op", "px", "py")), ignorenulls=True).over(w)
    e = pointers.withColumn("m", mark).filter("op = 'move' AND m.op = 'down'")
    return e.select("event_id", *KEY, (F.col("px") - F.col("m.px")).alias("dx"), (F.col("py") - F.col("m.py")).alias("dy"))


def stream_offsets(pointers: DataFrame) -> DataFrame:
    """Streaming form: the state of a pointer is its anchor while it is down; unknown pointers are passed over.

    Events of one micro-batch are put in order; a pointer that says nothing for an hour is forgotten.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        anchor = state.get if state.exists else None
        rows = []
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if e.op == "down":
                anchor = (e.px, e.py)
            elif e.op == "up":
                anchor = None
            elif anchor is not None:
                rows.append((e.event_id, key[0], key[1], e.px - anchor[0], e.py - anchor[1]))
        if anchor is None:
            if state.exists:
                state.remove()
        else:
            state.update(anchor)
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(rows, columns=["event_id", "user_id", "pointer", "dx", "dy"])

    return pointers.groupBy(*KEY).applyInPandasWithState(step, OUT, "ax double, ay double", "append", GroupStateTimeout.ProcessingTimeTimeout)
