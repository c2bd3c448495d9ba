"""Streams: the link to earlier visits kept as state, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINKED = "rid long, pid string, date date, items array<string>, prev_items array<string>, prev_gap int, visit_ix long"
STATE = "items array<string>, date date, n long"


def link_stream(visits: DataFrame) -> DataFrame:
    """LINKED for a stream of visits (rid, pid, date, items): the last earlier visit with items is the state of an entity.

    Within a batch visits are taken by date and rid; a visit that arrives in a later batch than a younger one follows it. The
    state is one visit an entity, whatever the number of visits.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, date, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values(["date", "rid"])
        out = []
        for r in rows.itertuples():
            own = list(r.items) if r.items is not None else []
            out.append((r.rid, key[0], r.date, own, None if items is None else list(items), None if items is None else (r.date - date).days, n))
            n += 1
            if own:
                items, date = own, r.date
        state.update((items, date, n))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in LINKED.split(", ")])
        frame["prev_gap"] = frame["prev_gap"].astype("Int32")
        yield frame

    return visits.groupBy("pid").applyInPandasWithState(step, LINKED, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """start, event_type, n and total of each window of a stream of events (ts, event_type, value); rows that come too late are left out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
