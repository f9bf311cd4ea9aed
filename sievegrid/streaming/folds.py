"""Structured Streaming over an event log (scan_id, seq, type, payload, at)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (scan_id, seq) once, though it may arrive again within the delay."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["scan_id", "seq"])


def latest(events: DataFrame) -> DataFrame:
    """The last payload of each scan and type by sequence number, and how many events were taken.

    Events at or below the highest number seen for their key are left out, as on a
    replay. State is two numbers and a payload for each key.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, taken, payload = state.get if state.exists else (0, 0, "")
        for pdf in batches:
            for row in pdf.sort_values("seq").itertuples():
                if row.seq > seq:
                    seq, taken, payload = row.seq, taken + 1, row.payload
        state.update((seq, taken, payload))
        yield pd.DataFrame({"scan_id": [key[0]], "type": [key[1]], "seq": [seq], "taken": [taken], "payload": [payload]})

    schema = "scan_id string, type string, seq long, taken long, payload string"
    return events.groupBy("scan_id", "type").applyInPandasWithState(fold, schema, "seq long, taken long, payload string", "update", GroupStateTimeout.NoTimeout)
