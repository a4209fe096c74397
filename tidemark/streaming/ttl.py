"""Fixed-TTL replay as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

#: Rows of a frame that goes back to Spark.
FRAME_ROWS = 50_000


class TtlEntry(StatefulProcessor):
    """One live entry per key: when it expires and whose response it is.

    Within a micro-batch the rows of a key are put in time order.  A row that
    is earlier than one of its key in a former batch can't be judged any more:
    it comes out as LATE without an owner and changes nothing
    (``runs.in_time_order`` feeds finished tables so that there is none).  A
    key's rows are held as plain number arrays, at most one micro-batch of
    them, so the source's admission limit (files or bytes per trigger) bounds
    the memory.
    """

    def __init__(self, ttl_us: int, client: DataType, idle_ms: int | None = None):
        self.ttl_us = ttl_us
        self.state = StructType([StructField("expiry", LongType()), StructField("owner", client), StructField("seen", LongType())])
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # An idle entry is dropped by the state store itself.
        self.entry = handle.getValueState("entry", self.state, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = [(b["us"].to_numpy(), b["id"].to_numpy(), b["client"].to_numpy()) for b in rows]
        us, ids, clients = (np.concatenate(part) for part in zip(*chunks))
        order = np.lexsort((ids, us))
        us, ids, clients = us[order], ids[order], clients[order]
        expiry, owner, seen = self.entry.get() if self.entry.exists() else (None, None, None)
        owners = np.empty(len(us), dtype=object)
        missed = np.zeros(len(us), dtype=bool)
        late = at = 0 if seen is None else int(np.searchsorted(us, seen))
        while at < len(us):
            stop = at if expiry is None else at + int(np.searchsorted(us[at:], expiry))
            owners[at:stop] = owner
            if stop == len(us):
                break
            missed[stop], owners[stop] = True, clients[stop]
            expiry, owner = int(us[stop]) + self.ttl_us, clients[stop]
            at = stop + 1
        seen = int(us[-1]) if seen is None else max(seen, int(us[-1]))
        self.entry.update((expiry, owner.item() if isinstance(owner, np.generic) else owner, seen))
        status = np.where(missed, "MISS", "HIT").astype(object)
        status[:late] = "LATE"
        for a in range(0, len(us), FRAME_ROWS):
            part = slice(a, a + FRAME_ROWS)
            yield pd.DataFrame(
                {
                    "cache_key": key[0],
                    "us": us[part],
                    "id": ids[part],
                    "client": clients[part],
                    "status": status[part],
                    "owner": owners[part],
                }
            )

    def close(self) -> None:
        pass


def ttl_replay_stream(requests: DataFrame, ttl_us: int, idle_ms: int | None = None) -> DataFrame:
    """Streaming counterpart of the batch replay; same columns, append mode."""
    slim = requests.select("cache_key", "us", "id", "client")
    client = slim.schema["client"].dataType
    labelled = StructType([*slim.schema.fields, StructField("status", StringType()), StructField("owner", client)])
    return slim.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=TtlEntry(ttl_us, client, idle_ms),
        outputStructType=labelled,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
