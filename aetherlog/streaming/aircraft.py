"""Live aircraft: closed sightings, and a table with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aetherlog import dims
from aetherlog.operators.aviation import STATE_FIELDS, _with_position

LATE = "10 seconds"

_FIELDS = {
    "flight": "STRING", "altitude": "INT", "speed": "DOUBLE", "track": "DOUBLE",
    "lat": "DOUBLE", "lon": "DOUBLE", "vert_rate": "INT", "squawk": "STRING",
}
_LIVE = "hex STRING, " + ", ".join(f"{n} {t}" for n, t in _FIELDS.items()) + ", seen TIMESTAMP, expired BOOLEAN"


def stream_sightings(updates: DataFrame, ttl_s: int = dims.AIRCRAFT_TTL_S, late: str = LATE) -> DataFrame:
    """One row per closed sighting, emitted once no update can extend it any more."""
    order = F.struct("ts", "seq")
    rows = _with_position(updates.withWatermark("ts", late))
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in STATE_FIELDS]
    merged = rows.groupBy("hex", F.session_window("ts", f"{ttl_s} seconds")).agg(*newest, F.max("ts").alias("seen"))
    return merged.select(
        "hex", F.col("session_window.start").alias("first_seen"), "flight", "altitude", "speed", "track",
        "position.lat", "position.lon", "vert_rate", "squawk", "seen")


class LiveAircraft(StatefulProcessor):
    """State of one aircraft: the newest value of every field and when it was sent.

    Each field carries its own time, so updates may come in any order.
    """

    def __init__(self, ttl_s: int):
        self.ttl_us = ttl_s * 1000000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stamped = ", ".join(f"{n} {t}, {n}_us BIGINT, {n}_seq BIGINT" for n, t in _FIELDS.items())
        self.state = handle.getValueState("aircraft", f"first_us BIGINT, seen_us BIGINT, {stamped}")

    def _expiry_ms(self, seen_us: int) -> int:
        # alive up to and including the limit
        return (seen_us + self.ttl_us) // 1000 + 1

    def _row(self, hex_id: str, values: dict, seen_us: int, expired: bool) -> pd.DataFrame:
        seen = pd.Timestamp(seen_us, unit="us")
        return pd.DataFrame([(hex_id, *[values[n][0] for n in _FIELDS], seen, expired)],
                            columns=["hex", *_FIELDS, "seen", "expired"])

    def _load(self):
        if not self.state.exists():
            return None, None, {n: (None, -1, -1) for n in _FIELDS}
        flat = self.state.get()
        return flat[0], flat[1], {n: tuple(flat[2 + 3 * i: 5 + 3 * i]) for i, n in enumerate(_FIELDS)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, seen, values = self._load()
        before = seen
        # a micro-batch is bounded by the source's rate limit
        batch = pd.concat(list(rows)).sort_values(["us", "seq"], ignore_index=True)
        if seen is not None:
            batch = batch[batch["us"] >= first - self.ttl_us]  # the rest belongs to earlier sightings
        us = batch["us"].to_numpy()
        if len(us):
            known = np.append(us[0] if seen is None else seen, us)
            breaks = np.flatnonzero(us - np.maximum.accumulate(known)[:-1] > self.ttl_us)
            if seen is None or len(breaks):
                batch = batch.iloc[breaks[-1] if len(breaks) else 0:]
                first = seen = int(batch["us"].iloc[0])
                values = {n: (None, -1, -1) for n in _FIELDS}
            first, seen = min(first, int(batch["us"].min())), max(seen, int(batch["us"].max()))
            for n in _FIELDS:
                sent = batch[batch[n].notna()]
                if len(sent):
                    v, at, seq = sent[[n, "us", "seq"]].iloc[-1]
                    if (at, seq) > values[n][1:]:
                        values[n] = (int(v) if _FIELDS[n] == "INT" else v, int(at), int(seq))
        self.state.update((first, seen, *[x for n in _FIELDS for x in values[n]]))
        if before is not None:
            self.handle.deleteTimer(self._expiry_ms(before))
        self.handle.registerTimer(self._expiry_ms(seen))
        yield self._row(key[0], values, seen, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, seen, values = self._load()
        self.state.clear()
        yield self._row(key[0], values, seen, True)

    def close(self) -> None:
        pass


def stream_aircraft(updates: DataFrame, ttl: int = dims.AIRCRAFT_TTL_S, late: str = LATE) -> DataFrame:
    """Changes of the live aircraft table: the full state after each batch, and expiries."""
    rows = updates.withWatermark("ts", late).select("hex", "ts", "seq", *_FIELDS, F.unix_micros("ts").alias("us"))
    return rows.groupBy("hex").transformWithStateInPandas(
        statefulProcessor=LiveAircraft(ttl), outputStructType=_LIVE, outputMode="Update", timeMode="EventTime")
