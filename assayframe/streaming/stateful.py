"""Stateful streams: chained audit logs, run states, windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.audit import CHAIN, TRANSITIONS, ZERO, envelope
from ..operators.bundles import egress_decisions, egress_events


def chain_stream(events: DataFrame) -> DataFrame:
    """The events of a stream chained by run as they come: run_id, line_no, prev_event_hash, event_hash.

    The state of a run is its last hash, so a restart from the checkpoint goes on where it stopped. Within a
    micro-batch a run's events are taken in order of line_no, for which they are held at once: limit a source's files or bytes
    per trigger (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) where one run may have very many.
    """
    head, tail = envelope()
    rows = events.select("run_id", F.col("line_no").cast("long"), head.alias("head"), tail.alias("tail"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ZERO
        batch = pd.concat(list(batches)).sort_values("line_no")
        prevs, hashes = [], []
        for h, t in zip(batch["head"], batch["tail"]):
            prevs.append(last)
            last = hashlib.sha256(f"{h}{last}{t}".encode()).hexdigest()
            hashes.append(last)
        state.update((last,))
        yield pd.DataFrame({"run_id": key[0], "line_no": batch["line_no"].to_numpy(), "prev_event_hash": prevs, "event_hash": hashes})

    return rows.groupBy("run_id").applyInPandasWithState(fold, CHAIN, "last string", "append", GroupStateTimeout.NoTimeout)


def transition_stream(states: DataFrame, legal: dict[str, tuple[str, ...]] = TRANSITIONS, always: str = "CANCELLED") -> DataFrame:
    """Illegal changes of state in a stream (run_id, line_no, state): run_id, line_no, from_state, to_state."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        out = []
        for line, to in pd.concat(list(batches)).sort_values("line_no")[["line_no", "state"]].itertuples(index=False):
            if now is not None and to != always and to not in legal.get(now, ()):
                out.append((key[0], line, now, to))
            now = to
        state.update((now,))
        yield pd.DataFrame(out, columns=["run_id", "line_no", "from_state", "to_state"])

    return states.groupBy("run_id").applyInPandasWithState(follow, "run_id string, line_no long, from_state string, to_state string", "state string", "append", GroupStateTimeout.NoTimeout)


def egress_stream(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """A stream of requests (run_id, line_no, ts_utc, vault_id, url) decided by the allowlist and recorded as chained audit events; state is each run's last hash."""
    return chain_stream(egress_events(egress_decisions(requests, rules)))


def tumbling(events: DataFrame, ts_col: str = "ts", width: str = "1 day", late: str = "1 hour", keys: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts and sums by time window, or by windows that begin every ``slide``. On a stream rows later than ``late`` are left out, and a window is told once the watermark has passed its end."""
    df = events.withWatermark(ts_col, late) if events.isStreaming else events
    return df.groupBy(F.window(ts_col, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts_col: str = "ts", gap: str = "30 minutes", key: str = "user_id", late: str = "1 hour") -> DataFrame:
    df = events.withWatermark(ts_col, late) if events.isStreaming else events
    return df.groupBy(F.session_window(ts_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
