"""Stateful processors: audit logs chained in order of their lines, and claims that expire.

They keep keyed state in the state store (``spark.sql.streaming.stateStore.providerClass`` has to name the one on RocksDB: see ``use_rocksdb``), touch it only for
what is out of order or has to be remembered, and take rows as they come: no more than a bounded part of a batch is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import CHAIN, ZERO, envelope

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Line numbers in a block of waiting lines; rows of a run that are judged at once.
BLOCK, AT_ONCE = 2048, 1 << 16
Lines = dict[int, tuple[str, str]]  # line number -> the text before and after its previous hash
EXPIRED = "claim_id string, generated timestamp, valid_until timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames joined to some of about ``AT_ONCE`` rows each."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= AT_ONCE:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


class _Chain(StatefulProcessor):
    """A run's chain: the number of the next line, the last hash, and the lines that came before their turn.

    These wait in pieces, each of a block of ``BLOCK`` line numbers: a state entry a line would take a call of the state's server for each. A new piece takes in those before it that aren't
    larger, so a line is written again about as often as its block doubles, and one that comes again and again doesn't add up.
    """

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "line long, last string, waiting long")  # waiting: blocks with lines in the state
        self.sizes = handle.getMapState("sizes", "block long", "sizes array<int>")
        self.early = handle.getMapState("early", "block long, piece int", "lines array<long>, heads array<string>, tails array<string>")

    def _piece(self, block: int, piece: int) -> Lines:
        lines, heads, tails = self.early.getValue((block, piece))
        self.early.removeKey((block, piece))
        return dict(zip(lines, zip(heads, tails)))

    def _sizes(self, block: int) -> list[int]:
        return list(self.sizes.getValue((block,))[0]) if self.sizes.containsKey((block,)) else []

    def _take(self, block: int) -> Lines:
        """The waiting lines of a block, which leave the state; of equal numbers the first that came."""
        found: Lines = {}
        pieces = len(self._sizes(block))
        for k in range(pieces):
            found = self._piece(block, k) | found
        if pieces:
            self.sizes.removeKey((block,))
        return found

    def _put(self, block: int, lines: Lines) -> bool:
        """Let the lines of a block wait; whether none of it waited before."""
        sizes = self._sizes(block)
        new = not sizes
        while sizes and sizes[-1] <= len(lines):
            sizes.pop()
            lines = lines | self._piece(block, len(sizes))
        self.early.updateValue((block, len(sizes)), (list(lines), [h for h, _ in lines.values()], [t for _, t in lines.values()]))
        self.sizes.updateValue((block,), ([*sizes, len(lines)],))
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line, last, waiting = self.at.get() if self.at.exists() else (self.first, ZERO, 0)
        for batch in _gathered(rows):
            out, came = [], {}
            for n, head, tail in zip(batch["line_no"].tolist(), batch["head"], batch["tail"]):
                if n >= line:
                    came.setdefault(n // BLOCK, {}).setdefault(n, (head, tail))
            on = line in came.get(line // BLOCK, ())  # the next line isn't in the state, as it would have been taken
            while on:
                block = line // BLOCK
                taken = self._take(block) if waiting else {}
                waiting -= bool(taken)
                held = came.pop(block, {}) | taken
                while line in held:
                    head, tail = held.pop(line)
                    mine = hashlib.sha256(f"{head}{last}{tail}".encode()).hexdigest()
                    out.append((key[0], line, last, mine))
                    line, last = line + 1, mine
                if held:
                    came[block] = held
                on = line // BLOCK > block
            for block, lines in came.items():
                waiting += self._put(block, lines)
            if out:
                yield pd.DataFrame(out, columns=["run_id", "line_no", "prev_event_hash", "event_hash"])
        self.at.update((line, last, waiting))

    def close(self) -> None:
        pass


def ordered_chain(events: DataFrame, first: int = 0) -> DataFrame:
    """(run_id, line_no, prev_event_hash, event_hash) of a stream whose lines are numbered without gaps from ``first`` in each run, and come in any order.

    A line that comes before its turn waits in the state, so the result is that of the whole log however its lines are dealt to micro-batches; a line that comes twice counts once. State is
    a run's last hash and its waiting lines. A line without a number is left out.
    """
    head, tail = envelope()
    rows = events.where("line_no is not null").select("run_id", F.col("line_no").cast("long"), head.alias("head"), tail.alias("tail"))
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=_Chain(first), outputStructType=CHAIN, outputMode="Append", timeMode="None")


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, start of the statement that ends last), those that meet made one: a statement made until another's end renews it."""
    out: list[tuple[int, int, int]] = []
    for start, end, last in sorted(spans):
        if out and start <= out[-1][1]:
            first, until, kept = out[-1]
            out[-1] = (first, max(until, end), last if end > until else min(kept, last) if end == until else kept)
        else:
            out.append((start, end, last))
    return out


class _Claims(StatefulProcessor):
    """A claim's statements as spans in which it is valid without a break: a span's end is that of the one statement which nothing renewed. One timer stands for the span that ends first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ends array<long>, lasts array<long>")

    def _held(self) -> list[tuple[int, int, int]]:
        state = self.open.get()
        return list(zip(*state)) if state else []

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        self.open.update(tuple(map(list, zip(*spans))))
        self.handle.registerTimer(-(-spans[0][1] // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._held()
        for batch in rows:
            generated, until = batch["generated_us"].tolist(), batch["until_us"].tolist()
            spans = _joined([*spans, *zip(generated, until, generated)])
        if spans:
            self._keep(spans)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed ends at once, so a timer of a span that grew since finds nothing or the next end
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = self._held()
        ended, spans = [s for s in held if s[1] <= now], [s for s in held if s[1] > now]
        if ended and spans:
            self._keep(spans)
        elif ended:
            self.open.clear()
        elif spans:
            self.handle.registerTimer(-(-spans[0][1] // 1000))
        if ended:
            stamps = lambda us: pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")
            yield pd.DataFrame({"claim_id": [key[0]] * len(ended), "generated": stamps([s[2] for s in ended]), "valid_until": stamps([s[1] for s in ended])})

    def close(self) -> None:
        pass


def expired_claims(claims: DataFrame, late: str = "1 hour", valid: str = "24 hours") -> DataFrame:
    """(claim_id, generated, valid_until) of statements in a stream of (claim_id, generated) that ran out without having been renewed.

    A statement is valid for ``valid``; one made until then renews the claim. Timers fire once the watermark, ``late`` behind the newest statement, has passed the end, so the
    result doesn't depend on the order of statements that are no later than that. State is the spans that haven't ended, those that meet joined. Nulls are left out.
    """
    us = lambda c: F.unix_micros(c)
    rows = claims.where("claim_id is not null and generated is not null").withWatermark("generated", late)
    rows = rows.select("claim_id", "generated", us(F.col("generated")).alias("generated_us"), us(F.col("generated") + F.expr(f"interval {valid}")).alias("until_us"))
    return rows.groupBy("claim_id").transformWithStateInPandas(statefulProcessor=_Claims(), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime")
