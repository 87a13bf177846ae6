"""Stateful processors over small steps and restarts; a log that no crash doubles or cuts."""

import hashlib
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from assayframe.operators import audit
from assayframe.sinks import logs
from assayframe.streaming import processors

EVENT = "run_id string, line_no long, ts_utc string, event_type string, vault_id string, actor string, details string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    processors.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(spark, rows):
    return spark.createDataFrame([(r, n, "t", f"e{n}", "v", "a", "{}") for r, n in rows], EVENT).coalesce(1)


def test_lines_wait_for_their_turn_over_restarts(spark, tmp_path):
    rows = [(r, n) for r in "rs" for n in range(12)]
    random.Random(1).shuffle(rows)
    rows = rows[:15] + rows[10:] + [("gap", 0), ("gap", 2), ("gap", None)]  # some come twice, one line of a run never
    for k in range(0, len(rows), 8):
        events(spark, rows[k : k + 8]).write.mode("append").parquet(f"{tmp_path}/in")
        stream = processors.ordered_chain(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
        logs.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/at").awaitTermination()
    want = audit.build_chain(events(spark, [(r, n) for r in "rs" for n in range(12)] + [("gap", 0)]))
    got = logs.read_log(spark, f"{tmp_path}/log").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) == 25


def test_waiting_lines_stand_in_few_pieces(monkeypatch):
    """A state entry for each line took some calls of the state's server a line."""
    calls = []

    class State(dict):
        exists, get = (lambda self: "v" in self), (lambda self, k="v": self[k])
        containsKey, getValue, removeKey = (lambda self, k: calls.append(k) or k in self), (lambda self, k: calls.append(k) or self[k]), (lambda self, k: calls.append(k) or self.pop(k))
        updateValue = lambda self, k, v: calls.append(k) or self.__setitem__(k, v)
        update = lambda self, v, k="v": self.__setitem__(k, v)

    class Handle(dict):
        getMapState = getValueState = lambda self, name, *_: self.setdefault(name, State())

    monkeypatch.setattr(processors, "BLOCK", 64, raising=False)
    chain, handle, lines, got = processors._Chain(0), Handle(), [*range(1, 2000)], []
    chain.init(handle)
    random.Random(2).shuffle(lines)
    for part in (lines[:900], lines[700:], lines[700:], [0, 0], [5]):  # some come twice while they wait, and one when it is done
        frame = pd.DataFrame({"line_no": part, "head": [f"h{n}" for n in part], "tail": [f"t{n}" for n in part]})
        got += [r for f in chain.handleInputRows(("r",), iter([frame[:500], frame[500:]]), None) for r in f.itertuples(index=False)]
    last = "0" * 64
    for n, r in enumerate(got):
        assert (r.line_no, r.prev_event_hash) == (n, last)
        last = hashlib.sha256(f"h{n}{last}t{n}".encode()).hexdigest()
        assert r.event_hash == last
    assert len(got) == 2000 and not handle["early"] and len(calls) < 2000


def test_a_batch_repeated_after_a_crash_is_appended_once(spark, tmp_path, monkeypatch):
    log, whole = f"{tmp_path}/log", logs.append_batch
    calls = []

    def dies_before(lines, path, name):
        lines.write.mode("overwrite").parquet(f"{path}/.aside-{name}/lines")
        raise RuntimeError("killed while writing")

    def dies_after(lines, path, name):
        calls.append(whole(lines, path, name))
        raise RuntimeError("killed before the commit")

    def again(lines, path, name):
        calls.append(whole(lines, path, name))
        return calls[-1]

    events(spark, [("r", 0), ("r", 1)]).write.parquet(f"{tmp_path}/in")
    for way in (dies_before, dies_after, again):
        monkeypatch.setattr(logs, "append_batch", way)
        stream = processors.ordered_chain(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
        query = logs.append_log(stream, log, f"{tmp_path}/at")
        if way is again:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination()
    assert calls == [True, False] and [r.line_no for r in logs.read_log(spark, log).orderBy("line_no").collect()] == [0, 1]
    chain = audit.build_chain(events(spark, [("r", n) for n in range(4)]))
    with pytest.raises(logs.BrokenLog, match="runs r"):
        logs.append_batch(chain.where("line_no = 3"), log, "other-0")
    with pytest.raises(logs.BrokenLog):
        logs.append_batch(chain.where("line_no < 2"), log, "other-0")  # a second beginning
    assert logs.append_batch(chain.where("line_no = 2"), log, "other-0") and logs.append_batch(chain.where("line_no = 3"), log, "other-1")
    assert [r.line_no for r in logs.read_log(spark, log).orderBy("line_no").collect()] == [0, 1, 2, 3]


def test_claims_expire_by_timer(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(2)
    rows = sorted((start + timedelta(minutes=rng.randrange(60 * 24 * 12)), rng.choice("abc")) for _ in range(40))
    rows += [(rows[5][0], rows[5][1])]
    for k in range(0, len(rows), 9):
        step = [(c, t) for t, c in rows[k : k + 9]]
        rng.shuffle(step)
        spark.createDataFrame(step, "claim_id string, generated timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = processors.expired_claims(spark.readStream.schema("claim_id string, generated timestamp").parquet(f"{tmp_path}/in"), late="30 days" if k < 0 else "1 hour")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    end, day, want = max(t for t, _ in rows) - timedelta(hours=1), timedelta(hours=24), set()
    for c in "abc":
        own = sorted({t for t, x in rows if x == c})
        want |= {(c, t, t + day) for t, after in zip(own, [*own[1:], None]) if (after is None or after > t + day) and t + day <= end}
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert set(got) == want and len(got) == len(want) > 3
