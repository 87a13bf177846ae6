"""Host names, allowlists, system-call profiles, report lines, and streams in small steps."""

import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from assayframe.functions.checks import ascii_host
from assayframe.functions.jsons import seccomp_profile
from assayframe.operators import bundles
from assayframe.sources import readers
from assayframe.streaming import stateful


def test_hosts(spark):
    hosts = spark.createDataFrame([("Example.COM",), ("bücher.example",), (None,), ("",)], "h string")
    assert [r[0] for r in hosts.select(ascii_host(F.col("h"))).collect()] == ["example.com", "xn--bcher-kva.example", None, ""]


def test_canonical_rules(spark):
    rows = [(1, "HTTPS", "A.example", 0, "v1\\x"), (2, "ftp", "a", 1, None), (3, "http", "", None, None), (4, "http", "a", None, "/a/../b")]
    got = bundles.canonical_rules(spark.createDataFrame(rows, "idx int, scheme string, host string, port int, path_prefix string")).orderBy("idx").collect()
    assert tuple(got[0])[1:] == ("https", "a.example", 443, "/v1/x", None) and got[1].port == 1 and got[3].port == 80
    assert [r.reject_reason for r in got] == [None, "scheme", "host", "path_prefix"]


def test_seccomp(spark):
    options = [
        ["no-new-privileges", 'seccomp={"b": 1, "architectures": ["X", "Y"]}'], ['seccomp={"archMap":[{"architecture":"A","subArchitectures":["B","C"]},{"architecture":"D"}]}'],
        ["seccomp={}", "seccomp={}"], ["seccomp=unconfined"], ['seccomp={"architectures":["X","X"]}'], ['seccomp={"architectures":["X",""]}'], ["seccomp={}"], [], None,
    ]
    digest, names, reason = seccomp_profile(F.col("o"))
    got = spark.createDataFrame([(o,) for o in options], "o array<string>").select(digest.alias("d"), names.alias("n"), reason.alias("r")).collect()
    assert got[0].d == hashlib.sha256(b'{"architectures":["X","Y"],"b":1}').hexdigest() and got[0].n == ["X", "Y"] and got[1].n == ["A", "B", "C", "D"]
    assert [r.r for r in got] == [None, None, "not exactly one profile", "not JSON", "no architecture binding", "invalid architecture", "no architecture binding", "not exactly one profile", "not exactly one profile"]
    assert all(r.d is None for r in got[2:])


def test_prefixed_reports(spark):
    lines = spark.createDataFrame([('REPORT={"a":"1"}',), ("other",), (None,)], "value string")
    assert [r.report for r in readers.parse_reports(lines, "REPORT=").collect()] == [{"a": "1"}]


def test_payloads(spark):
    good = hashlib.sha256(b"hi").hexdigest()
    rows = [("a", "utf8", "hi", good, "text/plain"), ("b", "base64", "!", None, "text/plain"), ("c", "utf8", "hi", "0" * 64, "text/plain"), ("d", "utf8", "x", None, "application/pdf"), ("e", "utf8", "x", None, ""), ("e", "utf8", "y", None, "")]
    got = readers.decode_payloads(spark.createDataFrame(rows, "artifact_id string, encoding string, data string, declared_sha256 string, content_type string")).distinct().collect()
    assert {(r.artifact_id, r.reject_reason) for r in got} == {("a", None), ("b", "bad encoding"), ("c", "sha256 mismatch"), ("d", "not a PDF"), ("e", "duplicate payload")}


def test_state_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema, found = "run_id string, line_no long, state string", []

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.transition_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    step([("r", 1, "CREATED"), ("r", 2, "READY"), ("s", 1, "CREATED")])
    assert found == []
    step([("r", 3, "COMPLETED"), ("s", 2, "CANCELLED")])
    assert found == [("r", 3, "READY", "COMPLETED")]


def test_windows_and_sessions(spark):
    rows = [(1, "a", datetime(2024, 1, 1, 0, 0), 1.0), (1, "a", datetime(2024, 1, 1, 0, 20), 2.0), (1, "a", datetime(2024, 1, 2, 0, 0), 4.0)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double")
    assert sorted((r.n, r.total) for r in stateful.tumbling(events).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in stateful.sessions(events).collect()) == [1, 2]


def test_chain_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from assayframe.operators import audit

    schema, found = "run_id string, line_no long, ts_utc string, event_type string, vault_id string, actor string, details string", []

    def step(rows):
        spark.createDataFrame([(r, n, "t", "e", "v", "a", "{}") for r, n in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.chain_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    step([("r", 2), ("r", 1), ("s", 1)])
    step([("r", 3), ("s", 2), ("s", 3)])
    whole = audit.build_chain(spark.read.schema(schema).parquet(f"{tmp_path}/in"))
    assert sorted(found) == sorted(map(tuple, whole.collect())) and len(found) == 6


def test_before_over_blocks(spark):
    from assayframe.operators.audit import before

    rows = [(g, n, n * 7 % 5) for g in "ab" for n in (1, 2, 5, 9, 10, 11, 30, 31)]
    got = before(spark.createDataFrame(rows, "run_id string, line_no long, v long"), "v", block=3).collect()
    last = {(g, n): v for (g, m, v), (h, n, _) in zip(rows, rows[1:]) if g == h}
    assert {(r.run_id, r.line_no): r.before for r in got} == {(g, n): last.get((g, n)) for g, n, _ in rows}


def test_json_numbers(spark):
    from assayframe.functions.jsons import number_text, with_numbers

    want = {0.0: "0.0", 1.5: "1.5", -12300000.0: "-12300000.0", 24691356.78: "24691356.78", 1234567890123456.0: "1234567890123456.0", 1e16: "1e16", -1.25e20: "-1.25e20", 0.00095: "0.00095", 1.234567890123e-5: "0.00001234567890123", 1.5e-7: "1.5e-7", float("inf"): None, float("nan"): None}
    df = spark.createDataFrame([(k, 'a "n":"1" \\ b') for k in want] + [(None, "x")], "v double, s string")
    rows = df.select("v", number_text(F.col("v")).alias("t"), with_numbers(F.to_json(F.struct("s", number_text(F.col("v")).alias("n"))), "n").alias("j")).collect()
    for r in rows:
        assert r.t == (None if r.v is None or r.v != r.v else want[r.v])
        read = json.loads(r.j)
        assert read.get("n") == (r.v if r.t else None) and read["s"] == ("x" if r.v is None else 'a "n":"1" \\ b')
