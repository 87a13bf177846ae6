"""Sources read back what sinks wrote, and odd files give rows with a reason."""

import io
import tarfile

from pyspark.sql import functions as F

from assayframe.operators import policies
from assayframe.sinks import writers
from assayframe.sources import readers


def test_zip_round_trip_is_deterministic(spark):
    files = spark.createDataFrame([("b1", "z.txt", b"last"), ("b1", "a/x.txt", b"first"), ("b2", "only", b"")], "bundle_id string, path string, bytes binary")
    once, again = (sorted(writers.zip_bundles(f).collect()) for f in (files, files.orderBy("path")))
    assert once == again and len(once) == 2
    entries = readers.zip_entries(writers.zip_bundles(files), "bundle_id").orderBy("bundle_id", "ord").collect()
    assert [(e.bundle_id, e.path, bytes(e.bytes), e.mtime, e.mode) for e in entries] == [
        ("b1", "a/x.txt", b"first", "1980-01-01 00:00:00", 0o644), ("b1", "z.txt", b"last", "1980-01-01 00:00:00", 0o644), ("b2", "only", b"", "1980-01-01 00:00:00", 0o644),
    ]


def test_pdf_round_trip(spark):
    made = writers.minimal_pdf(["Pay (net) 30", "back\\slash"])
    got = readers.pdf_text(spark.createDataFrame([("a", bytearray(made)), ("b", bytearray(b"no pdf"))], "path string, content binary")).orderBy("path").collect()
    assert got[0].text == "Pay (net) 30 back\\slash" and got[1].text is None


def test_tar_kinds(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, kind, data in (("d", tarfile.DIRTYPE, b""), ("d/f", tarfile.REGTYPE, b"abc"), ("link", tarfile.SYMTYPE, b"")):
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, len(data)
            t.addfile(info, io.BytesIO(data))
    got = readers.tar_entries(spark.createDataFrame([("t", bytearray(out.getvalue()))], "path string, content binary")).orderBy("ord").collect()
    assert [(e.path, e.kind) for e in got] == [("d", "directory"), ("d/f", "file"), ("link", "other")] and bytes(got[1].bytes) == b"abc"


def test_logs_of_both_forms(spark):
    one = '{"timestamp":"t","source_system":"s","actor":"a","action":"x","affected_resource":"r","evidence_text":"e"}'
    texts = spark.createDataFrame([("array", f"[{one},{one}]"), ("lines", f"{one}\n\n{one}\r\n"), ("bad", '{"timestamp":"t"}')], "incident_id string, text string")
    got = readers.parse_logs(texts).groupBy("incident_id").agg(F.count("*").alias("n"), F.count("reject_reason").alias("bad"), F.max("idx").alias("last")).collect()
    assert {r.incident_id: (r.n, r.bad, r.last) for r in got} == {"array": (2, 0, 1), "lines": (2, 0, 1), "bad": (1, 1, 0)}


def test_statements(spark):
    good = '{"statement_id":"s","period_start":"a","period_end":"b","transactions":[{"date":"d","amount":1.5,"account":"x","category":"c"}]}'
    rows = readers.parse_statements(spark.createDataFrame([(good,), ("{}",), ("not json",), (None,)], "text string")).collect()
    assert [(r.amount, r.description) for r in rows if r.reject_reason is None] == [(1.5, "")]
    assert sum(r.reject_reason is not None for r in rows) == 3


def test_encryption_round_trip(spark):
    key, other = "0123456789abcdef0123456789abcdef", "fedcba9876543210fedcba9876543210"
    plain = spark.createDataFrame([(bytearray(b"secret"),)], "data binary")
    moved = writers.rotate_key(writers.encrypt(plain, "data", key), "data", key, other)
    assert bytes(writers.decrypt(moved, "data", other).first().data) == b"secret"


def test_policies_with_nulls(spark):
    got = policies.validate_policies(spark.createDataFrame([(None,) * 15], policies.POLICY)).first()
    assert not got.valid and got.failed_rules == list(policies.policy_rules())
    assert policies.validate_policies(spark.createDataFrame([], policies.POLICY)).count() == 0


def test_directories(spark, tmp_path):
    root = tmp_path / "a"
    (root / "a" / "b").mkdir(parents=True)
    (root / "x.txt").write_bytes(b"x")
    (root / "a" / "b" / "y").write_bytes(b"z")
    for path in (str(root), f"file://{root}/"):
        got = {(r.path, None if r.bytes is None else bytes(r.bytes)) for r in readers.read_directory(spark, path).collect()}
        assert got == {("x.txt", b"x"), ("a/", None), ("a/b/", None), ("a/b/y", b"z")}


def test_publishing_fails_closed(spark, tmp_path):
    import pytest

    good, bad = ("a", bytearray(b"x"), "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", bytearray(b"x"), "0" * 64)
    schema = "bundle_id string, content binary, sha256 string"
    verdicts = spark.createDataFrame([("a", "PASS"), ("b", "FAIL")], "bundle_id string, overall string")
    with pytest.raises(ValueError):
        writers.write_archives(spark.createDataFrame([good, bad], schema), f"{tmp_path}/x")
    assert not (tmp_path / "x").exists()
    writers.publish_passed(spark.createDataFrame([good, bad], schema), verdicts, f"{tmp_path}/y")
    assert [r.bundle_id for r in spark.read.parquet(f"{tmp_path}/y").collect()] == ["a"]
    with pytest.raises(Exception, match="already exists"):
        writers.publish_passed(spark.createDataFrame([good], schema), verdicts, f"{tmp_path}/y")


def test_hash_lists_and_appended_events(spark, tmp_path):
    (tmp_path / "h.csv").write_text("artifact_id,bundle_rel_path,sha256,bytes,content_type,logical_role\na,\"p,1\",00,12,t,r\nb,q,00,many,t,r\n")
    assert [(r.artifact_id, r.bundle_rel_path, r.bytes) for r in readers.read_artifact_hashes(spark, f"{tmp_path}/h.csv").collect()] == [("a", "p,1", 12), ("b", "q", 0)]
    for k in (1, 2):
        spark.createDataFrame([(k,)], "n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        writers.append_stream(spark.readStream.schema("n int").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
