"""A bundle is published whole or not at all, and folders are listed whole."""

import os

import pytest
from pyspark.sql import functions as F

from assayframe.sinks import bundles
from assayframe.sources import folders


def rows(spark, *extra):
    made = [(f"b{i}", p, f"{i}{p}".encode()) for i in range(6) for p in ("a.txt", "d/e/f.json")] + list(extra)
    return spark.createDataFrame(made, "bundle_id string, path string, content binary").withColumn("sha256", F.sha2("content", 256))


def test_published_whole(spark, tmp_path):
    bundles.write_bundles(rows(spark), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == ["out"] and sorted(os.listdir(tmp_path / "out")) == [f"b{i}" for i in range(6)]
    assert (tmp_path / "out/b3/d/e/f.json").read_bytes() == b"3d/e/f.json"
    with pytest.raises(Exception, match="exists already"):
        bundles.write_bundles(rows(spark), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == ["out"]
    bundles.write_bundles(rows(spark).limit(0), f"file://{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []


def test_nothing_is_left_of_a_failure(spark, tmp_path):
    faults = {"no content": rows(spark, ("b2", "x", None)), "two files": rows(spark, ("b2", "a.txt", b"")), "another digest": rows(spark).withColumn("sha256", F.when(F.col("bundle_id") == "b5", "0").otherwise(F.col("sha256")))}
    for why, bad in faults.items():
        with pytest.raises(Exception, match=why):
            bundles.write_bundles(bad, f"{tmp_path}/out")
        assert os.listdir(tmp_path) == [], why


def test_an_attempt_that_died_leaves_its_whole_bundles(tmp_path):
    import pyarrow as pa

    made = pa.RecordBatch.from_pylist([{"bundle_id": b, "path": p, "content": p.encode(), "sha256": __import__("hashlib").sha256(p.encode()).hexdigest()} for b in ("b1", "b2") for p in ("x", "y/z")])
    writer = bundles._Writer(f"{tmp_path}/out")

    def dies():
        yield made
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert writer.write(iter([made])).bundles == 2 and not (tmp_path / "out").exists()
    writer.commit([])
    assert sorted(os.listdir(tmp_path / "out")) == ["b1", "b2"] and (tmp_path / "out/b2/y/z").read_bytes() == b"y/z"


def test_layout_needs_json_and_safe_paths(spark, tmp_path):
    own = {c: "{}" for c in bundles.JSON_FILES} | {c: "" for c in bundles.TEXT_FILES} | {"bundle_id": "b", "pack_id": "p"}
    of = lambda **k: spark.createDataFrame([tuple((own | k).values())], ", ".join(f"{c} string" for c in own))
    files = {r.path: bytes(r.content) for r in bundles.bundle_files(of(redactions_map=None)).collect()}
    assert len(files) == 11 and files["audit_log.ndjson"] == b"" and b'"audit_log_sha256":"e3b0c442' in files["run_manifest.json"]
    up = spark.createDataFrame([("b", "../x", b"1")], "bundle_id string, path string, content binary")
    for bad, more in ((of(bundle_info="{"), None), (of(eval_report=None), None), (of(), up)):
        with pytest.raises(Exception, match="no content"):
            bundles.write_bundles(bundles.bundle_files(bad, more), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_folders_with_empty_ones(spark, tmp_path):
    for p, data in (("a/b/c.txt", b"c"), ("a/empty", b""), ("top", b"t")):
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_bytes(data)
    os.makedirs(tmp_path / "a/none/below")
    want = {("a/", None), ("a/b/", None), ("a/b/c.txt", b"c"), ("a/empty", b""), ("a/none/", None), ("a/none/below/", None), ("top", b"t")}
    for tasks in (1, 2, 50):
        assert {(r.path, None if r.bytes is None else bytes(r.bytes)) for r in folders.read_folders(spark, str(tmp_path), tasks).collect()} == want
    assert folders.read_folders(spark, f"file://{tmp_path}", contents=False).where("bytes is not null").count() == 0
    with pytest.raises(Exception, match="missing"):
        folders.read_folders(spark, f"{tmp_path}/missing").collect()


def test_archives_are_seen_whole_or_not_at_all(spark, tmp_path):
    from assayframe.sinks import writers

    good = spark.createDataFrame([("a", b"x"), ("b", b"y")], "bundle_id string, content binary").withColumn("sha256", F.upper(F.sha2("content", 256)))
    with pytest.raises(ValueError, match="1 archives"):
        writers.write_archives(good.withColumn("sha256", F.when(F.col("bundle_id") == "a", "0").otherwise(F.col("sha256"))), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="torn"):
        writers.write_archives(good.withColumn("content", F.when(F.col("bundle_id") == "b", F.raise_error(F.lit("torn"))).otherwise(F.col("content"))), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []
    writers.write_archives(good, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == ["out"] and spark.read.parquet(f"{tmp_path}/out").count() == 2
    with pytest.raises(FileExistsError):
        writers.write_archives(good, f"{tmp_path}/out")
