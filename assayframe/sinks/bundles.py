"""Evidence bundles as folders of files, written so that a bundle is seen whole or not at all.

The files of a bundle come from ``bundle_files``: its fixed layout, JSON in canonical form, line ends unified, and the audit log's digest bound into the run manifest.
``write_bundles`` writes them through a data source of its own: tasks write files into a staging folder and read every file back against its digest; the driver
publishes all of them by renaming that folder once, or removes it if any task failed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.checks import safe_relative_path
from ..functions.jsons import canonical
from ..functions.text import unix_newlines

FILES = "bundle_id string, path string, content binary, sha256 string"
#: A bundle's own files, by the column that holds each one's text; {pack} is the pack's id.
JSON_FILES = {
    "bundle_info": "BUNDLE_INFO.json", "run_manifest": "run_manifest.json", "eval_report": "eval_report.json", "templates_used": "exports/{pack}/attachments/templates_used.json", "citations_map": "exports/{pack}/attachments/citations_map.json",
    "redactions_map": "exports/{pack}/attachments/redactions_map.json", "artifact_list": "inputs_snapshot/artifact_list.json", "policy_snapshot": "inputs_snapshot/policy_snapshot.json", "network_snapshot": "inputs_snapshot/network_snapshot.json",
    "model_snapshot": "inputs_snapshot/model_snapshot.json",
}
TEXT_FILES = {"audit_log": "audit_log.ndjson", "artifact_hashes": "artifact_hashes.csv"}
#: Files that a bundle may lack.
OPTIONAL = ("citations_map", "redactions_map")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
    return pafs.FileSystem.from_uri(uri)


def bound_manifest(manifest: Column, audit: Column) -> Column:
    """A run manifest whose evidence authority names the digest of the audit log as it will stand in the bundle."""
    whole = F.from_json(manifest, "map<string,variant>")
    authority = F.from_json(F.get_json_object(manifest, "$.evidence_authority"), "map<string,variant>")
    source = F.from_json(F.get_json_object(manifest, "$.evidence_authority.source"), "map<string,variant>")
    put = lambda m, k, text: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(F.lit(k), F.try_parse_json(text)))
    digest = F.concat(F.lit('"'), F.sha2(audit.cast("binary"), 256), F.lit('"'))
    inner = F.to_json(put(F.coalesce(source, F.create_map().cast("map<string,variant>")), "audit_log_sha256", digest))
    return F.to_json(put(whole, "evidence_authority", F.to_json(put(F.coalesce(authority, F.create_map().cast("map<string,variant>")), "source", inner))))


def bundle_files(bundles: DataFrame, deliverables: DataFrame | None = None) -> DataFrame:
    """(bundle_id, path, content, sha256): the files of each bundle.

    ``bundles`` has bundle_id, pack_id and a text column for each of JSON_FILES and TEXT_FILES; null leaves a file of OPTIONAL out. ``deliverables`` (bundle_id, path, content) lie where their path says. A text that
    should be JSON and isn't, or a missing one, leaves its content null, and so does a path that leads out of the bundle; ``write_bundles`` refuses both.
    """
    audit = unix_newlines(F.col("audit_log"))
    text = {c: canonical(bound_manifest(F.col(c), audit) if c == "run_manifest" else F.col(c)) for c in JSON_FILES} | {c: unix_newlines(F.col(c)) for c in TEXT_FILES}
    path = lambda p: F.replace(F.lit(p), F.lit("{pack}"), F.col("pack_id"))
    rows = F.array(*[F.struct(path(p).alias("path"), text[c].cast("binary").alias("content"), (F.lit(c in OPTIONAL) & F.col(c).isNull()).alias("out")) for c, p in (JSON_FILES | TEXT_FILES).items()])
    out = bundles.select("bundle_id", F.explode(rows).alias("f")).where("not f.out").select("bundle_id", "f.path", "f.content")
    if deliverables is not None:
        safe = F.coalesce(safe_relative_path(F.col("path")), F.lit(False))
        out = out.unionByName(deliverables.select("bundle_id", "path", F.when(safe, F.col("content").cast("binary")).alias("content")))
    return out.withColumn("sha256", F.sha2("content", 256))


@dataclass
class _Done(WriterCommitMessage):
    bundles: int  # of which the task wrote files


class _Writer(DataSourceArrowWriter):
    """Writes the files of a task, each in a folder of the task's own attempt, from where it takes its final name once it is whole."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), None
        head, _, name = self.path.rpartition("/")
        self.staging = f"{head}/.{name}.staging-{uuid.uuid4().hex}"
        fs, at = store(self.path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise ValueError(f"{path} exists already")

    def write(self, batches: Iterator) -> _Done:
        fs, staging = store(self.staging)
        own = f"{staging}/.{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        n, bundle, last, folder = 0, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['bundle_id']}/{row['path']}"
                if name == last:
                    raise ValueError(f"two files {name}")
                n += row["bundle_id"] != bundle
                bundle, last = row["bundle_id"], name
                self._file(fs, f"{own}/file", name, row)
                final = f"{staging}/{name}"
                if folder != (folder := final.rpartition("/")[0]):
                    fs.create_dir(folder, recursive=True)
                if fs.get_file_info(final).type == pafs.FileType.File:  # an earlier attempt of this task got so far
                    fs.delete_file(final)
                fs.move(f"{own}/file", final)
        fs.delete_dir(own)
        return _Done(n)

    @staticmethod
    def _file(fs: pafs.FileSystem, at: str, name: str, row: dict) -> None:
        if row["content"] is None:
            raise ValueError(f"no content for {name}")
        with fs.open_output_stream(at) as out:
            out.write(row["content"])
        with fs.open_input_stream(at) as back:
            if hashlib.sha256(back.read()).hexdigest() != row["sha256"]:
                raise ValueError(f"{name} has another digest than it should")

    def commit(self, messages: list) -> None:
        fs, staging = store(self.staging)
        _, at = store(self.path)
        fs.create_dir(staging, recursive=True)
        left = [x for x in fs.get_file_info(pafs.FileSelector(staging)) if x.base_name.startswith(".")]
        for x in left:  # of attempts that were killed
            fs.delete_dir(x.path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)
            raise ValueError(f"{self.path} exists already")
        fs.move(staging, at)

    def abort(self, messages: list) -> None:
        fs, staging = store(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class BundleFolders(DataSource):
    """The sink ``bundle_folders``: rows of FILES, each bundle's together, become folders under ``path``, which must not exist."""

    @classmethod
    def name(cls) -> str:
        return "bundle_folders"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_bundles(files: DataFrame, path: str) -> None:
    """Publish bundles (``FILES``) under a path that all executors share and that doesn't exist yet.

    A file without content, two files of one name, a digest that what was written doesn't have, or a failing task: nothing is published and nothing is left.
    Files are dealt over tasks by bundle and path, so that one large bundle is no task of its own, and written one at a time.
    """
    spark = files.sparkSession
    spark.dataSource.register(BundleFolders)
    path_ = F.regexp_replace("path", r"/(\.?/)+", "/")  # of one file's names, the same task gets all
    one = files.select("bundle_id", path_.alias("path"), "content", F.lower("sha256").alias("sha256")).repartition("bundle_id", "path").sortWithinPartitions("bundle_id", "path")
    one.write.format("bundle_folders").mode("append").save(path)
