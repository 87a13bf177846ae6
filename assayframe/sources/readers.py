"""Sources: statements, logs, transcripts, consents, audit logs, archives, PDF text.

Parsers work on a column of file texts, so that one job reads many small files; each returns valid rows, and
``rejects`` names what is wrong with the others.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import plus_years, safe_relative_path
from ..functions.ids import sha
from .folders import read_folders

STATEMENT = "statement_id string, period_start string, period_end string, transactions array<struct<date:string,amount:double,account:string,category:string,description:string>>"
LOG = "struct<timestamp:string,source_system:string,actor:string,action:string,affected_resource:string,evidence_text:string>"
TRANSCRIPT = "patient_id string, date string, provider string, specialty string, content string, confidence float"
CONSENT = "patient_id string, date_given string, scope string, status string"
AUDIT = "ts_utc string, event_type string, run_id string, vault_id string, actor string, details string, prev_event_hash string, event_hash string"
HASHES = "artifact_id string, bundle_rel_path string, sha256 string, bytes string, content_type string, logical_role string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as rows."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_statements(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Transactions of statement files in order of date, then place: statement_id, ordinal, date, amount, account, category, description, reject_reason.

    A file that doesn't parse or lacks a required field is one row with a reason and nothing else; a description may be absent.
    """
    s = F.from_json(text_col, STATEMENT)
    bad_tx = F.exists("s.transactions", lambda t: t["date"].isNull() | t["amount"].isNull() | t["account"].isNull() | t["category"].isNull())
    reason = F.when(F.col("s.statement_id").isNull() | F.col("s.period_start").isNull() | F.col("s.period_end").isNull(), "missing field").when(F.coalesce(F.size("s.transactions"), F.lit(0)) <= 0, "no transactions").when(bad_tx, "bad transaction")
    rows = files.select(s.alias("s")).withColumn("reject_reason", reason)
    good = rows.where("reject_reason is null").select("s.statement_id", F.posexplode("s.transactions").alias("ordinal", "t")).select("statement_id", "ordinal", "t.date", "t.amount", "t.account", "t.category", F.coalesce("t.description", F.lit("")).alias("description"), F.lit(None).cast("string").alias("reject_reason"))
    return good.unionByName(rows.where("reject_reason is not null").select("s.statement_id", "reject_reason"), allowMissingColumns=True)


def parse_logs(files: DataFrame, text_col: str = "text", id_col: str = "incident_id") -> DataFrame:
    """Log rows of JSON-array or NDJSON texts (told apart by the first character): incident_id, idx, line_no (from 1), the fields, reject_reason.

    Blank lines are skipped. A text without any row, null and empty ones included, is one row with the reason ``no events``.
    """
    text, names = F.col(text_col), ("timestamp", "source_system", "actor", "action", "affected_resource", "evidence_text")
    array = F.regexp_replace(text, r"^\s+", "").startswith("[")
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"[\r\n\t]", "")) == "", F.lit(True))
    many = F.from_json(text, f"array<{LOG}>")
    rows = F.when(blank, F.array().cast(f"array<struct<line:int,e:{LOG}>>")).when(array, F.transform(many, lambda e, i: F.struct((i + 1).alias("line"), e.alias("e"))))
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x"))), lambda r: F.trim(r["x"]) != "")
    rows = rows.otherwise(F.transform(lines, lambda r: F.struct(r["line"].alias("line"), F.from_json(r["x"], LOG).alias("e"))))
    out = files.select(F.col(id_col).alias("incident_id"), blank.alias("blank"), array.alias("array"), F.posexplode_outer(rows).alias("idx", "r"))
    out = out.select("incident_id", F.coalesce("idx", F.lit(0)).alias("idx"), F.col("r.line").alias("line_no"), *[F.col(f"r.e.{c}").alias(c) for c in names], "blank", "array")
    empty = F.col("blank") | (F.col("array") & F.col("line_no").isNull())
    whole = F.forall(F.array(*names), lambda c: c.isNotNull())
    return out.withColumn("reject_reason", F.when(empty, "no events").when(~whole, "missing field or malformed")).drop("blank", "array")


def parse_transcripts(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Transcripts with reject_reason; empty content is rejected, and so is a confidence that is no number."""
    rows = files.select(F.from_json(text_col, TRANSCRIPT).alias("t")).select("t.*")
    missing = F.col("patient_id").isNull() | F.col("date").isNull() | F.col("provider").isNull() | F.col("specialty").isNull() | F.col("content").isNull() | F.col("confidence").isNull()
    return rows.withColumn("reject_reason", F.when(missing, "missing field").when(F.col("content") == "", "empty content")).withColumn("transcript_id", F.concat(F.lit("CLINICAL_"), sha(F.concat("patient_id", "date", "content"), 16)))


def parse_consents(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Consents with their expiry date and reject_reason; an absent status is VALID."""
    rows = files.select(F.from_json(text_col, CONSENT).alias("t")).select("t.*").withColumn("status", F.coalesce("status", F.lit("VALID")))
    return rows.withColumns({"consent_id": F.concat(F.lit("CONSENT_"), sha(F.concat(F.lit("CONSENT_"), "patient_id", "date_given"), 16)), "date_expires": plus_years(F.col("date_given")), "reject_reason": F.when(F.col("patient_id").isNull() | F.col("date_given").isNull() | F.col("scope").isNull(), "missing field")})


def parse_audit_log(files: DataFrame, text_col: str = "text", id_col: str = "bundle_id") -> DataFrame:
    """Events of NDJSON audit logs with line_no (from 1), details as JSON text; unparsable lines have nulls. Blank lines are skipped."""
    lines = files.select(F.col(id_col), F.posexplode(F.split(text_col, "\r?\n")).alias("k", "line")).where(F.trim("line") != "")
    return lines.select(id_col, (F.col("k") + 1).alias("line_no"), F.from_json("line", AUDIT).alias("e")).select(id_col, "line_no", "e.*")


def last_hash(events: DataFrame, key: str = "run_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by("event_hash", "line_no").alias("last_hash"))


def hash_columns() -> list[str]:
    """The columns of a list of hashes, in order."""
    return [c.split()[0] for c in HASHES.split(", ")]


def read_artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    """artifact_hashes.csv files; a size that doesn't parse is 0."""
    return spark.read.csv(path, header=True, schema=HASHES, escape='"').withColumn("bytes", F.coalesce(F.col("bytes").try_cast("long"), F.lit(0).cast("long")))


def parse_reports(lines: DataFrame, prefix: str, schema: str = "map<string,string>", text_col: str = "value") -> DataFrame:
    """JSON reports in lines that begin with ``prefix``."""
    return lines.where(F.col(text_col).startswith(prefix)).select(F.from_json(F.expr(f"substring({text_col}, {len(prefix) + 1})"), schema).alias("report"))


def decode_payloads(payloads: DataFrame, max_text: int = 5 << 20, max_binary: int = 20 << 20) -> DataFrame:
    """Payloads (artifact_id, encoding base64|utf8, data, declared_sha256, content_type) with bytes, sha256 and the first failed check.

    Each artifact must have one payload.
    """
    n = payloads.groupBy("artifact_id").agg(F.count("*").alias("n"))
    out = payloads.join(n, "artifact_id").withColumn("bytes", F.when(F.col("encoding") == "base64", F.try_to_binary("data", F.lit("base64"))).otherwise(F.col("data").cast("binary")))
    out = out.withColumn("sha256", F.sha2("bytes", 256))
    size, pdf = F.octet_length("bytes"), F.col("content_type") == "application/pdf"
    declared = F.col("declared_sha256").rlike("^[0-9a-fA-F]{64}$")
    reason = (
        F.when(F.col("n") > 1, "duplicate payload").when(F.col("bytes").isNull(), "bad encoding").when(size > F.when(F.col("encoding") == "base64", max_binary).otherwise(max_text), "too large")
        .when(pdf & (F.hex(F.substring("bytes", 1, 5)) != "255044462D"), "not a PDF").when(declared & (F.lower("declared_sha256") != F.col("sha256")), "sha256 mismatch")
    )
    return out.withColumn("reject_reason", reason).drop("n")


def ingest_payloads(artifacts: DataFrame, payloads: DataFrame, max_text: int = 5 << 20, max_binary: int = 20 << 20) -> DataFrame:
    """Artifacts (artifact_id, expected: TEXT or PDF, declared_sha256) with the one payload (artifact_id, content_text, content_base64) of each.

    Gives bytes, text, sha256, sha_enforced (a digest was declared), transformations, and the first fault: missing or duplicate, empty,
    of the wrong kind, bad base64, not UTF-8, not a PDF, too large, a malformed or other digest.
    """
    sets = payloads.groupBy("artifact_id").agg(F.count("*").alias("n"), F.first("content_text").alias("t"), F.first("content_base64").alias("b"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    text = F.col("expected") == "TEXT"
    plain = text & filled("t")
    decoded = F.try_to_binary(F.when(filled("b"), F.trim("b")), F.lit("base64"))
    out = artifacts.join(sets, "artifact_id", "left").withColumn("bytes", F.when(plain, F.col("t").cast("binary")).otherwise(decoded))
    out = out.withColumns({"sha256": F.sha2("bytes", 256), "text": F.when(text, F.try_validate_utf8(F.col("bytes").cast("string")))})
    declared = F.lower(F.trim("declared_sha256"))
    told = filled("declared_sha256")
    fault = (
        F.when(F.col("n").isNull(), "missing payload").when(F.col("n") > 1, "duplicate payload").when(~text & ~filled("b") & filled("t"), "unsupported content type").when(~plain & ~filled("b"), "empty payload").when(F.col("bytes").isNull(), "invalid base64")
        .when(text & F.col("text").isNull(), "invalid UTF-8").when(~text & (F.hex(F.substring("bytes", 1, 5)) != "255044462D"), "not a PDF").when(F.octet_length("bytes") > F.when(text, max_text).otherwise(max_binary), "too large")
        .when(told & ~declared.rlike("^[0-9a-f]{64}$"), "malformed sha256").when(told & (declared != F.col("sha256")), "sha256 mismatch")
    )
    done = F.when(plain, F.array().cast("array<string>")).when(text, F.array(F.lit("BASE64_DECODE"), F.lit("UTF8_DECODE"))).otherwise(F.array(F.lit("BASE64_DECODE")))
    return out.withColumns({"sha_enforced": told, "transformations": done, "reject_reason": fault}).drop("n", "t", "b")


def pdf_text(files: DataFrame, content_col: str = "content", id_col: str = "path") -> DataFrame:
    """(id, text, pages): strings shown by Tj operators between BT and ET; blocks are joined by spaces, an ET ends a line.

    Content streams must be plain. Rows that don't begin with %PDF- have null text.
    """
    raw = F.decode(content_col, "ISO-8859-1")
    blocks = F.regexp_extract_all(raw, F.lit(r"(?s)\bBT\b(.*?)\bET\b"), F.lit(1))
    shown = F.transform(blocks, lambda b: F.array_join(F.transform(F.regexp_extract_all(b, F.lit(r"\(((?:[^()\\\n]|\\.)*)\)[^\n]*Tj"), F.lit(1)), lambda s: F.regexp_replace(s, r"\\([()\\])", "$1")), " "))
    pages = F.greatest(F.size(F.split(raw, "/Type /Page", -1)) - 1, F.lit(1))
    return files.select(F.col(id_col), F.when(raw.startswith("%PDF-"), F.array_join(shown, "\n")).alias("text"), pages.alias("pages"))


def zip_entries(bundles: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(bundle_id, ord, path, bytes, method, mtime, mode) of each entry of ZIP files."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, content in zip(batch[id_col], batch[content_col]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for k, i in enumerate(z.infolist()):
                        method = "DEFLATE" if i.compress_type == zipfile.ZIP_DEFLATED else "STORE"
                        yield pd.DataFrame({"bundle_id": [str(bundle)], "ord": [k], "path": [i.filename], "bytes": [z.read(i)], "method": [method], "mtime": ["%04d-%02d-%02d %02d:%02d:%02d" % i.date_time], "mode": [i.external_attr >> 16 & 0o777]})

    return bundles.select(id_col, content_col).mapInPandas(each, "bundle_id string, ord int, path string, bytes binary, method string, mtime string, mode int")


def tar_entries(archives: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(archive_id, ord, path, kind, bytes) of each entry of tar files; ``kind`` other than file or directory isn't admissible."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch[id_col], batch[content_col]):
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    for k, m in enumerate(t.getmembers()):
                        yield pd.DataFrame({"archive_id": [str(archive)], "ord": [k], "path": [m.name], "kind": ["file" if m.isreg() else "directory" if m.isdir() else "other"], "bytes": [t.extractfile(m).read() if m.isreg() else None]})

    return archives.select(id_col, content_col).mapInPandas(each, "archive_id string, ord int, path string, kind string, bytes binary")


def tar_headers(archives: DataFrame, id_col: str = "path", content_col: str = "content", most: int = 8 << 20) -> DataFrame:
    """(archive_id, ord, header, data, total): the 512-byte headers of tar archives as they stand, with regular files' bytes (null if cut short) and the sum of the header's bytes, its checksum taken as blanks.

    The first header of zeros is the last row. Only the walk from header to header is done here; ``inspect_tars`` judges them. Rows go out in frames of about ``most`` bytes.
    """
    columns = ["archive_id", "ord", "header", "data", "total"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for archive, content in zip(batch[id_col], batch[content_col]):
                at = k = 0
                while at + 512 <= len(content or b""):
                    header, at = content[at : at + 512], at + 512
                    digits = header[124:136].strip(b" \0")
                    size = int(digits, 8) if re.fullmatch(rb"[0-7]+", digits) and header[156:157] in (b"\0", b"0") else 0
                    data = content[at : at + size] if at + size <= len(content) else None
                    rows.append((str(archive), k, header, data, sum(header) - sum(header[148:156]) + 8 * 32))
                    held += 512 + len(data or b"")
                    if held >= most:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                    if not any(header):
                        break
                    at, k = at + -(-size // 512) * 512, k + 1
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return archives.select(id_col, content_col).mapInPandas(each, "archive_id string, ord int, header binary, data binary, total long")


def inspect_tars(archives: DataFrame, folders: tuple[str, ...], files: tuple[str, ...], limits: dict[str, int], most: int = 64 << 20, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(archive_id, files, fault): workspaces that must hold exactly these folders and regular files.

    ``files`` maps paths to bytes, and is null where there is a fault: a header's checksum, format, path or type, a size over its
    limit in ``limits`` or over ``most`` together, a cut entry, or another set of entries. An empty archive has no end.
    """
    text = lambda start, n: F.regexp_replace(F.decode(F.substring("header", start, n), "ISO-8859-1"), "\0.*", "")
    octal = lambda start, n: F.conv(F.when(F.trim(text(start, n)).rlike("^[0-7]+$"), F.trim(text(start, n))), 8, 10).try_cast("long")
    name = F.when(text(346, 155) == "", text(1, 100)).otherwise(F.concat(text(346, 155), F.lit("/"), text(1, 100)))
    path = F.regexp_replace(F.regexp_replace(name, r"^\./", ""), "/+$", "")
    rows = tar_headers(archives, id_col, content_col).withColumns({"path": path, "kind": F.substring(F.hex("header"), 313, 2), "size": octal(125, 12), "end": ~F.hex("header").rlike("[^0]")})
    regular, at = F.col("kind").isin("00", "30"), lambda what: F.concat(F.lit(f"{what}: "), "path")
    limit = F.coalesce(*[F.when(F.col("path") == p, n) for p, n in limits.items()], F.lit(most))
    types = F.when(F.col("kind") == "31", "hard link").when(F.col("kind") == "32", "symbolic link").when(F.col("kind").isin("33", "34", "36", "37"), "special entry").otherwise("unknown type")
    root = F.col("path") == ""
    fault = (
        F.when(F.col("end"), None).when(~F.coalesce(octal(149, 8) == F.col("total"), F.lit(False)), "checksum wrong").when(~F.hex(F.substring("header", 258, 6)).isin("757374617200", "757374617220"), "not ustar").when(F.col("size").isNull(), "size wrong")
        .when(root & (F.col("kind") == "35"), None).when(root, "root is no folder").when(~safe_relative_path(F.col("path")), at("unsafe path")).when((F.col("kind") == "35") & ((F.col("size") != 0) | ~F.col("path").isin(*folders)), at("unexpected folder"))
        .when(F.col("kind") == "35", None).when(~regular, F.concat(types, F.lit(": "), "path")).when(~F.col("path").isin(*files), at("unexpected file")).when(F.col("size") > limit, at("too large")).when(F.col("data").isNull(), at("cut short"))
    )
    rows = rows.withColumn("fault", fault)
    held = F.col("fault").isNull() & regular & ~root & ~F.col("end")
    sets = rows.groupBy("archive_id").agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ord"))).alias("fault"), F.bool_or("end").alias("ended"), F.sum(F.when(held, F.col("size"))).alias("bytes"), F.collect_set(F.when(F.col("kind") == "35", F.nullif("path", F.lit("")))).alias("folders"),
        F.array_sort(F.collect_list(F.when(held, F.struct("path", "ord", "data")))).alias("files"),
    )
    listed = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)])
    shape = ~F.col("ended") | (F.array_sort("folders") != listed(folders)) | (F.array_distinct(F.transform("files", lambda f: f["path"])) != listed(files))
    last = F.map_from_entries(F.filter(F.transform("files", lambda f: F.struct(f["path"], f["data"])), lambda f: f.isNotNull()))
    out = archives.select(F.col(id_col).cast("string").alias("archive_id")).join(sets, "archive_id", "left")
    fault = F.when(F.col("ended").isNull(), "empty").otherwise(F.coalesce("fault", F.when(F.col("bytes") > most, "too large together"), F.when(shape, "other entries")))
    return out.withColumn("fault", fault).select("archive_id", F.when(F.col("fault").isNull(), last).alias("files"), "fault")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path relative to the folder, bytes) of all files under a folder, empty ones too, and of its folders (ending in a slash, without bytes): see ``folders.read_folders``."""
    return read_folders(spark, path)
