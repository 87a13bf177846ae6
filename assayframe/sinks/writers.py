"""Sinks: ordered text reports, PDF, deterministic ZIP, encrypted blobs."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logs import folder


def documents_from_lines(lines: DataFrame, key: str, order: list[str], header: str = "", line_col: str = "line") -> DataFrame:
    """(key, content): the lines of each key in order, after a header, each ended by a newline. A key is one report file."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, line_col))), lambda x: F.concat(x[line_col], F.lit("\n")))
    return lines.groupBy(key).agg(F.concat(F.lit(header), F.array_join(ordered, "")).alias("content"))


def write_lines(lines: DataFrame, path: str, order: list[str], line_col: str = "line") -> None:
    """One sorted corpus-wide report as text files in order (range-partitioned, not gathered)."""
    lines.orderBy(*order).select(line_col).write.text(path)


def json_rows(df: DataFrame, key: str, name: str = "json") -> DataFrame:
    """(key, json): each row as a compact JSON object."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias(name))


def minimal_pdf(lines: list[str]) -> bytes:
    """A PDF of one page that shows the lines."""
    shown = "0 -14 Td\n".join(f"({x.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj\n" for x in lines)
    stream = f"BT\n/F1 11 Tf\n50 760 Td\n{shown}ET\n".encode()
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%sendstream" % (len(stream), stream), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, table, len(places) + 1, len(out))


def pdf_column(content: str = "content"):
    """The lines of a text column as a PDF (binary)."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else minimal_pdf(t.split("\n"))), "binary")(content)


def deterministic_zip(files: list[tuple[str, bytes]]) -> bytes:
    """Entries in order of their paths, DEFLATE 9, 1980-01-01, mode 0644 (0755 for folders)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for path, data in sorted(files):
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type, info.create_system = (0o755 if path.endswith("/") else 0o644) << 16, zipfile.ZIP_DEFLATED, 3
            z.writestr(info, data)
    return out.getvalue()


def zip_bundles(files: DataFrame, key: str = "bundle_id") -> DataFrame:
    """(bundle_id, content, sha256) of files (bundle_id, path, bytes): one archive a bundle; a bundle is one export and fits a task."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "content": [deterministic_zip(list(zip(pdf["path"], pdf["bytes"])))]})

    return files.select(key, "path", "bytes").groupBy(key).applyInPandas(each, f"{key} string, content binary").withColumn("sha256", F.sha2("content", 256))


def write_archives(bundles: DataFrame, path: str, key: str = "bundle_id") -> None:
    """Publish archives (bundle_id, content, sha256) as Parquet: written aside, their digests checked in what was written, and then seen at ``path`` by one rename.

    An existing target is an error, so nothing is overwritten, and so is a digest that doesn't fit; after any error nothing is left.
    """
    spark = bundles.sparkSession
    fs, target = folder(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} already exists")
    head, _, name = path.rstrip("/").rpartition("/")
    aside = f"{head}/.{name}.aside-{uuid.uuid4().hex}"
    try:
        rows = bundles.select(key, "content", "sha256")
        rows.write.parquet(aside)
        other = spark.read.schema(rows.schema).parquet(aside).where(~F.coalesce(F.sha2("content", 256) == F.lower("sha256"), F.lit(False))).count()
        if other:
            raise ValueError(f"{other} archives don't have their digest")
        if fs.exists(target) or not fs.rename(folder(spark, aside)[1], target):
            raise FileExistsError(f"{path} already exists")
    finally:
        fs.delete(folder(spark, aside)[1], True)


def publish_passed(bundles: DataFrame, verdicts: DataFrame, path: str, key: str = "bundle_id") -> None:
    """Publish only those archives whose overall verdict is PASS."""
    write_archives(bundles.join(verdicts.where("overall = 'PASS'").select(key), key, "left_semi"), path, key)


def encrypt(df: DataFrame, column: str, key: str) -> DataFrame:
    """A column replaced by its AES-256-GCM ciphertext (nonce first); ``key`` has 32 bytes. The key is a joined value, so plans don't show it."""
    return _keyed(df, key).withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.col("__key"), F.lit("GCM"))).select(*df.columns)


def decrypt(df: DataFrame, column: str, key: str) -> DataFrame:
    return _keyed(df, key).withColumn(column, F.aes_decrypt(column, F.col("__key"), F.lit("GCM"))).select(*df.columns)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    one = df.sparkSession.createDataFrame([(1, key)], "__one int, __key string")
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one")  # one row


def rotate_key(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return encrypt(decrypt(df, column, old), column, new)


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to Parquet, exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
