"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where it is set.

    Only a session in local mode without that setting (tests, one machine) gets a temporary folder of its own; a cluster without it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="assayframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; removed when the process ends."""
    path = f"{shared_dir(spark)}/assayframe-{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id isn't in the one column of ``ids``; that column gets a name of its own, so none of ``df``'s clashes with it."""
    name = f"id_{uuid.uuid4().hex}"
    gone = written(ids.toDF(name).distinct(), "gone")
    return df.join(gone, df[id_col] == gone[name], "left_anti")


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session is already gone
            return


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8MB") -> None:
    """Let Spark hand texts to Python in Arrow batches of at most so many rows and bytes; smaller settings stay.

    Batches of the default 10,000 rows of long texts take tens of MB in the JVM and in each Python worker.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n`` (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def parts(spark: SparkSession, n_bytes: int, per: int = 32 << 20) -> int:
    """Partitions for so many bytes, at least the session's shuffle parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per), 1)
