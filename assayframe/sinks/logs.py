"""A chained audit log that streams append to, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import ZERO


class BrokenLog(ValueError):
    """What should be appended doesn't go on from the last lines of the log."""


def folder(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All lines that have been appended."""
    return spark.read.parquet(f"{path}/batch-*/lines")


def _heads(spark: SparkSession, path: str) -> DataFrame | None:
    """(run_id, line_no, event_hash): the last line of each run of the log; None for an empty log."""
    fs, pattern = folder(spark, f"{path}/batch-*/heads")
    if not fs.globStatus(pattern):
        return None
    rows = spark.read.parquet(f"{path}/batch-*/heads")
    return rows.groupBy("run_id").agg(F.max("line_no").alias("line_no"), F.max_by("event_hash", "line_no").alias("event_hash"))


def append_batch(lines: DataFrame, path: str, name: str) -> bool:
    """Append chained lines (run_id, line_no, prev_event_hash, event_hash, ...) as the batch ``name``; False if that batch is in the log already.

    The batch is written aside, with the last line of each of its runs, and becomes part of the log by one rename. Before that, the first line of each run has to go on from the log's last line of the
    run, or from nothing; otherwise ``BrokenLog`` is raised and the log stays as it was.
    """
    spark = lines.sparkSession
    fs, final = folder(spark, f"{path}/batch-{name}")
    if fs.exists(final):
        return False
    aside = f"{path}/.aside-{name}"
    lines.write.mode("overwrite").parquet(f"{aside}/lines")
    kept = spark.read.schema(lines.schema).parquet(f"{aside}/lines")
    ends = kept.groupBy("run_id").agg(F.min_by("prev_event_hash", "line_no").alias("prev"), F.max("line_no").alias("line_no"), F.max_by("event_hash", "line_no").alias("event_hash"))
    ends.select("run_id", "line_no", "event_hash").write.mode("overwrite").parquet(f"{aside}/heads")
    heads = _heads(spark, path)
    starts = ends.select("run_id", "prev")
    last = starts.withColumn("last", F.lit(ZERO)) if heads is None else starts.join(heads.select("run_id", F.col("event_hash").alias("last")), "run_id", "left")
    broken = last.where(F.col("prev") != F.coalesce("last", F.lit(ZERO))).select("run_id").limit(5).collect()
    if broken:
        fs.delete(folder(spark, aside)[1], True)
        raise BrokenLog(f"batch {name} doesn't go on from the log in runs {', '.join(str(r.run_id) for r in broken)}")
    if not fs.rename(folder(spark, aside)[1], final):
        raise OSError(f"{final} can't be made")
    return True


def append_log(lines: DataFrame, path: str, checkpoint: str, name: str = "log", **options: str) -> StreamingQuery:
    """Append a stream of chained lines to the log at ``path``: a micro-batch that is repeated after a crash, wherever that was, isn't appended twice.

    ``name`` tells streams with different checkpoints that append to one log apart.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not append_batch(batch, path, f"{name}-{number}"):
            batch.write.format("noop").mode("overwrite").save()  # a batch that isn't read would leave its state behind

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).options(**options).outputMode("append").trigger(availableNow=True).start()
