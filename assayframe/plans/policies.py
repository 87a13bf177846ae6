"""Queries over orders as execution policies and over parts as evidence authorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies
from .registry import query, table

_FAILED = "concat_ws(',', {})"
_POLICY = _FAILED.format(
    "CASE WHEN o_orderkey % 17 = 0 THEN 'version' END, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 29 = 0 THEN 'isolation' END, CASE WHEN o_orderkey % 23 = 0 THEN 'user' END, CASE WHEN o_orderkey % 19 = 0 THEN 'command' END, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'environment' END, CASE WHEN o_orderkey % 11 = 0 THEN 'roots' END, CASE WHEN o_custkey % 10 = 0 THEN 'limits' END, CASE WHEN o_orderkey % 13 IN (0, 1) THEN 'outputs' END"
)


@query("policy_validation", f"SELECT o_orderkey, failed, failed = '' AS valid FROM (SELECT o_orderkey, {_POLICY} AS failed FROM orders)")
def policy_validation(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("p"), n.cast("string")).alias("policy_id"),
        F.when(n % 17 == 0, "2").otherwise("1").alias("policy_version"),
        F.when(n % 5 == 0, "bridge").otherwise("none").alias("network"),
        F.when(n % 23 == 0, "0:0").otherwise("1000:1000").alias("user"),
        F.lit(True).alias("read_only_root"),
        (n % 29 == 0).alias("privileged"),
        F.when(n % 19 != 0, F.array(F.lit("run"), n.cast("string"))).otherwise(F.array().cast("array<string>")).alias("argv"),
        F.create_map(F.when(n % 7 == 0, "aws_region").otherwise("LANG"), F.lit("C")).alias("env"),
        F.lit("/in").alias("input_root"),
        F.when(n % 11 == 0, "/in/out").otherwise("/out").alias("output_root"),
        (c % 10 * 1000).cast("long").alias("timeout_ms"),
        F.lit(1 << 30).alias("max_memory_bytes"),
        F.lit(64).alias("max_pids"),
        F.lit(1 << 20).alias("max_output_bytes"),
        F.when(n % 13 == 0, F.array(F.lit("../a"))).when(n % 13 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b/c"))).alias("output_paths"),
    )
    return policies.validate_policies(rows).select("o_orderkey", F.array_join("failed_rules", ",").alias("failed"), "valid")


_AUTHORITY = _FAILED.format(
    "CASE WHEN p_partkey % 7 = 0 THEN 'digest' END, CASE WHEN p_partkey % 5 = 0 THEN 'revision' END, CASE WHEN p_size NOT BETWEEN 6 AND 24 THEN 'fresh' END, "
    "CASE WHEN p_partkey % 11 = 0 THEN 'tools' END, CASE WHEN p_partkey % 3 = 0 THEN 'credentials' END, CASE WHEN p_partkey % 13 IN (0, 1) THEN 'claims' END"
)


@query("authority_validation", f"SELECT p_partkey, failed, failed = '' AS valid FROM (SELECT p_partkey, {_AUTHORITY} AS failed FROM part)")
def authority_validation(spark, sf_dir):
    n, at = F.col("p_partkey"), F.lit("2026-01-02 00:00:00").cast("timestamp")
    names = lambda *x: F.array(*map(F.lit, x))
    # generated p_size hours before the time of judgement, valid for a day or, too long, for 25 hours
    generated = at - F.make_interval(hours=F.col("p_size"))
    valid_until = generated + F.when(F.col("p_size") < 6, F.make_interval(hours=F.lit(25))).otherwise(F.make_interval(hours=F.lit(24)))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(n % 7 == 0, F.lit("none")).otherwise(F.sha2(n.cast("string").cast("binary"), 256)).alias("source_sha256"),
        F.when(n % 5 == 0, " Unknown ").otherwise("r1").alias("revision"),
        generated.alias("generated"),
        valid_until.alias("valid_until"),
        F.when(n % 11 == 0, names("a", "a")).otherwise(names("a", "b")).alias("tools"),
        F.when(n % 3 == 0, names("key", "other")).otherwise(names("key")).alias("credentials_observed"),
        names("key", "token").alias("credentials_allowed"),
        F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(names("read", "score")).alias("permitted"),
        F.when(n % 13 == 1, names("score")).otherwise(names("send")).alias("prohibited"),
    )
    return policies.validate_authorities(rows, "2026-01-02 00:00:00").select("p_partkey", F.array_join("failed_rules", ",").alias("failed"), "valid")
