"""Encrypted columns under wrapped data keys: rows name the key they are under, and keys are stored under a master key alone.

A key table has the columns key_id and wrapped (a data key under the master key, AES-256-GCM). Keys reach plans as values of joined tables, never as text of the plan.
Changing the master key rewraps the few keys and touches no row; changing the data key is a step of its own that only touches rows still under another.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "key_id string, wrapped binary"


def _with_master(keys: DataFrame, master: bytes) -> DataFrame:
    one = keys.sparkSession.createDataFrame([(1, bytearray(master))], "__one int, __master binary")
    return keys.withColumn("__one", F.lit(1)).join(one, "__one").drop("__one")


def wrapped_key(spark: SparkSession, key_id: str, master: bytes, data_key: bytes | None = None) -> DataFrame:
    """A key table of one row: a data key of 32 random bytes (or the one given) under the master key."""
    made = spark.createDataFrame([(key_id, bytearray(data_key or secrets.token_bytes(32)))], "key_id string, __data binary")
    return _with_master(made, master).select("key_id", F.aes_encrypt("__data", "__master", F.lit("GCM")).alias("wrapped"))


def _unwrapped(keys: DataFrame, master: bytes) -> DataFrame:
    """(__key_id, __data), few rows that go to every task, as rows joined by their key would meet in one task a key. Raises where the master key isn't the one a key was wrapped with."""
    return F.broadcast(_plain(keys, master))


def _plain(keys: DataFrame, master: bytes) -> DataFrame:
    return _with_master(keys, master).select(F.col("key_id").alias("__key_id"), F.aes_decrypt("wrapped", "__master", F.lit("GCM")).alias("__data"))


def rewrap(keys: DataFrame, old_master: bytes, new_master: bytes) -> DataFrame:
    """The same data keys under another master key."""
    plain = _plain(keys, old_master).select(F.col("__key_id").alias("key_id"), "__data")
    return _with_master(plain, new_master).select("key_id", F.aes_encrypt("__data", "__master", F.lit("GCM")).alias("wrapped"))


def _known(key_id: Column, data: Column, then: Column) -> Column:
    return F.when(data.isNotNull(), then).otherwise(F.raise_error(F.concat(F.lit("no key "), F.coalesce(key_id, F.lit("(null)")))).cast("binary"))


def encrypt_under(df: DataFrame, column: str, keys: DataFrame, master: bytes, key_id: str) -> DataFrame:
    """The column as ciphertext under the data key ``key_id``, which a new column ``key_id`` names. Null stays null. A key that isn't in the table is an error."""
    one = _unwrapped(keys, master)
    out = df.withColumn("key_id", F.lit(key_id)).join(one, F.col("key_id") == F.col("__key_id"), "left")
    sealed = _known(F.col("key_id"), F.col("__data"), F.aes_encrypt(F.col(column).cast("binary"), "__data", F.lit("GCM")))
    return out.withColumn(column, sealed).select(*df.columns, "key_id")


def decrypt_named(df: DataFrame, column: str, keys: DataFrame, master: bytes) -> DataFrame:
    """The column's plain bytes, each row by the key that its ``key_id`` names. An unknown key and altered bytes are errors."""
    out = df.join(_unwrapped(keys, master), F.col("key_id") == F.col("__key_id"), "left")
    return out.withColumn(column, _known(F.col("key_id"), F.col("__data"), F.aes_decrypt(column, "__data", F.lit("GCM")))).select(*df.columns)


def reencrypt(df: DataFrame, column: str, keys: DataFrame, master: bytes, key_id: str) -> DataFrame:
    """All rows under the data key ``key_id``: rows under it already stay as they are, byte for byte, so the step can be taken again after it broke off, on what it left."""
    one = _unwrapped(keys, master)
    new = F.broadcast(one.where(F.col("__key_id") == key_id).select(F.col("__key_id").alias("__new_id"), F.col("__data").alias("__new")))
    out = df.join(one, F.col("key_id") == F.col("__key_id"), "left").withColumn("__to", F.lit(key_id)).join(new, F.col("__to") == F.col("__new_id"), "left")
    plain = _known(F.col("key_id"), F.col("__data"), F.aes_decrypt(column, "__data", F.lit("GCM")))
    moved = F.when(F.col("key_id") == key_id, F.col(column)).otherwise(_known(F.col("__to"), F.col("__new"), F.aes_encrypt(plain, "__new", F.lit("GCM"))))
    return out.withColumn(column, moved).withColumn("key_id", F.col("__to")).select(*df.columns)
