"""Queries that publish bundles as folders, files and keys, and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as egress
from ..sinks import bundles, vault, writers
from ..sources import folders, readers
from .registry import query, scratch, table

_OWN = """b AS (SELECT 'b' || s_suppkey AS bundle_id, 's' || s_nationkey AS name, s_suppkey AS k, 'line one' || chr(10) || 'line ' || s_suppkey || chr(10) AS audit FROM supplier)"""


def _bundles(spark, sf_dir):
    k, text = F.col("s_suppkey").cast("string"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    name = text("s", F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(
        text("b", k).alias("bundle_id"), F.lit("pack").alias("pack_id"), text('{ "run": "r', k, '", "name":"', name, '" }').alias("bundle_info"),
        text('{"run_id":"r', k, '","evidence_authority":{"source":{"producer":"p","audit_log_sha256":"old"},"case_id":"c"}}').alias("run_manifest"), F.lit('{"gates":[ ]}').alias("eval_report"), F.lit("[2,1]").alias("templates_used"),
        F.when(F.col("s_suppkey") % 2 == 0, '{"z":1,"claims":{"b":2,"a":null}}').alias("citations_map"), F.lit(None).cast("string").alias("redactions_map"), F.lit("{}").alias("artifact_list"), F.lit("{}").alias("policy_snapshot"), F.lit("{}").alias("network_snapshot"), F.lit("{}").alias("model_snapshot"),
        text("line one\r\nline ", k, "\r").alias("audit_log"), text("artifact_id,path\r\na,", k, "\n").alias("artifact_hashes"),
    )


_PLAIN = ("eval_report.json", '{"gates":[]}'), ("exports/pack/attachments/templates_used.json", "[2,1]"), *[(f"inputs_snapshot/{x}.json", "{}") for x in ("artifact_list", "policy_snapshot", "network_snapshot", "model_snapshot")], ("exports/pack/deliverables/empty.md", "")


@query("bundle_folders", f"""WITH {_OWN}, f AS (SELECT bundle_id, 'BUNDLE_INFO.json' AS path, '{{"name":"' || name || '","run":"r' || k || '"}}' AS content FROM b
    UNION ALL SELECT bundle_id, 'run_manifest.json', '{{"evidence_authority":{{"case_id":"c","source":{{"audit_log_sha256":"' || sha256(audit) || '","producer":"p"}}}},"run_id":"r' || k || '"}}' FROM b
    UNION ALL SELECT bundle_id, 'audit_log.ndjson', audit FROM b UNION ALL SELECT bundle_id, 'artifact_hashes.csv', 'artifact_id,path' || chr(10) || 'a,' || k || chr(10) FROM b
    UNION ALL SELECT bundle_id, 'exports/pack/deliverables/name.md', name FROM b UNION ALL SELECT bundle_id, 'exports/pack/attachments/citations_map.json', '{{"claims":{{"a":null,"b":2}},"z":1}}' FROM b WHERE k % 2 = 0
    UNION ALL SELECT bundle_id, p, c FROM b, (VALUES {', '.join(f"('{p}', '{c}')" for p, c in _PLAIN)}) v(p, c)
    UNION ALL SELECT bundle_id, p, NULL FROM b, (VALUES (''), ('exports/'), ('exports/pack/'), ('exports/pack/attachments/'), ('exports/pack/deliverables/'), ('inputs_snapshot/')) v(p))
  SELECT bundle_id || '/' || path AS path, content, sha256(content) AS sha256 FROM f""")
def bundle_folders(spark, sf_dir):
    """Bundles of all suppliers in their fixed layout, published and listed again."""
    own = _bundles(spark, sf_dir)
    name = F.concat(F.lit("s"), F.get_json_object("bundle_info", "$.name").substr(2, 99))
    made = own.select("bundle_id", F.explode(F.array(F.struct(F.lit("exports/pack/deliverables/name.md").alias("path"), name.alias("content")), F.struct(F.lit("exports/pack/deliverables/empty.md").alias("path"), F.lit("").alias("content")))).alias("f")).select("bundle_id", "f.*")
    bundles.write_bundles(bundles.bundle_files(own, made), at := scratch(spark, "bundles"))
    return folders.read_folders(spark, at).select("path", F.col("bytes").cast("string").alias("content"), F.sha2("bytes", 256).alias("sha256"))


@query("src_folders", """WITH d AS (SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, doc_id, coalesce(text, '') AS t FROM documents)
  SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, CAST(strlen(t) AS BIGINT) AS size, sha256(t) AS sha256 FROM d UNION ALL SELECT DISTINCT lang || '/', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM d UNION ALL SELECT DISTINCT lang || '/' || source || '/', NULL, NULL FROM d""")
def src_folders(spark, sf_dir):
    """All documents as files in folders of folders, null and empty ones as empty files, listed again with their folders."""
    d, or_none = table(spark, sf_dir, "documents"), lambda c: F.coalesce(c, F.lit("none"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    files = d.select(or_none("lang").alias("bundle_id"), F.concat(or_none("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), text.alias("content"), F.sha2(text, 256).alias("sha256"))
    bundles.write_bundles(files, at := scratch(spark, "tree"))
    return folders.read_folders(spark, at).select("path", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))


@query("vault_rotation", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'k2' ELSE 'k1' END AS first_key, 'k2' AS last_key, doc_id % 3 = 0 OR text IS NULL AS kept, sha256(text) AS sha256 FROM documents")
def vault_rotation(spark, sf_dir):
    """Texts under two data keys, whose master key changes and which then move to one data key; each step reads what the one before wrote."""
    first, second = b"m" * 32, b"n" * 32
    keys = vault.wrapped_key(spark, "k1", first).union(vault.wrapped_key(spark, "k2", first))
    keys.write.parquet(at := scratch(spark, "keys"))
    keys = spark.read.parquet(at)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    sealed = vault.encrypt_under(d.where("doc_id % 3 <> 0"), "data", keys, first, "k1").union(vault.encrypt_under(d.where("doc_id % 3 = 0"), "data", keys, first, "k2"))
    sealed.write.parquet(at := scratch(spark, "blobs"))
    sealed = spark.read.parquet(at)
    vault.rewrap(keys, first, second).write.parquet(at := scratch(spark, "keys"))
    keys = spark.read.parquet(at)
    vault.reencrypt(sealed, "data", keys, second, "k2").write.parquet(at := scratch(spark, "blobs"))
    moved = spark.read.parquet(at)
    sealed_sha = F.sha2("data", 256)  # blobs are compared by their digests, so that none is shuffled
    plain = vault.decrypt_named(moved.withColumn("after", sealed_sha), "data", keys, second).select("doc_id", F.col("key_id").alias("last_key"), "after", F.sha2("data", 256).alias("sha256"))
    both = sealed.select("doc_id", F.col("key_id").alias("first_key"), sealed_sha.alias("before")).join(plain, "doc_id")
    return both.select("doc_id", "first_key", "last_key", F.col("before").eqNullSafe(F.col("after")).alias("kept"), "sha256")


@query("vault_blobs", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) + 28 AS sealed_bytes FROM documents")
def vault_blobs(spark, sf_dir):
    """All texts encrypted, written, and scanned again: nonce and tag take 28 bytes."""
    key = "0123456789abcdef0123456789abcdef"
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("data"))
    writers.encrypt(d, "data", key).write.parquet(at := scratch(spark, "sealed"))
    sealed = spark.read.parquet(at)
    return writers.decrypt(sealed, "data", key).select("doc_id", F.sha2("data", 256).alias("sha256")).join(sealed.select("doc_id", F.octet_length("data").cast("long").alias("sealed_bytes")), "doc_id")


@query("src_artifact_hashes", """SELECT CAST(doc_id AS VARCHAR) AS artifact_id, 'p,"' || doc_id || '"' AS path, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE coalesce(strlen(text), 0) END AS bytes FROM documents""")
def src_artifact_hashes(spark, sf_dir):
    """Lists of hashes written as CSV and read again; sizes that aren't numbers count as 0."""
    n = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(n.alias("artifact_id"), F.concat(F.lit('p,"'), n, F.lit('"')).alias("path"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 7 == 0, "many").otherwise(F.octet_length("text").cast("string")).alias("bytes"))
    wide = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns], *[F.lit("x").alias(c) for c in readers.hash_columns()[4:]]).toDF(*readers.hash_columns())
    wide.write.option("header", True).option("escape", '"').csv(at := scratch(spark, "hashes"))
    got = readers.read_artifact_hashes(spark, at)
    return got.select("artifact_id", F.col(got.columns[1]).alias("path"), F.col(got.columns[2]).alias("sha256"), F.col(got.columns[3]).alias("bytes"))


@query("allowlist_forms", r"""WITH r AS (SELECT p_partkey, ['HTTPS', 'http', 'ftp', NULL][p_partkey % 4 + 1] AS s, ['Example.ORG', 'bücher.example', '', NULL][p_partkey // 4 % 4 + 1] AS h, [0, NULL, 8080][p_partkey // 16 % 3 + 1] AS p, ['a\b', '/x', '/a/../b', NULL][p_partkey // 48 % 4 + 1] AS x FROM part),
  c AS (SELECT p_partkey, lower(s) AS scheme, CASE h WHEN 'bücher.example' THEN 'xn--bcher-kva.example' ELSE lower(h) END AS host, CAST(CASE WHEN coalesce(p, 0) <> 0 THEN p WHEN lower(s) = 'https' THEN 443 ELSE 80 END AS INTEGER) AS port, CASE WHEN x = 'a\b' THEN '/a/b' ELSE x END AS path_prefix FROM r)
  SELECT *, CASE WHEN scheme NOT IN ('http', 'https') OR scheme IS NULL THEN 'scheme' WHEN coalesce(host, '') = '' THEN 'host' WHEN contains(path_prefix, '..') THEN 'path_prefix' END AS reject_reason FROM c""")
def allowlist_forms(spark, sf_dir):
    n, one = F.col("p_partkey"), lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    rules = table(spark, sf_dir, "part").select(n, one(n % 4, "HTTPS", "http", "ftp", None).alias("scheme"), one(F.floor(n / 4) % 4, "Example.ORG", "bücher.example", "", None).alias("host"), one(F.floor(n / 16) % 3, 0, None, 8080).alias("port"), one(F.floor(n / 48) % 4, "a\\b", "/x", "/a/../b", None).alias("path_prefix"))
    return egress.canonical_rules(rules).select("p_partkey", "scheme", "host", F.col("port").cast("int").alias("port"), "path_prefix", "reject_reason")


@query("egress_match_many", """WITH q AS (SELECT o_orderkey, o_orderkey % 9 AS n, o_custkey % 3 = 0 AS other FROM orders), r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS idx FROM lineitem)
  SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision, 'ALW' || lpad(CAST(idx AS VARCHAR), CAST(greatest(4, length(CAST(idx AS VARCHAR))) AS INTEGER), '0') AS rule_id FROM q LEFT JOIN r ON NOT other AND l_orderkey = o_orderkey AND l_linenumber = n""")
def egress_match_many(spark, sf_dir):
    """One host with a rule for every line item."""
    o, k, n = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderkey") % 9
    url = F.concat(F.lit("http://"), F.when(F.col("o_custkey") % 3 == 0, "other").otherwise("h"), F.lit(".example.com/en/x"), k.cast("string"), F.lit("/"), n.cast("string"), F.lit("/more"))
    rules = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("idx"), F.lit("http").alias("scheme"), F.lit("h.example.com").alias("host"), F.lit(80).alias("port"), F.concat(F.lit("/en/x"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path_prefix"))
    return egress.egress_decisions(o.select(k, url.alias("url")), rules).select("o_orderkey", "decision", "rule_id")
