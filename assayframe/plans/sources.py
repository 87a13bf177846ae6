"""Queries that feed sources and small functions with texts made from the tables."""

from __future__ import annotations

import io
import json
import tarfile

from pyspark.sql import functions as F

from ..functions import checks, ids, jsons, text
from ..operators import audit, incident
from ..sources import readers
from .events import LOG_SQL, audit_events, log_rows
from .registry import dealt, query, table


def _texts(spark, sf_dir, name: str, number: str, variants: list):
    """(n, variant, text): one of the texts for each row of a table."""
    k = (F.col(number) % len(variants)).cast("int")
    return table(spark, sf_dir, name).select(F.col(number).alias("n"), k.alias("variant"), F.array(*map(F.lit, variants))[k].alias("text"))


_TX = '{"date":"2026-01-0%s","amount":%s,"account":"a","category":"c"%s}'
_STATEMENTS = [
    '{"statement_id":"s","period_start":"a","period_end":"b","transactions":[%s,%s]}' % (_TX % (1, "1.5", ""), _TX % (2, "-2", ',"description":"x, \\"y\\""')), "{}", "not json", None, '{"statement_id":"s","period_start":"a","period_end":"b","transactions":[]}',
    '{"statement_id":"s","period_start":"a","period_end":"b","transactions":[{"date":"d","account":"a","category":"c"}]}',
]


@query("src_statements", """SELECT statement_id, ordinal, amount, description, reason, count(*) AS n FROM (SELECT o_orderkey % 6 AS variant FROM orders) JOIN (VALUES (0, 's', 0, 1.5::DOUBLE, '', NULL), (0, 's', 1, -2.0, 'x, "y"', NULL), (1, NULL, NULL, NULL, NULL, 'missing field'), (2, NULL, NULL, NULL, NULL, 'missing field'), (3, NULL, NULL, NULL, NULL, 'missing field'), (4, 's', NULL, NULL, NULL, 'no transactions'), (5, 's', NULL, NULL, NULL, 'bad transaction')) w(variant, statement_id, ordinal, amount, description, reason) USING (variant) GROUP BY 1, 2, 3, 4, 5""")
def src_statements(spark, sf_dir):
    rows = readers.parse_statements(_texts(spark, sf_dir, "orders", "o_orderkey", _STATEMENTS))
    return rows.groupBy("statement_id", "ordinal", "amount", "description", F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


_LOG = '{"timestamp":"t%s","source_system":"s","actor":"a","action":"x","affected_resource":"r","evidence_text":"e"}'
_LOGS = [f"[{_LOG % 1},{_LOG % 2}]", f"{_LOG % 1}\n\n{_LOG % 2}\r\n", '{"timestamp":"t1"}\n{', "", None, "[]", " \n"]


@query("src_logs", """SELECT n AS incident_id, CAST(idx AS INTEGER) AS idx, line_no, stamp, reason FROM (SELECT c_custkey AS n, c_custkey % 7 AS variant FROM customer) JOIN (VALUES (0, 0, 1, 't1', NULL), (0, 1, 2, 't2', NULL), (1, 0, 1, 't1', NULL), (1, 1, 3, 't2', NULL), (2, 0, 1, 't1', 'missing field or malformed'), (2, 1, 2, NULL, 'missing field or malformed'), (3, 0, NULL, NULL, 'no events'), (4, 0, NULL, NULL, 'no events'), (5, 0, NULL, NULL, 'no events'), (6, 0, NULL, NULL, 'no events')) w(variant, idx, line_no, stamp, reason) USING (variant)""")
def src_logs(spark, sf_dir):
    rows = readers.parse_logs(_texts(spark, sf_dir, "customer", "c_custkey", _LOGS), id_col="n")
    return rows.select("incident_id", "idx", "line_no", F.col("timestamp").alias("stamp"), F.col("reject_reason").alias("reason"))


_TRANSCRIPTS = [json.dumps({"patient_id": "p", "date": "2026-01-01", "provider": "d", "specialty": "s", "content": c, "confidence": 0.5}) for c in ("words", "")] + ['{"patient_id":"p"}', "x", '{"patient_id":"p","date":"2026-01-01","provider":"d","specialty":"s","content":"words","confidence":"high"}']


@query("src_transcripts", "SELECT reason, id, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'empty content' ELSE 'missing field' END AS reason, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN 'CLINICAL_' || left(sha256('p2026-01-01' || CASE o_orderkey % 5 WHEN 1 THEN '' ELSE 'words' END), 16) END AS id FROM orders) GROUP BY ALL")
def src_transcripts(spark, sf_dir):
    return readers.parse_transcripts(_texts(spark, sf_dir, "orders", "o_orderkey", _TRANSCRIPTS)).groupBy(F.col("reject_reason").alias("reason"), F.col("transcript_id").alias("id")).agg(F.count("*").alias("n"))


@query("src_consents", "SELECT status, expires, id, reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 < 2 THEN 'CONSENT_' || left(sha256('CONSENT_p2024-02-29'), 16) END AS id, CASE o_orderkey % 3 WHEN 1 THEN 'REVOKED' ELSE 'VALID' END AS status, CASE WHEN o_orderkey % 3 < 2 THEN '2026-02-29' END AS expires, CASE WHEN o_orderkey % 3 = 2 THEN 'missing field' END AS reason FROM orders) GROUP BY ALL")
def src_consents(spark, sf_dir):
    texts = ['{"patient_id":"p","date_given":"2024-02-29","scope":"s"}', '{"patient_id":"p","date_given":"2024-02-29","scope":"s","status":"REVOKED"}', "[]"]
    return readers.parse_consents(_texts(spark, sf_dir, "orders", "o_orderkey", texts)).groupBy("status", F.col("date_expires").alias("expires"), F.col("consent_id").alias("id"), F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@query("src_audit_log", "SELECT 'r' || user_id AS bundle_id, CAST(2 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) - 1 AS INTEGER) AS line_no, event_type, props AS details FROM events")
def src_audit_log(spark, sf_dir):
    line = F.to_json(F.struct("ts_utc", "event_type", "run_id", "vault_id", "actor", F.parse_json("details").alias("details")))
    files = audit_events(table(spark, sf_dir, "events")).groupBy(F.col("run_id").alias("bundle_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("x")))), lambda e: e["x"]), "\n \n").alias("text"))
    return readers.parse_audit_log(files).select("bundle_id", "line_no", "event_type", F.regexp_replace("details", '":', '": ').alias("details"))


@query("src_pdf_text", r"SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CASE p_partkey % 4 WHEN 0 THEN 'a (b) \c' WHEN 1 THEN 'one two' || chr(10) || 'three' ELSE '' END END AS text, CAST(CASE p_partkey % 4 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS pages FROM part")
def src_pdf_text(spark, sf_dir):
    texts = ["%PDF-1.4 /Type /Page\nBT (a \\(b\\) \\\\c) Tj ET", "%PDF-1.4 /Type /Page x /Type /Page\nBT (one) Tj\n(two) Tj ET\nBT (three) Tj ET", "%PDF-1.4 none", "BT (x) Tj ET"]
    files = _texts(spark, sf_dir, "part", "p_partkey", texts).withColumn("content", F.col("text").cast("binary"))
    return readers.pdf_text(files, id_col="n").select(F.col("n").alias("p_partkey"), "text", "pages")


@query("src_prefixed_reports", "SELECT s_suppkey, s_suppkey % 3 = 1 AS odd FROM supplier WHERE s_suppkey % 3 < 2")
def src_prefixed_reports(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(F.when(k % 3 == 2, F.lit("other")).otherwise(F.concat(F.lit('REPORT={"k":"'), k.cast("string"), F.lit('","odd":"'), (k % 3 == 1).cast("string"), F.lit('"}'))).alias("value"))
    return readers.parse_reports(lines, "REPORT=").select(F.col("report")["k"].cast("long").alias("s_suppkey"), F.col("report")["odd"].cast("boolean").alias("odd"))


_URLS = ["http://127.0.0.1:8080/x", "http://127.255.1.9", "http://127.999.0.1/", "http://[::1]:80/", "http://localhost/", "https://127.0.0.1.example.org/", "nothing", None]
_MESSAGES = ["request timeout", "model not found", "op unsupported", "else", None]


@query("fn_checks", """SELECT p_partkey, coalesce(p_partkey % 8 IN (0, 1, 3), false) AS loopback, ['TIMEOUT', 'MODEL_NOT_FOUND', 'NOT_SUPPORTED', 'RUNTIME_ERROR', 'RUNTIME_ERROR'][p_partkey % 5 + 1] AS category, ['ADAPTER_TIMEOUT', 'MODEL_NOT_FOUND', 'NOT_SUPPORTED', 'RUNTIME_ERROR', 'RUNTIME_ERROR'][p_partkey % 5 + 1] AS code, p_partkey % 5 = 0 AS retryable,
    CASE WHEN p_partkey % 3 = 2 THEN 'NAME_ONLY' WHEN p_partkey % 2 = 0 THEN 'CRYPTO_PINNED' ELSE 'VERSION_PINNED' END AS pinning, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'r_' || left(sha256(CAST(p_partkey AS VARCHAR)), 32) END AS run_id, 'a,b c,x' || p_partkey AS list, 'a' || chr(10) || 'b' || chr(10) || p_partkey || chr(10) AS lines, '\\(x\\) \\\\' || p_partkey AS pdf, CASE WHEN p_partkey % 2 = 0 THEN 'z' ELSE '' END AS unknown, p_partkey % 6 IN (1, 2) AS below FROM part""")
def fn_checks(spark, sf_dir):
    n = F.col("p_partkey")
    pick = lambda xs: F.array(*map(F.lit, xs))[(n % len(xs)).cast("int")]
    error = checks.adapter_error(pick(_MESSAGES))
    key = F.sha2(n.cast("string").cast("binary"), 256)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(checks.loopback(pick(_URLS)), F.lit(False)).alias("loopback"), error["category"].alias("category"), error["code"].alias("code"), error["retryable"].alias("retryable"), checks.pinning_level(F.when(n % 2 == 0, "x"), F.when(n % 3 == 2, "").otherwise("a"), F.lit("1")).alias("pinning"),
        ids.run_id(F.when(n % 4 == 3, "short").when(n % 4 == 1, F.upper(key)).otherwise(key)).alias("run_id"), F.array_join(text.csv_list(F.concat(F.lit(" b c,a,, a ,x"), n.cast("string"), F.lit(" "))), ",").alias("list"), text.unix_newlines(F.concat(F.lit("a\r\nb\r"), n.cast("string"), F.lit("\r"))).alias("lines"), text.pdf_escaped(F.concat(F.lit("(x) \\"), n.cast("string"))).alias("pdf"),
        F.array_join(jsons.unknown_keys(F.when(n % 2 == 0, '{"a":1,"z":2}').otherwise('{"a":{"z":1}}'), ("a", "b")), ",").alias("unknown"), checks.strict_descendant(F.lit("/a/b"), pick(["/a/b", "/a/b/c", "/a/b/c/d", "/a/bc", "/a/b/../c", "a/b/c"])).alias("below"),
    )


@query("inc_timeline_csv", f"""WITH {LOG_SQL} SELECT incident_id, t AS ts, idx, stamp || ',' || source_system || ',u' || incident_id || ',' || action || ',' || replace(regexp_replace(evidence, ' timeout$', ''), '"', '""') || ',' || severity || ',' || anchor_id AS line FROM ev3""")
def inc_timeline_csv(spark, sf_dir):
    return incident.timeline_lines(incident.parse_events(log_rows(spark, sf_dir)))


#: Every type of event, with the first of its detail keys.
_TYPES = """('RUN_CREATED', 'pack_id'), ('RUN_STATE_CHANGED', 'from_state'), ('POLICY_APPLIED', 'policy_mode'), ('NETWORK_MODE_SET', 'network_mode'), ('ALLOWLIST_UPDATED', 'allowlist_hash_sha256'), ('ARTIFACT_INGEST_STARTED', 'source_type'), ('ARTIFACT_INGESTED', 'artifact_id'), ('ARTIFACT_INGEST_COMPLETED', 'artifact_count'), ('EVAL_STARTED', 'registry_version'), ('EVAL_GATE_RESULT', 'gate_id'),
  ('EVAL_COMPLETED', 'gates_executed'), ('EXPORT_REQUESTED', 'requested_by'), ('EXPORT_BLOCKED', 'block_reason'), ('EXPORT_COMPLETED', 'bundle_path'), ('EGRESS_REQUEST_ALLOWED', 'destination'), ('EGRESS_REQUEST_BLOCKED', 'destination'), ('MODEL_SELECTION_RESOLVED', 'task_type'), ('MODEL_CALL_STARTED', 'call_id'), ('MODEL_CALL_COMPLETED', 'call_id'), ('MODEL_CALL_FAILED', 'call_id'), ('NO_AI_MODE_USED', 'reason'),
  ('REDACTION_APPLIED', 'artifact_id'), ('REDACTION_VALIDATION_RESULT', 'result'), ('CITATION_VALIDATION_RESULT', 'result'), ('BUNDLE_VALIDATION_RESULT', 'result'), ('VAULT_ENCRYPTION_STATUS', 'encryption_at_rest'), ('VAULT_KEY_ROTATED', 'old_key_id'), ('DELETION_REQUESTED', 'artifact_ids'), ('DELETION_COMPLETED', 'artifact_ids_deleted'), ('RUN_COMPLETED', ''), ('RUN_FAILED', ''), ('RUN_CANCELLED', ''), ('DETERMINISM_PROFILE_SET', ''),
  ('DETERMINISM_DOWNGRADED', ''), ('DETERMINISM_VALIDATION_RESULT', ''), ('BUNDLE_GENERATION_STARTED', ''), ('BUNDLE_GENERATION_COMPLETED', ''), ('BUNDLE_VALIDATION_STARTED', ''), ('EXPORT_FAILED', '')"""


@query("aud_taxonomy_all", f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (VALUES {_TYPES}) v(event_type, first)), e AS (SELECT event_id, event_id % 39 AS k, event_id % 2 = 1 AS cut, event_id % 3 = 0 AS odd FROM events)
  SELECT event_id, t.event_type, CASE WHEN cut THEN first ELSE '' END AS lacks, CASE WHEN cut AND first <> '' THEN 'missing keys' WHEN odd AND t.event_type LIKE 'EGRESS%' THEN 'bad evidence_origin' ELSE 'ok' END AS verdict FROM e JOIN t USING (k)""")
def aud_taxonomy_all(spark, sf_dir):
    n, types = F.col("event_id"), sorted(audit.REQUIRED)
    origin = F.when(n % 3 == 0, '"x"').otherwise('"CONTROL_SIMULATION"')
    keys = F.array(*[F.array(*map(F.lit, audit.REQUIRED[t])).cast("array<string>") for t in types])[(n % len(types)).cast("int")]
    kept = F.when(n % 2 == 1, F.slice(keys, 2, 99)).otherwise(keys)
    details = F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.when(k == "evidence_origin", origin).otherwise("1"))), ","), F.lit("}"))
    events = table(spark, sf_dir, "events").select("event_id", F.array(*map(F.lit, types))[(n % len(types)).cast("int")].alias("event_type"), details.alias("details"))
    return audit.taxonomy(events).select("event_id", "event_type", "lacks", "verdict")


def _tar(*entries: tuple, end: bool = True) -> bytes:
    """An archive of (path, kind, data)."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for path, kind, data in entries:
            info = tarfile.TarInfo(path)
            info.type, info.size = kind, len(data)
            t.addfile(info, io.BytesIO(data))
        whole = t.offset
    return out.getvalue() if end else out.getvalue()[:whole]


_DIR, _REG = tarfile.DIRTYPE, tarfile.REGTYPE
_SOUND = (("./", _DIR, b""), ("home/", _DIR, b""), ("./project", _DIR, b""), ("candidate.patch.json", _REG, b"{}"), ("project/allowed.txt", _REG, b"x" * 700))
_DAMAGED = bytearray(_tar(*_SOUND))
_DAMAGED[600] ^= 1
_TARS = (
    (_tar(*_SOUND), ""), (b"", "empty"), (_tar(*_SOUND, end=False), "other entries"), (bytes(_DAMAGED), "checksum wrong"), (_tar(*_SOUND[:4]), "other entries"), (_tar(*_SOUND, ("other", _DIR, b"")), "unexpected folder: other"), (_tar(*_SOUND, ("other", _REG, b"")), "unexpected file: other"),
    (_tar(*_SOUND, ("home/../x", _REG, b"")), "unsafe path: home/../x"), (_tar(*_SOUND, ("l", tarfile.SYMTYPE, b"")), "symbolic link: l"), (_tar(*_SOUND, ("l", tarfile.LNKTYPE, b"")), "hard link: l"), (_tar(*_SOUND, ("l", tarfile.FIFOTYPE, b"")), "special entry: l"), (_tar(*_SOUND[:3], ("candidate.patch.json", _REG, b"{" * 99), _SOUND[4]), "too large: candidate.patch.json"),
    (_tar(*_SOUND)[: 5 * 512], "other entries"), (_tar(*_SOUND[:4], ("project/allowed.txt", _REG, b"y" * 700))[: 7 * 512], "cut short: project/allowed.txt"), (_tar(*_SOUND).replace(b"ustar", b"other"), "checksum wrong"),
)


@query("src_workspace_tars", f"SELECT p_partkey, w.fault, CASE WHEN w.fault = '' THEN rpad(CAST(p_partkey AS VARCHAR), 700, 'x') END AS allowed FROM part JOIN (VALUES {', '.join(f"({k}, '{f}')" for k, (_, f) in enumerate(_TARS))}) w(variant, fault) ON p_partkey % {len(_TARS)} = variant")
def src_workspace_tars(spark, sf_dir):
    """An archive for each part, whose file holds the part's number."""
    made = spark.createDataFrame([(k, t.hex().upper()) for k, (t, _) in enumerate(_TARS)], "variant int, hex string")
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    rows = parts.withColumn("variant", F.col("p_partkey") % len(_TARS)).join(F.broadcast(made), "variant")  # a constant of this module
    own = F.hex(F.rpad(F.col("p_partkey").cast("string"), 700, "x"))
    archives = rows.select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.replace("hex", F.lit("78" * 700), own)).alias("content"))
    seen = readers.inspect_tars(archives, ("home", "project"), ("candidate.patch.json", "project/allowed.txt"), {"candidate.patch.json": 50})
    return seen.select(F.col("archive_id").cast("long").alias("p_partkey"), F.coalesce("fault", F.lit("")).alias("fault"), F.col("files")["project/allowed.txt"].cast("string").alias("allowed"))
