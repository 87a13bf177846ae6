"""Queries over documents, orders and events as evidence packs, transcripts, payloads and egress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import sha
from ..operators import evidence, incident
from ..sources import readers
from ..streaming import stateful
from .documents import _PATTERNS
from .events import LOG_SQL, _streamed, log_rows
from .registry import query, table

_FAMILIES = ("AccessControl", "Auditability", "DataProtection", "NetworkGovernance", "ModelGovernance")
_ITEMS = """it AS (SELECT coalesce(source, 'none') AS pack, 'a' || doc_id AS artifact_id, sha256(coalesce(text, '')) AS sha, coalesce(left(text, 40), '') AS title, list_sort(list_distinct(list_filter([lang, 'x' || (doc_id % 3)], lambda t: t IS NOT NULL))) AS tags,
    CASE WHEN doc_id % 9 < 5 THEN [['AccessControl', 'Auditability', 'DataProtection', 'NetworkGovernance', 'ModelGovernance'][doc_id % 9 + 1]] ELSE [] END AS labels FROM documents)"""
_CONTROLS_SQL = "co AS (SELECT * FROM (VALUES ('CTRL-AC-001', 'Access Control', 'AccessControl'), ('CTRL-AU-001', 'Auditability', 'Auditability'), ('CTRL-CI-001', 'Traceability', 'Traceability'), ('CTRL-DP-001', 'Data Protection', 'DataProtection'), ('CTRL-MG-001', 'Model Governance', 'ModelGovernance'), ('CTRL-NW-001', 'Network Governance', 'NetworkGovernance')) v(control_id, capability, control_family))"
_MAPPED = f"""{_ITEMS}, {_CONTROLS_SQL}, pk AS (SELECT DISTINCT pack FROM it), la AS (SELECT DISTINCT pack, artifact_id, unnest(labels) AS control_family FROM it), ag AS (SELECT pack, control_family, list_sort(list(artifact_id)) AS ids FROM la GROUP BY 1, 2),
  ma AS (SELECT pk.pack, control_id, capability, co.control_family, CASE WHEN ids IS NULL THEN 'MISSING' ELSE 'MAPPED' END AS status, coalesce(ids, []) AS ids FROM pk CROSS JOIN co LEFT JOIN ag ON ag.pack = pk.pack AND ag.control_family = co.control_family)"""


def items(spark, sf_dir):
    n = F.col("doc_id")
    label = F.array(*map(F.lit, _FAMILIES))[(n % 9).cast("int")]
    tags = F.array_sort(F.array_distinct(F.array_compact(F.array("lang", F.concat(F.lit("x"), (n % 3).cast("string"))))))
    return table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("none")).alias("pack"), F.concat(F.lit("a"), n.cast("string")).alias("artifact_id"), sha(F.coalesce("text", F.lit(""))).alias("artifact_sha256"), F.coalesce(F.left("text", F.lit(40)), F.lit("")).alias("title"), tags.alias("tags"),
        F.when(n % 9 < 5, F.array(label)).otherwise(F.array().cast("array<string>")).alias("labels"),
    )


@query("evd_mapping_rows", f"WITH {_MAPPED} SELECT pack, control_id, capability, control_family, status, array_to_string(ids, ',') AS ids FROM ma")
def evd_mapping_rows(spark, sf_dir):
    return evidence.mapping_rows(items(spark, sf_dir), evidence.controls(spark)).select("pack", "control_id", "capability", "control_family", "status", F.array_join("mapped_artifact_ids", ",").alias("ids"))


@query("evd_mapping_review", f"""WITH {_MAPPED} SELECT pack, sha256('{{"mappings":[' || string_agg('{{"capability":"' || capability || '","control_family":"' || control_family || '","control_id":"' || control_id || '","mapped_artifact_ids":[' || coalesce('"' || nullif(array_to_string(ids, '","'), '') || '"', '') || '],"reviewer_note":"","status":"' || status || '"}}', ',' ORDER BY control_id)
    || '],"pack_id":"' || pack || '","pack_version":"1.0","run_id":"r_' || pack || '","schema_version":"EVIDENCE_MAPPING_REVIEW_V1"}}') AS json_sha256 FROM ma GROUP BY pack""")
def evd_mapping_review(spark, sf_dir):
    rows = evidence.mapping_rows(items(spark, sf_dir), evidence.controls(spark))
    return evidence.mapping_review(rows, "1.0", F.concat(F.lit("r_"), "pack")).select("pack", sha(F.col("json")).alias("json_sha256"))


@query("evd_missing_checklist", f"""WITH {_MAPPED}, l AS (SELECT pack, list_concat(['# Missing Evidence Checklist', ''], coalesce(list('- [ ] ' || control_id || ' (' || capability || ')' ORDER BY control_id) FILTER (status = 'MISSING'), ['- [x] No missing control evidence mappings.'])) AS ls FROM ma GROUP BY pack)
  SELECT pack, CAST(unnest(range(len(ls))) AS INTEGER) AS ord, unnest(ls) AS line FROM l""")
def evd_missing_checklist(spark, sf_dir):
    return evidence.missing_checklist(evidence.mapping_rows(items(spark, sf_dir), evidence.controls(spark)))


_CSV = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query("evd_index_csv", f"WITH {_ITEMS} SELECT DISTINCT pack, CAST(-1 AS INTEGER) AS section, '' AS artifact_id, 'artifact_id,artifact_sha256,title,tags,control_families' AS line FROM it UNION ALL SELECT pack, 0, artifact_id, artifact_id || ',' || sha || ',' || {_CSV.format('title')} || ',' || array_to_string(tags, ';') || ',' || coalesce(array_to_string(labels, ';'), '') FROM it")
def evd_index_csv(spark, sf_dir):
    return evidence.index_lines(items(spark, sf_dir))


@query("evd_index_md", f"""WITH {_ITEMS} SELECT pack, CAST(unnest(range(-4, 0)) AS INTEGER) AS section, '' AS artifact_id, unnest(['# Evidence Index', '', '| Artifact ID | SHA-256 | Title | Tags | Control Families |', '|---|---|---|---|---|']) AS line FROM (SELECT DISTINCT pack FROM it)
  UNION ALL SELECT pack, 0, artifact_id, '| ' || artifact_id || ' | ' || sha || ' | ' || title || ' | ' || array_to_string(tags, ', ') || ' | ' || coalesce(array_to_string(labels, ', '), '') || ' |' FROM it""")
def evd_index_md(spark, sf_dir):
    return evidence.index_lines(items(spark, sf_dir), markdown=True)


@query("evd_controls", """WITH c(control_id, capability) AS (VALUES ('CTRL-AC-001', 'Access Controls'), ('CTRL-AU-001', 'Auditability'), ('CTRL-CI-001', 'Traceability'), ('CTRL-DP-001', 'Data Protection'), ('CTRL-MG-001', 'Model Governance'), ('CTRL-NW-001', 'Network Governance')),
  p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['Traceability', 'Auditability', 'No such'] ELSE ['No such'] END AS asked FROM part)
  SELECT p_partkey, control_id FROM p, c WHERE len(coalesce(asked, [])) = 0 OR list_contains(asked, capability)""")
def evd_controls(spark, sf_dir):
    n, names = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    asked = F.when(n % 4 == 1, names()).when(n % 4 == 2, names("Traceability", "Auditability", "No such")).when(n % 4 == 3, names("No such"))
    return evidence.controls_for(table(spark, sf_dir, "part").select(n, asked.alias("capabilities"))).select("p_partkey", "control_id")


_HASHED = "SELECT source AS bundle_id, CASE WHEN doc_id % 4 = 0 THEN 'o:' ELSE '' END || 'a' || doc_id AS artifact_id, 'p,' || doc_id AS path, sha256(text) AS sha, strlen(text) AS bytes, doc_id FROM documents"


@query("evd_hash_lines", f"""SELECT bundle_id, artifact_id, path, artifact_id || ',"' || path || '",' || coalesce(sha, '') || ',' || coalesce(CAST(bytes AS VARCHAR), '') || ',text/plain,input' AS line FROM ({_HASHED})""")
def evd_hash_lines(spark, sf_dir):
    return evidence.hash_lines(_hashed(spark, sf_dir))


def _hashed(spark, sf_dir):
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("bundle_id"), F.concat(F.when(n % 4 == 0, "o:").otherwise(""), F.lit("a"), n.cast("string")).alias("artifact_id"), F.concat(F.lit("p,"), n.cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("bytes"),
        F.lit("text/plain").alias("content_type"), F.lit("input").alias("logical_role"), n,
    )


@query("evd_missing_inputs", "SELECT source AS bundle_id, 'a' || doc_id AS artifact_id FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 3 = 0 OR source IS NULL)")
def evd_missing_inputs(spark, sf_dir):
    rows = _hashed(spark, sf_dir)
    entries = rows.where("doc_id % 3 <> 0").select("bundle_id", F.concat(F.lit("inputs_snapshot/artifacts/"), "artifact_id", F.lit("/bytes")).alias("path"))
    return evidence.missing_inputs(rows.select("bundle_id", "artifact_id"), entries).select("bundle_id", "artifact_id")


@query("evd_directory_bytes", "SELECT source AS root, count(*) AS n_files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents GROUP BY source")
def evd_directory_bytes(spark, sf_dir):
    return evidence.directory_bytes(_hashed(spark, sf_dir).withColumnRenamed("bundle_id", "root"))


@query("evd_narrative_faults", "SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'empty claim_id' WHEN trim(coalesce(text, '')) = '' THEN 'empty text' WHEN turn % 2 = 1 THEN 'no citation' END AS reason FROM conversations")
def evd_narrative_faults(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, " ").otherwise("C").alias("claim_id"), "text", F.when(F.col("turn") % 2 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("citations"))
    return evidence.narrative_faults(c, True).select("conv_id", "turn", F.col("reject_reason").alias("reason"))


_LINES = "CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, chr(10) || '$', ''), chr(10)) END"


@query("evd_narrative", f"""WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), l AS (SELECT conv_id, CAST(turn AS INTEGER) AS ord, list_concat(['<!-- CLAIM:C' || turn || ' -->'], {_LINES}, ['']) AS ls FROM n
    UNION ALL SELECT DISTINCT conv_id, NULL, ['# Evidence Narrative', '', 'All claims below require citation support under strict mode.', ''] FROM n) SELECT conv_id AS narrative_id, ord, CAST(unnest(range(len(ls))) AS INTEGER) AS k, unnest(ls) AS line FROM l""")
def evd_narrative(spark, sf_dir):
    return evidence.narrative_lines(_claims(spark, sf_dir))


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("narrative_id"), F.col("turn").alias("ord"), F.concat(F.lit("C"), F.col("turn").cast("string")).alias("claim_id"), F.coalesce("text", F.lit("")).alias("text"))


@query("evd_citations_map", f"""WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), m AS (SELECT *, len({_LINES}) AS n FROM n), s AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 6 AS s FROM m)
  SELECT conv_id AS narrative_id, turn AS ord, '{{"claim_id":"C' || turn || '","output_path":"n.md","output_claim_locator":{{"locator_type":"TEXT_LINE_RANGE_V1","locator":{{"start_line":' || CAST(s AS BIGINT) || ',"end_line":' || CAST(s + n - 1 AS BIGINT) || ',"text_sha256":"' || sha256(t) || '"}}}},"citations":[{{"citation_index":0,"artifact_id":"a1","locator_type":"L","locator":{{"page":1}}}}]}}' AS json FROM s""")
def evd_citations_map(spark, sf_dir):
    cited = F.array(F.struct(F.lit("a1").alias("artifact_id"), F.lit("L").alias("locator_type"), F.lit('{"page": 1}').alias("locator")))
    return evidence.citations_map(_claims(spark, sf_dir).withColumn("citations", cited), "n.md")


@query("adapter_lookup", "SELECT o_orderkey AS call_id, CASE WHEN o_custkey % 7 < 5 THEN 'e' || (o_custkey % 7) END AS endpoint, CASE WHEN o_custkey % 7 >= 5 THEN 'adapter not found' END AS reject_reason FROM orders")
def adapter_lookup(spark, sf_dir):
    adapters = spark.createDataFrame([(k, f"ad{k % 5}", f"e{k}") for k in range(10)], "idx int, adapter_id string, endpoint string")
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("ad"), (F.col("o_custkey") % 7).cast("string")).alias("adapter_id"))
    return evidence.pick_adapters(calls, adapters).drop("adapter_id")


@query("small_projections", """SELECT doc_id, 'a_contract_' || left(sha256(coalesce(text, '')), 8) AS artifact_id, CASE doc_id % 3 WHEN 0 THEN 0.98 WHEN 1 THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence, doc_id % 4 = 1 AS retention, doc_id % 5 = 0 AS same, doc_id % 5 <= 1 AS within, 'k' || (doc_id % 5) || ',z' AS keys FROM documents""")
def small_projections(spark, sf_dir):
    n = F.col("doc_id")
    a = F.create_map(F.lit("z"), F.lit("1"), F.concat(F.lit("k"), (n % 5).cast("string")), F.lit("v"))
    b = F.map_concat(F.create_map(F.lit("z"), F.lit("1"), F.lit("k0"), F.lit("v")), F.when(n % 5 == 1, F.create_map(F.lit("k1"), F.lit("v"))).otherwise(F.create_map().cast("map<string,string>")))
    mode = F.when(n % 3 == 0, "NATIVE_PDF").when(n % 3 == 1, "OCR").otherwise("OTHER")
    retention = F.when(n % 4 == 0, "").when(n % 4 == 1, "P1").when(n % 4 == 2, "  ")
    return table(spark, sf_dir, "documents").select("doc_id", evidence.artifact_id(F.coalesce("text", F.lit(""))).alias("artifact_id"), evidence.extraction_confidence(mode).alias("confidence"), evidence.retention_ok(retention).alias("retention"), evidence.same_map(a, b).alias("same"), evidence.within_map(a, b).alias("within"), F.array_join(evidence.map_keys_sorted(a), ",").alias("keys"))


@query("output_manifest", """WITH m(kind, files) AS (VALUES ('finance', ['deliverables/exceptions_audit.md', 'deliverables/compliance_internal.md', 'deliverables/exceptions.csv', 'attachments/exceptions_map.json', 'attachments/compliance_summary.json']), ('incident', ['deliverables/customer_packet.md', 'deliverables/internal_packet.md', 'deliverables/timeline.csv', 'attachments/redactions_map.json', 'attachments/citations_map.json']),
    ('contract', ['deliverables/risk_memo.md', 'deliverables/clause_map.csv', 'deliverables/redline_suggestions.md', 'attachments/citations_map.json', 'attachments/anchor_index.json']), ('transcript', ['deliverables/draft_note.md', 'deliverables/verification_checklist.md', 'attachments/consent_record.json', 'attachments/citations_map.json', 'attachments/uncertainty_map.json']))
  SELECT s_suppkey, m.kind, unnest(files) AS path FROM supplier JOIN m ON m.kind = ['finance', 'incident', 'contract', 'transcript', 'none'][s_suppkey % 5 + 1]""")
def output_manifest(spark, sf_dir):
    kind = F.array(*map(F.lit, ("finance", "incident", "contract", "transcript", "none")))[(F.col("s_suppkey") % 5).cast("int")]
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"))
    return rows.select("*", F.explode(evidence.outputs_of(F.col("kind"))).alias("f")).select("s_suppkey", "kind", F.concat_ws("/", "f.folder", "f.file").alias("path"))


# incidents

_SPANS = " UNION ALL ".join(f"SELECT doc_id, text, '{rule}' AS rule, '{reason}' AS reason, regexp_extract_all(text, '{p}') AS f, regexp_split_to_array(text, '{p}') AS b FROM d" for rule, (reason, p) in _PATTERNS.items())


@query("inc_redaction_spans", f"""WITH d AS (SELECT doc_id, 'é ' || coalesce(text, '') || ' a@b.org 10.0.0.255 555-123-4567' AS text FROM documents), r AS ({_SPANS}), u AS (SELECT doc_id, rule, reason, f, b, unnest(range(1, len(f) + 1)) AS i FROM r)
  SELECT doc_id, CAST(list_sum(list_transform(b[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: strlen(x))), 0) AS INTEGER) AS span_start, CAST(list_sum(list_transform(b[1:i], lambda x: strlen(x))) + list_sum(list_transform(f[1:i], lambda x: strlen(x))) AS INTEGER) AS span_end, f[i] AS original, reason, rule FROM u""")
def inc_redaction_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("é "), F.coalesce("text", F.lit("")), F.lit(" a@b.org 10.0.0.255 555-123-4567")).alias("text"))
    return incident.redaction_spans(d, "text", ["doc_id"])


@query("inc_citations_map", f"""WITH {LOG_SQL} SELECT incident_id, t AS ts, idx, '{{"claim_id":"C' || anchor_id || '","anchor_id":"' || anchor_id || '","timestamp":"' || stamp || '","system":"' || source_system || '","action":"' || action || '"}}' AS item FROM ev3""")
def inc_citations_map(spark, sf_dir):
    return incident.citations_map(incident.parse_events(log_rows(spark, sf_dir)))


@query("inc_redactions_map", f"""WITH {LOG_SQL.replace("ELSE props END AS evidence", "ELSE props END || CASE WHEN event_id % 10 = 0 THEN ' x@y.org' ELSE '' END AS evidence")} SELECT incident_id, t AS ts, idx, '{{"event_id":"' || anchor_id || '","timestamp":"' || stamp || '","original_text":"x@y.org","reason":"Email address","profile_rule":"PII.email"}}' AS item FROM ev3 WHERE ends_with(evidence, ' x@y.org')""")
def inc_redactions_map(spark, sf_dir):
    rows = log_rows(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("incident_id"), "event_id")
    from pyspark.sql import Window

    idx = (F.row_number().over(Window.partitionBy("incident_id").orderBy("event_id")) - 1).cast("long")
    marked = e.withColumn("idx", idx).where("event_id % 10 = 0").select("incident_id", "idx", F.lit(" x@y.org").alias("more"))
    rows = rows.join(marked, ["incident_id", "idx"], "left").withColumn("evidence_text", F.concat("evidence_text", F.coalesce("more", F.lit("")))).drop("more")
    return incident.redactions_map(incident.parse_events(rows))


@query("inc_workflow_counts", "SELECT user_id AS incident_id, count(*) AS n_events, CAST(sum(event_id % 3) AS BIGINT) AS redaction_count, count(*) * 2 AS redaction_estimate FROM events GROUP BY user_id")
def inc_workflow_counts(spark, sf_dir):
    return evidence.workflow_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("incident_id"), (F.col("event_id") % 3).alias("n_masked")))


# transcripts

_TRANSCRIPTS = """tr AS (SELECT 't' || o_orderkey AS id, 'p' || o_custkey AS patient, strftime(o_orderdate, '%Y-%m-%d') AS d, 'Dr ' || o_clerk AS provider, o_orderpriority AS specialty, (50 + o_orderkey % 50)::DOUBLE / 100 AS conf, CASE o_orderkey % 3 WHEN 0 THEN 'Suspected, Possible' WHEN 1 THEN 'we May Have' ELSE 'clear' END AS content,
    CASE WHEN o_custkey % 3 = 0 THEN 'Missing' WHEN o_custkey % 7 = 0 THEN 'Revoked' WHEN o_custkey % 5 < 2 THEN 'Expired' ELSE 'Valid' END AS status FROM (SELECT *, 'Who' AS o_clerk FROM orders))"""


def transcripts(spark, sf_dir):
    n = F.col("o_orderkey")
    content = F.when(n % 3 == 0, "Suspected, Possible").when(n % 3 == 1, "we May Have").otherwise("clear")
    t = table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), n.cast("string")).alias("transcript_id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("Dr Who").alias("provider"), F.col("o_orderpriority").alias("specialty"), ((F.lit(50) + n % 50) / 100.0).alias("confidence"), content.alias("content"))
    # each patient has an older consent as well, which doesn't count
    c = F.col("c_custkey")
    given = table(spark, sf_dir, "customer").where(c % 3 != 0).withColumn("old", F.explode(F.array(F.lit(0), F.lit(1))))
    consents = given.select(F.concat(F.lit("p"), c.cast("string")).alias("patient_id"), F.when(F.col("old") == 1, "1990-01-01").when(c % 5 < 2, "1996-01-01").otherwise("1998-01-01").alias("date_given"), F.when((c % 7 == 0) == (F.col("old") == 0), "REVOKED").alias("status"))
    return evidence.assessed_transcripts(t, consents, "1999-06-01")


@query("cln_draft_note", f"""WITH {_TRANSCRIPTS}, l AS (SELECT id, list_concat(['# Clinical Draft Note', '', '## Patient Information', '', '- **Patient ID:** ' || patient, '- **Date:** ' || d, '- **Provider:** ' || provider, '- **Specialty:** ' || specialty, '- **Confidence:** ' || CAST(round(conf * 100) AS INTEGER) || '%', ''],
    CASE WHEN status = 'Expired' THEN ['⚠️ **WARNING:** Patient consent has expired. Request renewal before finalization.', ''] ELSE [] END, ['## Clinical Summary', '', content, '', '<!-- CLAIM:C' || id || ' ANCHOR:' || id || ' -->', '', '## Verification Status', '', '- [ ] Demographics verified', '- [ ] Chief complaint captured', '- [ ] Assessment accurate', '- [ ] Plan documented', '', '---', '', '*This draft requires provider review and signature*']) AS ls FROM tr WHERE status NOT IN ('Missing', 'Revoked'))
  SELECT id AS transcript_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM l""")
def cln_draft_note(spark, sf_dir):
    return evidence.draft_note(transcripts(spark, sf_dir))


@query("cln_checklist", f"""WITH {_TRANSCRIPTS}, l AS (SELECT id, list_concat(['# Verification Checklist', '', '**Patient:** ' || patient, '**Date:** ' || d, '**Provider:** ' || provider, '', '## Required Verifications', ''], string_split('### Demographics~- [ ] Patient name matches record~- [ ] DOB verified~- [ ] MRN confirmed~~### Clinical Content~- [ ] Chief complaint documented~- [ ] History of present illness clear~- [ ] Physical exam findings documented~- [ ] Assessment reflects clinical thinking~- [ ] Plan is actionable~~### Quality Checks~- [ ] No protected health info in free text~- [ ] Grammar and spelling acceptable~- [ ] Medical terminology accurate~- [ ] Clinical logic sound~~### Sign-Off~- [ ] Provider reviewed draft~- [ ] Corrections applied~- [ ] Ready for signature~', '~')) AS ls FROM tr)
  SELECT id AS transcript_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM l""")
def cln_checklist(spark, sf_dir):
    return evidence.verification_checklist(transcripts(spark, sf_dir))


@query("cln_uncertainty_map", f"""WITH {_TRANSCRIPTS}, l AS (SELECT id, list_concat(CASE WHEN conf < 0.95 THEN ['{{"type":"speech_recognition","confidence":' || CAST(conf AS FLOAT)::DOUBLE || ',"recommendation":"Verify medical terms against clinical context"}}'] ELSE [] END, list_transform(CASE content WHEN 'Suspected, Possible' THEN ['possible', 'suspected'] WHEN 'we May Have' THEN ['may have'] ELSE [] END, lambda t: '{{"type":"clinical_uncertainty","term":"' || t || '","recommendation":"Clarify with provider before finalization"}}')) AS ls FROM tr)
  SELECT id AS transcript_id, CAST(unnest(range(len(ls))) AS INTEGER) AS item_no, unnest(ls) AS item FROM l""")
def cln_uncertainty_map(spark, sf_dir):
    return evidence.uncertainty_map(transcripts(spark, sf_dir))


# payloads and egress

_CASES = ("ok text", "ok base64", "missing payload", "duplicate payload", "unsupported content type", "empty payload", "invalid base64", "invalid UTF-8", "not a PDF", "malformed sha256", "sha256 mismatch", "ok pdf", "too large")


@query("payload_ingest", f"""SELECT o_orderkey AS artifact_id, nullif(CASE WHEN c LIKE 'ok%' THEN '' ELSE c END, '') AS reject_reason, CASE WHEN c IN ('ok text', 'duplicate payload', 'sha256 mismatch', 'malformed sha256') THEN '' WHEN c IN ('ok pdf', 'not a PDF', 'unsupported content type') THEN 'BASE64_DECODE' WHEN c IN ('too large') THEN '' ELSE 'BASE64_DECODE,UTF8_DECODE' END AS transformations,
    c IN ('malformed sha256', 'sha256 mismatch', 'ok base64') AS sha_enforced FROM (SELECT o_orderkey, [{', '.join(f"'{c}'" for c in _CASES)}][o_orderkey % {len(_CASES)} + 1] AS c FROM orders)""")
def payload_ingest(spark, sf_dir):
    n = F.col("o_orderkey")
    c = F.array(*map(F.lit, _CASES))[(n % len(_CASES)).cast("int")]
    rows = table(spark, sf_dir, "orders").select(n.alias("artifact_id"), c.alias("c"))
    is_ = lambda *x: F.col("c").isin(*x)
    artifacts = rows.select("artifact_id", "c", F.when(is_("ok pdf", "not a PDF", "unsupported content type"), "PDF").otherwise("TEXT").alias("expected"), F.when(is_("malformed sha256"), "xyz").when(is_("sha256 mismatch"), "0" * 64).when(is_("ok base64"), F.upper(F.sha2(F.lit("héllo").cast("binary"), 256))).alias("declared_sha256"))
    made = rows.where(~is_("missing payload")).withColumn("k", F.explode(F.when(is_("duplicate payload"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(is_("ok text", "duplicate payload", "malformed sha256", "sha256 mismatch", "unsupported content type"), "héllo").when(is_("too large"), F.lit("x" * 101))
    coded = F.when(is_("ok base64", "not a PDF"), F.base64(F.lit("héllo").cast("binary"))).when(is_("ok pdf"), F.base64(F.lit("%PDF-1.4").cast("binary"))).when(is_("invalid base64"), "&&&").when(is_("invalid UTF-8"), F.base64(F.unhex(F.lit("FFFE41"))))
    got = readers.ingest_payloads(artifacts, made.select("artifact_id", text.alias("content_text"), coded.alias("content_base64")), 100, 100)
    return got.select("artifact_id", "reject_reason", F.array_join("transformations", ",").alias("transformations"), "sha_enforced")


_EGRESS = """eg AS (SELECT 'r' || user_id AS run_id, CAST(event_id AS BIGINT) AS line_no, '{"actor":"system","details":{' || CASE WHEN event_id % 3 = 0 THEN '"allowlist_rule_id":"ALW0001",' ELSE '"block_reason":"NOT_ALLOWLISTED",' END || '"destination":{"host":"h' || (event_id % 3) || '.org","path":"/a/' || event_type || '","port":443,"scheme":"https"},"evidence_origin":"RUNTIME_OBSERVATION","request_hash_sha256":"' || sha256('') || '"},"event_hash":"' || repeat('0', 64)
    || '","event_type":"EGRESS_REQUEST_' || CASE WHEN event_id % 3 = 0 THEN 'ALLOWED' ELSE 'BLOCKED' END || '","prev_event_hash":"' AS head, '","run_id":"r' || user_id || '","ts_utc":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","vault_id":"v1"}' AS tail FROM events)"""


@query("stream_egress", f"""WITH RECURSIVE {_EGRESS}, n AS (SELECT run_id, line_no, head, tail, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k FROM eg),
  c AS (SELECT run_id, line_no, k, repeat('0', 64) AS prev_event_hash, sha256(head || repeat('0', 64) || tail) AS event_hash FROM n WHERE k = 1 UNION ALL SELECT n.run_id, n.line_no, n.k, c.event_hash, sha256(n.head || c.event_hash || n.tail) FROM c JOIN n ON n.run_id = c.run_id AND n.k = c.k + 1)
  SELECT run_id, line_no, prev_event_hash, event_hash FROM c""")
def stream_egress(spark, sf_dir):
    rules = spark.createDataFrame([(1, "https", "h0.org", 443, "/a/")], "idx int, scheme string, host string, port int, path_prefix string")
    url = F.concat(F.lit("https://H"), (F.col("event_id") % 3).cast("string"), F.lit(".org/a/"), "event_type")
    asked = lambda e: e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("line_no"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), F.lit("v1").alias("vault_id"), url.alias("url"))
    return _streamed(spark, sf_dir, lambda e: stateful.egress_stream(asked(e), rules))
