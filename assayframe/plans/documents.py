"""Queries over documents, conversations, pages and orders as transcripts, contracts and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checks import plus_years
from ..functions.ids import stable_anchor
from ..operators import bundles, documents, incident, reports
from .registry import query, table

_PII_TAIL = " call 555-123-4567 or 555.123.4567, id 123-45-6789 at 10.0.0.255"
#: The patterns and lists again, written out, so that the SQL doesn't follow a slip in the operators.
_PATTERNS = {
    "PII.email": ("Email address", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "PII.phone": ("Phone number", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    "PII.ssn": ("Social security number", r"\b\d{3}-\d{2}-\d{4}\b"),
    "SYSTEM.ip_address": ("Network address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
}
_COMMANDS_SQL = "['SELECT', 'INSERT', 'UPDATE', 'DELETE', 'curl', 'wget', 'password', 'secret', 'token']"


def _redact_sql(ip: bool) -> str:
    x = f"text || '{_PII_TAIL}'"
    for reason, pattern in list(_PATTERNS.values())[: 4 if ip else 3]:
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED: {reason}]', 'g')"
    return f"SELECT doc_id, sha256({x}) AS redacted_sha256 FROM documents"


def _redacted(spark, sf_dir, profile):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(incident.redact(F.concat("text", F.lit(_PII_TAIL)), profile).cast("binary"), 256).alias("redacted_sha256"))


@query("inc_redact_basic", _redact_sql(False))
def inc_redact_basic(spark, sf_dir):
    return _redacted(spark, sf_dir, "BASIC")


@query("inc_redact_standard", _redact_sql(True))
def inc_redact_standard(spark, sf_dir):
    return _redacted(spark, sf_dir, "STANDARD")


@query("inc_redaction_records", "WITH d AS (SELECT doc_id, text || '" + _PII_TAIL + "' AS text FROM documents), r AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{rule}' AS rule, regexp_extract_all(text, '{p}') AS found FROM d" for rule, (_, p) in _PATTERNS.items()
) + f" UNION ALL SELECT doc_id, 'COMMAND.output', list_filter({_COMMANDS_SQL}, lambda k: contains(text, k)) FROM d) SELECT doc_id, rule, CAST(i - 1 AS INTEGER) AS ordinal, found[i] AS original FROM (SELECT doc_id, rule, found, unnest(range(1, len(found) + 1)) AS i FROM r)")
def inc_redaction_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(_PII_TAIL)).alias("text"))
    return incident.redaction_records(d, "text", ["doc_id"])


@query("cns_status", """SELECT o_orderkey, coalesce(o_custkey % 3 > 0, false) AS has_consent, CASE WHEN o_custkey % 3 = 0 THEN 'Missing' WHEN o_custkey % 7 = 0 THEN 'Revoked' WHEN CAST(1996 + o_custkey % 5 AS VARCHAR) || '-02-29' < '1999-06-01' THEN 'Expired' ELSE 'Valid' END AS consent_status,
    o_custkey % 3 = 0 OR o_custkey % 7 = 0 AS blocked FROM orders""")
def cns_status(spark, sf_dir):
    consents = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("patient_id"), F.concat((F.col("c_custkey") % 5 + 1994).cast("string"), F.lit("-02-29")).alias("date_given"), F.when(F.col("c_custkey") % 7 == 0, "REVOKED").alias("status"))
    out = documents.consent_check(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id")), consents, "1999-06-01")
    return out.select("o_orderkey", F.col("date_expires").isNotNull().alias("has_consent"), "consent_status", "blocked")


@query("cns_expiry", "SELECT o_orderkey, (year(o_orderdate) + 2) || strftime(o_orderdate, '-%m-%d') AS expires FROM orders")
def cns_expiry(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", plus_years(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("expires"))


@query("cln_uncertainty", """SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 100 < 95 THEN ['speech_recognition'] ELSE [] END, list_filter(['possible', 'may have', 'suspected', 'rule out'], lambda k: contains(lower(t), k))), ',') AS items
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Suspected, possible ' WHEN 1 THEN 'we May Have ' ELSE '' END || coalesce(text, '') AS t FROM documents)""")
def cln_uncertainty(spark, sf_dir):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "Suspected, possible ").when(F.col("doc_id") % 3 == 1, "we May Have ").otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(documents.uncertainty(text, (F.col("doc_id") % 100) / 100.0), ",").alias("items"))


_CONTRACT_SQL = "ct AS (SELECT CAST(doc_id AS VARCHAR) AS contract_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE '1.1 Indemnity shall indemnify' || chr(10) || coalesce(text, '') || chr(10) || '2.0 Governing law: arbitration ' || chr(10) || '3 Limitation of liability' END AS text FROM documents)"


def contracts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    long = F.concat(F.lit("1.1 Indemnity shall indemnify\n"), text, F.lit("\n2.0 Governing law: arbitration \n3 Limitation of liability"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("contract_id"), F.when(F.col("doc_id") % 4 == 0, text).otherwise(long).alias("text"))


_HIGH = "['indemnify', 'indemnification', 'perpetual', 'irrevocable', 'sole discretion', 'unrestricted', 'terminate at will', 'unlimited liability']"
_MEDIUM = "['limit liability', 'limitation of liability', 'liability', 'breach', 'default', 'force majeure', 'governing law', 'dispute', 'arbitration']"
_HITS = f"WITH {_CONTRACT_SQL}, k AS (SELECT contract_id, list_filter({_HIGH}, lambda k: contains(lower(text), k)) AS h, list_filter({_MEDIUM}, lambda k: contains(lower(text), k)) AS m FROM ct)"


@query("ctr_risk", f"{_HITS} SELECT contract_id, CASE WHEN len(h) > 0 THEN 'HIGH' WHEN len(m) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS level, array_to_string(list_concat(h, m), ';') AS keywords FROM k")
def ctr_risk(spark, sf_dir):
    level, found = documents.risk(F.col("text"))
    return contracts(spark, sf_dir).select("contract_id", level.alias("level"), F.array_join(found, ";").alias("keywords"))


_MARKED = r"regexp_replace(text, '(?m)^(\d+(?:\.\d+)*)\s+([^\n]+)', chr(65535) || '\0', 'g')"
_CLAUSES = f"""WITH {_CONTRACT_SQL}, p AS (SELECT contract_id, text, string_split({_MARKED}, chr(65535)) AS ps FROM ct WHERE trim(text) <> ''),
  u AS (SELECT contract_id, ps, unnest(range(2, len(ps) + 1)) AS i FROM p WHERE len(ps) > 1),
  c AS (SELECT contract_id, contract_id || '_C' || (i - 2) AS clause_id, (i - 1) || '.0' AS clause_number, CAST(NULL AS VARCHAR) AS title, regexp_replace(ps[i], '^\\s+|\\s+$', '', 'g') AS t, CAST(list_sum(list_transform(ps[1:i - 1], lambda x: strlen(x))) AS INTEGER) AS start_offset, 0.85::DOUBLE AS confidence FROM u
    UNION ALL SELECT contract_id, contract_id || '_C0', '1.0', 'General Terms', text, 0, 0.7::DOUBLE FROM p WHERE len(ps) = 1)
  SELECT contract_id, clause_id, clause_number, title, start_offset, CAST(start_offset + strlen(t) AS INTEGER) AS end_offset, confidence, 'REDLINE_' || contract_id || '_' || substr(sha256(t), 1, 8) || '_' || start_offset AS anchor_id FROM c"""


@query("ctr_clauses", _CLAUSES)
def ctr_clauses(spark, sf_dir):
    return documents.clauses(contracts(spark, sf_dir)).select("contract_id", "clause_id", "clause_number", "title", "start_offset", "end_offset", "confidence", "anchor_id")


@query("ctr_ws_anchor", r"SELECT doc_id, 'clause_' || substr(sha256(regexp_replace(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '[ \t\r\n]+', ' ', 'g')), 1, 16) AS anchor FROM documents")
def ctr_ws_anchor(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", stable_anchor(F.col("text")).alias("anchor"))


_CONTROLS = [("C1", "en"), ("C2", "fr"), ("C3", "src1"), ("C4", "src2"), ("C5", "none")]
_CONTROL_SQL = "co AS (SELECT * FROM (VALUES ('C1', 'en'), ('C2', 'fr'), ('C3', 'src1'), ('C4', 'src2'), ('C5', 'none')) v(control_id, control_family)), la AS (SELECT doc_id AS artifact_id, lang AS control_family FROM documents WHERE lang IS NOT NULL UNION SELECT doc_id, source FROM documents WHERE source IS NOT NULL)"


def _evidence(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.array_compact(F.array("lang", "source")).alias("labels"))
    return items, spark.createDataFrame(_CONTROLS, "control_id string, control_family string")


@query("evd_mapping", f"WITH {_CONTROL_SQL} SELECT DISTINCT control_id, artifact_id FROM co JOIN la USING (control_family)")
def evd_mapping(spark, sf_dir):
    return documents.control_pairs(*_evidence(spark, sf_dir))


@query("evd_missing", f"WITH {_CONTROL_SQL} SELECT control_id, any_value(co.control_family) AS control_family, CASE WHEN count(artifact_id) = 0 THEN 'MISSING' ELSE 'MAPPED' END AS status, count(DISTINCT artifact_id) AS n_items, min(artifact_id) AS first_id, max(artifact_id) AS last_id FROM co LEFT JOIN la USING (control_family) GROUP BY control_id")
def evd_missing(spark, sf_dir):
    return documents.control_status(*_evidence(spark, sf_dir))


@query("evd_line_ranges", """WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), m AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(regexp_replace(t, chr(10) || '$', ''), chr(10))) END AS n FROM n),
  s AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 6 AS s FROM m)
  SELECT conv_id AS narrative_id, turn AS ord, CAST(s AS BIGINT) AS start_line, CAST(s + n - 1 AS BIGINT) AS end_line, sha256(t) AS text_sha256 FROM s""")
def evd_line_ranges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("narrative_id"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return documents.claim_lines(c).select("narrative_id", "ord", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "text_sha256")


@query("cit_missing_claims", "SELECT 'C' || doc_id AS claim_id FROM documents WHERE text IS NOT NULL EXCEPT SELECT 'C' || doc_id FROM labels WHERE quality = 1")
def cit_missing_claims(spark, sf_dir):
    marked = F.concat(F.lit("<!-- CLAIM: C"), F.col("doc_id").cast("string"), F.lit(" -->\n"), "text", F.lit("<!-- CLAIM: X1 -->"))
    cited = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("claim_id"))
    return documents.uncited_claims(table(spark, sf_dir, "documents").select(marked.alias("text")), cited)


@query("hash_verify", """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'f' || doc_id END AS path, CASE WHEN text IS NULL OR doc_id % 11 = 0 OR doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'size mismatch' WHEN doc_id % 5 = 0 OR doc_id % 13 = 0 AND sha256(text) <> upper(sha256(text)) THEN 'sha256 mismatch' ELSE 'ok' END AS verdict FROM documents WHERE doc_id % 19 <> 0 OR doc_id % 17 = 0""")
def hash_verify(spark, sf_dir):
    """Digests in upper case and paths of blanks are taken as they stand."""
    d = table(spark, sf_dir, "documents")
    size, n, sha, own = F.octet_length("text"), F.col("doc_id"), F.sha2("text", 256), F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    path = F.when(n % 17 == 0, " ").when(n % 19 == 0, "").otherwise(own)
    declared = d.select(n, path.alias("path"), F.when(n % 5 == 0, "0").when(n % 13 == 0, F.upper(sha)).otherwise(sha).alias("sha256"), F.when(n % 7 == 0, size + 1).otherwise(size).alias("bytes"))
    entries = d.where(n % 11 != 0).select(own.alias("path"), sha.alias("sha256"), size.alias("bytes"))
    return bundles.verify_hashes(declared, entries).select("doc_id", "path", "verdict")


@query("fingerprint", "SELECT source, sha256(string_agg(e, '|' ORDER BY e)) AS fingerprint FROM (SELECT source, doc_id || coalesce(':' || sha256(text), '') AS e FROM documents) GROUP BY source")
def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return bundles.input_fingerprint(d.select("source", F.col("doc_id").cast("string").alias("artifact_id"), F.sha2("text", 256).alias("sha256")), "source")


@query("egress_match", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, url FROM pages),
  r AS (SELECT CAST(i + 1 AS INTEGER) AS idx, '/' || ['en', 'fr', 'de'][i + 1] || '/' AS prefix FROM range(3) t(i)), m AS (SELECT page_id, min(idx) AS idx FROM p JOIN r ON url LIKE 'http://%' AND host = 'ththre.example.com' AND starts_with(path, prefix) GROUP BY page_id)
  SELECT page_id AS request_id, host, CASE WHEN idx IS NULL THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision, CASE WHEN idx IS NOT NULL THEN printf('ALW%04d', idx) END AS rule_id FROM p LEFT JOIN m USING (page_id)""")
def egress_match(spark, sf_dir):
    rules = spark.createDataFrame([(k, "http", "ththre.example.com", 80, f"/{lang}/") for k, lang in enumerate(("en", "fr", "de"), 1)], "idx int, scheme string, host string, port int, path_prefix string")
    return bundles.egress_decisions(table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), "url"), rules).select("request_id", "host", "decision", "rule_id")


_ASSESSED = _CLAUSES.rsplit("\n  SELECT", 1)[0] + f""", k AS (SELECT contract_id, start_offset, 'REDLINE_' || contract_id || '_' || substr(sha256(t), 1, 8) || '_' || start_offset AS anchor_id,
    list_filter({_HIGH}, lambda x: contains(lower(t), x)) AS h, list_filter({_MEDIUM}, lambda x: contains(lower(t), x)) AS m FROM c),
  a AS (SELECT *, CASE WHEN len(h) > 0 THEN 'HIGH' WHEN len(m) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS level, list_concat(h, m) AS found FROM k),
  b AS (SELECT *, CASE WHEN len(found) = 0 THEN 'No significant risk keywords detected. Standard contract language.' ELSE 'Risk level: ' || level || '. Keywords found: ' || array_to_string(found, ', ') || '. Recommend legal review.' END AS advisory FROM a)"""
_CLAUSE_LINES = "SELECT contract_id, CAST(section AS INTEGER) AS section, CAST(start_offset AS INTEGER) AS start_offset, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM r"


def _assessed(spark, sf_dir):
    return reports.assess(documents.clauses(contracts(spark, sf_dir)))


@query("ctr_clause_map", f"{_ASSESSED} SELECT contract_id, start_offset, anchor_id || ',' || level || ',' || array_to_string(found, ';') || ',' || anchor_id AS line FROM b")
def ctr_clause_map(spark, sf_dir):
    return reports.clause_map_lines(_assessed(spark, sf_dir))


@query("ctr_risk_memo", f"""{_ASSESSED}, r AS (SELECT contract_id, 0 AS section, 0 AS start_offset, ['# Risk Assessment Memo', '', '## Summary', '', '- **HIGH Risk Clauses:** ' || count(*) FILTER (level = 'HIGH'), '- **MEDIUM Risk Clauses:** ' || count(*) FILTER (level = 'MEDIUM'), '- **LOW Risk Clauses:** ' || count(*) FILTER (level = 'LOW'), '', '## Detailed Findings', ''] AS ls FROM b GROUP BY 1
  UNION ALL SELECT contract_id, 1, start_offset, ['### Clause: ' || anchor_id || ' ', '**Risk Level:** ' || level, '', '**Advisory:** ' || advisory, '', '<!-- CLAIM:C' || anchor_id || ' ANCHOR:' || anchor_id || ' -->', ''] FROM b
  UNION ALL SELECT DISTINCT contract_id, 2, 0, ['---', '', '*Determinism: Enabled (reproducible outputs)*'] FROM b) {_CLAUSE_LINES}""")
def ctr_risk_memo(spark, sf_dir):
    return reports.risk_memo(_assessed(spark, sf_dir))


@query("ctr_suggestions", f"""{_ASSESSED}, r AS (SELECT contract_id, 0 AS section, 0 AS start_offset, ['# Suggested Redlines', '', CASE WHEN count(*) FILTER (level = 'HIGH') = 0 THEN 'No HIGH-risk clauses requiring redlines.' ELSE '## ' || count(*) FILTER (level = 'HIGH') || ' HIGH-Risk Clauses Requiring Review' END] AS ls FROM b GROUP BY 1
  UNION ALL SELECT contract_id, 1, start_offset, ['', '### Clause: ' || anchor_id, '', '**Issue:** ' || advisory, '', '**Recommended Action:** Consult legal counsel for appropriate redlines.'] FROM b WHERE level = 'HIGH') {_CLAUSE_LINES}""")
def ctr_suggestions(spark, sf_dir):
    return reports.redline_suggestions(_assessed(spark, sf_dir))
