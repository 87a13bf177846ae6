"""Validation of evidence bundles: twelve checks a bundle, thirteen gates from them, and the report on gates.

``bundles`` has the columns bundle_id, policy (STRICT, BALANCED or DRAFT_ONLY) and, if there is one, comment (the archive's).
``entries`` has bundle_id, ord, path, content (the text of an entry, null if it isn't UTF-8), sha256, bytes, method,
mtime (``yyyy-MM-dd HH:mm:ss``) and mode. A check is a row bundle_id, check_id, severity, result, message; of several failures
in one check the first is told, in this module's own words. Logs and hash lists are judged as rows, so a bundle of any
number of entries is spread over tasks; single JSON documents are judged within their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import sensitive
from ..functions.jsons import integers_only
from ..functions.text import claim_markers
from .audit import ZERO, before
from .bundles import EGRESS_REASONS, REQUIRED_FILES
from .coverage import uncovered_boxes, uncovered_spans
from .policies import AUTHORITY, authority_contract, first_failed

#: The checks, and the severity with which each fails.
CHECKS = (
    "CHK.BUNDLE.REQUIRED_FILES", "CHK.EXPORTS.ATTACHMENTS_LAYOUT", "CHK.NETWORK.SNAPSHOT_PRESENT", "CHK.AUDIT.REQUIRED_KEYS_AND_CHAIN", "CHK.EVIDENCE.AUTHORITY_CONTRACT", "CHK.ARTIFACT_HASHES.VERIFY",
    "CHK.MODEL.PINNING_LEVEL", "CHK.CITATIONS.STRICT", "CHK.REDACTION.POLICY_GATE", "CHK.EVAL.REPORT_AND_GATES", "CHK.DETERMINISM.ZIP_RULES", "CHK.VAULT_CRYPTO.POLICY_SNAPSHOT",
)
_ALL, _GATED, _STRICT = ["STRICT", "BALANCED", "DRAFT_ONLY"], ["STRICT", "BALANCED"], ["STRICT"]
#: Gate, category, severity, policies, evidence, and the check or the prefix of checks that decides it (none: decided on its own).
GATES = (
    ("BUNDLE_FORMAT.REQUIRED_FILES_V1", "BUNDLE_FORMAT", "BLOCKER", _ALL, ["<bundle_root>"], "CHK.BUNDLE."),
    ("AUDIT_HASH_CHAIN.VERIFY_V1", "AUDIT", "BLOCKER", _ALL, ["audit_log.ndjson"], "CHK.AUDIT.REQUIRED_KEYS_AND_CHAIN"),
    ("EVIDENCE_AUTHORITY.CONTRACT_V1", "EVIDENCE_AUTHORITY", "BLOCKER", _ALL, ["run_manifest.json", "audit_log.ndjson"], "CHK.EVIDENCE.AUTHORITY_CONTRACT"),
    ("OFFLINE_ENFORCEMENT.MODE_PROOF_V1", "OFFLINE_ENFORCEMENT", "BLOCKER", _ALL, ["inputs_snapshot/network_snapshot.json", "audit_log.ndjson"], "CHK.NETWORK.SNAPSHOT_PRESENT"),
    ("OFFLINE_ENFORCEMENT.ALLOWLIST_MATCH_V1", "OFFLINE_ENFORCEMENT", "BLOCKER", _GATED, ["inputs_snapshot/network_snapshot.json", "audit_log.ndjson"], None),
    ("CITATIONS.STRICT_ENFORCED_V1", "CITATIONS", "BLOCKER", _STRICT, ["exports/**/attachments/citations_map.json", "exports/**/deliverables/*.md", "artifact_hashes.csv"], "CHK.CITATIONS.STRICT"),
    ("REDACTION.REQUIRED_APPLIED_V1", "REDACTION", "BLOCKER", _GATED, ["exports/**/attachments/redactions_map.json", "exports/**/attachments/citations_map.json", "inputs_snapshot/artifact_list.json", "audit_log.ndjson"], "CHK.REDACTION.POLICY_GATE"),
    ("MODEL_PINNING.MIN_LEVEL_V1", "MODEL_PINNING", "BLOCKER", _GATED, ["inputs_snapshot/model_snapshot.json"], "CHK.MODEL.PINNING_LEVEL"),
    ("VAULT_CRYPTO.ENCRYPTION_AT_REST_V1", "VAULT_CRYPTO", "BLOCKER", _ALL, ["inputs_snapshot/policy_snapshot.json", "audit_log.ndjson"], "CHK.VAULT_CRYPTO.POLICY_SNAPSHOT"),
    ("DETERMINISM.ZIP_PACKAGING_V1", "DETERMINISM", "BLOCKER", _GATED, ["<bundle_zip_bytes>", "run_manifest.json"], "CHK.DETERMINISM.ZIP_RULES"),
    ("DETERMINISM.PDF_CAPABLE_V1", "DETERMINISM", "MAJOR", _GATED, ["exports/**/deliverables/*.pdf", "run_manifest.json"], None),
)
#: What an evidence pack must deliver.
DELIVERABLES = ("evidence_index.csv", "evidence_index.md", "evidence_index.pdf", "evidence_narrative.md", "missing_evidence_checklist.md")
#: Gates that may not apply although their policy does.
MAY_NOT_APPLY = ("OFFLINE_ENFORCEMENT.ALLOWLIST_MATCH_V1", "DETERMINISM.PDF_CAPABLE_V1")
_RANK = ("MINOR", "MAJOR", "BLOCKER")
_FILES = {
    "info": "BUNDLE_INFO.json", "manifest": "run_manifest.json", "report": "eval_report.json", "artifacts": "inputs_snapshot/artifact_list.json", "policy_text": "inputs_snapshot/policy_snapshot.json",
    "network": "inputs_snapshot/network_snapshot.json", "model": "inputs_snapshot/model_snapshot.json", "audit": "audit_log.ndjson", "hashes": "artifact_hashes.csv",
}
_AUDIT_KEYS = ("ts_utc", "event_type", "run_id", "vault_id", "actor", "details", "prev_event_hash", "event_hash")
_REVIEW = "^exports/[^/]+/deliverables/evidence_mapping_review[.]json$"
REPORT = "overall_status string, registry_version string, gates array<struct<gate_id:string,category:string,status:string,severity:string,message:string,evidence_pointers:array<string>>>"


def gate_registry(pack: str) -> tuple:
    """The gates, with those of the evidence pack, whose id is ``pack``."""
    at, name = f"exports/{pack}/deliverables/", pack.upper()
    return (*GATES, (f"{name}.OUTPUTS_PRESENT_V1", name, "BLOCKER", _ALL, [at + f for f in DELIVERABLES], None), (f"{name}.MAPPING_REVIEW_PRESENT_V1", name, "BLOCKER", _ALL, [at + "evidence_mapping_review.json"], None))


def registry_table(spark, pack: str) -> DataFrame:
    """The gates as a table: gate_id, category, severity, policies, evidence (sorted), decided_by."""
    rows = [(g, c, s, p, sorted(e), d) for g, c, s, p, e, d in gate_registry(pack)]
    return spark.createDataFrame(rows, "gate_id string, category string, severity string, policies array<string>, evidence array<string>, decided_by string")


def not_applicable_allowed(gate_id: Column, pack_id: Column, pack: str) -> Column:
    """Whether a gate may be NOT_APPLICABLE in a pack: gates of the evidence pack may in any other."""
    return gate_id.isin(*MAY_NOT_APPLY) | (gate_id.startswith(pack.upper() + ".") & F.coalesce(pack_id != pack, F.lit(True)))


def eval_status(gates: Column) -> Column:
    """FAIL if a BLOCKER failed, WARN if any gate failed or warned, else PASS, of an array of structs with status and severity."""
    return F.when(F.exists(gates, lambda g: (g["status"] == "FAIL") & (g["severity"] == "BLOCKER")), "FAIL").when(F.exists(gates, lambda g: g["status"].isin("FAIL", "WARN")), "WARN").otherwise("PASS")


def _path(text: str | Column, path: str) -> Column:
    return F.get_json_object(text, path)


def _is_true(text: Column, path: str) -> Column:
    """Whether a JSON text has a true (no text) at a path."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return F.coalesce((F.get_json_object(text, path) == "true") & (kind == "BOOLEAN"), F.lit(False))


def _json(text: str) -> Column:
    return F.try_parse_json(text).isNotNull()


def _facts(bundles: DataFrame, entries: DataFrame) -> DataFrame:
    """A row a bundle: its single files' texts, and what its paths alone show."""
    path = F.col("path")
    last = lambda name: F.max(F.when(path == name, F.col("content")))
    found = [F.bool_or(path.startswith(r) if r.endswith("/") else path == r) for r in REQUIRED_FILES]
    ends = lambda tail: path.endswith(f"attachments/{tail}.json")
    file = ~path.endswith("/")
    zip_rule = (
        F.when(file & (F.col("method") != "DEFLATE"), F.concat(F.lit("not DEFLATE: "), path)).when(F.col("mtime") != "1980-01-01 00:00:00", F.concat(F.lit("timestamp not fixed: "), path))
        .when(F.col("mode") != F.when(file, 0o644).otherwise(0o755), F.concat(F.lit("mode not normal: "), path))
    )
    # texts go by their own way, those that are judged alone; nothing else is shuffled with them, and a plan that reads a few of them shuffles only these
    held = path.isin(*_FILES.values()) | ends("citations_map") | ends("redactions_map") | path.rlike(_REVIEW)
    texts = entries.where(held).groupBy("bundle_id").agg(
        *[last(name).alias(k) for k, name in _FILES.items()],
        F.min(F.when(ends("citations_map"), path)).alias("citations_path"), F.min_by(F.when(ends("citations_map"), F.col("content")), F.when(ends("citations_map"), path)).alias("citations"),
        F.min(F.when(ends("redactions_map"), path)).alias("redactions_path"), F.min_by(F.when(ends("redactions_map"), F.col("content")), F.when(ends("redactions_map"), path)).alias("redactions"),
        F.max(F.when(path.rlike(_REVIEW), F.struct("path", "content"))).alias("review"),
    )
    rows = before(entries.select("bundle_id", "ord", "path", zip_rule.alias("zip_rule")), "path", "bundle_id", "ord", "path_before")
    paths = rows.withColumn("unsorted", F.coalesce(F.col("path_before") > path, F.lit(False))).groupBy("bundle_id").agg(
        F.collect_set(F.when(path.isin(*_FILES.values()), path)).alias("have"), F.array(*found).alias("found"), F.bool_or(path.startswith("exports/") & ends("templates_used")).alias("layout"),
        F.bool_or("unsorted").alias("unsorted"), F.min_by("zip_rule", F.when(F.col("zip_rule").isNotNull(), F.col("ord"))).alias("zip_rule"),
        F.collect_set(F.when(path.rlike("^exports/[^/]+/deliverables/evidence_"), path)).alias("evidence_paths"), F.collect_set(F.when(path.rlike("^exports/[^/]+/deliverables/missing_evidence_checklist"), path)).alias("checklist_paths"),
    )
    comment = F.col("comment") if "comment" in bundles.columns else F.lit("")
    return bundles.select("bundle_id", "policy", comment.alias("comment")).join(paths, "bundle_id", "left").join(texts, "bundle_id", "left")


def audit_lines(facts: DataFrame) -> DataFrame:
    """The lines of audit logs that aren't blank: bundle_id, line_no, line, the first thing wrong with a line, and the fields that checks read."""
    lines = facts.select("bundle_id", F.get_json_object("manifest", "$.run_id").alias("run"), F.posexplode(F.split("audit", "\r?\n")).alias("k", "line")).where(F.trim("line") != "")
    fields = F.try_variant_get(F.try_parse_json("line"), "$", "map<string,variant>")
    rows = lines.select("bundle_id", "run", (F.col("k") + 1).alias("line_no"), "line", fields.alias("m"), _path("line", "$.event_hash").alias("event_hash"))
    quoted = lambda k: F.to_json(F.array(k))
    member = lambda k: F.concat(F.regexp_replace(quoted(k), r"^\[|\]$", ""), F.lit(":"), F.when(k == "event_hash", F.lit(f'"{ZERO}"')).otherwise(F.to_json(F.element_at("m", k))))
    own = F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys("m")), member), ","), F.lit("}")).cast("binary"), 256)
    rows = before(rows, "event_hash", "bundle_id", "line_no", "hash_before")
    last = F.coalesce("hash_before", F.lit(ZERO))
    at = lambda text: F.concat(F.lit(text), F.lit(" at line "), F.col("line_no").cast("string"))
    lacks = F.element_at(F.array_append(F.filter(F.array(*map(F.lit, _AUDIT_KEYS)), lambda k: ~F.coalesce(F.map_contains_key("m", k), F.lit(False))), ""), 1)
    wrong = (
        F.when(F.try_parse_json("line").isNull(), at("not JSON")).when(lacks != "", F.concat(F.lit("missing key "), lacks, F.lit(" at line "), F.col("line_no").cast("string")))
        .when(~F.coalesce(_path("line", "$.prev_event_hash") == last, F.lit(False)), at("link broken")).when(~integers_only(F.col("line")), at("not canonical")).when(~F.coalesce(own == F.col("event_hash"), F.lit(False)), at("hash wrong"))
    )
    d = "$.details."
    return rows.select(
        "bundle_id", "run", "line_no", "line", wrong.alias("wrong"), F.try_parse_json("line").isNull().alias("broken"), _path("line", "$.event_type").alias("event_type"), _path("line", "$.run_id").alias("run_id"),
        _path("line", d + "evidence_origin").alias("origin"), _path("line", d + "block_reason").alias("reason"), _path("line", d + "allowlist_rule_id").alias("rule_id"), _path("line", d + "key_storage").alias("key_storage"),
    )


def audit_facts(lines: DataFrame) -> DataFrame:
    """A row a bundle: the first fault of its chain, that of a control simulation's audit, counts of egress events, and whether key storage is told."""
    t, egress = F.col("event_type"), F.col("event_type").isin("EGRESS_REQUEST_ALLOWED", "EGRESS_REQUEST_BLOCKED")
    simulated = F.coalesce(F.col("origin") == "CONTROL_SIMULATION", F.lit(False))
    at = F.col("line_no").cast("string")
    fault = (
        F.when(F.col("broken"), F.concat(F.lit("audit not JSON at line "), at)).when(~F.coalesce(F.col("run_id") == F.col("run"), F.lit(False)), F.concat(F.lit("run of another case at line "), at))
        .when(egress & ~simulated, F.concat(F.lit("egress origin conflicts at line "), at)).when(t == "EGRESS_REQUEST_ALLOWED", F.concat(F.lit("egress allowed at line "), at))
    )
    blocked, observed = t == "EGRESS_REQUEST_BLOCKED", F.coalesce(F.col("origin") == "RUNTIME_OBSERVATION", F.lit(False))
    bad_reason = blocked & ~F.coalesce(F.col("reason").isin(*EGRESS_REASONS), F.lit(False))
    rows = lines.withColumn("fault", fault)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return rows.groupBy("bundle_id").agg(
        first("wrong"), first("fault"), F.count_if(blocked & simulated).alias("n_simulated"), F.count_if(blocked & observed).alias("n_observed"), F.count_if(blocked & ~simulated & ~observed).alias("n_ambiguous"),
        F.count_if(t == "ALLOWLIST_UPDATED").alias("n_updates"), F.array_join(F.array_sort(F.collect_set(F.when(bad_reason, F.coalesce("reason", F.lit(""))))), ", ").alias("bad_reasons"), F.count_if(bad_reason).alias("n_bad"),
        F.count_if((t == "EGRESS_REQUEST_ALLOWED") & (F.coalesce("rule_id", F.lit("")) == "")).alias("n_no_rule"), F.min(F.when(F.col("broken"), F.col("line_no"))).alias("broken_line"),
        F.bool_or((t == "VAULT_ENCRYPTION_STATUS") & F.col("key_storage").isin("MACOS_KEYCHAIN", "WINDOWS_DPAPI", "FILE_FALLBACK")).alias("key_storage"),
    )


def hash_faults(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(bundle_id, hash_fault): the first fault of each bundle's list of hashes; order comes before all else. A quoted field may not hold a line end."""
    lines = facts.select("bundle_id", _path("policy_text", "$.export_profile.inputs").alias("profile"), F.size(F.split(F.element_at(F.split("hashes", "\r?\n"), 1), ",")).alias("width"), F.posexplode(F.split("hashes", "\r?\n")).alias("row", "line")).where("row > 0 and line <> ''")
    field = F.from_csv("line", F.lit("a string, p string, s string, b string"), {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""})
    n_fields = F.size(F.split(F.regexp_replace("line", '"(?:[^"]|"")*"', ""), ",", -1))
    rows = lines.select("bundle_id", "profile", "row", F.coalesce(field["a"], F.lit("")).alias("artifact_id"), F.coalesce(field["p"], F.lit("")).alias("path"), F.coalesce(field["s"], F.lit("")).alias("sha"), F.coalesce(field["b"].try_cast("long"), F.lit(0)).alias("size"), (n_fields != F.col("width")).alias("ragged"))
    key = F.struct("artifact_id", "path")
    rows = before(rows, key, "bundle_id", "row", "row_before")
    rows = rows.withColumn("unsorted", F.coalesce(F.col("row_before") > key, F.lit(False)))
    actual = entries.select("bundle_id", "path", F.col("sha256").alias("a_sha"), F.col("bytes").alias("a_bytes"), F.lit(True).alias("there"))
    inputs = entries.where(F.col("path").rlike("^inputs_snapshot/artifacts/.*/bytes$")).select("bundle_id", F.regexp_extract("path", "^inputs_snapshot/artifacts/(.*)/bytes$", 1).alias("artifact_id"), F.lit(True).alias("input"))
    joined = rows.join(actual, ["bundle_id", "path"], "left").join(inputs.distinct(), ["bundle_id", "artifact_id"], "left")
    needs = (F.col("profile") == "INCLUDE_INPUT_BYTES") & ~F.col("artifact_id").startswith("o:") & F.col("input").isNull()
    fault = (
        F.when(F.col("path") == "", None).when(F.col("there").isNull(), F.concat(F.lit("path missing: "), "path")).when(F.col("a_bytes") != F.col("size"), F.concat(F.lit("size differs: "), "path"))
        .when(F.col("a_sha") != F.col("sha"), F.concat(F.lit("sha256 differs: "), "path")).when(needs, F.concat(F.lit("input bytes missing: "), "artifact_id"))
    )
    joined = joined.withColumn("fault", fault)
    out = joined.groupBy("bundle_id").agg(F.bool_or("ragged").alias("ragged"), F.bool_or("unsorted").alias("unsorted"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("row"))).alias("fault"))
    return out.select("bundle_id", F.when(F.col("ragged"), "not CSV").when(F.col("unsorted"), "rows not sorted").otherwise(F.col("fault")).alias("hash_fault"))


_CLAIMS = "array<struct<claim_id:string,citations:array<struct<artifact_id:string,locator_type:string,locator:struct<start_char:long,end_char:long,bbox:struct<x:double,y:double,w:double,h:double>>>>>>"
_REDACTED = "array<struct<artifact_id:string,redactions:array<struct<redaction_type:string,region:struct<start_char:long,end_char:long,bbox:struct<x:double,y:double,w:double,h:double>>>>>>"
_ARTIFACTS = "array<struct<artifact_id:string,classification:string,tags:array<string>>>"


def uncited(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(bundle_id, uncited): the claims marked in deliverables that the first citations map doesn't cite, joined by commas."""
    texts = entries.where(F.col("path").startswith("exports/") & F.col("path").contains("/deliverables/") & F.col("path").endswith(".md"))
    marked = texts.select("bundle_id", F.explode(claim_markers(F.col("content"))).alias("claim_id")).distinct()
    claims = facts.select("bundle_id", F.explode(F.from_json(_path("citations", "$.claims"), _CLAIMS)).alias("c")).where("size(c.citations) > 0").select("bundle_id", "c.claim_id").distinct()
    return marked.join(claims, ["bundle_id", "claim_id"], "left_anti").groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), ", ").alias("uncited"))


def unredacted(facts: DataFrame) -> DataFrame:
    """(bundle_id, unredacted): claim:artifact of citations of sensitive artifacts that no redaction covers, in their order, joined by commas."""
    cited = facts.select("bundle_id", F.posexplode(F.from_json(_path("citations", "$.claims"), _CLAIMS)).alias("k", "c")).select("bundle_id", "k", F.coalesce("c.claim_id", F.lit("UNKNOWN")).alias("claim_id"), F.posexplode("c.citations").alias("i", "x"))
    cited = cited.select("bundle_id", "k", "i", "claim_id", "x.artifact_id", F.col("x.locator_type").alias("kind"), F.col("x.locator").alias("l"))
    known = facts.select("bundle_id", F.explode(F.from_json(_path("artifacts", "$.artifacts"), _ARTIFACTS)).alias("a")).where(sensitive(F.coalesce("a.classification", F.lit("")), F.coalesce("a.tags", F.array().cast("array<string>")))).select("bundle_id", "a.artifact_id").distinct()
    red = facts.select("bundle_id", F.explode(F.from_json(_path("redactions", "$.artifacts"), _REDACTED)).alias("a")).select("bundle_id", F.col("a.artifact_id").alias("artifact_id"), F.explode("a.redactions").alias("r"))
    cited = cited.join(known, ["bundle_id", "artifact_id"], "left_semi")
    keys = ("bundle_id", "artifact_id")
    spans = lambda l: [F.col(f"{l}.start_char").alias("start"), F.col(f"{l}.end_char").alias("end")]
    boxes = lambda l: [F.col(f"{l}.bbox.{c}").alias(c) for c in "xywh"]
    own, kind = [*keys, "k", "i", "claim_id"], F.coalesce("kind", F.lit(""))
    boxed = kind.isin("IMAGE_BBOX_V1", "PDF_BBOX_V1")
    of = lambda name, what: red.where(F.col("r.redaction_type") == name).select(*keys, *what("r.region"))
    bare = (
        cited.where((kind != "PDF_TEXT_SPAN_V1") & ~boxed).select(*own)
        .unionByName(uncovered_spans(cited.where(kind == "PDF_TEXT_SPAN_V1").select(*own, *spans("l")), of("TEXT_SPAN", spans), keys).select(*own))
        .unionByName(uncovered_boxes(cited.where(boxed).select(*own, *boxes("l")), of("IMAGE_BBOX", boxes), keys).select(*own))
    )
    named = F.transform(F.array_sort(F.collect_list(F.struct("k", "i", F.concat_ws(":", "claim_id", "artifact_id").alias("x")))), lambda s: s["x"])
    return bare.groupBy("bundle_id").agg(F.array_join(named, ", ").alias("unredacted"))


def report_fault(report: Column, policy: Column, pack_id: Column, gate_status: Column, pack: str) -> Column:
    """The first fault of an eval report (a struct of ``REPORT``), null if it authorises."""
    rows = gate_registry(pack)
    rank = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, _RANK)), s), F.lit(0))
    table = F.create_map(*[x for g, c, s, p, e, _ in rows for x in (F.lit(g), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.array(*map(F.lit, p)).alias("policies"), F.array(*map(F.lit, sorted(e))).alias("evidence")))])
    gates = report["gates"]
    ids = F.transform(gates, lambda g: g["gate_id"])

    def fault(g: Column, i: Column) -> Column:
        own = F.try_element_at(table, g["gate_id"])
        tests = (
            ("empty gate_id", F.trim(g["gate_id"]) == ""), ("duplicate gate", F.array_contains(F.slice(ids, F.lit(1), i), g["gate_id"])), ("unknown gate", own.isNull()), ("invalid status of gate", ~g["status"].isin("PASS", "FAIL", "NOT_APPLICABLE")),
            ("NOT_APPLICABLE refused for gate", (g["status"] == "NOT_APPLICABLE") & ~not_applicable_allowed(g["gate_id"], pack_id, pack)), ("invalid severity of gate", rank(g["severity"]) == 0), ("category differs for gate", g["category"] != own["category"]),
            ("severity lowered for gate", rank(g["severity"]) < rank(own["severity"])), ("evidence differs for gate", F.array_sort(g["evidence_pointers"]) != own["evidence"]),
        )
        return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.concat_ws(" ", F.lit(name), g["gate_id"])) for name, bad in tests])

    faults = F.array_compact(F.transform(gates, fault))
    due = F.array_sort(F.filter(F.array(*[F.lit(g) for g, *_ in rows]), lambda g: F.array_contains(F.element_at(table, g)["policies"], policy)))
    missing, more = F.array_except(due, ids), F.array_sort(F.array_except(ids, due))
    version, overall = report["registry_version"], report["overall_status"]
    return (
        F.when(report.isNull() | version.isNull() | overall.isNull() | gates.isNull(), "report unreadable").when(gate_status.isNull(), "manifest lacks eval.gate_status").when(F.coalesce(pack_id, F.lit("")) == "", "bundle info lacks pack_id")
        .when(version.isin("gates_registry_v1", "gates_registry_v2"), F.concat(F.lit("older registry "), version)).when(version != "gates_registry_v3", F.concat(F.lit("unknown registry "), version)).when(~overall.isin("PASS", "FAIL", "WARN"), F.concat(F.lit("invalid overall status "), overall))
        .when(F.size(gates) == 0, "no gates").when(F.size(faults) > 0, F.try_element_at(faults, F.lit(1))).when(F.size(missing) > 0, F.concat(F.lit("gates missing: "), F.array_join(missing, ", "))).when(F.size(more) > 0, F.concat(F.lit("gates of other policies: "), F.array_join(more, ", ")))
        .when(overall != eval_status(gates), "overall status contradicts gates").when(gate_status != overall, "manifest contradicts report").when(overall == "FAIL", "blocker gates failed")
    )


def _judged(bundles: DataFrame, entries: DataFrame) -> DataFrame:
    facts = _facts(bundles, entries)
    for more in (audit_facts(audit_lines(facts)), hash_faults(facts, entries), uncited(facts, entries), unredacted(facts)):
        facts = facts.join(more, "bundle_id", "left")
    return facts


def check_bundles(bundles: DataFrame, entries: DataFrame, pack: str, preflight: bool = False) -> DataFrame:
    """All twelve checks of every bundle. ``preflight`` defers the report's own gates, as before they are evaluated. A bundle without entries fails, an empty table stays empty."""
    return _checks(_judged(bundles, entries), pack, preflight)


def _checks(facts: DataFrame, pack: str, preflight: bool) -> DataFrame:
    # the array is never empty; of a plain explode the planner infers a filter on it, which judges every bundle a second time
    rows = _judgements(facts, pack, preflight).select("bundle_id", "policy", F.explode_outer("checks").alias("c"))
    return rows.select("bundle_id", "policy", "c.*")


def _judgements(facts: DataFrame, pack: str, preflight: bool) -> DataFrame:
    """``facts`` with the array ``checks`` of each bundle: check_id, severity, result, message.

    What is parsed, and what several conditions read, stands in columns of its own (``__``): within the conditions each would parse it again.
    """
    parsed = {f"__bad_{k}": F.when(F.col(k).isNull() | ~_json(k), F.lit(f"unreadable: {_FILES[k]}")) for k in ("info", "manifest", "report", "artifacts", "policy_text", "network", "model")}
    parsed |= {"__m": F.from_json("manifest", f"run_id string, evidence_authority struct<{AUTHORITY}>"), "__report": F.from_json("report", REPORT), "__fixed_zip": _is_true(F.col("policy_text"), "$.determinism.enabled")}
    policy, have = F.col("policy"), F.coalesce("have", F.array().cast("array<string>"))
    unreadable = lambda k: F.col(f"__bad_{k}")
    lacking = F.array_compact(F.transform(F.arrays_zip(F.coalesce("found", F.array_repeat(F.lit(False), len(REQUIRED_FILES))).alias("f"), F.array(*map(F.lit, REQUIRED_FILES)).alias("n")), lambda z: F.when(~z["f"], z["n"])))
    wanted = ("network_mode", "proof_level", "allowlist", "ui_remote_fetch_disabled", "adapter_endpoints")
    lacks = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(F.json_object_keys("network"), F.array().cast("array<string>")))
    remote = F.when(_is_true(F.col("network"), "$.ui_remote_fetch_disabled"), F.array().cast("array<string>")).otherwise(F.array(F.lit("ui_remote_fetch_disabled=true")))
    points = F.coalesce(F.from_json(_path("network", "$.adapter_endpoints"), "array<string>"), F.array().cast("array<string>"))
    open_ = F.array_compact(F.transform(points, lambda p, i: F.when(F.coalesce(F.get_json_object(p, "$.is_loopback"), F.lit("")) != "true", F.concat(F.lit("adapter_endpoints["), i.cast("string"), F.lit("].is_loopback=true")))))
    network = F.concat(lacks, remote, open_)
    level = F.coalesce(_path("model", "$.pinning_level"), F.lit(""))
    pinned = level.isin("CRYPTO_PINNED", "VERSION_PINNED") | ((policy == "DRAFT_ONLY") & (level == "NAME_ONLY"))
    schema = _path("info", "$.schema_versions.run_manifest")
    m = F.col("__m")
    authority = F.coalesce(
        unreadable("info"), F.when(schema == "RUN_MANIFEST_V1", "older run manifest doesn't authorise").when(F.coalesce(schema, F.lit("")) != "RUN_MANIFEST_V2", "unknown run manifest"), unreadable("manifest"),
        F.when(~F.coalesce(_path("info", "$.run_id") == _path("manifest", "$.run_id"), F.lit(False)), "run ids differ"), F.when(F.col("audit").isNull(), "unreadable: audit_log.ndjson"),
        first_failed(authority_contract(m["evidence_authority"], m["run_id"], F.col("audit"))), F.col("fault"), F.when(F.coalesce("n_simulated", F.lit(0)) == 0, "no blocked egress in the audit"),
    )
    report = F.coalesce(unreadable("report"), unreadable("manifest"), unreadable("info"), report_fault(F.col("__report"), policy, _path("info", "$.pack_id"), _path("manifest", "$.eval.gate_status"), pack))
    early = F.coalesce(unreadable("report"), F.when(F.coalesce(_path("report", "$.registry_version"), F.lit("")) != "gates_registry_v3", "unknown registry"))
    wrong_schema = lambda c, v: F.when(F.coalesce(_path(c, "$.schema_version"), F.lit("")) != v, F.lit(f"{c}: not {v}"))
    map_fault = lambda c: F.when(F.col(f"{c}_path").isNull(), f"{c} map missing").when(F.col(c).isNull() | ~_json(c), f"{c} map unreadable")
    fixed_zip = F.col("__fixed_zip")
    crypto = _is_true(F.col("policy_text"), "$.encryption_at_rest") & F.coalesce(_path("policy_text", "$.encryption_algorithm").isin("XCHACHA20_POLY1305", "AES_256_GCM"), F.lit(False))
    faults = {
        "CHK.BUNDLE.REQUIRED_FILES": F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))),
        "CHK.EXPORTS.ATTACHMENTS_LAYOUT": F.when(~F.coalesce("layout", F.lit(False)), "no attachments/templates_used.json under exports"),
        "CHK.NETWORK.SNAPSHOT_PRESENT": F.coalesce(unreadable("network"), F.when(F.size(network) > 0, F.concat(F.lit("missing fields: "), F.array_join(network, ", ")))),
        "CHK.AUDIT.REQUIRED_KEYS_AND_CHAIN": F.when(~F.array_contains(have, "audit_log.ndjson") | F.col("audit").isNull(), "unreadable: audit_log.ndjson").otherwise(F.col("wrong")),
        "CHK.EVIDENCE.AUTHORITY_CONTRACT": authority,
        "CHK.ARTIFACT_HASHES.VERIFY": F.coalesce(F.when(F.col("hashes").isNull(), "unreadable: artifact_hashes.csv"), unreadable("policy_text"), F.col("hash_fault")),
        "CHK.MODEL.PINNING_LEVEL": F.coalesce(unreadable("model"), F.when(~pinned, F.concat(F.lit("not enough: "), level))),
        "CHK.CITATIONS.STRICT": F.when(policy == "STRICT", F.coalesce(map_fault("citations"), wrong_schema("citations", "LOCATOR_SCHEMA_V1"), F.concat(F.lit("not cited: "), "uncited"))),
        "CHK.REDACTION.POLICY_GATE": F.when(policy != "DRAFT_ONLY", F.coalesce(map_fault("redactions"), wrong_schema("redactions", "REDACTION_SCHEMA_V1"), map_fault("citations"), unreadable("artifacts"), F.concat(F.lit("not redacted: "), "unredacted"))),
        "CHK.EVAL.REPORT_AND_GATES": early if preflight else report,
        "CHK.DETERMINISM.ZIP_RULES": F.coalesce(unreadable("policy_text"), F.when(fixed_zip, F.coalesce(F.when(F.coalesce("comment", F.lit("")) != "", "comment not empty"), F.col("zip_rule"), F.when(F.col("unsorted"), "entries not sorted")))),
        "CHK.VAULT_CRYPTO.POLICY_SNAPSHOT": F.coalesce(unreadable("policy_text"), F.when(~crypto, "no encryption at rest by a known algorithm"), F.when(~F.coalesce("key_storage", F.lit(False)), "key storage not told")),
    }
    idle = {"CHK.CITATIONS.STRICT": policy != "STRICT", "CHK.REDACTION.POLICY_GATE": policy == "DRAFT_ONLY", "CHK.DETERMINISM.ZIP_RULES": ~fixed_zip & unreadable("policy_text").isNull()}
    never = F.lit(False)
    minor = lambda k: F.coalesce(idle[k], never) if k == "CHK.DETERMINISM.ZIP_RULES" else never
    message = lambda k, x: F.coalesce(x, F.when(F.coalesce(idle.get(k, never), never), "not applicable").otherwise("ok"))
    told = {k: F.col(f"__fault_{n}") for n, k in enumerate(faults)}
    one = [F.struct(F.lit(k).alias("check_id"), F.when(minor(k), "MAJOR").otherwise("BLOCKER").alias("severity"), F.when(x.isNull(), "PASS").otherwise("FAIL").alias("result"), message(k, x).alias("message")) for k, x in told.items()]
    rows = facts.withColumns(parsed).withColumns({f"__fault_{n}": x for n, x in enumerate(faults.values())})
    return rows.withColumn("checks", F.array(*one)).drop(*parsed, *[f"__fault_{n}" for n in range(len(faults))])


def bundle_verdict(checks: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Per bundle: checks, those not PASS, and FAIL if one of these is a BLOCKER, NOT_APPLICABLE ones too."""
    bad = F.col("result") != "PASS"
    out = checks.groupBy(key).agg(F.count("*").alias("n_checks"), F.count_if(bad).alias("n_failed"), F.bool_or(bad & (F.col("severity") == "BLOCKER")).alias("blocked"))
    return out.select(key, "n_checks", "n_failed", F.when(F.col("blocked"), "FAIL").otherwise("PASS").alias("overall"))


def evaluate_gates(bundles: DataFrame, entries: DataFrame, pack: str, registry: DataFrame | None = None) -> DataFrame:
    """(bundle_id, gate_id, category, severity, result, message, evidence_pointers): every gate that applies to a bundle's policy.

    A gate follows the check that its registry row names, or all checks of a prefix (ending in a dot), which must be there; five
    gates are decided here. A gate that neither names a check nor is known here is a BLOCKER and fails.
    """
    facts = _judgements(_judged(bundles, entries), pack, True)
    registry = registry_table(entries.sparkSession, pack) if registry is None else registry
    checks = F.map_from_entries(F.transform("checks", lambda c: F.struct(c["check_id"], F.struct(c["result"].alias("result"), c["message"].alias("message")))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda text: F.struct(F.lit("FAIL").alias("result"), (F.lit(text) if isinstance(text, str) else text).alias("message"))
    idle = lambda text: F.struct(F.lit("NOT_APPLICABLE").alias("result"), (F.lit(text) if isinstance(text, str) else text).alias("message"))
    ok = F.struct(F.lit("PASS").alias("result"), F.lit("ok").alias("message"))
    blocked = zero("n_simulated") + zero("n_observed") + zero("n_ambiguous")
    allowlist = (
        F.when(F.col("broken_line").isNotNull(), no(F.concat(F.lit("audit not JSON at line "), F.col("broken_line").cast("string")))).when(zero("n_updates") == 0, no("allowlist never set")).when(blocked == 0, no("no blocked egress")).when(zero("n_ambiguous") > 0, no("egress of unclear origin"))
        .when(zero("n_bad") > 0, no(F.concat(F.lit("invalid reasons: "), "bad_reasons"))).when(zero("n_no_rule") > 0, no("egress allowed without a rule")).when(zero("n_observed") == 0, idle("only simulated egress")).otherwise(ok)
    )
    own = F.coalesce(_path("info", "$.pack_id") == pack, F.lit(False))
    at = f"exports/{pack}/deliverables/"
    need = F.array(*[F.lit(at + f) for f in DELIVERABLES])
    lacks = F.array_except(need, F.concat(F.coalesce("evidence_paths", F.array().cast("array<string>")), F.coalesce("checklist_paths", F.array().cast("array<string>"))))
    outputs = F.when(~own, idle("another pack")).when(F.size(lacks) > 0, no(F.concat(F.lit("missing: "), F.try_element_at(lacks, F.lit(1))))).otherwise(ok)
    review = F.when(F.col("review.path") == at + "evidence_mapping_review.json", F.col("review.content"))
    mapping = F.when(~own, idle("another pack")).when(review.isNull(), no("mapping review missing")).when(F.try_parse_json(review).isNull(), no("mapping review not JSON")).when(F.coalesce(_path(review, "$.schema_version"), F.lit("")) != "EVIDENCE_MAPPING_REVIEW_V1", no("mapping review of another schema")).otherwise(ok)
    name = pack.upper()
    decided = F.create_map(F.lit("OFFLINE_ENFORCEMENT.ALLOWLIST_MATCH_V1"), allowlist, F.lit("DETERMINISM.PDF_CAPABLE_V1"), idle("no PDF here"), F.lit(f"{name}.OUTPUTS_PRESENT_V1"), outputs, F.lit(f"{name}.MAPPING_REVIEW_PRESENT_V1"), mapping)
    rows = facts.select("bundle_id", F.col("policy").alias("p"), decided.alias("decided"), checks.alias("checks"))
    by = registry.select("*", F.explode("policies").alias("p")).drop("policies")
    rows = rows.join(F.broadcast(by), "p")  # a few gates; by policies all bundles would fall into three groups
    prefixed = F.map_values(F.map_filter("checks", lambda k, v: k.startswith(F.col("decided_by"))))
    of_prefix = F.when(F.size(prefixed) == 0, no("no such checks")).when(F.exists(prefixed, lambda v: v["result"] != "PASS"), no("a check failed")).otherwise(ok)
    exact = F.coalesce(F.try_element_at("checks", F.col("decided_by")), no("no such check"))
    known = F.col("decided_by").isNotNull() | F.map_contains_key("decided", F.col("gate_id"))
    got = F.when(F.col("decided_by").endswith("."), of_prefix).when(F.col("decided_by").isNotNull(), exact).when(known, F.try_element_at("decided", F.col("gate_id"))).otherwise(no("nothing decides this gate"))
    return rows.withColumn("got", got).select("bundle_id", "gate_id", "category", F.when(known, F.col("severity")).otherwise("BLOCKER").alias("severity"), "got.result", "got.message", F.col("evidence").alias("evidence_pointers"))


def materialised_reports(gates: DataFrame, bundles: DataFrame, pack: str) -> DataFrame:
    """(bundle_id, report, reject_reason): the report struct of each bundle (bundle_id, policy, pack_id) from its evaluated gates; faults leave it null."""
    row = F.struct("gate_id", "category", F.col("result").alias("status"), "severity", "message", "evidence_pointers")
    sets = gates.groupBy("bundle_id").agg(F.array_sort(F.collect_list(row)).alias("gates"))
    rows = bundles.select("bundle_id", "policy", "pack_id").join(sets, "bundle_id", "left").withColumn("gates", F.coalesce("gates", F.array().cast(REPORT.split("gates ")[1])))
    report = F.struct(eval_status(F.col("gates")).alias("overall_status"), F.lit("gates_registry_v3").alias("registry_version"), F.col("gates"))
    fault = report_fault(report, F.col("policy"), F.trim("pack_id"), report["overall_status"], pack)
    reason = F.when(fault != "blocker gates failed", fault)
    return rows.withColumn("reject_reason", reason).select("bundle_id", F.when(F.col("reject_reason").isNull(), report).alias("report"), "reject_reason")


def gate_satisfied(report: Column, gate_id: str, policy: Column, pack: str) -> Column:
    """Whether a gate lets an export pass: unknown gates never do, those of other policies always, others with one PASS or NOT_APPLICABLE."""
    policies = {g: p for g, _, _, p, _, _ in gate_registry(pack)}.get(gate_id)
    if policies is None:
        return F.lit(False)
    own = F.filter(report["gates"], lambda g: g["gate_id"] == gate_id)
    one = (F.size(own) == 1) & F.coalesce(F.try_element_at(own, F.lit(1))["status"].isin("PASS", "NOT_APPLICABLE"), F.lit(False))
    return ~policy.isin(*policies) | F.coalesce(one, F.lit(False))
