"""Queries over bundles, gates, receipts, policies, claims and patches, each with one variant a rule.

Variants are whole documents, written here with one fault each; customers, parts and orders pick theirs by number. The SQL
names what each variant must give, so it knows nothing of the operators.
"""

from __future__ import annotations

import copy
import hashlib
import json

from pyspark.sql import functions as F

from ..operators import policies, validation
from .registry import dealt, query, table

PACK = "evidencepack"
_ZERO, _SHA = "0" * 64, "ab" * 32


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _canonical(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _changed(document: dict, path: str, value) -> dict:
    """A copy of a document with the value at a dotted path set (None: removed)."""
    out = copy.deepcopy(document)
    *way, last = path.split(".")
    at = out
    for k in way:
        at = at[int(k) if isinstance(at, list) else k]
    key = int(last) if isinstance(at, list) else last
    if value is None:
        del at[key]
    else:
        at[key] = value
    return out


def _expected(rows: list[tuple], *columns: str) -> str:
    """VALUES (variant, expected ...) as SQL."""
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) w({', '.join(columns)})"


# policies and receipts

POLICY = {
    "schema_version": "POLICY_V1", "policy_id": "p", "backend_id": "OCI_ZERO_EGRESS_V1", "input_tree_sha256": _SHA, "image_id": f"sha256:{_SHA}", "argv": ["run", "--all"], "working_directory": "/work",
    "filesystem": {"immutable_input_path": "/input", "writable_workspace_path": "/work", "output_path_allowlist": ["out/a.patch", "b"], "max_output_bytes": 4096, "host_mounts_allowed": False},
    "network": {"mode": "DENY_ALL", "blocked_classes": ["PROXY", "DNS", "IPV4", "IPV6", "METADATA", "LOOPBACK", "UNIX_SOCKET"]},
    "process": {"child_processes_allowed": True, "pid_limit": 64, "wall_time_ms": 60000, "controller_death_cleanup_required": True, "trusted_init_required": True},
    "resources": {"memory_bytes": 1 << 28, "memory_swap_bytes": 1 << 28, "cpu_quota_millis": 1000, "workspace_bytes": 1 << 26, "max_file_bytes": 1 << 20, "max_open_files": 256},
    "environment": {"allowed_keys": ["HOME", "LANG", "TMPDIR", "PATH"], "secrets": "NONE", "synthetic_home": "/work/home", "synthetic_tmp": "/tmp"},
    "export": {"patch_only": True, "review_required": True, "reviewer_kind": "HUMAN", "max_patch_bytes": 4096}, "evidence": {"required_control_ids": ["c1", "c2"], "require_effective_policy_readback": True, "require_zero_residue": True, "maximum_claim": "BOUNDED"},
}
POLICY_FAULTS = (
    ("policy_id", "p", ""), ("network.blocked_classes", ["DNS", "DNS"], "sets,network"), ("environment.allowed_keys", ["A", "A"], "sets"), ("schema_version", "POLICY_V0", "schema"), ("schema_version", None, "schema"), ("backend_id", "OTHER", "backend"), ("policy_id", "  ", "identities"),
    ("input_tree_sha256", "AB" * 32, "identities"), ("image_id", _SHA, "identities"), ("argv", [], "argv"), ("argv", ["run", ""], "argv"), ("working_directory", "/other", "roots"), ("filesystem.immutable_input_path", "input", "roots"),
    ("filesystem.immutable_input_path", "/work/in", "roots"), ("environment.synthetic_tmp", "/work/tmp", "roots"), ("environment.synthetic_tmp", "/input", "roots"), ("environment.synthetic_home", "/work", "roots"), ("environment.synthetic_home", "/home", "roots"), ("environment.synthetic_home", "/work/../x", "roots"),
    ("filesystem.host_mounts_allowed", True, "roots"), ("filesystem.output_path_allowlist", [], "outputs"), ("filesystem.output_path_allowlist", ["a", "a"], "outputs"), ("filesystem.output_path_allowlist", ["../a"], "outputs"), ("filesystem.output_path_allowlist", ["/a"], "outputs"), ("filesystem.max_output_bytes", 0, "outputs"),
    ("filesystem.max_output_bytes", 1, "outputs"), ("network.mode", "ALLOW", "network"), ("network.blocked_classes", ["DNS"], "network"), ("environment.secrets", "ALL", "environment"), ("environment.allowed_keys", [], "environment"), ("environment.allowed_keys", ["my_token"], "environment"),
    ("environment.allowed_keys", ["AWS_REGION"], "environment"), ("environment.allowed_keys", ["A=B"], "environment"), ("process.child_processes_allowed", False, "ceilings"), ("process.pid_limit", 0, "ceilings"), ("process.wall_time_ms", 0, "ceilings"), ("process.controller_death_cleanup_required", False, "ceilings"),
    ("process.trusted_init_required", False, "ceilings"), ("resources.memory_bytes", 0, "ceilings"), ("resources.memory_swap_bytes", 1, "ceilings"), ("resources.cpu_quota_millis", 0, "ceilings"), ("resources.workspace_bytes", 0, "ceilings"), ("resources.max_file_bytes", 0, "ceilings"), ("resources.max_open_files", 0, "ceilings"),
    ("export.patch_only", False, "export"), ("export.review_required", False, "export"), ("export.reviewer_kind", " ", "export"), ("export.max_patch_bytes", 0, "outputs,export"), ("evidence.required_control_ids", [], "evidence"), ("evidence.required_control_ids", ["a", "a"], "sets"),
    ("evidence.require_effective_policy_readback", False, "evidence"), ("evidence.require_zero_residue", False, "evidence"), ("evidence.maximum_claim", "", "evidence"), ("evidence", None, "sets,evidence"),
)
_N_POLICY = len(POLICY_FAULTS)


def _variants(spark, texts: list[str], schema: str = "variant int, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


@query("execution_policies", f"SELECT o_orderkey, failed FROM orders JOIN {_expected([(k, e) for k, (_, _, e) in enumerate(POLICY_FAULTS)], 'variant', 'failed')} ON o_orderkey % {_N_POLICY} = variant")
def execution_policies(spark, sf_dir):
    texts = _variants(spark, [json.dumps(_changed(POLICY, path, value)) for path, value, _ in POLICY_FAULTS])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % _N_POLICY).alias("variant")).join(texts, "variant").withColumn("p", F.from_json("text", policies.EXECUTION_POLICY))
    return policies.validate_policies(rows, policies.execution_policy_rules(F.col("p"), "POLICY_V1")).select("o_orderkey", F.array_join("failed_rules", ",").alias("failed"))


_SECCOMP = {"architectures": ["SCMP_ARCH_X86_64"], "defaultAction": "SCMP_ACT_ERRNO"}
_PROFILE = _sha(_canonical(_SECCOMP))
_MOUNT = "rw,nosuid,nodev,size={},mode=0700,uid=65534,gid=65534"
_ENV = {"HOME": "/work/home", "TMPDIR": "/tmp", "LANG": "C.UTF-8"}
_SAMPLE = {"elapsed_ms": 400, "cleanup_ms": 30, "peak_disk_bytes": 1000}
RECEIPT = {
    "schema_version": "RECEIPT_V1", "run_id": "r1", "result": "PASS", "requested_policy": POLICY, "subject_identity": {"fixture_id": "f", "fixture_sha256": _SHA, "input_tree_sha256": _SHA, "argv": ["run", "--all"]},
    "backend_identity": {"backend_id": "OCI_ZERO_EGRESS_V1", "engine_endpoint": "unix:///run/d.sock", "daemon_id": "d", "architecture": "x86_64", "engine_version": "1", "runtime_version": "1", "kernel_version": "6", "image_id": f"sha256:{_SHA}", "enforcement_profile_sha256": _PROFILE, "controller_build": "b", "controller_executable_sha256": _SHA},
    "effective_policy": {
        "readback_complete": True, "image_id": f"sha256:{_SHA}", "enforcement_profile_sha256": _PROFILE, "seccomp_architectures": ["SCMP_ARCH_X86_64"], "argv": ["run", "--all"], "working_directory": "/work", "user": "65534:65534", "network_mode": "none", "readonly_root": True,
        "mount_count": 0, "host_mount_count": 0, "host_config_mount_count": 0, "runtime_mount_count": 0, "cap_drop": ["ALL"], "security_options": ["no-new-privileges", "seccomp=" + json.dumps(_SECCOMP)], "init_enabled": True, "init_implementation": "docker-init", "init_version": "0.19",
        "pid_limit": 64, "memory_bytes": 1 << 28, "memory_swap_bytes": 1 << 28, "cpu_quota_nanos": 1_000_000_000, "tmpfs": {"/work": _MOUNT.format(1 << 26), "/tmp": _MOUNT.format(1 << 20) + ",noexec"}, "ulimits": {"nofile": 256, "fsize": 1 << 20},
        "environment_key_names": ["HOME", "LANG", "PATH", "TMPDIR"], "environment": _ENV, "observed_environment": {**_ENV, "PATH": "/bin"},
    },
    "observed_effects": [{"effect_id": k, "effect_class": "NETWORK", "attempted": True, "allowed": False, "persisted": False, "evidence_origin": "TRUSTED_SENSOR", "sensor_identity": "s", "detail": "d"} for k in ("e1", "e2")],
    "controls": [{"control_id": c, "control_kind": "NEGATIVE", "expected": "blocked", "observed": "blocked", "evidence_refs": [{"effect_id": e, "expected_attempted": True, "expected_allowed": False}], "result": "PASS"} for c, e in (("c1", "e1"), ("c2", "e2"))],
    "cleanup": {"attempted": True, "completed": True, **{f"{k}_remaining": 0 for k in ("containers", "images", "networks", "volumes", "processes", "listeners", "mounts", "temporary_roots")}, "detail": "all gone"},
    "export_review": {"candidate_sha256": _SHA, "reviewed_sha256": _SHA, "exported_sha256": _SHA, "reviewer_kind": "HUMAN", "approved": True, "rejected_entries": [], "bytes": 100}, "evidence_ceiling": {"maximum_claim": "BOUNDED", "enforced": ["a"], "observed": ["b"], "unknown": ["c"], "excluded_claims": ["d"]}, "limitations": ["l"],
    "performance": {
        "cold_samples": [{"phase": "COLD_CACHED", **_SAMPLE}] * 5, "warm_samples": [{"phase": "WARM", **_SAMPLE}] * 29 + [{"phase": "WARM", **_SAMPLE, "cleanup_ms": 31, "peak_disk_bytes": 2000}], "five_second_samples": [{"phase": "FIVE_SECOND_OVERHEAD", **_SAMPLE, "elapsed_ms": 5100 + k} for k in range(5)],
        "concurrency_observations": [{"concurrency": k, "batch_wall_samples_ms": [500, 510, 520, 530, 540 + k], "batch_wall_p95_ms": 540 + k, "passed": True} for k in (1, 2, 4)], "input_bytes": 1001, "warm_start_p95_ms": 400, "cold_start_p95_ms": 400, "cleanup_p95_ms": 30, "cleanup_max_ms": 31, "added_overhead_p95_ms": 104,
        "added_overhead_percent": 3, "peak_disk_bytes": 2000, "disk_amplification_ceiling_bytes": 2502 + (128 << 20), "highest_passing_concurrency": 4, "gates_passed": True,
    },
}
_BOTH = "requested and effective"
RECEIPT_FAULTS = (
    ("run_id", "r1", ""), ("schema_version", "X", "receipt schema"), ("requested_policy.evidence.maximum_claim", " ", "requested policy,claim ceiling"), ("run_id", " ", "identities"), ("backend_identity.kernel_version", "", "identities"), ("subject_identity.fixture_sha256", "x", "fixture digest"), ("effective_policy.readback_complete", False, "readback"),
    ("effective_policy.enforcement_profile_sha256", _SHA, "seccomp profile"), ("effective_policy.security_options", ["no-new-privileges", "seccomp={}"], "seccomp profile"), ("effective_policy.seccomp_architectures", ["x86"], "seccomp profile,seccomp architectures"),
    ("effective_policy.tmpfs./extra", "rw", "tmpfs"), ("effective_policy.tmpfs./tmp", _MOUNT.format(1 << 20), "tmpfs"), ("subject_identity.argv", ["x"], _BOTH), ("backend_identity.engine_endpoint", "tcp://h", _BOTH), ("effective_policy.user", "0:0", _BOTH), ("effective_policy.network_mode", "bridge", _BOTH), ("effective_policy.mount_count", 1, _BOTH),
    ("effective_policy.cap_drop", [], _BOTH), ("effective_policy.init_version", "Unknown", _BOTH), ("effective_policy.cpu_quota_nanos", 1, _BOTH), ("effective_policy.ulimits.nproc", 0, _BOTH), ("effective_policy.ulimits.fsize", 1, _BOTH), ("effective_policy.readonly_root", False, _BOTH),
    ("effective_policy.environment_key_names", ["HOME", "LANG", "PATH"], "environment keys"), ("effective_policy.observed_environment.PATH", "", "environment values"), ("effective_policy.environment.HOME", "/x", "environment keys,environment values"), ("observed_effects.0.evidence_origin", "CONTROL_SIMULATION", "effect origins"),
    ("observed_effects.0.detail", " ", "effects"), ("observed_effects.0.attempted", False, "effects,evidence references"), ("observed_effects.1.effect_id", "e1", "effects,evidence references,effects and references"), ("controls.0.control_kind", "ODD", "controls"), ("controls.1.control_id", "c1", "controls,required controls"),
    ("controls.0.evidence_refs", [], "evidence references,effects and references"), ("controls.0.evidence_refs.0.expected_allowed", True, "evidence references"), ("controls.0.evidence_refs.0.effect_id", "e9", "evidence references,effects and references"), ("controls.0.result", "FAIL", "required controls,control results"),
    ("cleanup.images_remaining", 1, "clean-up"), ("cleanup.detail", "", "clean-up"), ("export_review.exported_sha256", "cd" * 32, "export review"), ("export_review.bytes", 5000, "export review"), ("export_review.rejected_entries", ["x"], "export review"), ("evidence_ceiling.unknown", [], "claim ceiling"), ("limitations", [" "], "claim ceiling"),
    ("performance", None, "performance"), ("performance.warm_samples", [{"phase": "WARM", **_SAMPLE}] * 29, "performance samples,performance figures"), ("performance.cold_samples.0.phase", "WARM", "performance samples,performance figures"), ("performance.concurrency_observations.1.batch_wall_p95_ms", 1, "concurrency observations,performance figures"),
    ("performance.concurrency_observations.2.passed", False, "concurrency claims"), ("performance.cleanup_max_ms", 30, "performance figures"), ("performance.added_overhead_percent", 2, "performance figures"), ("performance.highest_passing_concurrency", 2, "performance figures"), ("performance.gates_passed", False, "performance figures"), ("result", "FAIL", "terminal result"),
)
_N_RECEIPT = len(RECEIPT_FAULTS)


@query("execution_receipts", f"SELECT p_partkey, reasons, CASE WHEN reasons = '' THEN 'PASS' ELSE 'ERROR' END AS result FROM part JOIN {_expected([(k, e) for k, (_, _, e) in enumerate(RECEIPT_FAULTS)], 'variant', 'reasons')} ON p_partkey % {_N_RECEIPT} = variant")
def execution_receipts(spark, sf_dir):
    """A receipt for each part, whose run, case and argument names are the part's own."""
    texts = _variants(spark, [json.dumps(_changed(RECEIPT, path, value)) for path, value, _ in RECEIPT_FAULTS])
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % _N_RECEIPT).alias("variant")).join(texts, "variant")
    own = F.replace("text", F.lit('"r1"'), F.concat(F.lit('"r'), F.col("p_partkey").cast("string"), F.lit('"')))
    receipts = policies.validate_receipts(rows.withColumn("receipt", F.from_json(own, f"struct<{policies.RECEIPT}>")), "RECEIPT_V1", "POLICY_V1")
    return receipts.select("p_partkey", F.array_join("reasons", ",").alias("reasons"), "result")


_PATCH = {"schema_version": "PATCH_V1", "changes": [{"path": "a/b.txt", "before_sha256": _SHA}]}
_PATCHES = (
    (json.dumps(_PATCH), ""), ("", "empty or too large"), (json.dumps(_PATCH) + " " * 2000, "empty or too large"), ("{", "not JSON"), (json.dumps({**_PATCH, "schema_version": "V0"}), "schema or number of changes"), (json.dumps({**_PATCH, "changes": []}), "schema or number of changes"),
    (json.dumps({**_PATCH, "changes": _PATCH["changes"] * 17}), "empty or too large"), (json.dumps({**_PATCH, "changes": [{"path": "x", "before_sha256": _SHA}]}), "path or digest: x"), (json.dumps({**_PATCH, "changes": [*_PATCH["changes"], {"path": "../a", "before_sha256": _SHA}]}), "path or digest: ../a"),
    (json.dumps({**_PATCH, "changes": [{"path": "a/b.txt", "before_sha256": "zz" * 32}]}), "path or digest: a/b.txt"), (json.dumps({"schema_version": "PATCH_V1"}), "schema or number of changes"),
)


@query("patch_candidates", f"SELECT s_suppkey, fault FROM supplier JOIN {_expected([(k, e) for k, (_, e) in enumerate(_PATCHES)], 'variant', 'fault')} ON s_suppkey % {len(_PATCHES)} = variant")
def patch_candidates(spark, sf_dir):
    fault = policies.patch_fault(F.col("text"), F.lit(1200), F.array(F.lit("a/b.txt")), "PATCH_V1")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(_PATCHES)).alias("variant")).join(_variants(spark, [t for t, _ in _PATCHES]), "variant")
    return rows.select("s_suppkey", F.coalesce(fault, F.lit("")).alias("fault"))


# bundles


def _chain(events: list[dict]) -> list[str]:
    """Audit lines with their hashes."""
    last, out = _ZERO, []
    for e in events:
        e = {"ts_utc": "2026-01-01T00:00:00Z", "run_id": "r1", "vault_id": "v", "actor": "system", "details": {}, **e, "prev_event_hash": last, "event_hash": _ZERO}
        last = e["event_hash"] = _sha(_canonical(e))
        out.append(json.dumps(e))
    return out


_EVENTS = (
    {"event_type": "ALLOWLIST_UPDATED", "details": {"z": [1, {"b": 2, "a": "é\""}], "allowlist_count": 1}}, {"event_type": "VAULT_ENCRYPTION_STATUS", "details": {"key_storage": "FILE_FALLBACK"}},
    {"event_type": "EGRESS_REQUEST_BLOCKED", "details": {"evidence_origin": "CONTROL_SIMULATION", "block_reason": "OFFLINE_MODE"}},
)
_AUTHORITY = {
    "schema_version": "EVIDENCE_AUTHORITY_V1", "case_id": "r1", "source": {"producer": "p", "source_revision": "abc", "executable": "x", "executable_sha256": _SHA, "arguments_sha256": _SHA, "environment_sha256": _SHA, "audit_log_sha256": ""}, "generated_at_utc": "2026-01-01T00:00:00Z", "valid_until_utc": "2026-01-01T23:00:00+00:00",
    "allowed_effects": ["LOCAL_RUNTIME_DIRECTORY_WRITE", "LOCAL_AUDIT_LOG_WRITE", "LOCAL_EVIDENCE_BUNDLE_WRITE"], "observed_effects": ["LOCAL_AUDIT_LOG_WRITE", "LOCAL_RUNTIME_DIRECTORY_WRITE", "LOCAL_EVIDENCE_BUNDLE_WRITE"], "limitations": ["l"],
    "tools": [{"tool_id": t, "declared_available": a, "observed_used": a, "external_mutation_allowed": False} for t, a in (("LOCAL_EVIDENCE_BUNDLE_EXPORT", True), ("MODEL_INFERENCE", False), ("EXTERNAL_PUBLICATION_OR_DEPLOYMENT", False))],
    "credential_availability": "UNAVAILABLE", "state_scope": {"cache_scope": "CASE_LOCAL", "prior_approval_reused": False, "credential_state_reused": False, "mutable_cache_reused": False},
    "downstream_claims": {"may_satisfy": ["LOCAL_CONTROLLED_EXECUTION", "BUNDLE_INTEGRITY", "OFFLINE_POLICY_CONFIGURATION"], "must_not_satisfy": ["LIVE_EXECUTION", "PRODUCTION_AUTHORITY", "EXTERNAL_MUTATION", "REAL_USER_SUCCESS", "CURRENT_RUNTIME_CAPABILITY", "DEPLOYABILITY", "LIVE_EVALUATION_COMPLETION", "LIVE_EGRESS_BLOCKED"]},
    "evidence_origin": "CONTROL_SIMULATION", "production_equivalent": False, "requested_execution_class": "CONTROLLED", "observed_execution_class": "CONTROLLED",
}


def _report(policy: str) -> dict:
    gates = [
        {"gate_id": g, "category": c, "severity": s, "status": "NOT_APPLICABLE" if g.startswith(("OFFLINE_ENFORCEMENT.ALLOW", "DETERMINISM.PDF")) else "PASS", "message": "m", "evidence_pointers": e[::-1]}
        for g, c, s, p, e, _ in validation.gate_registry(PACK) if policy in p
    ]
    return {"overall_status": "PASS", "registry_version": "gates_registry_v3", "gates": gates, "tests": []}


def bundle_files(policy: str = "STRICT") -> dict[str, str]:
    """The files of a bundle that passes all checks, by path."""
    audit = "\n".join(_chain(list(_EVENTS))) + "\n\n"
    manifest = {"run_id": "r1", "eval": {"gate_status": "PASS"}, "evidence_authority": _changed(_AUTHORITY, "source.audit_log_sha256", _sha(audit))}
    citations = {"schema_version": "LOCATOR_SCHEMA_V1", "claims": [
        {"claim_id": "C1", "citations": [{"artifact_id": "a1", "locator_type": "PDF_TEXT_SPAN_V1", "locator": {"start_char": 5, "end_char": 9}}]}, {"claim_id": "C2", "citations": [{"artifact_id": "a2", "locator_type": "PDF_BBOX_V1", "locator": {"bbox": {"x": 1, "y": 1, "w": 2, "h": 2.5}}}, {"artifact_id": "a3"}]},
    ]}
    redactions = {"schema_version": "REDACTION_SCHEMA_V1", "artifacts": [{"artifact_id": "a1", "redactions": [{"redaction_type": "TEXT_SPAN", "region": {"start_char": 0, "end_char": 9}}]}, {"artifact_id": "a2", "redactions": [{"redaction_type": "IMAGE_BBOX", "region": {"bbox": {"x": 0, "y": 0, "w": 3, "h": 3.5}}}]}]}
    at, attach = f"exports/{PACK}/deliverables/", f"exports/{PACK}/attachments/"
    files = {
        "BUNDLE_INFO.json": json.dumps({"pack_id": PACK, "run_id": "r1", "schema_versions": {"run_manifest": "RUN_MANIFEST_V2"}}), "run_manifest.json": json.dumps(manifest), "audit_log.ndjson": audit, "eval_report.json": json.dumps(_report(policy)),
        "inputs_snapshot/artifact_list.json": json.dumps({"artifacts": [{"artifact_id": "a1", "classification": "Restricted", "tags": []}, {"artifact_id": "a2", "classification": "Public", "tags": ["x", "PHI"]}, {"artifact_id": "a3", "classification": "Public"}]}),
        "inputs_snapshot/policy_snapshot.json": json.dumps({"export_profile": {"inputs": "INCLUDE_INPUT_BYTES"}, "determinism": {"enabled": True}, "encryption_at_rest": True, "encryption_algorithm": "AES_256_GCM"}),
        "inputs_snapshot/network_snapshot.json": json.dumps({"network_mode": "OFFLINE", "proof_level": "OFFLINE_STRICT", "allowlist": [], "ui_remote_fetch_disabled": True, "adapter_endpoints": [{"is_loopback": True}]}), "inputs_snapshot/model_snapshot.json": json.dumps({"pinning_level": "VERSION_PINNED"}),
        "inputs_snapshot/artifacts/a1/bytes": "input one", attach + "templates_used.json": "{}", attach + "citations_map.json": json.dumps(citations), attach + "redactions_map.json": json.dumps(redactions), at + "evidence_mapping_review.json": json.dumps({"schema_version": "EVIDENCE_MAPPING_REVIEW_V1"}),
        **{at + f: "<!-- CLAIM:C1 -->\nx\n<!-- CLAIM: C2 -->" if f.endswith(".md") else "x" for f in validation.DELIVERABLES},
    }
    listed = [("a1", "inputs_snapshot/artifacts/a1/bytes"), ("o:1", at + "evidence_index.md"), ("o:2", ""), ("o:2", attach + "citations_map.json")]
    return {**files, "artifact_hashes.csv": "artifact_id,bundle_rel_path,sha256,bytes,content_type,logical_role\n" + "".join(f'{a},"{p}",{_sha(files[p]) if p else ""},{len(files[p].encode()) if p else ""},text/plain,x\n' for a, p in listed)}


_IN, _OUT = "inputs_snapshot/", f"exports/{PACK}/"
_REQ, _LAY, _NET, _AUD, _AUT, _HASH, _PIN, _CIT, _RED, _EVAL, _ZIP, _VAULT = validation.CHECKS
_FOREIGN = "run ids differ"


def _json_fault(path: str, where: str, value):
    return lambda files: {**files, path: json.dumps(_changed(json.loads(files[path]), where, value))}


def _authority_fault(where: str, value):
    return _json_fault("run_manifest.json", f"evidence_authority.{where}", value)


def _without(path: str):
    return lambda files: {k: v for k, v in files.items() if k != path}


def _with(path: str, text):
    return lambda files: {**files, path: text(files[path]) if callable(text) else text}


def _log(change, bound: bool = True):
    """Another audit log, which the authority is bound to again."""

    def made(files):
        text = change(files["audit_log.ndjson"])
        return _authority_fault("source.audit_log_sha256", _sha(text))({**files, "audit_log.ndjson": text}) if bound else {**files, "audit_log.ndjson": text}

    return made


def _events(*events: dict):
    return _log(lambda _: "\n".join(_chain(list(events))))


_SET, _KEYS, _EGRESS = _EVENTS
_LIVE = {"event_type": "EGRESS_REQUEST_BLOCKED", "details": {"evidence_origin": "RUNTIME_OBSERVATION", "block_reason": "OFFLINE_MODE"}}
_ALLOWED = {"event_type": "EGRESS_REQUEST_ALLOWED", "details": {"evidence_origin": "CONTROL_SIMULATION"}}
_S, _B, _D = "STRICT", "BALANCED", "DRAFT_ONLY"
#: (policy, change, the checks that fail with their messages, and of the gates that aren't PASS the result).
_LIST, _GATE = "OFFLINE_ENFORCEMENT.ALLOWLIST_MATCH_V1", f"{PACK.upper()}."
_PDF = "DETERMINISM.PDF_CAPABLE_V1"
BUNDLES = (
    (_S, dict, {}), (_B, dict, {}), (_D, dict, {}), (_S, _without("BUNDLE_INFO.json"), {_REQ: "missing: BUNDLE_INFO.json", _AUT: "unreadable: BUNDLE_INFO.json", _EVAL: "unreadable: BUNDLE_INFO.json"}),
    (_S, lambda f: {}, {_REQ: "missing: BUNDLE_INFO.json, run_manifest.json, audit_log.ndjson, eval_report.json, artifact_hashes.csv, inputs_snapshot/artifact_list.json, inputs_snapshot/policy_snapshot.json, inputs_snapshot/network_snapshot.json, inputs_snapshot/model_snapshot.json, exports/", _LAY: "no attachments/templates_used.json under exports",
        _NET: "unreadable: inputs_snapshot/network_snapshot.json", _AUD: "unreadable: audit_log.ndjson", _AUT: "unreadable: BUNDLE_INFO.json", _HASH: "unreadable: artifact_hashes.csv", _PIN: "unreadable: inputs_snapshot/model_snapshot.json", _CIT: "citations map missing", _RED: "redactions map missing", _EVAL: "unreadable: eval_report.json",
        _ZIP: "unreadable: inputs_snapshot/policy_snapshot.json", _VAULT: "unreadable: inputs_snapshot/policy_snapshot.json"}),
    (_B, _without(_OUT + "attachments/templates_used.json"), {_LAY: "no attachments/templates_used.json under exports"}), (_S, _json_fault(_IN + "network_snapshot.json", "allowlist", None), {_NET: "missing fields: allowlist"}),
    (_S, _json_fault(_IN + "network_snapshot.json", "ui_remote_fetch_disabled", "true"), {_NET: "missing fields: ui_remote_fetch_disabled=true"}), (_S, _json_fault(_IN + "network_snapshot.json", "adapter_endpoints", [{"is_loopback": True}, {}]), {_NET: "missing fields: adapter_endpoints[1].is_loopback=true"}), (_D, _with(_IN + "network_snapshot.json", "{"), {_NET: "unreadable: inputs_snapshot/network_snapshot.json"}),
    (_S, _log(lambda t: t.replace('"actor": "system"', '"actor": "other"', 1)), {_AUD: "hash wrong at line 1"}), (_S, _log(lambda t: "\n".join(t.split("\n")[1:])), {_AUD: "link broken at line 1"}), (_S, _log(lambda t: t + "{\n"), {_AUD: "not JSON at line 5", _AUT: "audit not JSON at line 5"}),
    (_S, _log(lambda t: t.replace('"vault_id": "v"', '"vault": "v"', 1)), {_AUD: "missing key vault_id at line 1"}), (_D, _log(lambda t: t.replace('"allowlist_count": 1', '"allowlist_count": 1.5', 1)), {_AUD: "not canonical at line 1"}), (_S, _log(lambda t: t + " \n", bound=False), {_AUT: "audit digest"}),
    (_S, _json_fault("BUNDLE_INFO.json", "schema_versions.run_manifest", "RUN_MANIFEST_V1"), {_AUT: "older run manifest doesn't authorise"}), (_S, _json_fault("BUNDLE_INFO.json", "schema_versions.run_manifest", "V9"), {_AUT: "unknown run manifest"}), (_S, _json_fault("BUNDLE_INFO.json", "run_id", "r2"), {_AUT: _FOREIGN}),
    (_S, _authority_fault("schema_version", "V0"), {_AUT: "authority schema"}), (_S, _authority_fault("case_id", "r2"), {_AUT: "case"}), (_S, _authority_fault("source.producer", " unknown"), {_AUT: "source names"}), (_S, _authority_fault("source.executable_sha256", "x"), {_AUT: "source digests"}), (_S, _authority_fault("generated_at_utc", "2026-01-01"), {_AUT: "times"}),
    (_S, _authority_fault("valid_until_utc", "2026-01-02T00:00:01Z"), {_AUT: "interval"}), (_S, _authority_fault("valid_until_utc", "2026-01-01T00:00:00Z"), {_AUT: "interval"}), (_S, _authority_fault("observed_effects", ["OTHER"]), {_AUT: "effects"}), (_S, _authority_fault("limitations", []), {_AUT: "limitations"}), (_S, _authority_fault("tools.1.observed_used", True), {_AUT: "tools"}),
    (_S, _authority_fault("tools.1.tool_id", "LOCAL_EVIDENCE_BUNDLE_EXPORT"), {_AUT: "tools"}), (_S, _authority_fault("credential_availability", "UNKNOWN"), {_AUT: "credentials"}), (_S, _authority_fault("state_scope.mutable_cache_reused", True), {_AUT: "state scope"}), (_S, _authority_fault("downstream_claims.may_satisfy", ["LIVE_EXECUTION"]), {_AUT: "claims"}),
    (_S, _authority_fault("evidence_origin", "RUNTIME"), {_AUT: "origin"}), (_S, _authority_fault("production_equivalent", True), {_AUT: "execution class"}), (_S, _authority_fault("downstream_claims.must_not_satisfy", ["LIVE_EXECUTION"]), {_AUT: "simulation claims"}), (_S, _authority_fault("observed_effects", ["LOCAL_AUDIT_LOG_WRITE"]), {_AUT: "simulation effects"}),
    (_S, _authority_fault("tools.0.observed_used", False), {_AUT: "simulation tools"}), (_S, _events(_SET, _KEYS), {_AUT: "no blocked egress in the audit"}), (_S, _events(_SET, _KEYS, {**_EGRESS, "run_id": "r2"}), {_AUT: "run of another case at line 3"}), (_S, _events(_SET, _KEYS, _EGRESS, _LIVE), {_AUT: "egress origin conflicts at line 4"}), (_B, _events(_SET, _KEYS, _ALLOWED, _EGRESS), {_AUT: "egress allowed at line 3"}),
    (_S, _with("artifact_hashes.csv", lambda t: t.replace("a1,", "z1,", 1)), {_HASH: "rows not sorted"}), (_S, _with("artifact_hashes.csv", lambda t: t.replace("o:1,", "b1,", 1).replace("o:2", "c")), {_HASH: "input bytes missing: b1"}), (_S, _without(_IN + "artifacts/a1/bytes"), {_HASH: "path missing: inputs_snapshot/artifacts/a1/bytes"}),
    (_S, _with(_IN + "artifacts/a1/bytes", "longer than it was"), {_HASH: "size differs: inputs_snapshot/artifacts/a1/bytes"}), (_S, _with(_IN + "artifacts/a1/bytes", "input two"), {_HASH: "sha256 differs: inputs_snapshot/artifacts/a1/bytes"}), (_S, _with("artifact_hashes.csv", lambda t: t + "x,y\n"), {_HASH: "not CSV"}),
    (_S, _json_fault(_IN + "model_snapshot.json", "pinning_level", "NAME_ONLY"), {_PIN: "not enough: NAME_ONLY"}), (_D, _json_fault(_IN + "model_snapshot.json", "pinning_level", "NAME_ONLY"), {}), (_D, _json_fault(_IN + "model_snapshot.json", "pinning_level", None), {_PIN: "not enough: "}),
    (_S, _json_fault(_OUT + "attachments/citations_map.json", "claims.0.citations", []), {_CIT: "not cited: C1", _HASH: f"size differs: {_OUT}attachments/citations_map.json"}), (_B, _json_fault(_OUT + "attachments/citations_map.json", "schema_version", "V0"), {_HASH: f"size differs: {_OUT}attachments/citations_map.json"}),
    (_S, _with(_OUT + "deliverables/evidence_narrative.md", "<!-- CLAIM:C9 --> <!-- CLAIM:C8 -->"), {_CIT: "not cited: C8, C9"}), (_B, _with(_OUT + "deliverables/evidence_narrative.md", "<!-- CLAIM:C9 -->"), {}),
    (_S, _json_fault(_OUT + "attachments/redactions_map.json", "artifacts.0.redactions.0.region.end_char", 8), {_RED: "not redacted: C1:a1"}), (_B, _json_fault(_OUT + "attachments/redactions_map.json", "artifacts", []), {_RED: "not redacted: C1:a1, C2:a2"}), (_B, _json_fault(_OUT + "attachments/redactions_map.json", "schema_version", "V0"), {_RED: "redactions: not REDACTION_SCHEMA_V1"}),
    (_D, _without(_OUT + "attachments/redactions_map.json"), {}), (_B, _without(_OUT + "attachments/redactions_map.json"), {_RED: "redactions map missing"}),
    (_S, _json_fault("eval_report.json", "registry_version", "gates_registry_v1"), {_EVAL: "older registry gates_registry_v1"}), (_S, _json_fault("eval_report.json", "overall_status", "WARN"), {_EVAL: "overall status contradicts gates"}), (_S, _json_fault("eval_report.json", "gates", []), {_EVAL: "no gates"}),
    (_S, _json_fault("eval_report.json", "gates.0", None), {_EVAL: "gates missing: BUNDLE_FORMAT.REQUIRED_FILES_V1"}), (_D, _with("eval_report.json", json.dumps(_report("BALANCED"))), {_EVAL: "gates of other policies: DETERMINISM.PDF_CAPABLE_V1, DETERMINISM.ZIP_PACKAGING_V1, MODEL_PINNING.MIN_LEVEL_V1, OFFLINE_ENFORCEMENT.ALLOWLIST_MATCH_V1, REDACTION.REQUIRED_APPLIED_V1"}),
    (_S, _json_fault("eval_report.json", "gates.1.gate_id", "BUNDLE_FORMAT.REQUIRED_FILES_V1"), {_EVAL: "duplicate gate BUNDLE_FORMAT.REQUIRED_FILES_V1"}), (_S, _json_fault("eval_report.json", "gates.1.gate_id", "X"), {_EVAL: "unknown gate X"}), (_S, _json_fault("eval_report.json", "gates.1.status", "MAYBE"), {_EVAL: "invalid status of gate AUDIT_HASH_CHAIN.VERIFY_V1"}),
    (_S, _json_fault("eval_report.json", "gates.1.status", "NOT_APPLICABLE"), {_EVAL: "NOT_APPLICABLE refused for gate AUDIT_HASH_CHAIN.VERIFY_V1"}), (_S, _json_fault("eval_report.json", "gates.1.severity", "MAJOR"), {_EVAL: "severity lowered for gate AUDIT_HASH_CHAIN.VERIFY_V1"}), (_S, _json_fault("eval_report.json", "gates.1.category", "X"), {_EVAL: "category differs for gate AUDIT_HASH_CHAIN.VERIFY_V1"}),
    (_S, _json_fault("eval_report.json", "gates.1.evidence_pointers", []), {_EVAL: "evidence differs for gate AUDIT_HASH_CHAIN.VERIFY_V1"}), (_S, _json_fault("run_manifest.json", "eval.gate_status", "FAIL"), {_EVAL: "manifest contradicts report"}), (_S, _json_fault("run_manifest.json", "eval", {}), {_EVAL: "manifest lacks eval.gate_status"}),
    (_S, _json_fault(_IN + "policy_snapshot.json", "encryption_algorithm", "DES"), {_VAULT: "no encryption at rest by a known algorithm"}), (_S, _events(_SET, _EGRESS), {_VAULT: "key storage not told"}), (_S, _with(_IN + "policy_snapshot.json", ""), {_HASH: "unreadable: inputs_snapshot/policy_snapshot.json", _ZIP: "unreadable: inputs_snapshot/policy_snapshot.json", _VAULT: "unreadable: inputs_snapshot/policy_snapshot.json"}),
    (_S, _json_fault(_IN + "policy_snapshot.json", "determinism.enabled", False), {}), (_B, _json_fault("BUNDLE_INFO.json", "pack_id", "other"), {}), (_B, _without(_OUT + "deliverables/evidence_index.pdf"), {}), (_B, _with(_OUT + "deliverables/evidence_mapping_review.json", "{}"), {}),
    (_B, _events(_SET, _KEYS, _EGRESS, {**_EGRESS, "details": {"evidence_origin": "CONTROL_SIMULATION", "block_reason": "ODD"}}), {}),
)
_N_BUNDLE = len(BUNDLES)
_ZIP_FAULTS = {1: ("method", "STORE", f"not DEFLATE: {_IN}artifact_list.json"), 2: ("mtime", "2026-01-01 00:00:00", f"timestamp not fixed: {_IN}artifact_list.json"), 3: ("mode", 0o755, f"mode not normal: {_IN}artifact_list.json"), 4: ("ord", -1, "entries not sorted"), 5: ("comment", "hi", "comment not empty")}
_ENTRY = "variant int, ord int, path string, content string, sha256 string, bytes long"


def _bundle_tables(spark, sf_dir):
    rows = [(k, n, path, text, _sha(text), len(text.encode())) for k, (policy, change, _) in enumerate(BUNDLES) for n, (path, text) in enumerate(sorted(change(bundle_files(policy)).items()))]
    # zip faults are variants of the first bundle, by the customer's number
    z = F.when(F.col("variant") == 0, F.floor(F.col("c_custkey") / _N_BUNDLE) % 6).otherwise(0)
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % _N_BUNDLE).cast("int").alias("variant")).withColumn("z", z).withColumn("bundle_id", F.concat(F.lit("b"), F.col("c_custkey").cast("string")))
    policy = F.element_at(F.array(*[F.lit(p) for p, *_ in BUNDLES]), F.col("variant") + 1)
    bundles = own.select("bundle_id", policy.alias("policy"), F.when(F.col("z") == 5, "hi").otherwise("").alias("comment"))
    odd = lambda k, value, usual: F.when((F.col("z") == k) & (F.col("path") == f"{_IN}artifact_list.json"), value).otherwise(usual)
    entries = own.join(F.broadcast(spark.createDataFrame(rows, _ENTRY)), "variant")  # a constant of this module
    return bundles, entries.select("bundle_id", odd(4, F.lit(-1), F.col("ord")).alias("ord"), "path", "content", "sha256", "bytes", odd(1, "STORE", "DEFLATE").alias("method"), odd(2, "2026-01-01 00:00:00", "1980-01-01 00:00:00").alias("mtime"), odd(3, 0o755, 0o644).alias("mode"))


_VARIANTS = _expected([(k, p) for k, (p, *_) in enumerate(BUNDLES)], "variant", "policy")
_FAULTS = _expected([(k, c, m) for k, (_, _, e) in enumerate(BUNDLES) for c, m in e.items()], "variant", "check_id", "message").replace(") w(", ") f(")
_ZIPS = _expected([(k, m) for k, (_, _, m) in _ZIP_FAULTS.items()], "z", "message").replace(") w(", ") zf(")
_OFF = [k for k, (_, change, _) in enumerate(BUNDLES) if change is BUNDLES[-5][1]]
#: The checks, and the gates with severity and policies, written out so that the SQL doesn't take them from what it checks.
_CHECK_IDS = (
    "CHK.BUNDLE.REQUIRED_FILES", "CHK.EXPORTS.ATTACHMENTS_LAYOUT", "CHK.NETWORK.SNAPSHOT_PRESENT", "CHK.AUDIT.REQUIRED_KEYS_AND_CHAIN", "CHK.EVIDENCE.AUTHORITY_CONTRACT", "CHK.ARTIFACT_HASHES.VERIFY",
    "CHK.MODEL.PINNING_LEVEL", "CHK.CITATIONS.STRICT", "CHK.REDACTION.POLICY_GATE", "CHK.EVAL.REPORT_AND_GATES", "CHK.DETERMINISM.ZIP_RULES", "CHK.VAULT_CRYPTO.POLICY_SNAPSHOT",
)
_GATE_ROWS = (
    ("BUNDLE_FORMAT.REQUIRED_FILES_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"), ("AUDIT_HASH_CHAIN.VERIFY_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"), ("EVIDENCE_AUTHORITY.CONTRACT_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"),
    ("OFFLINE_ENFORCEMENT.MODE_PROOF_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"), ("OFFLINE_ENFORCEMENT.ALLOWLIST_MATCH_V1", "BLOCKER", "STRICT|BALANCED"), ("CITATIONS.STRICT_ENFORCED_V1", "BLOCKER", "STRICT"),
    ("REDACTION.REQUIRED_APPLIED_V1", "BLOCKER", "STRICT|BALANCED"), ("MODEL_PINNING.MIN_LEVEL_V1", "BLOCKER", "STRICT|BALANCED"), ("VAULT_CRYPTO.ENCRYPTION_AT_REST_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"),
    ("DETERMINISM.ZIP_PACKAGING_V1", "BLOCKER", "STRICT|BALANCED"), ("DETERMINISM.PDF_CAPABLE_V1", "MAJOR", "STRICT|BALANCED"), (f"{_GATE}OUTPUTS_PRESENT_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"), (f"{_GATE}MAPPING_REVIEW_PRESENT_V1", "BLOCKER", "STRICT|BALANCED|DRAFT_ONLY"),
)
_CHECKS_SQL = f"""WITH b AS (SELECT 'b' || c_custkey AS bundle_id, variant, policy, CASE WHEN variant = 0 THEN (c_custkey // {_N_BUNDLE}) % 6 ELSE 0 END AS z FROM customer JOIN {_VARIANTS} ON c_custkey % {_N_BUNDLE} = variant),
  k AS (SELECT b.*, u.check_id FROM b, (SELECT unnest([{', '.join(f"'{c}'" for c in _CHECK_IDS)}]) AS check_id) u),
  r AS (SELECT k.*, coalesce(CASE WHEN k.check_id = '{_ZIP}' THEN zf.message END, f.message) AS fault, k.check_id = '{_CIT}' AND policy <> 'STRICT' OR k.check_id = '{_RED}' AND policy = 'DRAFT_ONLY' OR k.check_id = '{_ZIP}' AND k.variant IN ({', '.join(map(str, _OFF))}) AS idle
    FROM k LEFT JOIN {_FAULTS} ON f.variant = k.variant AND f.check_id = k.check_id LEFT JOIN {_ZIPS} ON zf.z = k.z),
  checks AS (SELECT bundle_id, policy, check_id, CASE WHEN idle AND check_id = '{_ZIP}' THEN 'MAJOR' ELSE 'BLOCKER' END AS severity, CASE WHEN fault IS NULL THEN 'PASS' ELSE 'FAIL' END AS result, coalesce(fault, CASE WHEN idle THEN 'not applicable' ELSE 'ok' END) AS message FROM r)"""


@query("bundle_checks", f"{_CHECKS_SQL} SELECT * FROM checks")
def bundle_checks(spark, sf_dir):
    return validation.check_bundles(*_bundle_tables(spark, sf_dir), PACK)


@query("bundle_verdicts", f"{_CHECKS_SQL} SELECT bundle_id, count(*) AS n_checks, count(*) FILTER (result <> 'PASS') AS n_failed, CASE WHEN bool_or(result <> 'PASS' AND severity = 'BLOCKER') THEN 'FAIL' ELSE 'PASS' END AS overall FROM checks GROUP BY bundle_id")
def bundle_verdicts(spark, sf_dir):
    return validation.bundle_verdict(validation.check_bundles(*_bundle_tables(spark, sf_dir), PACK))


#: Gates that follow a check, and results of the others where they aren't those of a sound bundle.
_FOLLOW = {
    "AUDIT_HASH_CHAIN.VERIFY_V1": _AUD, "EVIDENCE_AUTHORITY.CONTRACT_V1": _AUT, "OFFLINE_ENFORCEMENT.MODE_PROOF_V1": _NET, "CITATIONS.STRICT_ENFORCED_V1": _CIT, "REDACTION.REQUIRED_APPLIED_V1": _RED, "MODEL_PINNING.MIN_LEVEL_V1": _PIN, "VAULT_CRYPTO.ENCRYPTION_AT_REST_V1": _VAULT, "DETERMINISM.ZIP_PACKAGING_V1": _ZIP,
    "BUNDLE_FORMAT.REQUIRED_FILES_V1": _REQ,
}
_GATE_SETS = {"STRICT": 13, "BALANCED": 12, "DRAFT_ONLY": 7}


def _by_change(*numbers: int) -> str:
    return ", ".join(str(k % _N_BUNDLE) for k in numbers)


_EMPTY, _BROKEN_LINE, _NO_EGRESS, _LIVE_TOO, _ALLOWED_TOO, _FIRST_LOST = 4, 12, 38, 40, 41, 11
_GATES_SQL = f"""{_CHECKS_SQL}, g AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{s}', '{p}', '{_FOLLOW.get(g, '')}')" for g, s, p in _GATE_ROWS)}) t(gate_id, severity, policies, follows)),
  x AS (SELECT b.bundle_id, b.variant, b.policy, g.gate_id, g.severity, g.follows FROM b JOIN g ON list_contains(string_split(g.policies, '|'), b.policy))
  SELECT x.bundle_id, x.gate_id, x.severity, CASE WHEN x.follows <> '' THEN checks.result WHEN x.gate_id = '{_PDF}' THEN 'NOT_APPLICABLE'
      WHEN x.gate_id = '{_LIST}' THEN CASE WHEN x.variant IN ({_by_change(_EMPTY, _BROKEN_LINE, _NO_EGRESS, _ALLOWED_TOO, _FIRST_LOST, -1)}) THEN 'FAIL' WHEN x.variant = {_LIVE_TOO} THEN 'PASS' ELSE 'NOT_APPLICABLE' END
      WHEN x.variant IN ({_by_change(3, _EMPTY, -4)}) THEN 'NOT_APPLICABLE' WHEN x.gate_id = '{_GATE}OUTPUTS_PRESENT_V1' THEN CASE WHEN x.variant = {_N_BUNDLE - 3} THEN 'FAIL' ELSE 'PASS' END ELSE CASE WHEN x.variant = {_N_BUNDLE - 2} THEN 'FAIL' ELSE 'PASS' END END AS result
  FROM x LEFT JOIN checks ON checks.bundle_id = x.bundle_id AND checks.check_id = x.follows"""


@query("bundle_gates", _GATES_SQL)
def bundle_gates(spark, sf_dir):
    return validation.evaluate_gates(*_bundle_tables(spark, sf_dir), PACK).select("bundle_id", "gate_id", "severity", "result")


@query("gates_unmapped", f"""{_CHECKS_SQL} SELECT b.bundle_id, g.gate_id, 'BLOCKER' AS severity, 'FAIL' AS result, m AS message FROM b, (VALUES ('NOBODY.DECIDES_V1', 'nothing decides this gate', 'STRICT|DRAFT_ONLY'), ('NO.SUCH_CHECK_V1', 'no such check', 'BALANCED'), ('NO.SUCH_PREFIX_V1', 'no such checks', 'BALANCED')) g(gate_id, m, p) WHERE list_contains(string_split(g.p, '|'), b.policy)""")
def gates_unmapped(spark, sf_dir):
    """Gates that nothing decides block, whatever severity the registry gives them."""
    rows = [("NOBODY.DECIDES_V1", "X", "MINOR", ["STRICT", "DRAFT_ONLY"], ["e"], None), ("NO.SUCH_CHECK_V1", "X", "BLOCKER", ["BALANCED"], ["e"], "CHK.NONE"), ("NO.SUCH_PREFIX_V1", "X", "BLOCKER", ["BALANCED"], ["e"], "NONE.")]
    registry = spark.createDataFrame(rows, validation.registry_table(spark, PACK).schema)
    return validation.evaluate_gates(*_bundle_tables(spark, sf_dir), PACK, registry).select("bundle_id", "gate_id", "severity", "result", "message")


@query("eval_statuses", f"""{_GATES_SQL.replace('SELECT x.bundle_id, x.gate_id', ', gates AS (SELECT x.bundle_id, x.gate_id', 1)}) SELECT bundle_id, count(*) AS n_gates, CASE WHEN bool_or(result = 'FAIL' AND severity = 'BLOCKER') THEN 'FAIL' WHEN bool_or(result = 'FAIL') THEN 'WARN' ELSE 'PASS' END AS overall FROM gates GROUP BY bundle_id""")
def eval_statuses(spark, sf_dir):
    bundles, entries = _bundle_tables(spark, sf_dir)
    made = validation.materialised_reports(validation.evaluate_gates(bundles, entries, PACK), bundles.withColumn("pack_id", F.when(F.substring("bundle_id", 2, 9).cast("int") % _N_BUNDLE == _N_BUNDLE - 4, "other").when((F.substring("bundle_id", 2, 9).cast("int") % _N_BUNDLE).isin(3, 4), "none").otherwise(PACK)), PACK)
    return made.select("bundle_id", F.size("report.gates").cast("long").alias("n_gates"), F.col("report.overall_status").alias("overall"))


@query("gates_satisfied", f"""{_GATES_SQL.replace('SELECT x.bundle_id, x.gate_id', ', gates AS (SELECT x.bundle_id, x.gate_id', 1)}) SELECT b.bundle_id, coalesce(bool_or(result IN ('PASS', 'NOT_APPLICABLE')) FILTER (gate_id = 'AUDIT_HASH_CHAIN.VERIFY_V1'), false) AS audit, b.policy <> 'STRICT' OR coalesce(bool_or(result IN ('PASS', 'NOT_APPLICABLE')) FILTER (gate_id = 'CITATIONS.STRICT_ENFORCED_V1'), false) AS citations,
    b.policy = 'DRAFT_ONLY' OR coalesce(bool_or(result IN ('PASS', 'NOT_APPLICABLE')) FILTER (gate_id = '{_LIST}'), false) AS allowlist, false AS unknown FROM b JOIN gates USING (bundle_id) GROUP BY b.bundle_id, b.policy""")
def gates_satisfied(spark, sf_dir):
    bundles, entries = _bundle_tables(spark, sf_dir)
    row = F.struct("gate_id", "category", F.col("result").alias("status"), "severity", "message", "evidence_pointers")
    report = F.struct(F.collect_list(row).alias("gates"))
    made = validation.evaluate_gates(bundles, entries, PACK).groupBy("bundle_id").agg(report.alias("report")).join(bundles, "bundle_id")
    named = {"audit": "AUDIT_HASH_CHAIN.VERIFY_V1", "citations": "CITATIONS.STRICT_ENFORCED_V1", "allowlist": _LIST, "unknown": "NO.SUCH_GATE"}
    return made.select("bundle_id", *[validation.gate_satisfied(F.col("report"), g, F.col("policy"), PACK).alias(k) for k, g in named.items()])


_CLAIM = {"as_of_utc": "2026-01-01T12:00:00Z", "expected_case_id": "r1", "expected_source_revision": "abc", **{f"expected_{k}_sha256": _SHA for k in ("executable", "arguments", "environment", "audit_log")}, "credentials_required": False, "required_tool_id": None}
_BOUND = _changed(_AUTHORITY, "source.audit_log_sha256", _SHA)
_ASKED = (
    (_BOUND, "BUNDLE_INTEGRITY", {}, "Authorized"), (_BOUND, "LIVE_EXECUTION", {}, "Denied"), (_BOUND, "NO_SUCH", {}, "Unknown"), (_changed(_BOUND, "limitations", []), "BUNDLE_INTEGRITY", {}, "Unknown"), (_BOUND, "BUNDLE_INTEGRITY", {"expected_case_id": "r2"}, "Unknown"), (_BOUND, "BUNDLE_INTEGRITY", {"expected_audit_log_sha256": "x"}, "Unknown"),
    (_BOUND, "LIVE_EXECUTION", {"as_of_utc": "2026-01-02T12:00:00Z"}, "Unknown"), (_BOUND, "BUNDLE_INTEGRITY", {"as_of_utc": "2026-01-01T00:30:00+01:00"}, "Unknown"), (_BOUND, "BUNDLE_INTEGRITY", {"as_of_utc": "soon"}, "Unknown"), (_BOUND, "BUNDLE_INTEGRITY", {"credentials_required": True}, "Unknown"),
    (_changed(_BOUND, "credential_availability", "AVAILABLE"), "BUNDLE_INTEGRITY", {"credentials_required": True}, "Authorized"), (_BOUND, "BUNDLE_INTEGRITY", {"required_tool_id": "LOCAL_EVIDENCE_BUNDLE_EXPORT"}, "Authorized"), (_BOUND, "BUNDLE_INTEGRITY", {"required_tool_id": "MODEL_INFERENCE"}, "Unknown"), (_BOUND, "BUNDLE_INTEGRITY", {"required_tool_id": "x"}, "Unknown"),
)


@query("claim_evaluation", f"SELECT o_orderkey, decision FROM orders JOIN {_expected([(k, e) for k, (*_, e) in enumerate(_ASKED)], 'variant', 'decision')} ON o_orderkey % {len(_ASKED)} = variant")
def claim_evaluation(spark, sf_dir):
    rows = [(k, json.dumps(a), claim, json.dumps({**_CLAIM, **more})) for k, (a, claim, more, _) in enumerate(_ASKED)]
    asked = spark.createDataFrame(rows, "variant int, authority string, claim string, context string")
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("variant", F.col("o_orderkey") % len(_ASKED)).join(F.broadcast(asked), "variant")  # a constant of this module
    own = lambda c: F.replace(F.col(c), F.lit('"r1"'), F.concat(F.lit('"r'), F.col("o_orderkey").cast("string"), F.lit('"')))
    # parsed in columns of their own, which the rules read: within the rules each would parse the text again
    rows = rows.select("o_orderkey", "claim", F.from_json(own("authority"), f"struct<{policies.AUTHORITY}>").alias("a"), F.from_json(own("context"), f"struct<{policies.CONTEXT}>").alias("context"))
    return rows.select("o_orderkey", policies.claim_decision(F.col("a"), F.col("claim"), F.col("context")).alias("decision"))
