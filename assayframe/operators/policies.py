"""Execution policies and claim authorities as rule tables: one boolean a rule, the failed ones named.

A policy or authority is one row of nested columns. Every rule is a column expression, so that a table of any size is
judged in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.jsons import seccomp_profile

POLICY = (
    "policy_id string, policy_version string, network string, user string, read_only_root boolean, privileged boolean, argv array<string>, "
    "env map<string,string>, input_root string, output_root string, timeout_ms long, max_memory_bytes long, max_pids long, max_output_bytes long, output_paths array<string>"
)


def failed(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold, in their own order; a null counts as not holding."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def first_failed(rules: dict[str, Column]) -> Column:
    """The name of the first rule that doesn't hold, or null."""
    return F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])


def distinct_items(items: Column) -> Column:
    return F.size(items) == F.size(F.array_distinct(items))


def policy_rules(version: str = "1", most_ms: int = 3_600_000, most_memory: int = 64 << 30, most_pids: int = 4096, most_output: int = 20 << 20) -> dict[str, Column]:
    """The rules of an execution policy (columns of ``POLICY``), by name."""
    between = lambda c, top: (F.col(c) > 0) & (F.col(c) <= top)
    return {
        "version": F.col("policy_version") == version,
        "identity": F.trim("policy_id") != "",
        "isolation": (F.col("network") == "none") & F.col("read_only_root") & ~F.col("privileged"),
        "user": F.col("user").rlike("^[1-9][0-9]*(:[1-9][0-9]*)?$"),
        "command": (F.size("argv") > 0) & F.forall("argv", lambda a: (a != "") & ~a.contains("\0")),
        "environment": ~F.exists(F.map_keys("env"), checks.secret_key),
        "roots": checks.disjoint_roots(F.col("input_root"), F.col("output_root")),
        "limits": between("timeout_ms", most_ms) & between("max_memory_bytes", most_memory) & between("max_pids", most_pids) & between("max_output_bytes", most_output),
        "outputs": (F.size("output_paths") > 0) & distinct_items(F.col("output_paths")) & F.forall("output_paths", checks.safe_relative_path),
    }


def validate_policies(policies: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """All columns with ``failed_rules`` and ``valid``. Null fields fail the rules that read them; an empty table stays empty."""
    out = policies.withColumn("failed_rules", failed(rules or policy_rules()))
    return out.withColumn("valid", F.size("failed_rules") == 0)


def authority_rules(as_of: Column, hours: int = 24) -> dict[str, Column]:
    """The rules of an evidence authority, by name.

    Columns: source_sha256, generated, valid_until (timestamps), tools, credentials_observed, credentials_allowed,
    permitted, prohibited (arrays of text), revision.
    """
    return {
        "digest": F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"),
        "revision": (F.trim("revision") != "") & (F.lower(F.trim("revision")) != "unknown"),
        "fresh": checks.fresh(F.col("generated"), as_of, F.col("valid_until"), hours),
        "tools": distinct_items(F.col("tools")),
        "credentials": F.size(F.array_except("credentials_observed", "credentials_allowed")) == 0,
        "claims": (F.size("permitted") > 0) & ~F.arrays_overlap("permitted", "prohibited"),
    }


def validate_authorities(authorities: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """All columns with ``failed_rules`` and ``valid``, judged at the time ``as_of``."""
    return validate_policies(authorities, authority_rules(F.lit(as_of).cast("timestamp"), hours))


#: Kinds of network traffic that a policy must block.
NETWORK_CLASSES = ("DNS", "IPV4", "IPV6", "METADATA", "LOOPBACK", "UNIX_SOCKET", "PROXY")
EXECUTION_POLICY = (
    "schema_version string, policy_id string, backend_id string, input_tree_sha256 string, image_id string, argv array<string>, working_directory string, "
    "filesystem struct<immutable_input_path:string,writable_workspace_path:string,output_path_allowlist:array<string>,max_output_bytes:long,host_mounts_allowed:boolean>, network struct<mode:string,blocked_classes:array<string>>, "
    "process struct<child_processes_allowed:boolean,pid_limit:long,wall_time_ms:long,controller_death_cleanup_required:boolean,trusted_init_required:boolean>, "
    "resources struct<memory_bytes:long,memory_swap_bytes:long,cpu_quota_millis:long,workspace_bytes:long,max_file_bytes:long,max_open_files:long>, environment struct<allowed_keys:array<string>,secrets:string,synthetic_home:string,synthetic_tmp:string>, "
    "export struct<patch_only:boolean,review_required:boolean,reviewer_kind:string,max_patch_bytes:long>, evidence struct<required_control_ids:array<string>,require_effective_policy_readback:boolean,require_zero_residue:boolean,maximum_claim:string>"
)


def sha256_text(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def known(c: Column) -> Column:
    """Neither blank nor ``unknown``."""
    return (F.trim(c) != "") & (F.lower(F.trim(c)) != "unknown")


def rfc3339(c: Column) -> Column:
    """The time that an RFC 3339 text gives; null for any other text."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.upper(c)))


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _same_set(items: Column, fixed: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_distinct(items)) == F.array(*[F.lit(x) for x in sorted(fixed)])


def execution_policy_rules(p: Column, schema: str, backend: str = "OCI_ZERO_EGRESS_V1") -> dict[str, Column]:
    """The rules of an execution policy, a struct of ``EXECUTION_POLICY``, in the order of their checks. ``schema`` is the version that is taken."""
    f, n, pr, r, e, x, v = (p[k] for k in ("filesystem", "network", "process", "resources", "environment", "export", "evidence"))
    input_, work, tmp, home = f["immutable_input_path"], f["writable_workspace_path"], e["synthetic_tmp"], e["synthetic_home"]
    some = lambda c, *names: _all(*[c[k] > 0 for k in names])
    return {
        "sets": distinct_items(n["blocked_classes"]) & distinct_items(e["allowed_keys"]) & distinct_items(v["required_control_ids"]),
        "schema": p["schema_version"] == schema,
        "backend": p["backend_id"] == backend,
        "identities": (F.trim(p["policy_id"]) != "") & sha256_text(p["input_tree_sha256"]) & p["image_id"].rlike("^sha256:[0-9a-f]{64}$"),
        "argv": (F.size(p["argv"]) > 0) & F.forall(p["argv"], lambda a: a != ""),
        "roots": _all(p["working_directory"] == work, *[checks.path_parts(c).isNotNull() for c in (input_, work, tmp, home)], checks.disjoint_roots(input_, work), checks.disjoint_roots(input_, tmp), checks.disjoint_roots(work, tmp), checks.strict_descendant(work, home), ~f["host_mounts_allowed"]),
        "outputs": _all(F.size(f["output_path_allowlist"]) > 0, distinct_items(f["output_path_allowlist"]), f["max_output_bytes"] > 0, f["max_output_bytes"] == x["max_patch_bytes"], F.forall(f["output_path_allowlist"], checks.safe_relative_path)),
        "network": (n["mode"] == "DENY_ALL") & _same_set(n["blocked_classes"], NETWORK_CLASSES),
        "environment": (e["secrets"] == "NONE") & (F.size(e["allowed_keys"]) > 0) & ~F.exists(e["allowed_keys"], checks.secret_key),
        "ceilings": _all(pr["child_processes_allowed"], some(pr, "pid_limit", "wall_time_ms"), pr["controller_death_cleanup_required"], pr["trusted_init_required"], some(r, "memory_bytes", "cpu_quota_millis", "workspace_bytes", "max_file_bytes", "max_open_files"), r["memory_swap_bytes"] == r["memory_bytes"]),
        "export": _all(x["patch_only"], x["review_required"], x["max_patch_bytes"] > 0, F.trim(x["reviewer_kind"]) != ""),
        "evidence": _all(F.size(v["required_control_ids"]) > 0, v["require_effective_policy_readback"], v["require_zero_residue"], F.trim(v["maximum_claim"]) != ""),
    }


AUTHORITY = (
    "schema_version:string,case_id:string,source:struct<producer:string,source_revision:string,executable:string,executable_sha256:string,arguments_sha256:string,environment_sha256:string,audit_log_sha256:string>,"
    "generated_at_utc:string,valid_until_utc:string,allowed_effects:array<string>,observed_effects:array<string>,limitations:array<string>,"
    "tools:array<struct<tool_id:string,declared_available:boolean,observed_used:boolean,external_mutation_allowed:boolean>>,credential_availability:string,"
    "state_scope:struct<cache_scope:string,prior_approval_reused:boolean,credential_state_reused:boolean,mutable_cache_reused:boolean>,downstream_claims:struct<may_satisfy:array<string>,must_not_satisfy:array<string>>,"
    "evidence_origin:string,production_equivalent:boolean,requested_execution_class:string,observed_execution_class:string"
)
#: What a control simulation may claim, must not claim, does, and with which tools (declared available, observed used).
SIMULATION_CLAIMS = ("LOCAL_CONTROLLED_EXECUTION", "BUNDLE_INTEGRITY", "OFFLINE_POLICY_CONFIGURATION")
SIMULATION_PROHIBITED = ("LIVE_EXECUTION", "PRODUCTION_AUTHORITY", "EXTERNAL_MUTATION", "REAL_USER_SUCCESS", "CURRENT_RUNTIME_CAPABILITY", "DEPLOYABILITY", "LIVE_EVALUATION_COMPLETION", "LIVE_EGRESS_BLOCKED")
SIMULATION_EFFECTS = ("LOCAL_RUNTIME_DIRECTORY_WRITE", "LOCAL_AUDIT_LOG_WRITE", "LOCAL_EVIDENCE_BUNDLE_WRITE")
SIMULATION_TOOLS = {"LOCAL_EVIDENCE_BUNDLE_EXPORT": (True, True), "MODEL_INFERENCE": (False, False), "EXTERNAL_PUBLICATION_OR_DEPLOYMENT": (False, False)}


def authority_shape(a: Column) -> dict[str, Column]:
    """The rules of an evidence authority (a struct of ``AUTHORITY``) that need nothing else, in the order of their checks."""
    s, t, d, scope = a["source"], a["tools"], a["downstream_claims"], a["state_scope"]
    generated, until = rfc3339(a["generated_at_utc"]), rfc3339(a["valid_until_utc"])
    ids = F.transform(t, lambda x: x["tool_id"])
    stands = lambda name, have, used: lambda x: (x["tool_id"] == name) & (x["declared_available"] == have) & (x["observed_used"] == used) & ~x["external_mutation_allowed"]
    return {
        "authority schema": a["schema_version"] == "EVIDENCE_AUTHORITY_V1",
        "case id": known(a["case_id"]),
        "source names": known(s["producer"]) & known(s["source_revision"]) & known(s["executable"]),
        "source digests": _all(*[s[k].rlike("^[0-9a-fA-F]{64}$") for k in ("executable_sha256", "arguments_sha256", "environment_sha256", "audit_log_sha256")]),
        "times": generated.isNotNull() & until.isNotNull(),
        "interval": (until > generated) & (until <= generated + F.expr("interval 24 hours")),
        "effects": (F.size(a["allowed_effects"]) > 0) & (F.size(a["observed_effects"]) > 0) & (F.size(F.array_except(a["observed_effects"], a["allowed_effects"])) == 0),
        "limitations": F.size(a["limitations"]) > 0,
        "tools": (F.size(t) > 0) & distinct_items(ids) & F.forall(t, lambda x: known(x["tool_id"]) & (x["declared_available"] | (~x["observed_used"] & ~x["external_mutation_allowed"]))),
        "credentials": a["credential_availability"] != "UNKNOWN",
        "state scope": _all(scope["cache_scope"] == "CASE_LOCAL", ~scope["prior_approval_reused"], ~scope["credential_state_reused"], ~scope["mutable_cache_reused"]),
        "claims": (F.size(d["may_satisfy"]) > 0) & (F.size(d["must_not_satisfy"]) > 0) & ~F.arrays_overlap(d["may_satisfy"], d["must_not_satisfy"]),
        "origin": a["evidence_origin"] == "CONTROL_SIMULATION",
        "execution class": ~a["production_equivalent"] & (a["requested_execution_class"] == "CONTROLLED") & (a["observed_execution_class"] == "CONTROLLED"),
        "simulation claims": _same_set(d["may_satisfy"], SIMULATION_CLAIMS) & _same_set(d["must_not_satisfy"], SIMULATION_PROHIBITED),
        "simulation effects": _same_set(a["allowed_effects"], SIMULATION_EFFECTS) & _same_set(a["observed_effects"], SIMULATION_EFFECTS),
        "simulation tools": _same_set(ids, tuple(SIMULATION_TOOLS)) & _all(*[F.exists(t, stands(k, *v)) for k, v in SIMULATION_TOOLS.items()]),
    }


def authority_contract(a: Column, case_id: Column, audit_log: Column) -> dict[str, Column]:
    """All rules of an authority within its bundle: its shape, its case and the digest of the audit log."""
    shape = authority_shape(a)
    bound = {"case": a["case_id"] == case_id, "audit digest": a["source"]["audit_log_sha256"] == F.sha2(audit_log.cast("binary"), 256)}
    names = list(shape)
    cut = names.index("source digests") + 1
    return {**{k: shape[k] for k in names[:1]}, "case": bound["case"], **{k: shape[k] for k in names[1:cut]}, "audit digest": bound["audit digest"], **{k: shape[k] for k in names[cut:]}}


#: What a claim is asked under.
CONTEXT = (
    "as_of_utc:string,expected_case_id:string,expected_source_revision:string,expected_executable_sha256:string,expected_arguments_sha256:string,expected_environment_sha256:string,expected_audit_log_sha256:string,"
    "credentials_required:boolean,required_tool_id:string"
)


def claim_decision(a: Column, claim: Column, context: Column) -> Column:
    """Authorized, Denied or Unknown: a claim under an authority (``AUTHORITY``) and a context (``CONTEXT``). What can't be told is Unknown."""
    source = ("source_revision", "executable_sha256", "arguments_sha256", "environment_sha256", "audit_log_sha256")
    same = (a["case_id"] == context["expected_case_id"]) & _all(*[a["source"][k] == context[f"expected_{k}"] for k in source])
    at = rfc3339(context["as_of_utc"])
    live = (at >= rfc3339(a["generated_at_utc"])) & (at <= rfc3339(a["valid_until_utc"]))
    tool = context["required_tool_id"].isNull() | F.exists(a["tools"], lambda t: (t["tool_id"] == context["required_tool_id"]) & t["declared_available"] & t["observed_used"])
    holds = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(first_failed(authority_shape(a)).isNotNull() | ~holds(same & live), "Unknown").when(holds(F.array_contains(a["downstream_claims"]["must_not_satisfy"], claim)), "Denied")
        .when(~holds(F.array_contains(a["downstream_claims"]["may_satisfy"], claim)), "Unknown").when(context["credentials_required"] & (a["credential_availability"] != "AVAILABLE"), "Unknown").when(~holds(tool), "Unknown").otherwise("Authorized")
    )


RECEIPT = (
    f"schema_version string, run_id string, result string, requested_policy struct<{EXECUTION_POLICY.replace(', ', ',')}>, "
    "subject_identity struct<fixture_id:string,fixture_sha256:string,input_tree_sha256:string,argv:array<string>>, backend_identity struct<backend_id:string,engine_endpoint:string,daemon_id:string,architecture:string,engine_version:string,runtime_version:string,kernel_version:string,image_id:string,enforcement_profile_sha256:string,controller_build:string,controller_executable_sha256:string>, "
    "effective_policy struct<readback_complete:boolean,image_id:string,enforcement_profile_sha256:string,seccomp_architectures:array<string>,argv:array<string>,working_directory:string,user:string,network_mode:string,readonly_root:boolean,mount_count:long,host_mount_count:long,host_config_mount_count:long,runtime_mount_count:long,cap_drop:array<string>,security_options:array<string>,init_enabled:boolean,init_implementation:string,init_version:string,pid_limit:long,memory_bytes:long,memory_swap_bytes:long,cpu_quota_nanos:long,tmpfs:map<string,string>,ulimits:map<string,long>,environment_key_names:array<string>,environment:map<string,string>,observed_environment:map<string,string>>, "
    "observed_effects array<struct<effect_id:string,effect_class:string,attempted:boolean,allowed:boolean,persisted:boolean,evidence_origin:string,sensor_identity:string,detail:string>>, controls array<struct<control_id:string,control_kind:string,expected:string,observed:string,evidence_refs:array<struct<effect_id:string,expected_attempted:boolean,expected_allowed:boolean>>,result:string>>, "
    "cleanup struct<attempted:boolean,completed:boolean,containers_remaining:long,images_remaining:long,networks_remaining:long,volumes_remaining:long,processes_remaining:long,listeners_remaining:long,mounts_remaining:long,temporary_roots_remaining:long,detail:string>, "
    "export_review struct<candidate_sha256:string,reviewed_sha256:string,exported_sha256:string,reviewer_kind:string,approved:boolean,rejected_entries:array<string>,bytes:long>, evidence_ceiling struct<maximum_claim:string,enforced:array<string>,observed:array<string>,unknown:array<string>,excluded_claims:array<string>>, limitations array<string>, "
    "performance struct<cold_samples:array<struct<phase:string,elapsed_ms:long,cleanup_ms:long,peak_disk_bytes:long>>,warm_samples:array<struct<phase:string,elapsed_ms:long,cleanup_ms:long,peak_disk_bytes:long>>,five_second_samples:array<struct<phase:string,elapsed_ms:long,cleanup_ms:long,peak_disk_bytes:long>>,concurrency_observations:array<struct<concurrency:long,batch_wall_samples_ms:array<long>,batch_wall_p95_ms:long,passed:boolean>>,input_bytes:long,warm_start_p95_ms:long,cold_start_p95_ms:long,cleanup_p95_ms:long,cleanup_max_ms:long,added_overhead_p95_ms:long,added_overhead_percent:long,peak_disk_bytes:long,disk_amplification_ceiling_bytes:long,highest_passing_concurrency:long,gates_passed:boolean>"
).replace(" struct<", ":struct<").replace(" array<", ":array<").replace(" map<", ":map<").replace(" string", ":string").replace(" boolean", ":boolean").replace(" long", ":long").replace(", ", ",")
_RESIDUE = ("containers", "images", "networks", "volumes", "processes", "listeners", "mounts", "temporary_roots")


def zero_residue(cleanup: Column) -> Column:
    """Whether a clean-up was tried, ended, and left nothing."""
    return _all(cleanup["attempted"], cleanup["completed"], *[cleanup[f"{k}_remaining"] == 0 for k in _RESIDUE])


def array_p95(values: Column) -> Column:
    """The nearest-rank 95th percentile of an array of whole numbers; null if it is empty."""
    return F.try_element_at(F.array_sort(values), F.ceil(F.size(values) * 0.95).cast("int"))


def performance_rules(p: Column) -> dict[str, Column]:
    """The rules of a receipt's performance summary: shapes, and that every figure and the verdict follow from the samples."""
    cold, warm, five, seen = (p[k] for k in ("cold_samples", "warm_samples", "five_second_samples", "concurrency_observations"))
    of = lambda samples, k: F.transform(samples, lambda x: x[k])
    every = F.concat(cold, warm, five)
    over = F.transform(five, lambda x: F.greatest(x["elapsed_ms"] - 5000, F.lit(0)))
    shape = _all(
        p["input_bytes"] > 0, F.size(cold) == 5, F.size(warm) == 30, F.size(five) == 5, F.forall(cold, lambda x: (x["phase"] == "COLD_CACHED") & (x["elapsed_ms"] > 0)), F.forall(warm, lambda x: (x["phase"] == "WARM") & (x["elapsed_ms"] > 0)),
        F.forall(five, lambda x: (x["phase"] == "FIVE_SECOND_OVERHEAD") & (x["elapsed_ms"] >= 5000)),
    )
    concurrent = (F.size(seen) == 3) & (F.array_sort(of(seen, "concurrency")) == F.array(*[F.lit(k).cast("long") for k in (1, 2, 4)])) & F.forall(seen, lambda o: (F.size(o["batch_wall_samples_ms"]) == 5) & F.forall(o["batch_wall_samples_ms"], lambda x: x > 0) & (o["batch_wall_p95_ms"] == array_p95(o["batch_wall_samples_ms"])))
    worst = F.array_max(of(every, "cleanup_ms"))
    single = array_p95(F.try_element_at(F.filter(seen, lambda o: o["concurrency"] == 1), F.lit(1))["batch_wall_samples_ms"])
    passes = lambda o: (array_p95(o["batch_wall_samples_ms"]) <= 2000) & (array_p95(o["batch_wall_samples_ms"]) <= F.coalesce(single * 2, F.lit(1 << 62))) & (worst <= 5000)
    highest = F.coalesce(F.array_max(F.transform(F.filter(seen, passes), lambda o: o["concurrency"])), F.lit(0))
    figures = {
        "cold_start_p95_ms": array_p95(of(cold, "elapsed_ms")), "warm_start_p95_ms": array_p95(of(warm, "elapsed_ms")), "cleanup_p95_ms": array_p95(of(every, "cleanup_ms")), "cleanup_max_ms": worst, "added_overhead_p95_ms": array_p95(over),
        "added_overhead_percent": F.floor((array_p95(over) * 100 + 4999) / 5000), "peak_disk_bytes": F.array_max(of(every, "peak_disk_bytes")), "disk_amplification_ceiling_bytes": F.floor(p["input_bytes"] * 5 / 2) + (128 << 20), "highest_passing_concurrency": highest,
    }
    most = {"cold_start_p95_ms": 5000, "warm_start_p95_ms": 2000, "cleanup_p95_ms": 2000, "cleanup_max_ms": 5000, "added_overhead_p95_ms": 1000, "added_overhead_percent": 20}
    fits = _all(shape, concurrent, *[figures[k] <= v for k, v in most.items()], figures["peak_disk_bytes"] <= figures["disk_amplification_ceiling_bytes"], highest >= 1)
    return {
        "performance samples": shape, "concurrency observations": concurrent, "concurrency claims": F.forall(seen, lambda o: o["passed"] == F.coalesce(passes(o), F.lit(False))),
        "performance figures": _all(*[p[k] == x for k, x in figures.items()], p["gates_passed"], fits),
    }


def receipt_rules(r: Column, schema: str, policy_schema: str) -> dict[str, Column]:
    """The rules of an execution receipt, a struct of ``RECEIPT``. The schemas are the versions that are taken."""
    q, e, b, s, c, x, v = (r[k] for k in ("requested_policy", "effective_policy", "backend_identity", "subject_identity", "controls", "export_review", "evidence_ceiling"))
    effects, env, seen = r["observed_effects"], e["environment"], e["observed_environment"]
    digest, names, reason = seccomp_profile(e["security_options"])
    filled = lambda *cs: _all(*[F.trim(k) != "" for k in cs])
    some = lambda a: (F.size(a) > 0) & F.forall(a, lambda k: F.trim(k) != "")
    ids = F.transform(effects, lambda k: k["effect_id"])
    refs = F.flatten(F.transform(c, lambda k: F.transform(k["evidence_refs"], lambda f: f["effect_id"])))
    by_id = F.map_from_entries(F.transform(F.filter(effects, lambda k, i: F.array_position(ids, k["effect_id"]) == i + 1), lambda k: F.struct(k["effect_id"], k)))
    agrees = lambda f: (F.try_element_at(by_id, f["effect_id"])["attempted"] == f["expected_attempted"]) & (F.try_element_at(by_id, f["effect_id"])["allowed"] == f["expected_allowed"])
    options = lambda size, *more: F.array_sort(F.array(*map(F.lit, ("rw", "nosuid", "nodev", "mode=0700", "uid=65534", "gid=65534", *more)), F.concat(F.lit("size="), size.cast("string"))))
    mounted = lambda path, want: F.array_sort(F.split(F.try_element_at(e["tmpfs"], path), ",")) == want
    work, tmp, res = q["filesystem"]["writable_workspace_path"], q["environment"]["synthetic_tmp"], q["resources"]
    passed = F.transform(F.filter(c, lambda k: k["result"] == "PASS"), lambda k: k["control_id"])
    key_names, keys = e["environment_key_names"], lambda m: F.array_sort(F.map_keys(m))
    value = lambda m, k: F.try_element_at(m, F.lit(k))
    rules = {
        "receipt schema": r["schema_version"] == schema,
        "requested policy": first_failed(execution_policy_rules(q, policy_schema)).isNull(),
        "identities": filled(r["run_id"], s["fixture_id"], *[b[k] for k in ("backend_id", "engine_endpoint", "daemon_id", "architecture", "engine_version", "runtime_version", "kernel_version", "image_id", "controller_build")]),
        "fixture digest": sha256_text(s["fixture_sha256"]),
        "readback": e["readback_complete"],
        "seccomp profile": reason.isNull() & (digest == e["enforcement_profile_sha256"]) & (digest == b["enforcement_profile_sha256"]) & (names == e["seccomp_architectures"]),
        "seccomp architectures": F.forall(e["seccomp_architectures"], lambda a: a.rlike("^SCMP_ARCH_[A-Z0-9_]+$")),
        "tmpfs": (keys(e["tmpfs"]) == F.array_sort(F.array_distinct(F.array(work, tmp)))) & mounted(work, options(res["workspace_bytes"])) & mounted(tmp, options(res["max_file_bytes"], "noexec")),
        "requested and effective": _all(
            s["input_tree_sha256"] == q["input_tree_sha256"], s["argv"] == q["argv"], b["backend_id"] == q["backend_id"], b["engine_endpoint"].startswith("unix:///"), b["image_id"] == q["image_id"], *[sha256_text(k) for k in (b["enforcement_profile_sha256"], b["controller_executable_sha256"], e["enforcement_profile_sha256"])],
            e["image_id"] == q["image_id"], e["argv"] == q["argv"], e["working_directory"] == q["working_directory"], e["network_mode"] == "none", e["readonly_root"], *[e[k] == 0 for k in ("mount_count", "host_mount_count", "host_config_mount_count", "runtime_mount_count")], e["user"] == "65534:65534",
            F.array_contains(e["cap_drop"], "ALL"), F.exists(e["security_options"], lambda k: k.contains("no-new-privileges")), F.exists(e["security_options"], lambda k: k.contains("seccomp")), e["init_enabled"], e["init_implementation"] == "docker-init", known(e["init_version"]),
            e["pid_limit"] == q["process"]["pid_limit"], e["memory_bytes"] == res["memory_bytes"], e["memory_swap_bytes"] == res["memory_swap_bytes"], e["cpu_quota_nanos"] == res["cpu_quota_millis"] * 1_000_000, value(e["ulimits"], "nofile") == res["max_open_files"], value(e["ulimits"], "fsize") == res["max_file_bytes"], F.forall(F.map_values(e["ulimits"]), lambda k: k != 0),
        ),
        "environment keys": _all(distinct_items(key_names), F.forall(key_names, lambda k: k != ""), F.array_sort(key_names) == keys(seen), F.size(F.array_except(F.map_keys(env), F.map_keys(seen))) == 0, F.size(F.array_except(F.map_keys(seen), q["environment"]["allowed_keys"])) == 0, F.size(F.map_filter(env, lambda k, w: ~F.coalesce(F.try_element_at(seen, k) == w, F.lit(False)))) == 0),
        "environment values": _all(*[value(m, k) == w for m in (env, seen) for k, w in (("HOME", q["environment"]["synthetic_home"]), ("TMPDIR", q["environment"]["synthetic_tmp"]), ("LANG", F.lit("C.UTF-8")))], F.forall(F.map_values(seen), lambda k: k != "")),
        "effect origins": F.forall(effects, lambda k: k["evidence_origin"].isin("RUNTIME_ENFORCED", "TRUSTED_SENSOR")),
        "effects": F.forall(effects, lambda k: filled(k["effect_id"], k["effect_class"], k["sensor_identity"], k["detail"]) & k["attempted"]) & distinct_items(ids),
        "controls": F.forall(c, lambda k: filled(k["control_id"], k["control_kind"], k["expected"], k["observed"]) & k["control_kind"].isin("POSITIVE", "VULNERABLE", "NEGATIVE")) & distinct_items(F.transform(c, lambda k: k["control_id"])),
        "evidence references": F.forall(c, lambda k: (F.size(k["evidence_refs"]) > 0) & distinct_items(F.transform(k["evidence_refs"], lambda f: f["effect_id"])) & F.forall(k["evidence_refs"], agrees)),
        "effects and references": F.array_sort(F.array_distinct(refs)) == F.array_sort(F.array_distinct(ids)),
        "required controls": F.size(F.array_except(q["evidence"]["required_control_ids"], passed)) == 0,
        "control results": F.forall(c, lambda k: k["result"] == "PASS"),
        "clean-up": zero_residue(r["cleanup"]) & (r["cleanup"]["detail"] != ""),
        "export review": _all(*[sha256_text(x[k]) for k in ("candidate_sha256", "reviewed_sha256", "exported_sha256")], x["bytes"] > 0, x["approved"], x["candidate_sha256"] == x["reviewed_sha256"], x["reviewed_sha256"] == x["exported_sha256"], x["bytes"] <= q["export"]["max_patch_bytes"], x["reviewer_kind"] == q["export"]["reviewer_kind"], F.size(x["rejected_entries"]) == 0),
        "claim ceiling": _all(v["maximum_claim"] == q["evidence"]["maximum_claim"], *[some(v[k]) for k in ("enforced", "observed", "unknown", "excluded_claims")], some(r["limitations"])),
        "performance": r["performance"].isNotNull(),
    }
    for name, rule in performance_rules(r["performance"]).items():
        rules[name] = r["performance"].isNull() | rule
    return {**rules, "terminal result": r["result"] == "PASS"}


def validate_receipts(receipts: DataFrame, schema: str, policy_schema: str, receipt_col: str = "receipt") -> DataFrame:
    """All columns with ``reasons`` (the names of the rules that fail) and ``result``, PASS or ERROR; a null receipt fails every rule."""
    out = receipts.withColumn("reasons", failed(receipt_rules(F.col(receipt_col), schema, policy_schema)))
    return out.withColumn("result", F.when(F.size("reasons") == 0, "PASS").otherwise("ERROR"))


def patch_fault(text: Column, max_bytes: Column, allowlist: Column, schema: str) -> Column:
    """What is wrong with a patch candidate's JSON, null if nothing is."""
    p = F.from_json(text, "schema_version string, changes array<struct<path:string,before_sha256:string>>")
    size = F.octet_length(text)
    changes = (p["schema_version"] == schema) & (F.size(p["changes"]) > 0) & (F.size(p["changes"]) <= 16)
    ok = lambda c: checks.safe_relative_path(c["path"]) & F.array_contains(allowlist, c["path"]) & c["before_sha256"].rlike("^[0-9a-fA-F]{64}$")
    holds = lambda c: F.coalesce(c, F.lit(False))
    bad = F.filter(p["changes"], lambda c: ~holds(ok(c)))
    return (
        F.when(~holds((size > 0) & (size <= max_bytes)), "empty or too large").when(F.try_parse_json(text).isNull(), "not JSON").when(~holds(changes), "schema or number of changes")
        .when(F.size(bad) > 0, F.concat(F.lit("path or digest: "), F.coalesce(F.try_element_at(bad, F.lit(1))["path"], F.lit(""))))
    )
