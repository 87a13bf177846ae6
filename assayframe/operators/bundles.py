"""Bundle checks, gates, egress rules, receipts and performance figures as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import ascii_host, sensitive
from . import coverage
from .audit import before, ordered_sha256

#: Files that a bundle must hold; a name with a final slash is a prefix.
REQUIRED_FILES = (
    "BUNDLE_INFO.json", "run_manifest.json", "audit_log.ndjson", "eval_report.json", "artifact_hashes.csv", "inputs_snapshot/artifact_list.json",
    "inputs_snapshot/policy_snapshot.json", "inputs_snapshot/network_snapshot.json", "inputs_snapshot/model_snapshot.json", "exports/",
)
#: Reasons for which egress may be blocked.
EGRESS_REASONS = ("OFFLINE_MODE", "NOT_ALLOWLISTED", "UI_DIRECT_EGRESS_BLOCKED")
_SEVERITIES, MOST_GATES = ("MINOR", "MAJOR", "BLOCKER"), 1000


def required_files(entries: DataFrame, required: tuple[str, ...] = REQUIRED_FILES) -> DataFrame:
    """Per bundle of ``entries`` (bundle_id, path): the required names it lacks, and the verdict. One aggregation."""
    found = [F.bool_or(F.col("path").startswith(r) if r.endswith("/") else F.col("path") == r).alias(f"f{k}") for k, r in enumerate(required)]
    lacks = F.array_compact(F.array(*[F.when(~F.col(f"f{k}"), r) for k, r in enumerate(required)]))
    out = entries.groupBy("bundle_id").agg(*found).select("bundle_id", F.array_join(lacks, ", ").alias("missing"))
    return out.withColumn("result", F.when(F.col("missing") == "", "PASS").otherwise("FAIL"))


def verify_hashes(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """Declared (path, sha256, bytes) against actual entries (path, sha256, bytes): the first failure of each, or ok. Digests and paths count as they stand: an upper-case digest differs, a path of blanks is a path. Empty paths are skipped."""
    actual = entries.select("path", F.col("sha256").alias("a_sha"), F.col("bytes").alias("a_bytes"))
    out = declared.where(F.col("path") != "").join(actual, "path", "left")
    why = F.when(F.col("a_sha").isNull(), "missing").when(F.col("a_bytes") != F.col("bytes"), "size mismatch").when(~F.coalesce(F.col("a_sha") == F.col("sha256"), F.lit(False)), "sha256 mismatch").otherwise("ok")
    return out.withColumn("verdict", why).drop("a_sha", "a_bytes")


def uncovered_spans(citations: DataFrame, artifacts: DataFrame, redactions: DataFrame) -> DataFrame:
    """Citations (claim_id, artifact_id, start, end) that no redaction (artifact_id, start, end) contains, of sensitive ``artifacts`` (artifact_id, classification, tags)."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    guarded = artifacts.where(sensitive(F.coalesce("classification", F.lit("")), tags)).select("artifact_id").distinct()
    return coverage.uncovered_spans(citations.join(guarded, "artifact_id", "left_semi"), redactions)


def uncovered_boxes(citations: DataFrame, redactions: DataFrame) -> DataFrame:
    """Citations (claim_id, artifact_id, x, y, w, h) that no redaction box of the artifact contains."""
    return coverage.uncovered_boxes(citations, redactions)


def overall(checks: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Per bundle, of evaluated gates: FAIL if a BLOCKER failed, WARN if anything did, else PASS; what doesn't apply has not failed. ``validation.bundle_verdict`` judges checks."""
    bad = ~F.col("result").isin("PASS", "NOT_APPLICABLE")
    out = checks.groupBy(key).agg(F.count("*").alias("n_checks"), F.count_if(bad).alias("n_failed"), F.bool_or(bad & (F.col("severity") == "BLOCKER")).alias("blocked"))
    return out.select(key, "n_checks", "n_failed", F.when(F.col("blocked"), "FAIL").when(F.col("n_failed") > 0, "WARN").otherwise("PASS").alias("overall"))


def prefix_rollup(checks: DataFrame, prefixes: tuple[str, ...], key: str = "bundle_id") -> DataFrame:
    """Per bundle and prefix of check ids: FAIL without a match or with a failure, else PASS."""
    per = checks.groupBy(key).agg(*[F.count_if(F.col("check_id").startswith(p)).alias(f"n{k}") for k, p in enumerate(prefixes)], *[F.count_if(F.col("check_id").startswith(p) & (F.col("result") != "PASS")).alias(f"b{k}") for k, p in enumerate(prefixes)])
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("bad")) for k, p in enumerate(prefixes)])
    out = per.select(key, F.explode(rows).alias("r")).select(key, "r.*")
    return out.withColumn("result", F.when((F.col("n") == 0) | (F.col("bad") > 0), "FAIL").otherwise("PASS"))


def gate_report(results: DataFrame, registry: DataFrame, policy: str) -> DataFrame:
    """Per run and gate: ok, missing, unexpected, duplicate or downgraded, of results (run_id, gate_id, severity, result) against the
    gates of ``registry`` (gate_id, severity, policies: array) that apply to ``policy``. A registry of over ``MOST_GATES`` of them is refused: they become a list in the plan, so that no run is joined with all gates."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, _SEVERITIES)), c)
    due = registry.where(F.array_contains("policies", policy)).select("gate_id", F.col("severity").alias("due_severity"))
    got = results.groupBy("run_id", "gate_id").agg(F.count("*").alias("n"), F.min(rank(F.col("severity"))).alias("lowest"), F.bool_and(F.col("result").isin("PASS", "NOT_APPLICABLE")).alias("passed"))
    listed = due.limit(MOST_GATES + 1).collect()
    if len(listed) > MOST_GATES:
        raise ValueError(f"over {MOST_GATES} gates apply to {policy}")
    one = F.array(*[F.struct(F.lit(g.gate_id).alias("gate_id"), F.lit(g.due_severity).alias("due_severity")) for g in listed]).cast("array<struct<gate_id:string,due_severity:string>>")
    expected = results.select("run_id").distinct().select("run_id", F.explode(one).alias("g")).select("run_id", "g.*")
    out = expected.join(got, ["run_id", "gate_id"], "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("due_severity").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(F.col("lowest") < rank(F.col("due_severity")), "downgraded").otherwise("ok")
    return out.select("run_id", "gate_id", status.alias("status"), F.coalesce(F.col("passed") & (status == "ok"), F.lit(False)).alias("satisfied"))


def _asked(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the parts of their URL: scheme, host, port, path."""
    part = lambda p: F.try_parse_url("url", F.lit(p))
    scheme = F.lower(part("PROTOCOL"))
    authority = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    port = F.when(authority != "", authority.try_cast("int")).when(scheme == "https", 443).otherwise(80)
    return requests.select(*keys, "url", scheme.alias("scheme"), F.lower(part("HOST")).alias("host"), port.alias("port"), F.when(F.coalesce(part("PATH"), F.lit("")) == "", "/").otherwise(part("PATH")).alias("path"))


def _first_rules(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(scheme, host, port, path, idx): the first rule for each different request, by look-ups of its path's beginnings.

    A host's rules have few different lengths: a path is cut to each of them, and each cut is an equi-join with the rules. So a request takes a row a length, however many rules its host has.
    """
    target = ["scheme", "host", "port"]
    prefix = rules.select(*target, F.coalesce("path_prefix", F.lit("")).alias("prefix"), "idx").groupBy(*target, "prefix").agg(F.min("idx").alias("idx"))
    lengths = prefix.groupBy(*target).agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cuts = asked.select(*target, "path").distinct().join(lengths, target)
    cuts = cuts.select(*target, "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.expr("left(path, n)"))
    return cuts.join(prefix, [*target, "prefix"]).groupBy(*target, "path").agg(F.min("idx").alias("idx"))


def egress_decisions(requests: DataFrame, rules: DataFrame, many: int = 1000, small: int = 50_000) -> DataFrame:
    """Requests (request_id, url) with the first rule of ``rules`` (idx from 1, scheme, host, port, path_prefix) that allows them.

    Up to ``many`` rules of a host are one sorted array, joined on scheme, host and port, and the first that fits the path is taken within the row; so
    this works on streams, and requests are shuffled once at most. An allowlist of up to ``small`` rules goes to every task, so that the requests of a host don't meet in one. If a host has more, rules are looked up by the beginnings of paths; the number, which one job over the rules finds, decides the way alone.
    """
    keys = [c for c in requests.columns if c != "url"]
    asked, target = _asked(requests, keys), ["scheme", "host", "port"]
    if not requests.isStreaming and not rules.groupBy(*target).count().where(F.col("count") > many).isEmpty():
        out = asked.join(_first_rules(asked, rules), [*target, "path"], "left")
    else:
        by_host = rules.groupBy(*target).agg(F.array_sort(F.collect_list(F.struct("idx", "path_prefix"))).alias("rules"))
        by_host = F.broadcast(by_host) if rules.limit(small + 1).count() <= small else by_host
        fits = F.filter("rules", lambda r: r["path_prefix"].isNull() | F.startswith(F.col("path"), r["path_prefix"]))
        out = asked.join(by_host, target, "left").withColumn("idx", F.try_element_at(fits, F.lit(1))["idx"])
    return out.select(*keys, "url", *target, "path", F.when(F.col("idx").isNull(), "BLOCKED").otherwise("ALLOWED").alias("decision"), F.when(F.col("idx").isNotNull(), F.format_string("ALW%04d", "idx")).alias("rule_id"))


def egress_events(decisions: DataFrame, reason: str = "NOT_ALLOWLISTED") -> DataFrame:
    """Decisions (run_id, line_no, ts_utc, vault_id and, if there is one, body) as the audit events that record them, ready for a chain. Works on streams."""
    body = F.col("body") if "body" in decisions.columns else F.lit("")
    allowed = F.col("decision") == "ALLOWED"
    destination = F.struct(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("port", F.lit(0)).alias("port"), F.coalesce("scheme", F.lit("")).alias("scheme"))
    details = F.to_json(F.struct(F.col("rule_id").alias("allowlist_rule_id"), F.when(~allowed, reason).alias("block_reason"), destination.alias("destination"), F.lit("RUNTIME_OBSERVATION").alias("evidence_origin"), F.sha2(body.cast("binary"), 256).alias("request_hash_sha256")))
    return decisions.select("run_id", "line_no", "ts_utc", F.when(allowed, "EGRESS_REQUEST_ALLOWED").otherwise("EGRESS_REQUEST_BLOCKED").alias("event_type"), "vault_id", F.lit("system").alias("actor"), details.alias("details"))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """Allowlist rules (idx, scheme, host, port, path_prefix) in canonical form, with reject_reason.

    A missing or zero port is the scheme's own; a prefix gets forward slashes, the first one included.
    """
    scheme, prefix = F.lower("scheme"), F.replace(F.col("path_prefix"), F.lit("\\"), F.lit("/"))
    port = F.when(F.coalesce("port", F.lit(0)) != 0, F.col("port")).when(scheme == "https", 443).otherwise(80)
    out = rules.withColumns({"scheme": scheme, "host": ascii_host(F.col("host")), "port": port, "path_prefix": F.when(prefix.startswith("/"), prefix).otherwise(F.concat(F.lit("/"), prefix))})
    reason = F.when(~F.coalesce(F.col("scheme").isin("http", "https"), F.lit(False)), "scheme").when(F.coalesce("host", F.lit("")) == "", "host").when(F.coalesce(F.col("path_prefix").contains(".."), F.lit(False)), "path_prefix")
    return out.withColumn("reject_reason", reason)


def egress_gate(log: DataFrame) -> DataFrame:
    """Per run of an audit log (run_id, event_type, origin, reason, rule_id): counts and the allowlist gate's result."""
    t = F.col("event_type")
    blocked, allowed = t == "EGRESS_REQUEST_BLOCKED", t == "EGRESS_REQUEST_ALLOWED"
    out = log.groupBy("run_id").agg(
        F.count_if(t == "ALLOWLIST_UPDATED").alias("n_updates"), F.count_if(blocked & F.coalesce(F.col("origin") == "CONTROL_SIMULATION", F.lit(False))).alias("n_simulated"),
        F.count_if(blocked & F.coalesce(F.col("origin") == "RUNTIME_OBSERVATION", F.lit(False))).alias("n_observed"), F.count_if(blocked & ~F.coalesce(F.col("origin").isin("CONTROL_SIMULATION", "RUNTIME_OBSERVATION"), F.lit(False))).alias("n_ambiguous"),
        F.count_if(blocked & ~F.coalesce(F.col("reason").isin(*EGRESS_REASONS), F.lit(False))).alias("n_bad_reason"), F.count_if(allowed & (F.coalesce("rule_id", F.lit("")) == "")).alias("n_no_rule"),
    )
    fail = (F.col("n_updates") == 0) | (F.col("n_simulated") + F.col("n_observed") + F.col("n_ambiguous") == 0) | (F.col("n_ambiguous") > 0) | (F.col("n_bad_reason") > 0) | (F.col("n_no_rule") > 0)
    return out.withColumn("result", F.when(fail, "FAIL").when(F.col("n_observed") == 0, "NOT_APPLICABLE").otherwise("PASS"))


def effect_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(effect_id, problem): expected (effect_id, attempted, allowed) against observed effects: missing, unexpected, duplicate or flags differ."""
    e = expected.groupBy("effect_id").agg(F.count("*").alias("e_n"), F.bool_or("attempted").alias("e_att"), F.bool_or("allowed").alias("e_all"))
    o = observed.groupBy("effect_id").agg(F.count("*").alias("o_n"), F.bool_or("attempted").alias("o_att"), F.bool_or("allowed").alias("o_all"))
    why = F.when(F.col("o_n").isNull(), "missing").when(F.col("e_n").isNull(), "unexpected").when((F.col("e_n") > 1) | (F.col("o_n") > 1), "duplicate").when((F.col("e_att") != F.col("o_att")) | (F.col("e_all") != F.col("o_all")), "flags differ")
    return e.join(o, "effect_id", "full_outer").select("effect_id", why.alias("problem")).where("problem is not null")


def nearest_rank(rows: DataFrame, keys: list[str], column: str, percent: int = 95, bits: int = 20) -> DataFrame:
    """(keys, rank_value): the nearest-rank percentile of whole numbers, exact for groups of any size and any number of different values. Nulls don't count.

    A histogram of ranges of 2^bits values tells which range holds the rank; then only that range's values are counted one by one. So
    no state holds more than a count a range of a task, and no window more than 2^bits values of a group.
    """
    cut = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("long").alias("__v")).withColumn("__bin", F.shiftright("__v", bits))
    of = Window.partitionBy(*keys)
    bins = cut.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    below = F.sum("__n").over(of.orderBy("__bin")) - F.col("__n")
    rank = F.floor((F.sum("__n").over(of) * percent + 99) / 100)
    bins = bins.select(*keys, "__bin", "__n", below.alias("__below"), rank.alias("__rank")).where((F.col("__below") < F.col("__rank")) & (F.col("__rank") <= F.col("__below") + F.col("__n")))
    values = cut.join(bins.select(*keys, "__bin", (F.col("__rank") - F.col("__below")).alias("__rank")), [*keys, "__bin"]).groupBy(*keys, "__v", "__rank").agg(F.count(F.lit(1)).alias("__n"))
    reached = F.sum("__n").over(of.orderBy("__v"))
    return values.withColumn("__to", reached).where("__to >= __rank").groupBy(*keys).agg(F.min("__v").alias("rank_value"))


def p95(column: str) -> Column:
    """The nearest-rank 95th percentile of whole numbers, of which a group has few different ones (its state is a count of each); of many see ``nearest_rank``."""
    return F.expr(f"cast(percentile_disc(0.95) within group (order by {column}) as long)")


def performance(samples: DataFrame, key: str = "run_id") -> DataFrame:
    """Figures and verdict of each run from samples (run_id, phase, elapsed_ms, cleanup_ms, peak_disk_bytes, input_bytes).

    Phases are COLD_CACHED, WARM and FIVE_SECOND. One pass: a phase's percentile ignores the other phases' nulls.
    """
    phase = lambda p, x: F.when(F.col("phase") == p, x)
    rows = samples.withColumns({"cold": phase("COLD_CACHED", F.col("elapsed_ms")), "warm": phase("WARM", F.col("elapsed_ms")), "over": phase("FIVE_SECOND", F.greatest(F.col("elapsed_ms") - 5000, F.lit(0)))})
    out = rows.groupBy(key).agg(p95("cold").alias("cold_p95"), p95("warm").alias("warm_p95"), p95("over").alias("overhead_p95"), p95("cleanup_ms").alias("cleanup_p95"), F.max("cleanup_ms").alias("cleanup_max"), F.max("peak_disk_bytes").alias("peak_disk"), F.max("input_bytes").alias("input_bytes"))
    out = out.withColumns({"overhead_percent": F.expr("(overhead_p95 * 100 + 4999) div 5000"), "disk_ceiling": F.expr("input_bytes * 5 div 2 + 134217728")})
    fits = (F.col("cold_p95") <= 5000) & (F.col("warm_p95") <= 2000) & (F.col("cleanup_p95") <= 2000) & (F.col("cleanup_max") <= 5000) & (F.col("overhead_p95") <= 1000) & (F.col("overhead_percent") <= 20) & (F.col("peak_disk") <= F.col("disk_ceiling"))
    return out.withColumn("gates_passed", F.coalesce(fits, F.lit(False))).drop("input_bytes")


def regressions(current: DataFrame, baseline: DataFrame, most: float = 0.1) -> DataFrame:
    """Metrics (metric, value) that got worse than their baseline by more than the part ``most``."""
    out = current.join(baseline.select("metric", F.col("value").alias("baseline")), "metric").withColumn("ratio", (F.col("value") - F.col("baseline")) / F.nullif("baseline", F.lit(0.0)))
    return out.withColumn("regressed", F.coalesce(F.col("ratio") > most, F.lit(False)))


def claim_decisions(claims: DataFrame, as_of: str) -> DataFrame:
    """Each claim request's decision: Unknown, Denied or Authorized.

    Columns: identity_matches, generated, valid_until, prohibited, permitted, credentials_required, credentials_available,
    tool_required, tool_used.
    """
    at = F.lit(as_of).cast("timestamp")
    in_time = (at >= F.col("generated")) & (at <= F.col("valid_until"))
    unknown = F.lit("Unknown")
    decision = F.when(~F.col("identity_matches") | ~F.coalesce(in_time, F.lit(False)), unknown).when(F.col("prohibited"), "Denied").when(~F.col("permitted"), unknown)
    decision = decision.when(F.col("credentials_required") & ~F.col("credentials_available"), unknown).when(F.col("tool_required") & ~F.col("tool_used"), unknown).otherwise("Authorized")
    return claims.withColumn("decision", decision)


def order_violations(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Rows whose ``value`` is smaller than that of the row before them (binary order)."""
    return before(rows.withColumn("value", value), "value", key, order).where("before > value")


def input_fingerprint(items: DataFrame, key: str) -> DataFrame:
    """The SHA-256 of each group's sorted ``id:sha256`` list joined by ``|``."""
    text = F.concat_ws(":", "artifact_id", "sha256")
    return ordered_sha256(items.select(key, text.alias("text")), key, ["text"], "|").withColumnRenamed("sha256", "fingerprint")
