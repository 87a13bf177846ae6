"""Queries over events as incident logs, audit logs and run states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsons import canonical
from ..functions.text import digit_fold
from ..operators import audit, bundles, incident, reports
from ..sinks import logs
from ..streaming import processors, stateful
from .documents import _PATTERNS
from .registry import query, scratch, table

LOG_SQL = """log AS (SELECT CAST(user_id AS VARCHAR) AS incident_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
    'sys' || (event_id % 5) AS source_system, event_type AS action, CASE WHEN event_id % 7 = 0 THEN props || ' timeout' ELSE props END AS evidence, CASE WHEN event_type = 'error' THEN 'HIGH' WHEN event_id % 7 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events),
  ev AS (SELECT *, CAST(regexp_replace(stamp, '[^0-9]', '', 'g') AS BIGINT) AS t, evidence AS e FROM log),
  ev2 AS (SELECT *, 'INCIDENT_' || printf('%08x', xor(t, idx) & 4294967295) || '_' || printf('%04x', idx & 65535) || '_' || printf('%04x', xor(strlen(action), strlen(source_system)) & 65535) AS event_id FROM ev),
  ev3 AS (SELECT *, 'INCIDENT_' || event_id || '_' || substr(sha256(incident_id || event_id || e || t), 1, 16) AS anchor_id FROM ev2)"""


def log_rows(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(
        F.col("user_id").cast("string").alias("incident_id"), idx.cast("long").alias("idx"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("sys"), (F.col("event_id") % 5).cast("string")).alias("source_system"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("affected_resource"), F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit(" timeout"))).otherwise(F.col("props")).alias("evidence_text"),
    )


@query("inc_severity", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'HIGH' WHEN event_id % 7 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events")
def inc_severity(spark, sf_dir):
    from ..functions.checks import severity

    return table(spark, sf_dir, "events").select("event_id", severity(F.col("event_type"), F.when(F.col("event_id") % 7 == 0, "Timeout").otherwise("")).alias("severity"))


@query("inc_digit_ts", "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS folded FROM events")
def inc_digit_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", digit_fold(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("folded"))


@query("inc_events", f"WITH {LOG_SQL} SELECT incident_id, idx, t AS ts, severity, event_id, anchor_id FROM ev3")
def inc_events(spark, sf_dir):
    return incident.parse_events(log_rows(spark, sf_dir)).select("incident_id", "idx", "ts", "severity", "event_id", "anchor_id")


@query("inc_timeline", f"""WITH {LOG_SQL} SELECT incident_id, CAST(greatest(max(t) - min(t), 0) AS BIGINT) AS duration, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium,
    count(*) FILTER (severity = 'LOW') AS n_low, sha256(string_agg(anchor_id || t, '' ORDER BY t, idx)) AS timeline_hash FROM ev3 GROUP BY incident_id""")
def inc_timeline(spark, sf_dir):
    return incident.timeline(incident.parse_events(log_rows(spark, sf_dir)))


EVENT_SQL = """au AS (SELECT 'r' || user_id AS run_id, CAST(event_id AS BIGINT) AS line_no, '{"actor":"user","details":' || replace(props, ': ', ':') || ',"event_hash":"' || repeat('0', 64) || '","event_type":"' || event_type || '","prev_event_hash":"' AS head,
    '","run_id":"r' || user_id || '","ts_utc":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","vault_id":"v1"}' AS tail FROM events)"""
""
_CHAIN = f"""WITH RECURSIVE {EVENT_SQL}, n AS (SELECT run_id, line_no, head, tail, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k FROM au),
  c AS (SELECT run_id, line_no, k, repeat('0', 64) AS prev_event_hash, sha256(head || repeat('0', 64) || tail) AS event_hash FROM n WHERE k = 1
    UNION ALL SELECT n.run_id, n.line_no, n.k, c.event_hash, sha256(n.head || c.event_hash || n.tail) FROM c JOIN n ON n.run_id = c.run_id AND n.k = c.k + 1)
  SELECT run_id, line_no, prev_event_hash, event_hash FROM c"""


def audit_events(events):
    return events.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("line_no"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), "event_type", F.lit("v1").alias("vault_id"), F.lit("user").alias("actor"), F.col("props").alias("details")
    )


@query("aud_chain_build", _CHAIN)
def aud_chain_build(spark, sf_dir):
    return audit.build_chain(audit_events(table(spark, sf_dir, "events")))


@query("aud_chain_verify", """SELECT 'r' || user_id AS run_id, count(*) AS n_events, CAST(0 AS BIGINT) AS n_unlinked, count(*) FILTER (event_id % 1000 = 3) AS n_altered, min(event_id) FILTER (event_id % 1000 = 3) AS first_bad_line,
    CASE WHEN count(*) FILTER (event_id % 1000 = 3) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM events GROUP BY user_id""")
def aud_chain_verify(spark, sf_dir):
    events = audit_events(table(spark, sf_dir, "events"))
    chained = audit.build_chain(events, keep=("ts_utc", "event_type", "vault_id", "actor", "details"))
    altered = chained.withColumn("vault_id", F.when(F.col("line_no") % 1000 == 3, "v2").otherwise(F.col("vault_id")))
    return audit.verify_chain(altered)


_STATE = "CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'EVALUATING' WHEN 'purchase' THEN 'EXPORTING' ELSE 'FAILED' END"
_TRANSITIONS = f"""SELECT run_id, line_no, from_state, to_state FROM (SELECT 'r' || user_id AS run_id, event_id AS line_no, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, {_STATE} AS to_state FROM events)
    WHERE from_state IS NOT NULL AND from_state || '>' || to_state NOT IN ('CREATED>READY', 'READY>EVALUATING', 'EVALUATING>EXPORTING', 'EVALUATING>FAILED', 'EXPORTING>FAILED')"""


def run_states(events):
    state = F.when(F.col("event_type") == "signup", "CREATED").when(F.col("event_type") == "view", "READY").when(F.col("event_type") == "click", "EVALUATING").when(F.col("event_type") == "purchase", "EXPORTING").otherwise("FAILED")
    return events.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("line_no"), state.alias("state"))


@query("aud_state_transitions", _TRANSITIONS)
def aud_state_transitions(spark, sf_dir):
    return audit.illegal_transitions(run_states(table(spark, sf_dir, "events")))


@query("aud_taxonomy", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN '' ELSE 'reason,to_state' END AS lacks,
    CASE event_type WHEN 'view' THEN 'unknown event_type' WHEN 'click' THEN 'ok' ELSE 'missing keys' END AS verdict FROM events""")
def aud_taxonomy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "NO_SUCH_TYPE").when(F.col("event_type") == "click", "ARTIFACT_INGEST_COMPLETED").otherwise("RUN_STATE_CHANGED")
    details = F.when(F.col("event_type") == "click", F.lit('{"artifact_count": 1}')).otherwise(F.lit('{"from_state": "READY"}'))
    return audit.taxonomy(e.select("event_id", kind.alias("event_type"), details.alias("details"))).select("event_id", "lacks", "verdict")


@query("aud_last_line", "SELECT 'r' || user_id AS run_id, max(event_id) AS last_line FROM events GROUP BY user_id")
def aud_last_line(spark, sf_dir):
    from ..sources.readers import last_hash

    e = audit_events(table(spark, sf_dir, "events")).withColumn("event_hash", F.col("line_no"))
    return last_hash(e).select("run_id", F.col("last_hash").alias("last_line"))


@query("canonical_json", """SELECT event_id, '{"a":' || replace(props, ': ', ':') || ',"z":[1,{"b":2,"c":"x"}]}' AS json FROM events""")
def canonical_json(spark, sf_dir):
    text = F.concat(F.lit('{ "z" : [1, {"c":"x", "b": 2}], "a": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", canonical(text).alias("json"))


@query("egress_gate", """SELECT 'r' || user_id AS run_id, count(*) FILTER (event_type = 'signup') AS n_updates, count(*) FILTER (event_type = 'error' AND event_id % 3 = 0) AS n_simulated, count(*) FILTER (event_type = 'error' AND event_id % 3 = 1) AS n_observed,
    count(*) FILTER (event_type = 'error' AND event_id % 3 = 2 AND user_id % 2 = 1) AS n_ambiguous, CAST(0 AS BIGINT) AS n_bad_reason, count(*) FILTER (event_type = 'click' AND event_id % 50 = 7) AS n_no_rule,
    CASE WHEN count(*) FILTER (event_type = 'signup') = 0 OR count(*) FILTER (event_type = 'error' AND (event_id % 3 < 2 OR user_id % 2 = 1)) = 0 OR count(*) FILTER (event_type = 'error' AND event_id % 3 = 2 AND user_id % 2 = 1) > 0 OR count(*) FILTER (event_type = 'click' AND event_id % 50 = 7) > 0 THEN 'FAIL'
      WHEN count(*) FILTER (event_type = 'error' AND event_id % 3 = 1) = 0 THEN 'NOT_APPLICABLE' ELSE 'PASS' END AS result FROM events GROUP BY user_id""")
def egress_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    kind = F.when(F.col("event_type") == "signup", "ALLOWLIST_UPDATED").when((F.col("event_type") == "error") & ((k < 2) | (F.col("user_id") % 2 == 1)), "EGRESS_REQUEST_BLOCKED").when(F.col("event_type") == "click", "EGRESS_REQUEST_ALLOWED").otherwise("OTHER")
    origin = F.when(k == 0, "CONTROL_SIMULATION").when(k == 1, "RUNTIME_OBSERVATION")
    return bundles.egress_gate(e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), kind.alias("event_type"), origin.alias("origin"), F.lit("OFFLINE_MODE").alias("reason"), F.when(F.col("event_id") % 50 != 7, "ALW0001").alias("rule_id")))


_PHASE = "CASE WHEN event_type = 'click' THEN 'COLD_CACHED' WHEN event_type = 'view' THEN 'WARM' ELSE 'FIVE_SECOND' END"


@query("perf_p95", f"SELECT {_PHASE} AS phase, CAST(quantile_disc(CAST(floor(value * 100) AS BIGINT), 0.95) AS BIGINT) AS p95 FROM events GROUP BY 1")
def perf_p95(spark, sf_dir):
    return bundles.nearest_rank(samples(spark, sf_dir), ["phase"], "v").withColumnRenamed("rank_value", "p95")


def samples(spark, sf_dir):
    t = F.col("event_type")
    phase = F.when(t == "click", "COLD_CACHED").when(t == "view", "WARM").otherwise("FIVE_SECOND")
    v = F.floor(F.col("value") * 100)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("run_id"), phase.alias("phase"), v.alias("v"), F.when(phase == "FIVE_SECOND", F.lit(5000) + v).otherwise(v).alias("elapsed_ms"), (F.col("event_id") % 2500).alias("cleanup_ms"), (F.col("event_id") * 1000).alias("peak_disk_bytes"), F.lit(1000).cast("long").alias("input_bytes"))


@query("perf_summary", f"""WITH s AS (SELECT 'r' || (user_id % 10) AS run_id, {_PHASE} AS phase, CAST(floor(value * 100) AS BIGINT) AS v, event_id % 2500 AS cleanup_ms, event_id * 1000 AS disk FROM events),
  g AS (SELECT run_id, quantile_disc(CASE WHEN phase = 'COLD_CACHED' THEN v END, 0.95) AS cold_p95, quantile_disc(CASE WHEN phase = 'WARM' THEN v END, 0.95) AS warm_p95, quantile_disc(CASE WHEN phase = 'FIVE_SECOND' THEN greatest(v, 0) END, 0.95) AS overhead_p95,
    quantile_disc(cleanup_ms, 0.95) AS cleanup_p95, max(cleanup_ms) AS cleanup_max, max(disk) AS peak_disk FROM s GROUP BY run_id)
  SELECT *, (overhead_p95 * 100 + 4999) // 5000 AS overhead_percent, CAST(2500 + 134217728 AS BIGINT) AS disk_ceiling,
    coalesce(cold_p95 <= 5000 AND warm_p95 <= 2000 AND cleanup_p95 <= 2000 AND cleanup_max <= 5000 AND overhead_p95 <= 1000 AND (overhead_p95 * 100 + 4999) // 5000 <= 20 AND peak_disk <= 134220228, false) AS gates_passed FROM g""")
def perf_summary(spark, sf_dir):
    return bundles.performance(samples(spark, sf_dir))


@query("freshness", "SELECT event_id, event_id % 30 <= 24 AND event_id % 5 <= event_id % 30 AS fresh FROM events")
def freshness(spark, sf_dir):
    from ..functions.checks import fresh

    hours = lambda n: F.make_dt_interval(hours=n)
    e, g = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    return e.select("event_id", fresh(g, g + hours((F.col("event_id") % 5).cast("int")), g + hours((F.col("event_id") % 30).cast("int"))).alias("fresh"))


@query("claim_decisions", """SELECT event_id, CASE WHEN event_id % 11 = 0 OR ts > TIMESTAMP '2024-01-15 00:00:00' THEN 'Unknown' WHEN event_type = 'error' THEN 'Denied' WHEN event_type = 'view' THEN 'Unknown' WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 'Unknown' WHEN event_id % 4 = 0 AND user_id % 3 = 0 THEN 'Unknown' ELSE 'Authorized' END AS decision FROM events""")
def claim_decisions(spark, sf_dir):
    e, n, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    c = e.select(n, (n % 11 != 0).alias("identity_matches"), F.col("ts").cast("timestamp").alias("generated"), F.lit("2030-01-01").cast("timestamp").alias("valid_until"), (F.col("event_type") == "error").alias("prohibited"), (F.col("event_type") != "view").alias("permitted"), (n % 5 == 0).alias("credentials_required"), (u % 2 != 0).alias("credentials_available"), (n % 4 == 0).alias("tool_required"), (u % 3 != 0).alias("tool_used"))
    return bundles.claim_decisions(c, "2024-01-15 00:00:00").select("event_id", "decision")


def _streamed(spark, sf_dir, make):
    """Run a stateful query over the table as a stream, up to its end; the result is read from the sink."""
    at = scratch(spark, "stream")
    batch = table(spark, sf_dir, "events")
    out = make(spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events*.parquet"))
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("stream_audit_chain", _CHAIN)
def stream_audit_chain(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: stateful.chain_stream(audit_events(e)))


@query("stream_transitions", _TRANSITIONS)
def stream_transitions(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: stateful.transition_stream(run_states(e)))


_LINED = _CHAIN.replace("'r' || user_id", "'r' || event_id % 50").replace("\"run_id\":\"r' || user_id", "\"run_id\":\"r' || event_id % 50").replace("CAST(event_id AS BIGINT) AS line_no", "CAST(event_id // 50 AS BIGINT) AS line_no")


def _dealt(spark, rows):
    """Rows as a stream of one small file after another, in no order."""
    at = scratch(spark, "dealt")
    rows.repartition(5).write.parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


@query("stream_log", _LINED)
def stream_log(spark, sf_dir):
    """Lines that come in no order, chained in theirs and appended to a log batch by batch."""
    events, n = table(spark, sf_dir, "events"), F.col("event_id")
    rows = audit_events(events.withColumn("user_id", n % 50)).withColumn("line_no", F.expr("line_no div 50"))
    processors.use_rocksdb(spark)
    log, at = scratch(spark, "log"), scratch(spark, "log-state")
    logs.append_log(processors.ordered_chain(_dealt(spark, rows)), log, at).awaitTermination()
    return logs.read_log(spark, log)


@query("stream_expired_claims", """WITH c AS (SELECT DISTINCT 'u' || user_id AS claim_id, ts FROM events), n AS (SELECT claim_id, ts, lead(ts) OVER (PARTITION BY claim_id ORDER BY ts) AS again FROM c)
  SELECT claim_id, ts AS generated, ts + INTERVAL 24 HOUR AS valid_until FROM n WHERE (again IS NULL OR again > ts + INTERVAL 24 HOUR) AND ts + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_expired_claims(spark, sf_dir):
    processors.use_rocksdb(spark)
    claims = lambda e: e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("claim_id"), F.col("ts").cast("timestamp").alias("generated"))
    return _streamed(spark, sf_dir, lambda e: processors.expired_claims(claims(e)))


@query("stream_sliding", """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start, event_type, value FROM events, range(4) r(k))
  SELECT window_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM w WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Days that begin every six hours, on a stream: those that the watermark has passed."""
    days = lambda e: stateful.tumbling(e.withColumns({"value": F.col("value").cast("decimal(18,2)"), "ts": F.col("ts").cast("timestamp")}), slide="6 hours").withColumn("total", F.col("total").cast("double"))
    return _streamed(spark, sf_dir, days)


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    return stateful.tumbling(table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))).withColumn("total", F.col("total").cast("double"))


@query("ext_session", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark, sf_dir):
    return stateful.sessions(table(spark, sf_dir, "events"))


def _packet_sql(title: str, tally: str, last: str, heading: str, evidence: str, end: str) -> str:
    return f"""WITH {LOG_SQL}, s AS (SELECT incident_id, count(*) AS n, max(t) - min(t) AS duration, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l, sha256(string_agg(anchor_id || t, '' ORDER BY t, idx)) AS hash FROM ev3 GROUP BY 1),
  p AS (SELECT incident_id, 0 AS section, 0 AS ts, 0 AS idx, ['# Incident Timeline - {title}', '', '## Overview', '', '- **Total Events:** ' || n, '- **Timeline Duration:** ' || (duration // 1000) || 's', '- **Severity {tally}:** ' || h || ' HIGH, ' || m || ' MEDIUM, ' || l || ' LOW', {last}, '', '## {heading}', ''] AS ls FROM s
    UNION ALL SELECT incident_id, 1, t, idx, ['**' || stamp || '** | ' || source_system || ' | ' || severity, 'u' || incident_id || ' → ' || action, 'Resource: ' || regexp_replace(evidence, ' timeout$', ''), {evidence}, '<!-- CLAIM:C' || anchor_id || ' ANCHOR:' || anchor_id || ' -->', ''] FROM ev3
    UNION ALL SELECT incident_id, 2, 0, 0, ['---', '', '{end}'] FROM s)
  SELECT incident_id, CAST(section AS INTEGER) AS section, CAST(ts AS BIGINT) AS ts, CAST(idx AS BIGINT) AS idx, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM p"""


def _masked_sql() -> str:
    x = "evidence"
    for reason, pattern in _PATTERNS.values():
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED: {reason}]', 'g')"
    return x


@query("inc_packet_internal", _packet_sql("Internal Analysis", "Breakdown", "'- **Timeline Hash:** ' || hash", "Complete Timeline with Citations", "'Evidence: ' || evidence", "*This internal packet contains full unredacted details*"))
def inc_packet_internal(spark, sf_dir):
    return reports.incident_packet(incident.parse_events(log_rows(spark, sf_dir)))


@query("inc_packet_customer", _packet_sql("Customer Summary", "Summary", "'- **Redaction Profile:** Standard'", "Redacted Timeline", f"{_masked_sql()}, ''", "*This customer packet has redactions applied per profile*"))
def inc_packet_customer(spark, sf_dir):
    return reports.incident_packet(incident.parse_events(log_rows(spark, sf_dir)), "STANDARD")
