"""Incident logs: severities, timelines, redaction.

Log rows have the columns incident_id, idx (from 0), timestamp, source_system, actor, action, affected_resource, evidence_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import severity
from ..functions.ids import event_id, timeline_anchor
from ..functions.text import digit_fold, drop_nul, keyword_hits
from .audit import ordered_sha256

#: The patterns of personal data, in the order they are replaced.
PII = {"email": ("Email address", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), "phone": ("Phone number", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"), "ssn": ("Social security number", r"\b\d{3}-\d{2}-\d{4}\b")}
IP = ("Network address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b")
COMMANDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "curl", "wget", "password", "secret", "token")
PROFILES = ("BASIC", "STANDARD", "STRICT")


def parse_events(log: DataFrame) -> DataFrame:
    """Timestamps, severities, ids and anchors of log rows; a timestamp without digits counts as idx * 1000."""
    ts = F.coalesce(digit_fold(F.col("timestamp")), F.col("idx").cast("long") * 1000)
    rows = log.withColumn("evidence_text", drop_nul(F.col("evidence_text"))).withColumns({"ts": ts, "severity": severity(F.col("action"), F.col("evidence_text"))})
    rows = rows.withColumn("event_id", event_id(F.col("ts"), F.col("idx"), F.col("action"), F.col("source_system")))
    return rows.withColumn("anchor_id", timeline_anchor(F.col("incident_id"), F.col("event_id"), F.col("evidence_text"), F.col("ts")))


def timeline(events: DataFrame) -> DataFrame:
    """Duration, counts by severity and hash of each incident's timeline.

    The hash runs over anchors and times in order, as a stream: an incident of any length needs the memory of a batch.
    """
    text = F.concat("anchor_id", F.col("ts").cast("string"))
    hashes = ordered_sha256(events.select("incident_id", "ts", "idx", text.alias("text")), "incident_id", ["ts", "idx", "text"]).withColumnRenamed("sha256", "timeline_hash")
    counts = events.groupBy("incident_id").agg(F.greatest(F.max("ts") - F.min("ts"), F.lit(0)).alias("duration"), *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")])
    joined = counts.join(hashes.withColumnRenamed("incident_id", "of"), F.col("incident_id").eqNullSafe(F.col("of")), "left")
    return joined.drop("of")


def timeline_lines(events: DataFrame) -> DataFrame:
    """(incident_id, ts, idx, line): the timeline's CSV lines."""
    resource = F.replace("affected_resource", F.lit('"'), F.lit('""'))
    return events.select("incident_id", "ts", "idx", F.concat_ws(",", "timestamp", "source_system", "actor", "action", resource, "severity", "anchor_id").alias("line"))


def redact(text: Column, profile: str = "STANDARD") -> Column:
    """A text with personal data (and addresses, unless BASIC) masked, class after class, so that no match leaks."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    for reason, pattern in [*PII.values(), *([] if profile == "BASIC" else [IP])]:
        text = F.regexp_replace(text, pattern, f"[REDACTED: {reason}]")
    return text


def redaction_spans(docs: DataFrame, text_col: str, id_cols: list[str], profile: str = "STANDARD") -> DataFrame:
    """One row a match of the patterns: the id columns, span_start and span_end (bytes, end exclusive), original, reason, rule.

    A text is cut at its matches, so that offsets are sums of lengths; no row leaves the JVM.
    """
    text, size = F.col(text_col), lambda x: F.octet_length(x)
    rules = [(f"PII.{k}", reason, p) for k, (reason, p) in PII.items()] + ([] if profile == "BASIC" else [("SYSTEM.ip_address", *IP)])

    def spans(rule: str, reason: str, pattern: str) -> Column:
        found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        step = lambda acc, z: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["end"] + size(z["b"])).alias("start"), (F.element_at(acc, -1)["end"] + size(z["b"]) + size(z["f"])).alias("end"), z["f"].alias("original"))))
        first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("original")))
        walked = F.aggregate(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("f")), first, step)
        return F.transform(F.slice(walked, 2, 1 << 30), lambda s: F.struct(s["start"].alias("span_start"), s["end"].alias("span_end"), s["original"].alias("original"), F.lit(reason).alias("reason"), F.lit(rule).alias("rule")))

    return docs.where(text.isNotNull()).select(*id_cols, F.explode(F.flatten(F.array(*[spans(*r) for r in rules]))).alias("r")).select(*id_cols, "r.*")


def redactions_map(events: DataFrame, profile: str = "STANDARD") -> DataFrame:
    """(incident_id, ts, idx, item): what is masked in the evidence of parsed events, as JSON objects."""
    spans = redaction_spans(events, "evidence_text", ["incident_id", "ts", "idx", "anchor_id", "timestamp"], profile)
    item = F.struct(F.col("anchor_id").alias("event_id"), "timestamp", F.col("original").alias("original_text"), "reason", F.col("rule").alias("profile_rule"))
    return spans.select("incident_id", "ts", "idx", F.to_json(item).alias("item"))


def citations_map(events: DataFrame) -> DataFrame:
    """(incident_id, ts, idx, item): each parsed event as the JSON object that cites it."""
    item = F.struct(F.concat(F.lit("C"), "anchor_id").alias("claim_id"), "anchor_id", "timestamp", F.col("source_system").alias("system"), "action")
    return events.select("incident_id", "ts", "idx", F.to_json(item).alias("item"))


def redaction_records(docs: DataFrame, text_col: str, id_cols: list[str], profile: str = "STRICT") -> DataFrame:
    """One row a match: the id columns, rule, ordinal (from 0, within the rule), original."""
    text = F.col(text_col)
    lists = [(f"PII.{k}", F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (_, p) in PII.items()]
    if profile != "BASIC":
        lists.append(("SYSTEM.ip_address", F.regexp_extract_all(text, F.lit(IP[1]), F.lit(0))))
    if profile == "STRICT":
        lists.append(("COMMAND.output", keyword_hits(text, COMMANDS, fold=False)))

    def named(rule: str):
        return lambda v, i: F.struct(F.lit(rule).alias("rule"), i.alias("ordinal"), v.alias("original"))

    each = F.flatten(F.array(*[F.transform(found, named(rule)) for rule, found in lists]))
    return docs.select(*id_cols, F.explode(each).alias("r")).select(*id_cols, "r.*")
