"""Evidence packs and small projections of the other packs.

Evidence items have the columns pack (whose they are), artifact_id, artifact_sha256, title, tags and labels (arrays). Long results are ordered lines, as in
``reports``; no list grows with the corpus but the one that is asked for (``mapping_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import consent_status, plus_years
from ..functions.ids import sha
from ..functions.jsons import number_text, with_numbers
from .documents import UNCERTAIN_TERMS, claim_lines, latest_consents

#: The controls: id, title, capability, family, description.
CONTROLS = (
    ("CTRL-AC-001", "Access control boundary", "Access Control", "AccessControl", "Evidence that access boundaries are defined and enforced."),
    ("CTRL-AU-001", "Audit event integrity", "Auditability", "Auditability", "Evidence that audit events are complete and tamper-evident."),
    ("CTRL-CI-001", "Citation traceability", "Traceability", "Traceability", "Evidence that narrative claims are citation-backed."),
    ("CTRL-DP-001", "Data protection in exports", "Data Protection", "DataProtection", "Evidence that restricted data is handled with policy controls."),
    ("CTRL-MG-001", "Model identity governance", "Model Governance", "ModelGovernance", "Evidence that model identity and pinning are recorded."),
    ("CTRL-NW-001", "Offline and egress posture", "Network Governance", "NetworkGovernance", "Evidence that network mode and allowlist controls are enforced."),
)
#: Headings of the evidence index and of the list of hashes.
INDEX_CSV = "artifact_id,artifact_sha256,title,tags,control_families"
HASHES_CSV = "artifact_id,bundle_rel_path,sha256,bytes,content_type,logical_role"
#: How sure the text of a document is, by the way it was extracted.
EXTRACTION_CONFIDENCE = {"NATIVE_PDF": 0.98, "OCR": 0.85}
#: What each kind of pack delivers, and what it attaches.
OUTPUTS = {
    "finance": (("exceptions_audit.md", "compliance_internal.md", "exceptions.csv"), ("exceptions_map.json", "compliance_summary.json")),
    "incident": (("customer_packet.md", "internal_packet.md", "timeline.csv"), ("redactions_map.json", "citations_map.json")),
    "contract": (("risk_memo.md", "clause_map.csv", "redline_suggestions.md"), ("citations_map.json", "anchor_index.json")),
    "transcript": (("draft_note.md", "verification_checklist.md"), ("consent_record.json", "citations_map.json", "uncertainty_map.json")),
}


def controls(spark, capabilities: tuple[str, ...] = ()) -> DataFrame:
    """The controls with one of the capabilities; all of them, if none is named."""
    table = spark.createDataFrame(CONTROLS, "control_id string, title string, capability string, control_family string, description string")
    return table.where(F.col("capability").isin(*capabilities)) if capabilities else table


def controls_for(asked: DataFrame, capabilities: str = "capabilities") -> DataFrame:
    """Each row with its controls (control_id, title, capability, control_family, description): those with one of its capabilities (an array), or all if it names none. Within the row, as the controls are few and fixed."""
    one = lambda c: F.struct(*[F.lit(x).alias(n) for n, x in zip(("control_id", "title", "capability", "control_family", "description"), c)])
    every, own = F.array(*map(one, CONTROLS)), F.coalesce(capabilities, F.array().cast("array<string>"))
    mine = F.filter(every, lambda c: (F.size(own) == 0) | F.array_contains(own, c["capability"]))
    return asked.withColumn("__c", F.explode(mine)).select(*asked.columns, "__c.*")


def csv_field(text: Column) -> Column:
    """A text as a CSV field, quoted only where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def extraction_confidence(mode: Column) -> Column:
    return F.when(mode == "NATIVE_PDF", EXTRACTION_CONFIDENCE["NATIVE_PDF"]).when(mode == "OCR", EXTRACTION_CONFIDENCE["OCR"]).otherwise(0.80)


def retention_ok(profile: Column) -> Column:
    """Whether a retention profile is named."""
    return F.coalesce(F.trim(profile) != "", F.lit(False))


def artifact_id(content: Column, kind: str = "contract") -> Column:
    """``a_<kind>_`` and eight hex digits of the content's SHA-256."""
    return F.concat(F.lit(f"a_{kind}_"), sha(content, 8))


def map_keys_sorted(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps have the same keys with the same values."""
    return (F.size(a) == F.size(b)) & within_map(a, b)


def within_map(a: Column, b: Column) -> Column:
    """Whether each entry of a map is one of another."""
    return F.size(F.map_filter(a, lambda k, v: ~F.coalesce(F.try_element_at(b, k) == v, F.lit(False)))) == 0


def pick_adapters(calls: DataFrame, adapters: DataFrame) -> DataFrame:
    """Calls (call_id, adapter_id) with the first adapter of that id in ``adapters`` (idx, adapter_id, endpoint), or a reason."""
    first = adapters.groupBy("adapter_id").agg(F.min_by("endpoint", "idx").alias("endpoint"), F.lit(True).alias("found"))
    out = calls.join(first, "adapter_id", "left")
    return out.select("call_id", "adapter_id", "endpoint", F.when(F.col("found").isNull(), "adapter not found").alias("reject_reason"))


def output_manifest(spark) -> DataFrame:
    """(kind, folder, file): the files that each kind of pack writes, below its folder of exports."""
    rows = [(kind, folder, f) for kind, both in OUTPUTS.items() for folder, files in zip(("deliverables", "attachments"), both) for f in files]
    return spark.createDataFrame(rows, "kind string, folder string, file string")


def outputs_of(kind: Column) -> Column:
    """An array of (folder, file): what a pack of a kind writes, in order of OUTPUTS; null for an unknown kind."""
    files = {k: F.array(*[F.struct(F.lit(folder).alias("folder"), F.lit(f).alias("file")) for folder, fs in zip(("deliverables", "attachments"), both) for f in fs]) for k, both in OUTPUTS.items()}
    return F.try_element_at(F.create_map(*[x for k, v in files.items() for x in (F.lit(k), v)]), kind)


def directory_bytes(files: DataFrame, root_col: str = "root") -> DataFrame:
    """Files and bytes under each root of (root, path, bytes)."""
    return files.groupBy(root_col).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def missing_inputs(hashes: DataFrame, entries: DataFrame) -> DataFrame:
    """Hash rows (bundle_id, artifact_id) of inputs whose bytes ``inputs_snapshot/artifacts/<id>/bytes`` a bundle's entries lack; outputs (``o:``) need none."""
    held = entries.select("bundle_id", "path").distinct()
    asked = hashes.where(~F.col("artifact_id").startswith("o:")).withColumn("path", F.concat(F.lit("inputs_snapshot/artifacts/"), "artifact_id", F.lit("/bytes")))
    return asked.join(held, ["bundle_id", "path"], "left_anti")


def workflow_counts(events: DataFrame, key: str = "incident_id") -> DataFrame:
    """Events of each incident, those whose evidence a rule masks, and the older estimate of two maskings an event."""
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.sum("n_masked").alias("redaction_count"), (F.count("*") * 2).alias("redaction_estimate"))


def narrative_faults(claims: DataFrame, strict: bool) -> DataFrame:
    """Claims (claim_id, text, citations: array) with reject_reason: blank id or text, or, where ``strict``, no citation."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bare = F.lit(strict) & (F.coalesce(F.size("citations"), F.lit(0)) <= 0)
    return claims.withColumn("reject_reason", F.when(blank("claim_id"), "empty claim_id").when(blank("text"), "empty text").when(bare, "no citation"))


def mapping_rows(items: DataFrame, table: DataFrame) -> DataFrame:
    """Every control for every pack: status and mapped_artifact_ids, the sorted distinct artifacts that bear its family as a label.

    The list is the feature: a pack is one review, and its artifacts' ids must fit a row. ``documents.control_pairs`` gives the same as pairs.
    """
    packs = items.select("pack").distinct()
    labels = items.select("pack", "artifact_id", F.explode("labels").alias("control_family")).distinct()
    ids = labels.groupBy("pack", "control_family").agg(F.array_sort(F.collect_list("artifact_id")).alias("ids"))
    every = packs.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("control_id"), F.lit(c).alias("capability"), F.lit(f).alias("control_family")) for i, c, f in _rows(table)]))).select("pack", "c.*")
    out = every.join(ids, ["pack", "control_family"], "left").withColumn("mapped_artifact_ids", F.coalesce("ids", F.array().cast("array<string>")))
    return out.select("pack", "control_id", "capability", "control_family", F.when(F.size("mapped_artifact_ids") == 0, "MISSING").otherwise("MAPPED").alias("status"), "mapped_artifact_ids", F.lit("").alias("reviewer_note"))


def _rows(table: DataFrame) -> list:
    return [tuple(r) for r in table.select("control_id", "capability", "control_family").collect()]  # the control library, a few rows


def mapping_review(rows: DataFrame, version: str, run_id: Column) -> DataFrame:
    """(pack, json): the review of each pack's mapping as canonical JSON."""
    row = F.struct("capability", "control_family", "control_id", "mapped_artifact_ids", "reviewer_note", "status")
    by = rows.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("control_id", row.alias("r")))).alias("rs"))
    text = F.to_json(F.struct(F.transform("rs", lambda x: x["r"]).alias("mappings"), F.col("pack").alias("pack_id"), F.lit(version).alias("pack_version"), run_id.alias("run_id"), F.lit("EVIDENCE_MAPPING_REVIEW_V1").alias("schema_version")))
    return by.select("pack", text.alias("json"))


def index_lines(items: DataFrame, markdown: bool = False) -> DataFrame:
    """(pack, section, artifact_id, line): the evidence index as CSV or Markdown, headings in section 0, in order of artifact_id."""
    joined = lambda c: F.array_join(c, ", " if markdown else ";")
    fields = ["artifact_id", "artifact_sha256", "title", joined("tags"), joined("labels")]
    fields = [F.col(f) if isinstance(f, str) else f for f in fields]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(f, F.lit("")) for f in fields]), F.lit(" |")) if markdown else F.concat_ws(",", *[csv_field(F.coalesce(f, F.lit(""))) for f in fields])
    heads = ("# Evidence Index", "", "| Artifact ID | SHA-256 | Title | Tags | Control Families |", "|---|---|---|---|---|") if markdown else (INDEX_CSV,)
    head = items.select("pack").distinct().select("pack", F.posexplode(F.array(*map(F.lit, heads))).alias("section", "line")).select("pack", (F.col("section") - len(heads)).alias("section"), F.lit("").alias("artifact_id"), "line")
    return head.unionByName(items.select("pack", F.lit(0).alias("section"), "artifact_id", line.alias("line")))


def hash_lines(files: DataFrame) -> DataFrame:
    """(bundle_id, artifact_id, path, line): the list of hashes of files (bundle_id, artifact_id, path, sha256, bytes, content_type, logical_role); sorted by artifact and path under ``HASHES_CSV``."""
    fields = [csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("artifact_id", "path", "sha256", "bytes", "content_type", "logical_role")]
    return files.select("bundle_id", "artifact_id", "path", F.concat_ws(",", *fields).alias("line"))


def missing_checklist(rows: DataFrame) -> DataFrame:
    """(pack, ord, line): what of the mapping is missing."""
    lacks = F.array_sort(F.collect_list(F.when(F.col("status") == "MISSING", F.struct("control_id", "capability"))))
    by = rows.groupBy("pack").agg(lacks.alias("lacks"))
    body = F.when(F.size("lacks") == 0, F.array(F.lit("- [x] No missing control evidence mappings."))).otherwise(F.transform("lacks", lambda r: F.concat(F.lit("- [ ] "), r["control_id"], F.lit(" ("), r["capability"], F.lit(")"))))
    return by.select("pack", F.posexplode(F.concat(F.array(F.lit("# Missing Evidence Checklist"), F.lit("")), body)).alias("ord", "line"))


def narrative_lines(claims: DataFrame) -> DataFrame:
    """(narrative_id, ord, k, line): the narrative's text, claim after claim with its marker; claims are (narrative_id, ord, claim_id, text)."""
    heads = ("# Evidence Narrative", "", "All claims below require citation support under strict mode.", "")
    head = claims.select("narrative_id").distinct().select("narrative_id", F.lit(None).cast("int").alias("ord"), F.posexplode(F.array(*map(F.lit, heads))).alias("k", "line"))
    own = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("text", "\n$", ""), "\r?\n"))
    lines = F.concat(F.array(F.concat(F.lit("<!-- CLAIM:"), "claim_id", F.lit(" -->"))), own, F.array(F.lit("")))
    return head.unionByName(claims.select("narrative_id", F.col("ord").cast("int").alias("ord"), F.posexplode(lines).alias("k", "line")))


def citations_map(claims: DataFrame, output_path: str) -> DataFrame:
    """(narrative_id, ord, json): each claim's entry in the citations map; citations are an array of structs (artifact_id, locator_type, locator as JSON)."""
    at = claim_lines(claims)
    locator = F.struct(F.lit("TEXT_LINE_RANGE_V1").alias("locator_type"), F.struct("start_line", "end_line", "text_sha256").alias("locator"))
    cited = F.transform("citations", lambda c, i: F.struct(i.alias("citation_index"), c["artifact_id"].alias("artifact_id"), c["locator_type"].alias("locator_type"), F.try_parse_json(c["locator"]).alias("locator")))
    return at.select("narrative_id", "ord", F.to_json(F.struct("claim_id", F.lit(output_path).alias("output_path"), locator.alias("output_claim_locator"), cited.alias("citations"))).alias("json"))


# transcripts; headings and sentences within the builders are fixed values


def assessed_transcripts(transcripts: DataFrame, consents: DataFrame, as_of: str) -> DataFrame:
    """Transcripts with consent_status: that of the patient's latest consent (as ``documents.latest_consents``), so that one transcript stays one row."""
    last = latest_consents(consents).select("patient_id", F.struct("date_given", "status").alias("c"))
    status = consent_status(F.col("c").isNotNull(), F.col("c.status"), plus_years(F.col("c.date_given")), as_of)
    return transcripts.join(last, "patient_id", "left").withColumn("consent_status", status).drop("c")


def _note(rows: DataFrame, lines: Column, packed: bool, names: tuple[str, str] = ("line_no", "line")) -> DataFrame:
    """A row for each of a transcript's lines; ``packed``, one row a transcript with the array ``lines``, unless that is empty."""
    return rows.select("transcript_id", lines.alias("lines")).where(F.size("lines") > 0) if packed else rows.select("transcript_id", F.posexplode(lines).alias(*names))


def draft_note(transcripts: DataFrame, packed: bool = False) -> DataFrame:
    """(transcript_id, line_no, line): the draft note of transcripts (transcript_id, patient_id, date, provider, specialty, confidence, content, consent_status). A blocked consent gets none. A confidence half-way between two percent goes to the even one."""
    field = lambda name, c: F.concat(F.lit(f"- **{name}:** "), c)
    percent = F.concat(F.bround(F.col("confidence").cast("float") * F.lit(100).cast("float"), 0).cast("int").cast("string"), F.lit("%"))
    warning = F.when(F.col("consent_status") == "Expired", F.array(F.lit("⚠️ **WARNING:** Patient consent has expired. Request renewal before finalization."), F.lit(""))).otherwise(F.array().cast("array<string>"))
    texts = lambda *x: F.array(*[F.lit(t) if isinstance(t, str) else t for t in x])
    claim = F.concat(F.lit("<!-- CLAIM:C"), "transcript_id", F.lit(" ANCHOR:"), "transcript_id", F.lit(" -->"))
    lines = F.concat(
        texts("# Clinical Draft Note", "", "## Patient Information", "", field("Patient ID", "patient_id"), field("Date", "date"), field("Provider", "provider"), field("Specialty", "specialty"), field("Confidence", percent), ""), warning,
        texts("## Clinical Summary", "", F.col("content"), "", claim, "", "## Verification Status", "", "- [ ] Demographics verified", "- [ ] Chief complaint captured", "- [ ] Assessment accurate", "- [ ] Plan documented", "", "---", "", "*This draft requires provider review and signature*"),
    )
    return _note(transcripts.where(~F.col("consent_status").isin("Missing", "Revoked")), lines, packed)


#: What is to be verified, by section.
VERIFICATIONS = {
    "Demographics": ("Patient name matches record", "DOB verified", "MRN confirmed"),
    "Clinical Content": ("Chief complaint documented", "History of present illness clear", "Physical exam findings documented", "Assessment reflects clinical thinking", "Plan is actionable"),
    "Quality Checks": ("No protected health info in free text", "Grammar and spelling acceptable", "Medical terminology accurate", "Clinical logic sound"),
    "Sign-Off": ("Provider reviewed draft", "Corrections applied", "Ready for signature"),
}


def verification_checklist(transcripts: DataFrame, packed: bool = False) -> DataFrame:
    """(transcript_id, line_no, line): the verification checklist of transcripts."""
    head = [F.lit("# Verification Checklist"), F.lit(""), *[F.concat(F.lit(f"**{n}:** "), c) for n, c in (("Patient", "patient_id"), ("Date", "date"), ("Provider", "provider"))], F.lit(""), F.lit("## Required Verifications"), F.lit("")]
    body = [F.lit(x) for name, items in VERIFICATIONS.items() for x in (f"### {name}", *[f"- [ ] {i}" for i in items], "")]
    return _note(transcripts, F.array(*head, *body), packed)


def uncertainty_map(transcripts: DataFrame, limit: float = 0.95, packed: bool = False) -> DataFrame:
    """(transcript_id, item_no, item): what a transcript leaves uncertain, as JSON objects; confidences are compared as floats, and written as the doubles equal to them."""
    single = F.col("confidence").cast("float")
    item = F.to_json(F.struct(F.lit("speech_recognition").alias("type"), number_text(single.cast("double")).alias("confidence"), F.lit("Verify medical terms against clinical context").alias("recommendation")))
    heard = F.when(single < F.lit(limit).cast("float"), with_numbers(item, "confidence"))
    low = F.lower("content")
    terms = [F.when(low.contains(t), F.to_json(F.struct(F.lit("clinical_uncertainty").alias("type"), F.lit(t).alias("term"), F.lit("Clarify with provider before finalization").alias("recommendation")))) for t in UNCERTAIN_TERMS]
    return _note(transcripts, F.array_compact(F.array(heard, *terms)), packed, ("item_no", "item"))
