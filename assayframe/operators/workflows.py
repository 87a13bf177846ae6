"""Whole packs: from a table of input files to their outputs, each a table of ordered lines or items.

A workflow takes files as rows and gives a dictionary from the name of an output to its table; ``rejected`` holds what couldn't be read.
Several outputs read what a workflow finds: ``once`` says how that is kept between them (such as written as a table and read
back), so that a run over large files parses and judges them once. As it stands, each output plans the whole again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import transaction_id
from ..sources import readers
from . import documents, evidence, finance, incident, reports

Once = Callable[[DataFrame], DataFrame]


def _again(df: DataFrame) -> DataFrame:
    return df


def finance_workflow(files: DataFrame, known: DataFrame, threshold: float = 10000.0, once: Once = _again, packed: bool = False) -> dict[str, DataFrame]:
    """Statements (a column ``text`` of JSON) to their exceptions and reports; ``known`` names each account's categories. Reports come ``packed`` as in ``reports``, if asked for."""
    rows = once(readers.parse_statements(files))
    tx = rows.where("reject_reason is null")
    found = once(finance.exceptions(tx, known, threshold).withColumn("transaction_id", transaction_id(*map(F.col, ("statement_id", "date", "amount", "account", "ordinal")))))
    return {
        "rejected": rows.where("reject_reason is not null").select("statement_id", "reject_reason"), "exceptions.csv": reports.exception_lines(found), "exceptions_map.json": reports.exceptions_map(found), "compliance_summary.json": reports.compliance_summary(files, tx, found),
        "exceptions_audit.md": reports.audit_report(tx, found, packed), "compliance_internal.md": reports.compliance_report(tx, found, packed),
    }


def incident_workflow(files: DataFrame, profile: str = "STANDARD", id_col: str = "incident_id", once: Once = _again, packed: bool = False) -> dict[str, DataFrame]:
    """Logs (incident_id, text) to packets, timelines and maps. Packets come ``packed`` as in ``reports``, if asked for."""
    rows = once(readers.parse_logs(files, id_col=id_col))
    events = once(incident.parse_events(rows.where("reject_reason is null")))
    spans = incident.redaction_spans(events, "evidence_text", ["incident_id", "idx"], profile)
    masked = events.select("incident_id", "idx").join(spans.groupBy("incident_id", "idx").agg(F.count("*").alias("n_masked")), ["incident_id", "idx"], "left").na.fill(0)
    return {
        "rejected": rows.where("reject_reason is not null").select("incident_id", "line_no", "reject_reason"), "customer_packet.md": reports.incident_packet(events, profile, packed), "internal_packet.md": reports.incident_packet(events, packed=packed), "timeline.csv": incident.timeline_lines(events),
        "redactions_map.json": incident.redactions_map(events, profile), "citations_map.json": incident.citations_map(events), "counts": evidence.workflow_counts(masked),
    }


def contract_workflow(files: DataFrame, id_col: str = "path", content_col: str = "content", once: Once = _again, apart: bool = True) -> dict[str, DataFrame]:
    """Contract PDFs (path, content) to memos, clause maps and suggestions, each with a contract's path and id. The id is that of its bytes; one without text is rejected.

    An id is short, so that different contracts may share it: a contract is told by its path, and each has its own files. If not ``apart``,
    contracts are told by their ids alone: those that share one have their clauses in one set of files.
    """
    named = F.struct(F.col(id_col).alias("path"), evidence.artifact_id(F.col(content_col)).alias("contract_id"))
    read = once(readers.pdf_text(files.select(named.alias("of"), content_col), content_col, "of")).select("of.*", "text")
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\r\n\t]", "")) == "", F.lit(True))
    judged, keys = reports.assess(documents.clauses(read.where(~blank), keep=("path",))), ("path", "contract_id") if apart else ("contract_id",)
    return {
        "rejected": read.where(blank).select("contract_id", F.when(F.col("text").isNull(), "not a PDF").otherwise("no text").alias("reject_reason")),
        "risk_memo.md": reports.risk_memo(judged, keys), "clause_map.csv": reports.clause_map_lines(judged, keys), "redline_suggestions.md": reports.redline_suggestions(judged, keys),
    }


def transcript_workflow(files: DataFrame, consents: DataFrame, as_of: str, once: Once = _again, packed: bool = False) -> dict[str, DataFrame]:
    """Transcripts and consents (columns ``text`` of JSON) to draft notes, checklists and maps; transcripts without a valid consent get no note. ``packed``, a transcript's lines are one array."""
    rows = readers.parse_transcripts(files)
    given = readers.parse_consents(consents).where("reject_reason is null").select("patient_id", "date_given", "status")
    known = once(evidence.assessed_transcripts(rows.where("reject_reason is null").drop("reject_reason"), given, as_of))
    blocked = known.where("consent_status in ('Missing', 'Revoked')").select("transcript_id", F.concat(F.lit("consent "), F.lower("consent_status")).alias("reject_reason"))
    return {
        "rejected": rows.where("reject_reason is not null").select("transcript_id", "reject_reason").union(blocked), "draft_note.md": evidence.draft_note(known, packed), "verification_checklist.md": evidence.verification_checklist(known, packed), "uncertainty_map.json": evidence.uncertainty_map(known, packed=packed),
    }


def evidence_workflow(items: DataFrame, claims: DataFrame, run_id: str, capabilities: tuple[str, ...] = (), strict: bool = True, version: str = "1.0", once: Once = _again) -> dict[str, DataFrame]:
    """Evidence items and narrative claims (narrative_id, ord, claim_id, text, citations) to indexes, mapping reviews, checklists and narratives."""
    items = items.withColumns({"tags": F.array_sort(F.array_distinct("tags")), "labels": F.array_sort(F.array_distinct("labels"))})
    checked = evidence.narrative_faults(claims, strict)
    good = checked.where("reject_reason is null").drop("reject_reason")
    rows = once(evidence.mapping_rows(items, evidence.controls(items.sparkSession, capabilities)))
    return {
        "rejected": checked.where("reject_reason is not null").select("claim_id", "reject_reason"), "evidence_index.csv": evidence.index_lines(items), "evidence_index.md": evidence.index_lines(items, markdown=True), "evidence_mapping_review.json": evidence.mapping_review(rows, version, F.lit(run_id)),
        "missing_evidence_checklist.md": evidence.missing_checklist(rows), "evidence_narrative.md": evidence.narrative_lines(good), "citations_map.json": evidence.citations_map(good, "evidence_narrative.md"),
    }
