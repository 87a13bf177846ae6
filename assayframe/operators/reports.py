"""Markdown reports as ordered lines.

Headings, labels and sentences within the builders are fixed values. A report is rows (key, section, the place in it, line_no, line), so that a key with a third of all findings isn't gathered in one
value; ``write_lines`` writes them in order, and ``documents_from_lines`` makes one text of each key where reports are small.
Some builders also give their lines ``packed``: those of one place as one array ``lines``, for readers that sort or send them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import number_text, with_numbers
from ..functions.text import csv_quoted, money2
from .documents import risk
from .finance import compliance, summary
from .incident import redact, timeline

LINE = ("statement_id", "section", "position", "line_no", "line")
#: What a finding's id begins with, and the action that its rule asks for.
RULES = {
    "THRESHOLD_VIOLATION": ("EXC_THRESHOLD_", "Manual approval required for large transactions"),
    "DUPLICATE_DETECTED": ("EXC_DUPLICATE_", "Verify transaction not a duplicate entry"),
    "ROUND_NUMBER": ("EXC_ROUND_", "Review for possible rounding or estimate"),
    "CATEGORY_ANOMALY": ("EXC_ANOMALY_", "Confirm correct categorization"),
}


def _of_rule(k: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for rule, texts in RULES.items() for x in (rule, texts[k])]), F.col("rule"))


def finding_id() -> Column:
    """The id of a finding: its rule and the first 16 characters of its transaction's id."""
    return F.concat(_of_rule(0), F.substring(F.col("transaction_id"), 1, 16))


def finding_text(threshold: float = 10000.0) -> Column:
    """What a rule found, in words."""
    amount = F.concat(F.lit("$"), money2(F.col("amount")))
    return (
        F.when(F.col("rule") == "THRESHOLD_VIOLATION", F.concat(F.lit("Transaction amount "), amount, F.lit(f" exceeds threshold ${threshold:.2f}")))
        .when(F.col("rule") == "DUPLICATE_DETECTED", F.concat(F.lit("Duplicate transaction detected: "), amount, F.lit(" in "), "account", F.lit(" on similar date")))
        .when(F.col("rule") == "ROUND_NUMBER", F.concat(F.lit("Transaction amount "), amount, F.lit(" is suspiciously round")))
        .otherwise(F.concat(F.lit("Unexpected category for account '"), "account", F.lit("'")))
    )


def marker() -> Column:
    """The marker that ties a finding's lines to its anchor."""
    return F.concat(F.lit("<!-- CLAIM:C"), finding_id(), F.lit(" ANCHOR:"), finding_id(), F.lit(" -->"))


def _lines(rows: DataFrame, section: int, position: Column, *lines: Column | str) -> DataFrame:
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return rows.select("statement_id", F.lit(section).alias("section"), position.cast("int").alias("position"), texts.alias("lines"))


def _unpacked(rows: DataFrame) -> DataFrame:
    """A row for each of ``lines``: line_no, line."""
    return rows.select(*[c for c in rows.columns if c != "lines"], F.posexplode("lines").alias("line_no", "line"))


def _counted(tx: DataFrame, found: DataFrame) -> DataFrame:
    return summary(tx).join(compliance(found, tx), "statement_id").select("statement_id", "total", "n", "accounts", "categories", "first_date", "last_date", "n_high", "n_medium", "n_low")


def _tally(sep: str = "") -> Column:
    return F.format_string("%d HIGH, %d MEDIUM, %d LOW" + sep, "n_high", "n_medium", "n_low")


def audit_report(tx: DataFrame, found: DataFrame, packed: bool = False) -> DataFrame:
    """The auditor's report on every statement of ``tx``, as ordered lines.

    ``found``: statement_id, position, rule, severity, date, amount, account, transaction_id. A statement without findings gets a conclusion.
    """
    all_, first = _counted(tx, found), F.lit(0)
    head = _lines(
        all_, 0, first, "# Financial Audit - Exceptions Report", "", "## Executive Summary", "", F.concat(F.lit("- **Statement Period:** "), "first_date", F.lit(" to "), "last_date"),
        F.concat(F.lit("- **Total Transactions:** "), F.col("n").cast("string")), F.concat(F.lit("- **Total Amount:** $"), money2(F.col("total"))), F.concat(F.lit("- **Exceptions Found:** "), _tally()), "",
    )
    none = F.col("n_high") + F.col("n_medium") + F.col("n_low") == 0
    clean = _lines(all_.where(none), 1, first, "## Conclusion", "", "No exceptions detected. Statement appears compliant.")
    title = _lines(all_.where(~none), 1, first, "## Flagged Transactions", "")
    body = _lines(
        found, 2, F.col("position"), F.concat(F.lit("### ["), "severity", F.lit("] "), "transaction_id", F.lit(" on "), "date"), "", F.concat(F.lit("**Amount:** $"), money2(F.col("amount"))),
        F.concat(F.lit("**Rule:** "), "rule"), F.concat(F.lit("**Finding:** "), finding_text()), F.concat(F.lit("**Action Required:** "), _of_rule(1)), "", marker(), "",
    )
    foot = _lines(all_, 3, first, "---", "", "*This audit report contains exceptions for investigation*")
    out = head.union(clean).union(title).union(body).union(foot)
    return out if packed else _unpacked(out)


def compliance_report(tx: DataFrame, found: DataFrame, packed: bool = False) -> DataFrame:
    """The compliance team's report on every statement of ``tx``, as ordered lines; ``found`` as for ``audit_report``."""
    all_, first = _counted(tx, found), F.lit(0)
    spaced = lambda c: F.replace(F.col(c), F.lit(","), F.lit(", "))
    none = F.col("n_high") + F.col("n_medium") + F.col("n_low") == 0
    head = _lines(
        all_, 0, first, "# Financial Compliance - Internal Analysis", "", "## Statement Overview", "", F.concat(F.lit("- **Statement ID:** "), "statement_id"), F.concat(F.lit("- **Period:** "), "first_date", F.lit(" to "), "last_date"),
        F.concat(F.lit("- **Transactions:** "), F.col("n").cast("string")), F.concat(F.lit("- **Total Amount:** $"), money2(F.col("total"))), F.concat(F.lit("- **Accounts:** "), spaced("accounts")),
        F.concat(F.lit("- **Categories:** "), spaced("categories")), "", "## Exception Analysis", "",
        F.concat(F.lit("**Status:** "), F.when(none, "COMPLIANT - No exceptions detected").otherwise(_tally(" exceptions"))), "",
    )
    out = head
    for k, level in enumerate(("HIGH", "MEDIUM", "LOW")):
        has = ~none if level == "HIGH" else F.col(f"n_{level.lower()}") > 0
        out = out.union(_lines(all_.where(has), 2 * k + 1, first, *[""] * (k > 0), f"### {level} Severity Items", ""))
        item = F.concat(F.lit("- **"), "transaction_id", F.lit("** on "), "date", *([F.lit(" ($"), money2(F.col("amount")), F.lit(")")] if level == "HIGH" else []))
        more = [F.concat(F.lit("  - Rule: "), "rule"), F.concat(F.lit("  - Finding: "), finding_text())] if level == "HIGH" else []
        out = out.union(_lines(found.where(F.col("severity") == level), 2 * k + 2, F.col("position"), item, *more, F.concat(F.lit("  "), marker())))
    out = out.union(_lines(all_, 7, first, "", "---", "", "*This compliance report contains full analysis for internal teams*"))
    return out if packed else _unpacked(out)


#: The heading of the exceptions file.
EXCEPTIONS_CSV = "transaction_id,date,amount,rule,severity,description\n"


def exception_lines(found: DataFrame) -> DataFrame:
    """(statement_id, position, line): the lines of the exceptions file; ``found`` as for ``audit_report``."""
    line = F.concat_ws(",", "transaction_id", "date", money2(F.col("amount")), "rule", "severity", csv_quoted(finding_text()))
    return found.select("statement_id", "position", line.alias("line"))


def compliance_summary(files: DataFrame, tx: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(statement_id, json): each statement's compliance summary; the period is that of its file (a column of JSON)."""
    period = files.select(F.from_json(text_col, "statement_id string, period_start string, period_end string").alias("s")).select("s.*").groupBy("statement_id").agg(F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"))
    all_ = summary(tx).join(compliance(found, tx), "statement_id").join(period, "statement_id", "left")
    levels = F.struct(F.col("n_high").alias("HIGH"), F.col("n_medium").alias("MEDIUM"), F.col("n_low").alias("LOW"))
    text = F.struct("statement_id", "period_start", "period_end", F.col("n").alias("transaction_count"), number_text(F.col("total")).alias("total_amount"), (F.col("n_high") + F.col("n_medium") + F.col("n_low")).alias("exception_count"), levels.alias("exceptions_by_severity"), F.col("status").alias("compliance_status"))
    return all_.select("statement_id", with_numbers(F.to_json(text), "total_amount").alias("json"))


def exceptions_map(found: DataFrame) -> DataFrame:
    """(statement_id, position, item): the exceptions file's items as JSON objects, in order of position."""
    item = F.struct(finding_id().alias("exception_id"), "transaction_id", "date", number_text(F.col("amount")).alias("amount"), F.col("rule").alias("rule_triggered"), "severity", _of_rule(1).alias("recommended_action"))
    return found.select("statement_id", "position", with_numbers(F.to_json(item), "amount").alias("item"))


def incident_packet(events: DataFrame, profile: str | None = None, packed: bool = False) -> DataFrame:
    """(incident_id, section, ts, idx, line_no, line): the packet on every incident of ``events`` (see ``incident.parse_events``).

    With a redaction profile it is the customer's, whose evidence is masked; without one the internal packet.
    """
    whole = timeline(events).join(events.groupBy("incident_id").agg(F.count("*").alias("n")), "incident_id")
    zero, claim = F.lit(0).cast("long"), F.concat(F.lit("<!-- CLAIM:C"), "anchor_id", F.lit(" ANCHOR:"), "anchor_id", F.lit(" -->"))

    def part(rows: DataFrame, section: int, ts: Column, idx: Column, *lines: Column | str) -> DataFrame:
        texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
        return rows.select("incident_id", F.lit(section).alias("section"), ts.alias("ts"), idx.cast("long").alias("idx"), texts.alias("lines"))

    title, tally, last, heading, end = (
        ("Internal Analysis", "Breakdown", F.concat(F.lit("- **Timeline Hash:** "), "timeline_hash"), "Complete Timeline with Citations", "*This internal packet contains full unredacted details*") if profile is None
        else ("Customer Summary", "Summary", F.lit(f"- **Redaction Profile:** {profile.capitalize()}"), "Redacted Timeline", "*This customer packet has redactions applied per profile*")
    )
    head = part(
        whole, 0, zero, zero, f"# Incident Timeline - {title}", "", "## Overview", "", F.concat(F.lit("- **Total Events:** "), F.col("n").cast("string")),
        F.concat(F.lit("- **Timeline Duration:** "), F.floor(F.col("duration") / 1000).cast("string"), F.lit("s")), F.concat(F.lit(f"- **Severity {tally}:** "), _tally()), last, "", f"## {heading}", "",
    )
    evidence = [F.concat(F.lit("Evidence: "), "evidence_text")] if profile is None else [redact(F.col("evidence_text"), profile), F.lit("")]
    body = part(
        events, 1, F.col("ts"), F.col("idx"), F.concat(F.lit("**"), "timestamp", F.lit("** | "), "source_system", F.lit(" | "), "severity"), F.concat("actor", F.lit(" → "), "action"),
        F.concat(F.lit("Resource: "), "affected_resource"), *evidence, claim, "",
    )
    out = head.union(body).union(part(whole, 2, zero, zero, "---", "", end))
    return out if packed else _unpacked(out)


def assess(clauses: DataFrame) -> DataFrame:
    """Clauses (contract_id, start_offset, anchor_id, text) with risk_level, keywords and advisory."""
    level, found = risk(F.col("text"))
    said = F.concat(F.lit("Risk level: "), "risk_level", F.lit(". Keywords found: "), F.array_join("keywords", ", "), F.lit(". Recommend legal review."))
    rows = clauses.withColumns({"risk_level": level, "keywords": found})
    return rows.withColumn("advisory", F.when(F.size("keywords") == 0, "No significant risk keywords detected. Standard contract language.").otherwise(said))


def clause_map_lines(assessed: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """(contract_id, start_offset, line): the clause map's CSV lines. Here and below ``keys`` are the columns that tell contracts apart."""
    return assessed.select(*keys, "start_offset", F.concat_ws(",", "anchor_id", "risk_level", F.array_join("keywords", ";"), "anchor_id").alias("line"))


def _clause_lines(rows: DataFrame, keys: tuple[str, ...], section: int, place: Column, *lines: Column | str) -> DataFrame:
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return rows.select(*keys, F.lit(section).alias("section"), place.cast("int").alias("start_offset"), F.posexplode(texts).alias("line_no", "line"))


def risk_memo(assessed: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """(contract_id, section, start_offset, line_no, line): the memo on the risks of each contract's clauses."""
    counts = [F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in ("HIGH", "MEDIUM", "LOW")]
    whole, first = assessed.groupBy(*keys).agg(*counts), F.lit(0)
    tally = [F.concat(F.lit(f"- **{level} Risk Clauses:** "), F.col(level.lower()).cast("string")) for level in ("HIGH", "MEDIUM", "LOW")]
    head = _clause_lines(whole, keys, 0, first, "# Risk Assessment Memo", "", "## Summary", "", *tally, "", "## Detailed Findings", "")
    claim = F.concat(F.lit("<!-- CLAIM:C"), "anchor_id", F.lit(" ANCHOR:"), "anchor_id", F.lit(" -->"))
    body = _clause_lines(
        assessed, keys, 1, F.col("start_offset"), F.concat(F.lit("### Clause: "), "anchor_id", F.lit(" ")), F.concat(F.lit("**Risk Level:** "), "risk_level"), "", F.concat(F.lit("**Advisory:** "), "advisory"), "", claim, "",
    )
    return head.union(body).union(_clause_lines(whole, keys, 2, first, "---", "", "*Determinism: Enabled (reproducible outputs)*"))


def redline_suggestions(assessed: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """(contract_id, section, start_offset, line_no, line): what should be redlined in each contract."""
    whole, first = assessed.groupBy(*keys).agg(F.count_if(F.col("risk_level") == "HIGH").alias("high")), F.lit(0)
    said = F.when(F.col("high") == 0, F.lit("No HIGH-risk clauses requiring redlines.")).otherwise(F.format_string("## %d HIGH-Risk Clauses Requiring Review", "high"))
    head = _clause_lines(whole, keys, 0, first, "# Suggested Redlines", "", said)
    body = _clause_lines(
        assessed.where("risk_level = 'HIGH'"), keys, 1, F.col("start_offset"), "", F.concat(F.lit("### Clause: "), "anchor_id"), "", F.concat(F.lit("**Issue:** "), "advisory"), "",
        "**Recommended Action:** Consult legal counsel for appropriate redlines.",
    )
    return head.union(body)
