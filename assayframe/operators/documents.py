"""Clinical transcripts, contracts and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import consent_status, plus_years
from ..functions.ids import clause_anchor, sha, stable_anchor
from ..functions.text import claim_markers, keyword_hits

#: Clinical terms that need clarification.
UNCERTAIN_TERMS = ("possible", "may have", "suspected", "rule out")
#: Phrases of risky clauses.
HIGH_RISK = ("indemnify", "indemnification", "perpetual", "irrevocable", "sole discretion", "unrestricted", "terminate at will", "unlimited liability")
MEDIUM_RISK = ("limit liability", "limitation of liability", "liability", "breach", "default", "force majeure", "governing law", "dispute", "arbitration")
CLAUSE = r"(?md)^(\d+(?:\.\d+)*)\s+([^\n]+)"
_MARK = "￿"  # not a character, so no text holds it


def uncertainty(content: Column, confidence: Column, limit: float = 0.95) -> Column:
    """What a transcript leaves uncertain: ``speech_recognition``, then the terms that it holds. Confidences are compared as floats, as transcripts hold them."""
    heard = F.when(confidence.cast("float") < F.lit(limit).cast("float"), F.array(F.lit("speech_recognition"))).otherwise(F.array().cast("array<string>"))
    return F.concat(heard, keyword_hits(content, UNCERTAIN_TERMS))


def latest_consents(consents: DataFrame) -> DataFrame:
    """(patient_id, date_given, status): of each patient the consent given last, of several of one date a revoked one. A null status is VALID."""
    status = F.coalesce("status", F.lit("VALID"))
    last = consents.groupBy("patient_id").agg(F.max(F.struct("date_given", (status == "REVOKED").alias("revoked"), status.alias("status"))).alias("c"))
    return last.select("patient_id", "c.date_given", "c.status")


def consent_check(transcripts: DataFrame, consents: DataFrame, as_of: str) -> DataFrame:
    """Transcripts (patient_id ...) with the status of the patient's consent (patient_id, date_given, status), and whether it blocks or warns.

    A null status is VALID; a consent lasts two years. Of a patient's consents the one given last counts, of several of one date a revoked one.
    """
    known = latest_consents(consents).select("patient_id", F.col("status").alias("consent"), plus_years(F.col("date_given")).alias("date_expires"), F.lit(True).alias("found"))
    out = transcripts.join(known, "patient_id", "left").withColumn("consent_status", consent_status(F.coalesce("found", F.lit(False)), F.col("consent"), F.col("date_expires"), as_of))
    return out.withColumns({"blocked": F.col("consent_status").isin("Missing", "Revoked"), "warned": F.col("consent_status") == "Expired"}).drop("found", "consent")


def risk(text: Column) -> tuple[Column, Column]:
    """(level, phrases) of a clause; high phrases come first."""
    high, medium = keyword_hits(text, HIGH_RISK), keyword_hits(text, MEDIUM_RISK)
    return F.when(F.size(high) > 0, "HIGH").when(F.size(medium) > 0, "MEDIUM").otherwise("LOW"), F.concat(high, medium)


def clauses(contracts: DataFrame, text_col: str = "text", id_col: str = "contract_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(contract_id, clause_id, clause_number, title, text, start_offset, end_offset, confidence, anchor_id): numbered clauses.

    A clause begins at a line with a number and text, and ends before the next. A text without any is one clause;
    blank texts have none. Offsets are bytes. All work is within the row. Columns named in ``keep`` stay, before the others.
    """
    text = F.col(text_col)
    pieces = F.split(F.regexp_replace(text, CLAUSE, f"{_MARK}$0"), _MARK, -1)
    starts = F.aggregate(F.transform("pieces", lambda p: F.octet_length(p)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = contracts.where(F.trim(text) != "").select(*keep, F.col(id_col).alias("contract_id"), text.alias("whole"), pieces.alias("pieces")).withColumn("starts", starts)
    cut = F.transform(F.filter("pieces", lambda p, i: i > 0), lambda p, i: F.struct(F.regexp_replace(p, r"^\s+|\s+$", "").alias("text"), F.element_at("starts", i + 2).alias("start")))
    numbered = rows.where(F.size("pieces") > 1).select(*keep, "contract_id", F.posexplode(cut).alias("k", "c")).select(
        *keep, "contract_id", F.concat("contract_id", F.lit("_C"), F.col("k").cast("string")).alias("clause_id"), F.concat((F.col("k") + 1).cast("string"), F.lit(".0")).alias("clause_number"),
        F.lit(None).cast("string").alias("title"), F.col("c.text").alias("text"), F.col("c.start").alias("start_offset"), F.lit(0.85).alias("confidence"),
    )
    single = rows.where(F.size("pieces") == 1).select(*keep, "contract_id", F.concat("contract_id", F.lit("_C0")).alias("clause_id"), F.lit("1.0").alias("clause_number"), F.lit("General Terms").alias("title"), F.col("whole").alias("text"), F.lit(0).alias("start_offset"), F.lit(0.7).alias("confidence"))
    out = numbered.unionByName(single).withColumn("end_offset", F.col("start_offset") + F.octet_length("text"))
    return out.withColumn("anchor_id", clause_anchor(F.col("contract_id"), F.col("text"), F.col("start_offset"))).withColumn("stable_anchor", stable_anchor(F.col("text")))


def control_pairs(items: DataFrame, controls: DataFrame) -> DataFrame:
    """Distinct (control_id, artifact_id) pairs: the item bears the control's family as a label."""
    labels = items.select("artifact_id", F.explode("labels").alias("control_family")).distinct()
    return controls.select("control_id", "control_family").join(labels, "control_family").select("control_id", "artifact_id")


def control_status(items: DataFrame, controls: DataFrame) -> DataFrame:
    """MAPPED or MISSING for each control, the number of its items, the smallest and the largest artifact id.

    Items are counted by family before the join; no list of items is gathered in one row.
    """
    labels = items.select("artifact_id", F.explode(F.array_distinct("labels")).alias("control_family"))
    by_family = labels.groupBy("control_family").agg(F.count_distinct("artifact_id").alias("n"), F.min("artifact_id").alias("first_id"), F.max("artifact_id").alias("last_id"))
    out = controls.join(by_family, "control_family", "left")
    return out.select("control_id", "control_family", F.when(F.col("n").isNull(), "MISSING").otherwise("MAPPED").alias("status"), F.coalesce("n", F.lit(0)).alias("n_items"), "first_id", "last_id")


def claim_lines(claims: DataFrame, header_lines: int = 4) -> DataFrame:
    """Where each claim (narrative_id, ord, text) stands in its rendered narrative: start_line, end_line, text_sha256.

    A claim takes its marker's line, its own lines and an empty one.
    """
    text = F.regexp_replace("text", "\n$", "")
    n = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(text, "\n", -1)))
    before = F.coalesce(F.sum(F.col("n") + 2).over(Window.partitionBy("narrative_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = claims.withColumn("n", n)
    return rows.withColumn("start_line", before + header_lines + 2).withColumn("end_line", F.col("start_line") + F.col("n") - 1).withColumn("text_sha256", sha(F.col("text"))).drop("n")


def uncited_claims(docs: DataFrame, cited: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct claim markers in texts that ``cited`` (claim_id) lacks."""
    return docs.select(F.explode(claim_markers(F.col(text_col))).alias("claim_id")).distinct().join(cited.select("claim_id").distinct(), "claim_id", "left_anti")
