"""Deterministic identifiers, as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space


def sha(text: Column, n: int = 64) -> Column:
    """The first ``n`` hex digits of the SHA-256 of a text's UTF-8 or of bytes."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def double_bits(x: Column) -> Column:
    """The IEEE bits of a double as an unsigned decimal number (decimal(20,0)); every NaN has those of the quiet one."""
    a, whole = F.abs(x), lambda n: F.lit(Decimal(n)).cast("decimal(20,0)")
    e = F.floor(F.log2(a))
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    mantissa = (a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(2**52))
    normal = (e + 1023).cast("long") * F.lit(2**52) + mantissa.cast("long")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    magnitude = F.when(F.isnan(x), whole(0x7FF8 << 48)).when(a == float("inf"), whole(0x7FF0 << 48)).when(a == 0, whole(0)).when(a < F.lit(2.0**-1022), tiny.cast("decimal(20,0)")).otherwise(normal.cast("decimal(20,0)"))
    negative = ~F.isnan(x) & (F.atan2(x, F.lit(-1.0)) < 0)  # of a negative zero as well
    return (magnitude + F.when(negative, whole(2**63)).otherwise(whole(0))).cast("decimal(20,0)")


def transaction_id(statement_id: Column, date: Column, amount: Column, account: Column, idx: Column) -> Column:
    text = F.concat(statement_id, date, double_bits(amount).cast("string"), account, idx.cast("string"))
    return F.concat(F.lit("FINANCE_"), F.replace(account, F.lit(" "), F.lit("_")), F.lit("_"), sha(text, 16))


def _hex(n: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(n.bitwiseAND(F.lit((1 << 4 * width) - 1))), width, "0"))


def event_id(ts: Column, idx: Column, action: Column, system: Column) -> Column:
    ts, idx = ts.cast("long"), idx.cast("long")
    lengths = F.octet_length(action).cast("long").bitwiseXOR(F.octet_length(system).cast("long"))
    return F.concat_ws("_", F.lit("INCIDENT"), _hex(ts.bitwiseXOR(idx), 8), _hex(idx, 4), _hex(lengths, 4))


def timeline_anchor(incident_id: Column, event: Column, evidence: Column, ts: Column) -> Column:
    return F.concat(F.lit("INCIDENT_"), event, F.lit("_"), sha(F.concat(incident_id, event, evidence, ts.cast("string")), 16))


def clause_anchor(contract_id: Column, text: Column, offset: Column) -> Column:
    return F.concat_ws("_", F.lit("REDLINE"), contract_id, sha(text, 8), offset.cast("string"))


def stable_anchor(text: Column) -> Column:
    """An anchor that doesn't depend on white space."""
    return F.concat(F.lit("clause_"), sha(collapse_space(text), 16))


def run_id(fingerprint: Column) -> Column:
    """``r_`` and 32 hex digits of a 64-digit fingerprint; null if it isn't one."""
    return F.when(fingerprint.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("r_"), F.substring(F.lower(fingerprint), 1, 32)))
