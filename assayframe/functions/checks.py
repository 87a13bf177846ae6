"""Predicates and classifications, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make an event severe.
HIGH_SEVERITY = ("critical", "error", "fail", "breach", "attack", "intrusion")
MEDIUM_SEVERITY = ("warn", "timeout", "retry", "denied", "rejected")
#: Block reasons in order of their checks.
BLOCK_REASONS = ("EVAL_FAILED", "DETERMINISM_FAILED", "INSUFFICIENT_PINNING", "MISSING_CITATIONS", "MISSING_REDACTIONS", "OFFLINE_PROOF_INSUFFICIENT")
#: Parts of effect ids, by class.
EFFECT_CLASSES = {"FILESYSTEM": ("write", "link", "fifo", "device"), "NETWORK": ("loopback", "ipv", "socket", "dns", "metadata", "proxy"), "PROCESS": ("child",)}


def severity(action: Column, evidence: Column) -> Column:
    """HIGH, MEDIUM or LOW by words anywhere in the lowered action and evidence."""
    text = F.lower(F.concat_ws(" ", action, evidence))
    return F.when(text.rlike("|".join(HIGH_SEVERITY)), "HIGH").when(text.rlike("|".join(MEDIUM_SEVERITY)), "MEDIUM").otherwise("LOW")


def severity_rank(level: Column) -> Column:
    return F.when(level == "HIGH", 0).when(level == "MEDIUM", 1).otherwise(2)


def pinning_level(model_sha256: Column, adapter_id: Column, adapter_version: Column) -> Column:
    adapter = (F.coalesce(adapter_id, F.lit("")) != "") & (F.coalesce(adapter_version, F.lit("")) != "")
    return F.when(adapter & model_sha256.isNotNull(), "CRYPTO_PINNED").when(adapter, "VERSION_PINNED").otherwise("NAME_ONLY")


def adapter_error(message: Column) -> Column:
    """(category, code, retryable) of an adapter's error message."""
    of = lambda a, b, c: F.struct(F.lit(a).alias("category"), F.lit(b).alias("code"), F.lit(c).alias("retryable"))
    return (
        F.when(message.contains("timeout"), of("TIMEOUT", "ADAPTER_TIMEOUT", True)).when(message.contains("not found"), of("MODEL_NOT_FOUND", "MODEL_NOT_FOUND", False))
        .when(message.contains("unsupported"), of("NOT_SUPPORTED", "NOT_SUPPORTED", False)).otherwise(of("RUNTIME_ERROR", "RUNTIME_ERROR", False))
    )


def effect_class(effect_id: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, parts in EFFECT_CLASSES.items():
        out = out.when(effect_id.rlike("|".join(parts)), name)
    return out.otherwise("OTHER")


def export_block_reason(policy: Column, blockers: Column, deterministic: Column, pinning: Column, citations: Column, redactions: Column, network: Column, proof: Column) -> Column:
    """The first reason that blocks an export, or null."""
    strict, gated = policy == "STRICT", policy.isin("STRICT", "BALANCED")
    tests = (
        blockers > 0, ~deterministic, gated & ~pinning.isin("CRYPTO_PINNED", "VERSION_PINNED"), strict & ~citations, gated & ~redactions,
        strict & ((network != "OFFLINE") | (proof != "OFFLINE_STRICT")),
    )
    return F.coalesce(*[F.when(t, name) for t, name in zip(tests, BLOCK_REASONS)])


def consent_status(found: Column, status: Column, expires: Column, as_of: str) -> Column:
    """Missing, Revoked, Expired or Valid; dates are compared as ISO text."""
    return F.when(~found, "Missing").when(status == "REVOKED", "Revoked").when(expires < as_of, "Expired").otherwise("Valid")


def plus_years(date: Column, years: int = 2) -> Column:
    """An ISO date with a later year and all else as it was (a 29 February stays); other texts stay."""
    parts = F.split(date, "-")
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    moved = F.concat_ws("-", (year + years).cast("string"), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)))
    return F.when((F.size(parts) == 3) & year.isNotNull(), moved).otherwise(date)


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a.try_cast("date"), b.try_cast("date")))


def days_apart_compat(a: Column, b: Column) -> Column:
    """Days between ISO dates as older results have them: right within a month, 30 less the earlier day of the month over
    one month's end, 99 otherwise. Parts that don't parse count as 2026, 1 and 1."""

    def parts(d: Column) -> list[Column]:
        p = F.split(d, "-")
        three = F.size(p) == 3
        return [F.when(three, F.coalesce(F.try_element_at(p, F.lit(k + 1)).try_cast("int"), F.lit(default))).otherwise(default) for k, default in enumerate((2026, 1, 1))]

    (y1, m1, d1), (y2, m2, d2) = parts(a), parts(b)
    return F.when((y1 == y2) & (m1 == m2), F.abs(d1 - d2)).when((y1 == y2) & (F.abs(m1 - m2) == 1), 30 - F.least(d1, d2)).otherwise(99)


def safe_relative_path(path: Column) -> Column:
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"[\\\x00]") & ~F.exists(F.split(path, "/"), lambda c: c.isin("", ".", ".."))


def path_parts(path: Column) -> Column:
    """The components of a normal absolute path; null for any other text."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    normal = path.startswith("/") & ~path.contains("\\") & (F.size(parts) > 0) & ~F.exists(parts, lambda c: c.isin("", ".", ".."))
    return F.when(normal, parts)


def strict_descendant(parent: Column, child: Column) -> Column:
    p, c = path_parts(parent), path_parts(child)
    return F.coalesce((F.size(c) > F.size(p)) & (F.slice(c, F.lit(1), F.size(p)) == p), F.lit(False))


def disjoint_roots(a: Column, b: Column) -> Column:
    p, q = path_parts(a), path_parts(b)
    n = F.least(F.size(p), F.size(q))
    return F.coalesce(F.slice(p, F.lit(1), n) != F.slice(q, F.lit(1), n), F.lit(False))


def secret_key(name: Column) -> Column:
    """Whether an environment key may not be passed on."""
    up = F.upper(name)
    return (name == "") | name.contains("=") | up.rlike("TOKEN|SECRET|PASSWORD|PROXY|^(AWS_|GITHUB_|DOCKER_|SSH_)")


def loopback(url: Column) -> Column:
    """Whether a URL's host is a loopback address literal."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return host.rlike(r"^127(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$") | host.isin("::1", "[::1]")


def ascii_host(host: Column) -> Column:
    """A host name in lower case, its international labels in their ASCII form; null if it has none."""

    def encode(hosts: pd.Series) -> pd.Series:
        out = []
        for h in hosts:
            try:
                out.append(None if h is None else h.encode("idna").decode("ascii").lower())
            except UnicodeError:
                out.append(None)
        return pd.Series(out, dtype=object)

    plain = host.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(host)).otherwise(F.pandas_udf(encode, "string")(F.when(~plain, host)))


def sensitive(classification: Column, tags: Column) -> Column:
    return (classification == "Restricted") | F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, ("PII", "PHI", "PCI", "SECRET")))), F.lit(False))


def span_contains(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (start >= 0) & (end >= 0) & (inner_start >= 0) & (inner_end >= 0) & (start <= inner_start) & (end >= inner_end)


def bbox_contains(x: Column, y: Column, w: Column, h: Column, ix: Column, iy: Column, iw: Column, ih: Column) -> Column:
    whole = (F.least(x, y, w, h, ix, iy, iw, ih) >= 0) & (x <= ix) & (y <= iy)
    return whole & (x + w >= ix + iw) & (y + h >= iy + ih)


def fresh(generated: Column, as_of: Column, valid_until: Column, hours: int = 24) -> Column:
    """generated <= as_of <= valid_until <= generated + ``hours``."""
    return (generated <= as_of) & (as_of <= valid_until) & (valid_until <= generated + F.expr(f"interval {hours} hours"))
