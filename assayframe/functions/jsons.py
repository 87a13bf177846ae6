"""JSON columns: canonical text, keys, tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column, integers: bool = False) -> Column:
    """Compact JSON with keys sorted at every level; null if it doesn't parse or, with ``integers``, if a number has a fraction or an exponent."""
    out = F.to_json(F.try_parse_json(text))
    return F.when(integers_only(text), out) if integers else out


def missing_keys(text: Column, required: Column) -> Column:
    """Those of an array of names that a JSON object lacks (all of them, if it isn't an object)."""
    return F.array_except(required, F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))


def unknown_keys(text: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in allowed]))


def integers_only(text: Column) -> Column:
    """Whether a JSON text holds no fraction or exponent outside of strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    return ~bare.rlike(r"\d[.eE]")


def number_text(c: Column) -> Column:
    """A double as JSON number: plain from 0.00001 to below 1e16, with a fraction at all times (12300000.0), else with an exponent (1.5e-7). No text for what isn't finite."""
    size, text = F.abs(c), c.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    short = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    finite = ~F.isnan(c) & (size != float("inf"))
    return F.when(short, text).when((size >= 1e-5) & (size < 1e16), plain).when(finite, F.lower(F.regexp_replace(text, r"\.0E", "E")))


def with_numbers(json: Column, *names: str) -> Column:
    """JSON text in which the strings under these names, made by ``number_text``, stand as numbers. Quotes within values are escaped, so none passes for a name."""
    return F.regexp_replace(json, f'"({"|".join(names)})":"([^"]*)"', '"$1":$2')


def seccomp_profile(options: Column) -> tuple[Column, Column, Column]:
    """(digest, architectures, reason) of the one ``seccomp=`` option among an array of security options.

    The digest is that of the profile's canonical JSON. Architectures are named by ``architectures`` or else, entry by
    entry, by ``archMap``. A reason says why there is no identity; the digest and the architectures are null then.
    """
    own = F.filter(options, lambda o: o.startswith("seccomp="))
    text = F.substring(F.try_element_at(own, F.lit(1)), 9, 1 << 30)
    whole = canonical(text)
    listed = F.from_json(F.get_json_object(text, "$.architectures"), "array<string>")
    mapped = F.from_json(F.get_json_object(text, "$.archMap"), "array<struct<architecture:string,subArchitectures:array<string>>>")
    from_map = F.flatten(F.transform(mapped, lambda e: F.array_compact(F.concat(F.array(e["architecture"]), F.coalesce(e["subArchitectures"], F.array().cast("array<string>"))))))
    names = F.coalesce(listed, from_map)
    bad = F.coalesce(F.exists(listed, lambda a: a.isNull() | (a == "")), F.lit(False))
    unbound = names.isNull() | (F.size(names) == 0) | (F.size(F.array_distinct(names)) != F.size(names))
    reason = F.when(F.coalesce(F.size(own), F.lit(0)) != 1, "not exactly one profile").when(whole.isNull(), "not JSON").when(bad, "invalid architecture").when(unbound, "no architecture binding")
    return F.when(reason.isNull(), F.sha2(whole.cast("binary"), 256)), F.when(reason.isNull(), names), reason
