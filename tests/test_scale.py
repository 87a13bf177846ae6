"""Operators on large groups against plain ones: exact ranks, digests in order, rules by the thousand, wrapped keys."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators import audit, bundles
from assayframe.sinks import vault


def test_rank_of_millions_of_different_values(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 7_919_111 % 1_000_000_007 - 400_000_000).alias("v"))
    want = np.sort(np.arange(n, dtype=np.int64) * 7_919_111 % 1_000_000_007 - 400_000_000)[(n * 95 + 99) // 100 - 1]
    assert bundles.nearest_rank(rows, ["g"], "v").collect()[0].rank_value == want


def test_rank_of_small_groups_and_odd_values(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice((None, -(1 << 62), 1 << 62, 0, -1, rng.randrange(-50, 50)))) for g in ("a", "b", None) for _ in range(rng.randrange(1, 60))] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    for percent in (1, 50, 95, 100):
        for bits in (2, 20):
            got = {r.g: r.rank_value for r in bundles.nearest_rank(df.where("g is not null"), ["g"], "v", percent, bits).collect()}
            want = {}
            for g in ("a", "b", "one"):
                own = sorted(v for k, v in rows if k == g and v is not None)
                want[g] = own[(len(own) * percent + 99) // 100 - 1]
            assert got == want, (percent, bits)


def test_digest_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("a", "b", None)), n, rng.choice((None, "", "é", "x" * n))) for n in range(300)]
    df = spark.createDataFrame(rows + [("nulls", 1, None)], "k string, n long, text string").repartition(7)
    for sep in ("", "|"):
        want = {k: hashlib.sha256(sep.join(t for key, _, t in rows if key == k and t is not None).encode()).hexdigest() for k in ("a", "b", None)} | {"nulls": hashlib.sha256(b"").hexdigest()}
        assert {r.k: r.sha256 for r in audit.ordered_sha256(df, "k", ["n"], sep).collect()} == want
    assert audit.ordered_sha256(df.limit(0), "k", ["n"]).collect() == []


def test_rules_by_look_up_equal_rules_in_a_row(spark):
    rng = random.Random(3)
    path = lambda: "".join(rng.choice(("/a", "/b", "/ab", "x")) for _ in range(rng.randrange(5)))
    rules = [(k, rng.choice(("http", "https")), rng.choice(("h.org", "g.org")), rng.choice((80, 443)), rng.choice((None, path(), path()))) for k in range(1, 60)]
    asked = [(k, f"{rng.choice(('http', 'https', 'HTTP'))}://{rng.choice(('h.org', 'G.org', 'other'))}{rng.choice(('', ':80', ':443'))}{path()}") for k in range(300)] + [(300, None), (301, "no url")]
    r = spark.createDataFrame(rules, "idx int, scheme string, host string, port int, path_prefix string")
    a = spark.createDataFrame(asked, "request_id long, url string")
    one, other = (sorted(map(tuple, bundles.egress_decisions(a, r, many).collect())) for many in (1000, 0))
    assert one == other and len(one) == 302 and len({x[-2] for x in one}) == 2


def test_wrapped_keys(spark):
    m1, m2 = b"1" * 32, b"2" * 32
    made = vault.wrapped_key(spark, "k1", m1).union(vault.wrapped_key(spark, "k2", m1)).collect()
    keys = spark.createDataFrame([tuple(r) for r in made], vault.KEYS)
    plain = spark.createDataFrame([(1, bytearray(b"one")), (2, None), (3, bytearray(b""))], "id long, data binary")
    sealed = spark.createDataFrame([tuple(r) for r in vault.encrypt_under(plain, "data", keys, m1, "k1").collect()], "id long, data binary, key_id string")
    values = lambda df: {r.id: None if r.data is None else bytes(r.data) for r in df.collect()}
    assert values(vault.decrypt_named(sealed, "data", keys, m1)) == {1: b"one", 2: None, 3: b""}
    moved = vault.rewrap(keys, m1, m2)
    assert values(vault.decrypt_named(sealed, "data", moved, m2)) == {1: b"one", 2: None, 3: b""}
    with pytest.raises(Exception):
        vault.decrypt_named(sealed, "data", moved, m1).collect()
    half = vault.reencrypt(sealed.where("id = 1"), "data", keys, m1, "k2").union(sealed.where("id <> 1"))  # broken off
    half = spark.createDataFrame([tuple(r) for r in half.collect()], sealed.schema)
    again = vault.reencrypt(half, "data", keys, m1, "k2")
    assert values(again)[1] == values(half)[1] and {r.key_id for r in again.collect()} == {"k2"}
    assert values(vault.decrypt_named(again, "data", keys.where("key_id = 'k2'"), m1)) == {1: b"one", 2: None, 3: b""}
    for bad in (lambda: vault.decrypt_named(sealed, "data", keys.where("key_id = 'k2'"), m1), lambda: vault.encrypt_under(plain, "data", keys, m1, "k9"), lambda: vault.reencrypt(sealed, "data", keys, m1, "k9")):
        with pytest.raises(Exception, match="no key"):
            bad().collect()
    assert b"1" * 32 not in vault.encrypt_under(plain, "data", keys, m1, "k1")._jdf.queryExecution().toString().encode()


def test_controls_and_outputs_of_rows(spark):
    from assayframe.operators import evidence

    rows = evidence.controls_for(spark.createDataFrame([("all", None), ("two", ["Auditability", "Traceability"]), ("none", ["x"])], "k string, capabilities array<string>")).collect()
    assert sorted(r.control_id for r in rows if r.k == "all") == sorted(c[0] for c in evidence.CONTROLS) and {r.control_id for r in rows if r.k == "two"} == {"CTRL-AU-001", "CTRL-CI-001"} and not [r for r in rows if r.k == "none"]
    kinds = spark.createDataFrame([("finance",), ("odd",), (None,)], "k string").select("k", evidence.outputs_of(F.col("k")).alias("f")).collect()
    assert len(kinds[0].f) == 5 and kinds[1].f is None and kinds[2].f is None


def test_last_consent_counts(spark):
    from assayframe.operators import documents

    consents = spark.createDataFrame([("p", "2024-01-01", "REVOKED"), ("p", "2025-01-01", None), ("q", "2025-01-01", "VALID"), ("q", "2025-01-01", "REVOKED"), ("r", "2020-01-01", None)], "patient_id string, date_given string, status string")
    got = documents.consent_check(spark.createDataFrame([(x,) for x in "pqrs"], "patient_id string"), consents, "2026-01-01").collect()
    assert {r.patient_id: r.consent_status for r in got} == {"p": "Valid", "q": "Revoked", "r": "Expired", "s": "Missing"} and len(got) == 4


def test_transcripts_of_odd_confidence_and_consents_of_one_date(spark):
    from assayframe.operators import documents, workflows

    made = '{{"patient_id":"{}","date":"2026-01-01","provider":"d","specialty":"s","content":"{}","confidence":{}}}'.format
    texts = [made("p", "clear", "0.95"), made("p", "may have", "0.9499"), made("q", "clear", "0.125"), made("q", "  ", "0.375"), made("q", "", "0.5"), made("q", "no number", '"high"'), '{"patient_id":"q"}', "x", "", None]
    consents = [('{"patient_id":"%s","date_given":"2025-01-01","scope":"s","status":"%s"}' % x,) for x in (("p", "VALID"), ("p", "REVOKED"), ("q", "VALID"))]
    kept = []
    out = workflows.transcript_workflow(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame(consents, "text string"), "2026-06-01", once=lambda df: kept.append(df) or df)
    assert len(kept) == 1
    assert sorted(r.reject_reason for r in out["rejected"].collect()) == ["consent revoked"] * 2 + ["empty content"] + ["missing field"] * 5
    assert sorted(r.line for r in out["draft_note.md"].where("line like '%Confidence%'").collect()) == ["- **Confidence:** 12%", "- **Confidence:** 38%"]
    heard = out["uncertainty_map.json"].where("item like '%speech%'").count()
    assert heard == 3 and out["uncertainty_map.json"].where("item like '%clinical_uncertainty%'").count() == 1
    one = spark.createDataFrame([(0.95,), (0.9499,), (None,)], "c double").select(F.size(documents.uncertainty(F.lit("x"), F.col("c"))).alias("n")).collect()
    assert [r.n for r in one] == [0, 1, 0]
