"""Queries over line items, parts, labels and orders as citations, gate results and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, sets
from ..operators import bundles, coverage
from .registry import query, table

_CITE = "c AS (SELECT l_orderkey * 8 + l_linenumber AS claim_id, l_partkey AS artifact_id, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber AS e FROM lineitem)"
_RED = "r AS (SELECT o_orderkey % 2000 AS artifact_id, o_custkey % 40 AS s, o_custkey % 40 + 10 AS e FROM orders)"


def citations(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), F.col("l_partkey").alias("artifact_id"), q.alias("start"), (q + F.col("l_linenumber")).alias("end"))


@query("red_coverage", f"WITH {_CITE}, {_RED} SELECT claim_id, artifact_id FROM c WHERE artifact_id IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0 OR p_size > 25) AND NOT EXISTS (SELECT 1 FROM r WHERE r.artifact_id = c.artifact_id AND r.s <= c.s AND r.e >= c.e)")
def red_coverage(spark, sf_dir):
    start = F.col("o_custkey") % 40
    r = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2000).alias("artifact_id"), start.alias("start"), (start + 10).alias("end"))
    tags = F.array(F.lit("internal"), F.when(F.col("p_size") > 25, "PII").otherwise("public"))
    artifacts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"), F.when(F.col("p_size") % 5 == 0, "Restricted").otherwise("Internal").alias("classification"), tags.alias("tags"))
    return bundles.uncovered_spans(citations(spark, sf_dir), artifacts, r).select("claim_id", "artifact_id")


@query("red_coverage_hot", """WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS claim_id, l_partkey % 3 AS artifact_id, l_orderkey * 7 % 100003 AS s, l_orderkey * 7 % 100003 + l_linenumber * 3 AS e FROM lineitem), r AS (SELECT o_orderkey % 3 AS artifact_id, o_orderkey * 11 % 100003 AS s, o_orderkey * 11 % 100003 + o_custkey % 12 AS e FROM orders),
  p AS (SELECT artifact_id, s, max(e) AS e FROM (SELECT artifact_id, s, e FROM r UNION ALL SELECT artifact_id, s, NULL FROM c) GROUP BY ALL), w AS (SELECT artifact_id, s, max(e) OVER (PARTITION BY artifact_id ORDER BY s) AS far FROM p)
  SELECT claim_id, artifact_id FROM c JOIN w USING (artifact_id, s) WHERE coalesce(far, -1) < c.e""")
def red_coverage_hot(spark, sf_dir):
    """Three artifacts with all citations and redactions."""
    k = F.col("l_orderkey") * 7 % 100003
    c = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_partkey") % 3).alias("artifact_id"), k.alias("start"), (k + F.col("l_linenumber") * 3).alias("end"))
    s = F.col("o_orderkey") * 11 % 100003
    r = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("artifact_id"), s.alias("start"), (s + F.col("o_custkey") % 12).alias("end"))
    return coverage.uncovered_spans(c, r).select("claim_id", "artifact_id")


@query("bbox_containment", """WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS claim_id, l_partkey AS a, l_quantity AS x, l_linenumber AS y FROM lineitem), r AS (SELECT o_orderkey % 2000 AS a, o_custkey % 30 AS x, o_custkey % 5 AS y FROM orders)
  SELECT claim_id, a AS artifact_id FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = c.a AND r.x <= c.x AND r.y <= c.y AND r.x + 20 >= c.x + 2 AND r.y + 5 >= c.y + 1)""")
def bbox_containment(spark, sf_dir):
    box = lambda df, *cols: df.select(*cols[0], *[c.cast("double").alias(n) for c, n in zip(cols[1], "xywh")])
    c = box(table(spark, sf_dir, "lineitem"), [(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), F.col("l_partkey").alias("artifact_id")], [F.col("l_quantity"), F.col("l_linenumber"), F.lit(2), F.lit(1)])
    r = box(table(spark, sf_dir, "orders"), [(F.col("o_orderkey") % 2000).alias("artifact_id")], [F.col("o_custkey") % 30, F.col("o_custkey") % 5, F.lit(20), F.lit(5)])
    return bundles.uncovered_boxes(c, r).select("claim_id", "artifact_id")


_CHECK_SQL = "k AS (SELECT 'b' || o_custkey AS bundle_id, CASE o_orderkey % 3 WHEN 0 THEN 'CHK.BUNDLE.' WHEN 1 THEN 'CHK.AUDIT.' ELSE 'CHK.MODEL.' END || (o_orderkey % 7) AS check_id, CASE o_orderstatus WHEN 'F' THEN 'BLOCKER' WHEN 'O' THEN 'MAJOR' ELSE 'MINOR' END AS severity, CASE WHEN o_orderkey % 10 < 8 THEN 'PASS' WHEN o_orderkey % 10 = 8 THEN 'NOT_APPLICABLE' ELSE 'FAIL' END AS result FROM orders)"


def check_results(spark, sf_dir):
    n, s = F.col("o_orderkey"), F.col("o_orderstatus")
    check = F.concat(F.when(n % 3 == 0, "CHK.BUNDLE.").when(n % 3 == 1, "CHK.AUDIT.").otherwise("CHK.MODEL."), (n % 7).cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("bundle_id"), check.alias("check_id"), F.when(s == "F", "BLOCKER").when(s == "O", "MAJOR").otherwise("MINOR").alias("severity"), F.when(n % 10 < 8, "PASS").when(n % 10 == 8, "NOT_APPLICABLE").otherwise("FAIL").alias("result"))


@query("gate_overall", f"WITH {_CHECK_SQL} SELECT bundle_id, count(*) AS n_checks, count(*) FILTER (result = 'FAIL') AS n_failed, CASE WHEN bool_or(result = 'FAIL' AND severity = 'BLOCKER') THEN 'FAIL' WHEN bool_or(result = 'FAIL') THEN 'WARN' ELSE 'PASS' END AS overall FROM k GROUP BY bundle_id")
def gate_overall(spark, sf_dir):
    return bundles.overall(check_results(spark, sf_dir))


_HIT = "count(*) FILTER (starts_with(check_id, prefix)"


@query("gate_rollup", f"""WITH {_CHECK_SQL}, p AS (SELECT unnest(['CHK.BUNDLE.', 'CHK.AUDIT.', 'CHK.NONE.']) AS prefix)
  SELECT bundle_id, prefix, {_HIT}) AS n, {_HIT} AND result <> 'PASS') AS bad, CASE WHEN {_HIT}) = 0 OR {_HIT} AND result <> 'PASS') > 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM k CROSS JOIN p GROUP BY 1, 2""")
def gate_rollup(spark, sf_dir):
    return bundles.prefix_rollup(check_results(spark, sf_dir), ("CHK.BUNDLE.", "CHK.AUDIT.", "CHK.NONE."))


@query("gate_completeness", """WITH g AS (SELECT 'r' || (event_id % 1000) AS run_id, 'G' || lpad(CAST(event_id % 15 AS VARCHAR), 2, '0') AS gate_id, CASE event_id % 4 WHEN 0 THEN 'MAJOR' ELSE 'BLOCKER' END AS severity, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS result FROM events),
  due AS (SELECT 'G' || lpad(CAST(i AS VARCHAR), 2, '0') AS gate_id, CASE WHEN i < 6 THEN 'BLOCKER' ELSE 'MAJOR' END AS severity FROM range(13) t(i) WHERE i % 4 <> 3),
  got AS (SELECT run_id, gate_id, count(*) AS n, min(CASE severity WHEN 'MAJOR' THEN 2 ELSE 3 END) AS low, bool_and(result = 'PASS') AS passed FROM g GROUP BY 1, 2),
  x AS (SELECT run_id, gate_id, severity FROM (SELECT DISTINCT run_id FROM g) CROSS JOIN due),
  j AS (SELECT coalesce(x.run_id, got.run_id) AS run_id, coalesce(x.gate_id, got.gate_id) AS gate_id, passed, CASE WHEN n IS NULL THEN 'missing' WHEN severity IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' WHEN low < CASE severity WHEN 'MAJOR' THEN 2 ELSE 3 END THEN 'downgraded' ELSE 'ok' END AS status FROM x FULL JOIN got ON x.run_id = got.run_id AND x.gate_id = got.gate_id)
  SELECT run_id, gate_id, status, coalesce(passed AND status = 'ok', false) AS satisfied FROM j""")
def gate_completeness(spark, sf_dir):
    n = F.col("event_id")
    results = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (n % 1000).cast("string")).alias("run_id"), F.format_string("G%02d", n % 15).alias("gate_id"), F.when(n % 4 == 0, "MAJOR").otherwise("BLOCKER").alias("severity"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("result"))
    registry = spark.createDataFrame([(f"G{i:02d}", "BLOCKER" if i < 6 else "MAJOR", ["BALANCED"] if i % 4 == 3 else ["STRICT", "BALANCED"]) for i in range(13)], "gate_id string, severity string, policies array<string>")
    return bundles.gate_report(results, registry, "STRICT")


@query("export_gate", """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'EVAL_FAILED' WHEN o_orderkey % 11 = 0 THEN 'DETERMINISM_FAILED' WHEN o_orderstatus IN ('F', 'O') AND o_custkey % 5 = 0 THEN 'INSUFFICIENT_PINNING' WHEN o_orderstatus = 'F' AND o_custkey % 7 = 0 THEN 'MISSING_CITATIONS'
  WHEN o_orderstatus IN ('F', 'O') AND o_custkey % 3 = 0 THEN 'MISSING_REDACTIONS' WHEN o_orderstatus = 'F' AND o_custkey % 4 = 0 THEN 'OFFLINE_PROOF_INSUFFICIENT' END AS reason FROM orders""")
def export_gate(spark, sf_dir):
    n, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    policy = F.when(s == "F", "STRICT").when(s == "O", "BALANCED").otherwise("DRAFT_ONLY")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.export_block_reason(policy, F.when(n % 13 == 0, 1).otherwise(0), n % 11 != 0, F.when(c % 5 == 0, "NAME_ONLY").otherwise("CRYPTO_PINNED"), c % 7 != 0, c % 3 != 0, F.lit("OFFLINE"), F.when(c % 4 == 0, "NONE").otherwise("OFFLINE_STRICT")).alias("reason"))


@query("required_files", """WITH e AS (SELECT 'b' || o_custkey AS bundle_id, ['BUNDLE_INFO.json', 'audit_log.ndjson', 'exports/x.md', 'other'][o_orderkey % 4 + 1] AS path FROM orders),
  g AS (SELECT bundle_id, concat_ws(', ', CASE WHEN NOT bool_or(path = 'BUNDLE_INFO.json') THEN 'BUNDLE_INFO.json' END, CASE WHEN NOT bool_or(path = 'audit_log.ndjson') THEN 'audit_log.ndjson' END, CASE WHEN NOT bool_or(starts_with(path, 'exports/')) THEN 'exports/' END) AS missing FROM e GROUP BY bundle_id)
  SELECT bundle_id, missing, CASE WHEN missing = '' THEN 'PASS' ELSE 'FAIL' END AS result FROM g""")
def required_files(spark, sf_dir):
    paths = F.array(*map(F.lit, ("BUNDLE_INFO.json", "audit_log.ndjson", "exports/x.md", "other")))
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("bundle_id"), F.element_at(paths, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("path"))
    return bundles.required_files(e, ("BUNDLE_INFO.json", "audit_log.ndjson", "exports/"))


@query("effect_differences", """WITH e AS (SELECT p_partkey AS id, p_size > 10 AS att, p_size > 20 AS al FROM part WHERE p_partkey % 9 <> 0), o AS (SELECT p_partkey AS id, p_size > 10 AS att, p_size > 20 AND p_partkey % 5 <> 0 AS al FROM part WHERE p_partkey % 7 <> 0)
  SELECT 'e' || coalesce(e.id, o.id) AS effect_id, CASE WHEN o.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'flags differ' END AS problem FROM e FULL JOIN o ON e.id = o.id WHERE o.id IS NULL OR e.id IS NULL OR e.al <> o.al""")
def effect_differences(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    own = lambda allowed: [F.concat(F.lit("e"), k.cast("string")).alias("effect_id"), (F.col("p_size") > 10).alias("attempted"), allowed.alias("allowed")]
    return bundles.effect_differences(p.where(k % 9 != 0).select(*own(F.col("p_size") > 20)), p.where(k % 7 != 0).select(*own((F.col("p_size") > 20) & (k % 5 != 0))))


@query("effect_classes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'FILESYSTEM' WHEN 1 THEN 'NETWORK' WHEN 2 THEN 'PROCESS' ELSE 'OTHER' END AS class FROM part")
def effect_classes(spark, sf_dir):
    ids = F.array(*map(F.lit, ("symlink-write", "dns-query", "child-spawn", "timer")))
    return table(spark, sf_dir, "part").select("p_partkey", checks.effect_class(F.element_at(ids, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("class"))


@query("regressions", "SELECT a.n_name AS metric, avg_a AS value, avg_b AS baseline, (avg_a - avg_b) / avg_b > 0.1 AS regressed FROM (SELECT n_name, count(*)::DOUBLE AS avg_a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a JOIN (SELECT n_name, count(*)::DOUBLE * 14 AS avg_b FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b USING (n_name)")
def regressions(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("metric"))
    count = lambda t, key, by: table(spark, sf_dir, t).join(nation, F.col(key) == F.col("n_nationkey")).groupBy("metric").agg((F.count("*") * float(by)).alias("value"))
    return bundles.regressions(count("customer", "c_nationkey", 1), count("supplier", "s_nationkey", 14)).select("metric", "value", "baseline", "regressed")


@query("set_except", "SELECT p_partkey FROM part WHERE p_size > 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_except(spark, sf_dir):
    taken = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return sets.rows_except(table(spark, sf_dir, "part").where("p_size > 10"), taken, "p_partkey")


@query("set_predicates", "SELECT o_orderkey, list_has_any([o_orderstatus, o_orderpriority], ['F', '5-LOW']) AS overlap, o_orderstatus IN ('F', 'O') AS subset, o_orderstatus = 'P' AS equal, greatest(o_orderkey - 100, 0) AS minus, CAST(ceil(o_orderkey / 7) AS BIGINT) AS parts FROM orders")
def set_predicates(spark, sf_dir):
    both, one = F.array("o_orderstatus", "o_orderpriority"), F.array("o_orderstatus", "o_orderstatus")
    of, n = (lambda *x: F.array(*map(F.lit, x))), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", sets.overlap(both, of("F", "5-LOW")).alias("overlap"), sets.subset(one, of("F", "O")).alias("subset"), sets.equal(one, of("P")).alias("equal"), sets.saturating_minus(n, F.lit(100)).alias("minus"), sets.div_ceil(n, F.lit(7)).alias("parts"))


@query("order_violations", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS v, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before > v")
def order_violations(spark, sf_dir):
    return bundles.order_violations(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey", F.col("o_orderpriority")).select("o_custkey", "o_orderkey")
