"""Statement queries: orders and line items as transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checks import days_apart_compat
from ..functions.ids import transaction_id
from ..functions.text import money2
from ..operators import finance, reports
from ..sinks.writers import documents_from_lines, json_rows
from .registry import query, table

TX_SQL = """tx AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS statement_id, o_orderkey AS ordinal, strftime(o_orderdate, '%Y-%m-%d') AS date,
    floor(o_totalprice / 500) * 100.0 AS amount, CAST(o_custkey % 20 AS VARCHAR) AS account, o_orderpriority AS category FROM orders)"""
ITEM_SQL = """it AS (SELECT CAST(l_suppkey AS VARCHAR) AS statement_id, l_orderkey * 8 + l_linenumber AS ordinal, strftime(l_shipdate, '%Y-%m-%d') AS date,
    l_quantity AS amount, CAST(l_partkey % 20 AS VARCHAR) AS account FROM lineitem)"""
KNOWN_SQL = "known AS (SELECT CAST(i AS VARCHAR) AS account, ['1-URGENT', '2-HIGH', '3-MEDIUM'] AS categories FROM range(0, 20, 2) t(i))"
ROUND_SQL = "list_bool_or(list_transform([100.0, 500.0, 1000.0, 5000.0, 10000.0, 50000.0], lambda r: abs(amount - r) < 0.01))"
ID_SQL = "'FINANCE_' || replace(account, ' ', '_') || '_' || left(sha256(statement_id || date || CAST(CAST(amount AS BIT) AS UBIGINT) || account || ordinal), 16)"
LATER = "(b.date > a.date OR (b.date = a.date AND b.ordinal > a.ordinal))"
DUP = f"a.statement_id = b.statement_id AND a.account = b.account AND {LATER} AND abs(a.amount - b.amount) < 0.01 AND abs(date_diff('day', CAST(a.date AS DATE), CAST(b.date AS DATE))) <= 1"
EX_SQL = f"""{TX_SQL}, {KNOWN_SQL}, ex AS (
    SELECT statement_id, ordinal, CAST(NULL AS BIGINT) AS other_ordinal, 'THRESHOLD_VIOLATION' AS rule, 'HIGH' AS severity, 0 AS rule_seq, date, amount, account FROM tx WHERE amount > 10000
    UNION ALL SELECT a.statement_id, a.ordinal, b.ordinal, 'DUPLICATE_DETECTED', 'MEDIUM', 1, a.date, a.amount, a.account FROM tx a JOIN tx b ON {DUP}
    UNION ALL SELECT statement_id, ordinal, NULL, 'ROUND_NUMBER', 'LOW', 2, date, amount, account FROM tx WHERE {ROUND_SQL}
    UNION ALL SELECT statement_id, ordinal, NULL, 'CATEGORY_ANOMALY', 'MEDIUM', 3, date, amount, tx.account FROM tx JOIN known USING (account) WHERE NOT list_contains(categories, category)),
  placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, rule_seq, date, ordinal, other_ordinal NULLS FIRST) AS INTEGER) AS position FROM ex)"""


def transactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("statement_id"), F.col("o_orderkey").alias("ordinal"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.floor(F.col("o_totalprice") / 500) * 100.0).alias("amount"), (F.col("o_custkey") % 20).cast("string").alias("account"), F.col("o_orderpriority").alias("category"))


def items(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_suppkey").cast("string").alias("statement_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").alias("amount"), (F.col("l_partkey") % 20).cast("string").alias("account"))


def known_categories(spark):
    return spark.range(0, 20, 2).select(F.col("id").cast("string").alias("account"), F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM"))).alias("categories"))


def all_exceptions(spark, sf_dir):
    return finance.exceptions(transactions(spark, sf_dir), known_categories(spark))


def identified(found):
    """Findings with their transactions' ids."""
    return found.withColumn("transaction_id", transaction_id(*map(F.col, ("statement_id", "date", "amount", "account", "ordinal"))))


@query("fin_threshold", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def fin_threshold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("amount"))
    return finance.over_threshold(o, 400000.0).drop("amount")


@query("fin_round_number", f"WITH {TX_SQL} SELECT ordinal, amount FROM tx WHERE {ROUND_SQL}")
def fin_round_number(spark, sf_dir):
    return transactions(spark, sf_dir).where(finance.is_round(F.col("amount"))).select("ordinal", "amount")


@query("fin_category_anomaly", f"WITH {TX_SQL}, {KNOWN_SQL} SELECT ordinal, tx.account AS account, category FROM tx JOIN known USING (account) WHERE NOT list_contains(categories, category)")
def fin_category_anomaly(spark, sf_dir):
    return finance.category_anomalies(transactions(spark, sf_dir), known_categories(spark)).select("ordinal", "account", "category")


@query("fin_duplicates", f"WITH {ITEM_SQL} SELECT a.statement_id AS statement_id, a.ordinal AS ordinal, b.ordinal AS other_ordinal, a.amount AS amount FROM it a JOIN it b ON {DUP}")
def fin_duplicates(spark, sf_dir):
    return finance.duplicates(items(spark, sf_dir)).select("statement_id", "ordinal", "other_ordinal", "amount")


_DAYS = """CASE WHEN year(a) = year(b) AND month(a) = month(b) THEN abs(day(a) - day(b)) WHEN year(a) = year(b) AND abs(month(a) - month(b)) = 1 THEN 30 - least(day(a), day(b)) ELSE 99 END"""


@query("fin_days_between_compat", f"SELECT o_orderkey, CAST({_DAYS} AS INTEGER) AS days FROM (SELECT o_orderkey, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS b FROM orders)")
def fin_days_between_compat(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int"))
    return o.select("o_orderkey", days_apart_compat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(b, "yyyy-MM-dd")).alias("days"))


@query("fin_exceptions_all", f"WITH {EX_SQL} SELECT statement_id, ordinal, other_ordinal, rule, severity, position, amount, account FROM placed")
def fin_exceptions_all(spark, sf_dir):
    return all_exceptions(spark, sf_dir).select("statement_id", "ordinal", "other_ordinal", "rule", "severity", "position", "amount", "account")


@query("fin_summary", f"""WITH {TX_SQL} SELECT statement_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, array_to_string(list_sort(list(DISTINCT account)), ',') AS accounts,
    array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, min(date) AS first_date, max(date) AS last_date FROM tx GROUP BY statement_id""")
def fin_summary(spark, sf_dir):
    return finance.summary(transactions(spark, sf_dir))


_COMPLIANCE = "SELECT statement_id, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, count(*) FILTER (severity = 'LOW') AS n_low, CASE WHEN count(*) FILTER (severity <> 'LOW') = 0 THEN 'COMPLIANT' ELSE 'REVIEW_REQUIRED' END AS status FROM (SELECT statement_id, severity FROM placed UNION ALL SELECT DISTINCT statement_id, NULL FROM tx) GROUP BY statement_id"


@query("fin_compliance", f"WITH {EX_SQL} {_COMPLIANCE}")
def fin_compliance(spark, sf_dir):
    return finance.compliance(all_exceptions(spark, sf_dir), transactions(spark, sf_dir))


@query("fin_compliance_json", f"""WITH {EX_SQL}, c AS ({_COMPLIANCE}) SELECT statement_id, CAST(to_json({{'statement_id': statement_id, 'n_high': n_high, 'n_medium': n_medium, 'n_low': n_low, 'status': status}}) AS VARCHAR) AS json FROM c""")
def fin_compliance_json(spark, sf_dir):
    return json_rows(finance.compliance(all_exceptions(spark, sf_dir), transactions(spark, sf_dir)), "statement_id")


@query("fin_money_render", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS money FROM orders")
def fin_money_render(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", money2(F.col("o_totalprice")).alias("money"))


_FINDING = """CASE rule WHEN 'THRESHOLD_VIOLATION' THEN 'Transaction amount $' || printf('%.2f', amount) || ' exceeds threshold $10000.00' WHEN 'DUPLICATE_DETECTED' THEN 'Duplicate transaction detected: $' || printf('%.2f', amount) || ' in ' || account || ' on similar date'
    WHEN 'ROUND_NUMBER' THEN 'Transaction amount $' || printf('%.2f', amount) || ' is suspiciously round' ELSE 'Unexpected category for account ''' || account || '''' END"""
_LINE = f"""{ID_SQL} || ',' || date || ',' || printf('%.2f', amount) || ',' || rule || ',' || severity || ',"' || replace({_FINDING}, '"', '""') || '"'"""


@query("fin_exceptions_csv", f"""WITH {EX_SQL} SELECT statement_id, sha256('transaction_id,date,amount,rule,severity,description' || chr(10) || string_agg({_LINE} || chr(10), '' ORDER BY position)) AS csv_sha256 FROM placed GROUP BY statement_id""")
def fin_exceptions_csv(spark, sf_dir):
    out = documents_from_lines(reports.exception_lines(identified(all_exceptions(spark, sf_dir))), "statement_id", ["position"], reports.EXCEPTIONS_CSV)
    return out.select("statement_id", F.sha2(F.col("content").cast("binary"), 256).alias("csv_sha256"))


@query("fin_transaction_ids", f"WITH {TX_SQL} SELECT ordinal, {ID_SQL} AS transaction_id FROM tx UNION ALL SELECT -o_orderkey, 'FINANCE_x_' || left(sha256('sd' || CAST(CAST(v AS BIT) AS UBIGINT) || 'x1'), 16) FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN -o_totalprice WHEN 1 THEN o_totalprice * 1e-310 WHEN 2 THEN o_totalprice / 7 ELSE o_totalprice * -1e300 END AS v FROM orders)")
def fin_transaction_ids(spark, sf_dir):
    n, p = F.col("o_orderkey"), F.col("o_totalprice")
    v = F.when(n % 4 == 0, -p).when(n % 4 == 1, p * 1e-310).when(n % 4 == 2, p / 7).otherwise(p * -1e300)
    odd = table(spark, sf_dir, "orders").select((-n).alias("ordinal"), transaction_id(F.lit("s"), F.lit("d"), v, F.lit("x"), F.lit(1)).alias("transaction_id"))
    return identified(transactions(spark, sf_dir)).select("ordinal", "transaction_id").union(odd)


@query("fin_exceptions_map", f"""WITH {EX_SQL} SELECT statement_id, position, CAST(to_json({{'exception_id': CASE rule WHEN 'THRESHOLD_VIOLATION' THEN 'EXC_THRESHOLD_' WHEN 'DUPLICATE_DETECTED' THEN 'EXC_DUPLICATE_' WHEN 'ROUND_NUMBER' THEN 'EXC_ROUND_' ELSE 'EXC_ANOMALY_' END || left({ID_SQL}, 16), 'transaction_id': {ID_SQL}, 'date': date, 'amount': amount, 'rule_triggered': rule, 'severity': severity,
    'recommended_action': CASE rule WHEN 'THRESHOLD_VIOLATION' THEN 'Manual approval required for large transactions' WHEN 'DUPLICATE_DETECTED' THEN 'Verify transaction not a duplicate entry' WHEN 'ROUND_NUMBER' THEN 'Review for possible rounding or estimate' ELSE 'Confirm correct categorization' END}}) AS VARCHAR) AS item FROM placed""")
def fin_exceptions_map(spark, sf_dir):
    return reports.exceptions_map(identified(all_exceptions(spark, sf_dir)))


_REPORT_SQL = f"""WITH {EX_SQL}, f AS (SELECT *, {_FINDING} AS finding, CASE rule WHEN 'THRESHOLD_VIOLATION' THEN 'EXC_THRESHOLD_' WHEN 'DUPLICATE_DETECTED' THEN 'EXC_DUPLICATE_' WHEN 'ROUND_NUMBER' THEN 'EXC_ROUND_' ELSE 'EXC_ANOMALY_' END || left({ID_SQL}, 16) AS id, {ID_SQL} AS tid,
    CASE rule WHEN 'THRESHOLD_VIOLATION' THEN 'Manual approval required for large transactions' WHEN 'DUPLICATE_DETECTED' THEN 'Verify transaction not a duplicate entry' WHEN 'ROUND_NUMBER' THEN 'Review for possible rounding or estimate' ELSE 'Confirm correct categorization' END AS action FROM placed),
  c AS (SELECT statement_id, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l FROM f GROUP BY 1),
  s AS (SELECT tx.statement_id, printf('%.2f', CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)) AS total, count(*) AS n, array_to_string(list_sort(list(DISTINCT account)), ', ') AS accounts, array_to_string(list_sort(list(DISTINCT category)), ', ') AS categories,
    min(date) AS a, max(date) AS b, coalesce(any_value(h), 0) AS h, coalesce(any_value(m), 0) AS m, coalesce(any_value(l), 0) AS l FROM tx LEFT JOIN c USING (statement_id) GROUP BY 1),
  parts AS (%s)
  SELECT statement_id, CAST(section AS INTEGER) AS section, CAST(position AS INTEGER) AS position, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT statement_id, section, position, string_split(txt, '~') AS ls FROM parts)"""
_AUDIT_PARTS = """SELECT statement_id, 0 AS section, 0 AS position, '# Financial Audit - Exceptions Report~~## Executive Summary~~- **Statement Period:** ' || a || ' to ' || b || '~- **Total Transactions:** ' || n || '~- **Total Amount:** $' || total || '~- **Exceptions Found:** ' || h || ' HIGH, ' || m || ' MEDIUM, ' || l || ' LOW~' AS txt FROM s
  UNION ALL SELECT statement_id, 1, 0, CASE WHEN h + m + l = 0 THEN '## Conclusion~~No exceptions detected. Statement appears compliant.' ELSE '## Flagged Transactions~' END FROM s
  UNION ALL SELECT statement_id, 2, position, '### [' || severity || '] ' || tid || ' on ' || date || '~~**Amount:** $' || printf('%.2f', amount) || '~**Rule:** ' || rule || '~**Finding:** ' || finding || '~**Action Required:** ' || action || '~~<!-- CLAIM:C' || id || ' ANCHOR:' || id || ' -->~' FROM f
  UNION ALL SELECT statement_id, 3, 0, '---~~*This audit report contains exceptions for investigation*' FROM s"""
_INTERNAL_PARTS = """SELECT statement_id, 0 AS section, 0 AS position, '# Financial Compliance - Internal Analysis~~## Statement Overview~~- **Statement ID:** ' || statement_id || '~- **Period:** ' || a || ' to ' || b || '~- **Transactions:** ' || n || '~- **Total Amount:** $' || total || '~- **Accounts:** ' || accounts || '~- **Categories:** ' || categories
    || '~~## Exception Analysis~~**Status:** ' || CASE WHEN h + m + l = 0 THEN 'COMPLIANT - No exceptions detected' ELSE h || ' HIGH, ' || m || ' MEDIUM, ' || l || ' LOW exceptions' END || '~' AS txt FROM s
  UNION ALL SELECT statement_id, 1, 0, '### HIGH Severity Items~' FROM s WHERE h + m + l > 0 UNION ALL SELECT statement_id, 3, 0, '~### MEDIUM Severity Items~' FROM s WHERE m > 0 UNION ALL SELECT statement_id, 5, 0, '~### LOW Severity Items~' FROM s WHERE l > 0
  UNION ALL SELECT statement_id, CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 4 ELSE 6 END, position, '- **' || tid || '** on ' || date || CASE severity WHEN 'HIGH' THEN ' ($' || printf('%.2f', amount) || ')~  - Rule: ' || rule || '~  - Finding: ' || finding ELSE '' END || '~  <!-- CLAIM:C' || id || ' ANCHOR:' || id || ' -->' FROM f
  UNION ALL SELECT statement_id, 7, 0, '~---~~*This compliance report contains full analysis for internal teams*' FROM s"""


def _reported(spark, sf_dir, report):
    tx = transactions(spark, sf_dir)
    return report(tx, identified(finance.exceptions(tx, known_categories(spark))))


@query("fin_report_audit", _REPORT_SQL.replace("%s", _AUDIT_PARTS))
def fin_report_audit(spark, sf_dir):
    return _reported(spark, sf_dir, reports.audit_report)


@query("fin_report_compliance", _REPORT_SQL.replace("%s", _INTERNAL_PARTS))
def fin_report_compliance(spark, sf_dir):
    return _reported(spark, sf_dir, reports.compliance_report)
