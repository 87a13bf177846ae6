"""Statement analytics: exception rules, duplicates, summaries.

Transactions have the columns statement_id, ordinal, date (ISO text), amount, account, category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import days_apart, days_apart_compat, severity_rank

#: Amounts that count as round.
ROUND_AMOUNTS = (100.0, 500.0, 1000.0, 5000.0, 10000.0, 50000.0)
CELL = 16  # tolerances of amount, and days, in a cell in which equal payments are looked for
EXCEPTION = ("statement_id", "ordinal", "other_ordinal", "rule", "severity", "rule_seq", "date", "amount", "account")


def is_round(amount: Column, rounds: tuple[float, ...] = ROUND_AMOUNTS, tolerance: float = 0.01) -> Column:
    return F.exists(F.array(*[F.lit(r) for r in rounds]), lambda r: F.abs(amount - r) < tolerance)


def over_threshold(tx: DataFrame, threshold: float = 10000.0) -> DataFrame:
    return tx.where(F.col("amount") > threshold)


def category_anomalies(tx: DataFrame, known: DataFrame) -> DataFrame:
    """Transactions of a known account whose category isn't among its ``categories``; unknown accounts never count.

    ``known`` (account, categories: array) is joined by key, so Spark broadcasts it only if it is small.
    """
    return tx.join(known, "account").where(~F.array_contains("categories", F.col("category"))).drop("categories")


def duplicates(tx: DataFrame, tolerance: float = 0.01, max_days: int = 1, compat: bool = False) -> DataFrame:
    """Pairs of transactions of one account with nearly equal amounts and dates; the earlier row with other_ordinal.

    Rows meet in cells of ``CELL`` tolerances of amount and ``CELL`` times ``max_days`` days, so that neither an account with a third of all rows nor a fee
    paid daily for years meets itself. Each row stands in its own cell; a later one also in those beside it that it lies so near to that a row there may match it (the cell's
    halo), which few do. The older rule for days has no cells of days, as it takes dates of different years for 99 days apart and no more.
    """
    wide, amount, reach_ = CELL * tolerance, F.col("amount"), 1.5 * tolerance  # a bit more than the tolerance: sums are rounded
    day, days = F.unix_date(F.col("date").try_cast("date")), CELL * max(max_days, 1)
    cell = lambda c, by: F.floor(c / by)
    around = lambda lo, hi: F.explode(F.sequence(lo, hi))
    a = tx.withColumns({"bucket": cell(amount, wide), "day": F.lit(0).cast("long") if compat else cell(day, days)})
    b = tx.select("statement_id", "account", F.col("ordinal").alias("other_ordinal"), F.col("date").alias("o_date"), amount.alias("o_amount"), (F.lit(0) if compat else day).alias("at"), around(cell(amount - reach_, wide), cell(amount + reach_, wide)).alias("bucket"))
    b = b.withColumn("day", F.col("at").cast("long") if compat else around(cell(F.col("at") - max_days, days), cell(F.col("at"), days))).drop("at")
    days = (days_apart_compat if compat else days_apart)(F.col("date"), F.col("o_date"))
    later = (F.col("o_date") > F.col("date")) | ((F.col("o_date") == F.col("date")) & (F.col("other_ordinal") > F.col("ordinal")))
    return a.join(b, ["statement_id", "account", "bucket", "day"]).where(later & (F.abs(F.col("amount") - F.col("o_amount")) < tolerance) & (days <= max_days)).drop("bucket", "day", "o_date", "o_amount")


def _rule(name: str, level: str, seq: int) -> Column:
    return F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"), F.lit(seq).alias("rule_seq"))


def exceptions(tx: DataFrame, known: DataFrame, threshold: float = 10000.0) -> DataFrame:
    """All rules' findings, with their position in the statement's report (severity, rule, date, row). Rules on one row take one pass together."""

    amount = F.col("amount")
    own = [
        F.when(amount > threshold, _rule("THRESHOLD_VIOLATION", "HIGH", 0)), F.when(is_round(amount), _rule("ROUND_NUMBER", "LOW", 2)),
        F.when(~F.array_contains("categories", F.col("category")), _rule("CATEGORY_ANOMALY", "MEDIUM", 3)),
    ]
    rows = tx.join(known, "account", "left").withColumn("r", F.explode(F.array_compact(F.array(*own)))).withColumn("other_ordinal", F.lit(None).cast("long"))
    twins = duplicates(tx).withColumn("r", _rule("DUPLICATE_DETECTED", "MEDIUM", 1))
    columns = [F.col(f"r.{c}").alias(c) if c in ("rule", "severity", "rule_seq") else F.col(c) for c in EXCEPTION]
    found = rows.select(*columns).union(twins.select(*columns))
    order = Window.partitionBy("statement_id").orderBy(severity_rank(F.col("severity")), "rule_seq", "date", "ordinal", "other_ordinal")
    return found.withColumn("position", F.row_number().over(order))


def summary(tx: DataFrame) -> DataFrame:
    """Totals, counts, distinct accounts and categories and the period of each statement."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return tx.groupBy("statement_id").agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"), names("account").alias("accounts"), names("category").alias("categories"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def compliance(found: DataFrame, tx: DataFrame) -> DataFrame:
    """Findings by severity of each statement of ``tx``; COMPLIANT without HIGH and MEDIUM ones."""
    n = found.groupBy("statement_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")])
    n = tx.select("statement_id").distinct().join(n, "statement_id", "left").na.fill(0)
    return n.withColumn("status", F.when((F.col("n_high") == 0) & (F.col("n_medium") == 0), "COMPLIANT").otherwise("REVIEW_REQUIRED"))
