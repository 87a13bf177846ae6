"""Containment against all pairs, and hot artifacts whose pairs would be too many."""

import random
import re

from pyspark.sql import functions as F

from assayframe.operators import coverage, finance


def spans(rng, n, top):
    out = []
    for i in range(n):
        s = rng.choice((None, -1, rng.randrange(top), rng.randrange(top), rng.randrange(top)))
        out.append((i, rng.choice(("a", "a", "b", None)), s, None if rng.random() < 0.05 else (s or 0) + rng.randrange(30)))
    return out


def test_spans_equal_all_pairs(spark):
    rng = random.Random(4)
    cited, red = spans(rng, 300, 400), spans(rng, 60, 400)
    ok = lambda s, e: s is not None and e is not None and s >= 0 and e >= 0
    want = sorted(i for i, a, s, e in cited if not (ok(s, e) and any(a is not None and a == b and ok(x, y) and x <= s and y >= e for _, b, x, y in red)))
    schema = "claim_id long, artifact_id string, start long, end long"
    c, r = spark.createDataFrame(cited, schema), spark.createDataFrame(red, schema)
    for block, few in ((7, 0), (1 << 16, 0), (7, 20), (7, 1000)):
        got = coverage.uncovered_spans(c, r, block=block, few=few)
        assert sorted(x.claim_id for x in got.collect()) == want and got.columns == c.columns
    assert coverage.uncovered_spans(c, r.limit(0)).count() == len(cited) and coverage.uncovered_spans(c.limit(0), r).count() == 0


def boxes(rng, n, top, sides):
    num = lambda a, b: rng.choice((float(rng.randrange(a, b)), rng.uniform(a, b)))
    return [(i, rng.choice(("a", "a", "b", None)), *[None if rng.random() < 0.02 else -1.0 if rng.random() < 0.02 else v for v in (num(0, top), num(0, top), num(0, sides), num(0, sides))]) for i in range(n)]


def test_boxes_equal_all_pairs(spark):
    rng = random.Random(5)
    cited, red = boxes(rng, 250, 60, 12), boxes(rng, 150, 50, 30)
    ok = lambda b: all(v is not None and v >= 0 for v in b)
    inside = lambda c, r: r[0] <= c[0] and r[1] <= c[1] and r[0] + r[2] >= c[0] + c[2] and r[1] + r[3] >= c[1] + c[3]
    want = sorted(i for i, a, *c in cited if not (ok(c) and any(a is not None and a == b and ok(r) and inside(c, r) for _, b, *r in red)))
    schema = "claim_id long, artifact_id string, x double, y double, w double, h double"
    c, r = spark.createDataFrame(cited, schema), spark.createDataFrame(red, schema)
    for few in (0, 10_000):
        got = coverage.uncovered_boxes(c, r, few=few)
        assert sorted(x.claim_id for x in got.collect()) == want and got.columns == c.columns
    assert coverage.uncovered_boxes(c, r.limit(0)).count() == len(cited) and coverage.uncovered_boxes(c.limit(0), r).count() == 0


def rows_of(df):
    """The most rows that any operator of a query made."""
    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    stack, most = [plan.executedPlan()], 0
    while stack:
        p = stack.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        if "QueryStage" in p.getClass().getSimpleName():
            stack.append(p.plan())
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return most


def most_dealt_by(df, key):
    """The most rows that an exchange dealt by one column alone."""
    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    stack, most = [plan.executedPlan()], 0
    while stack:
        p = stack.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if re.match(rf"hashpartitioning\({key}#\d+L?, \d+\)", p.outputPartitioning().toString()) and p.metrics().contains("shuffleRecordsWritten"):
            most = max(most, p.metrics().apply("shuffleRecordsWritten").value())
        if "QueryStage" in p.getClass().getSimpleName():
            stack.append(p.plan())
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_citations_are_not_dealt_by_their_artifact_alone(spark):
    """As with tables that are too large to be broadcast by their size: three artifacts hold all, with and without one of few redactions."""
    n, threshold = 20_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = lambda k: F.col("id") * k % 9973
        cited = spark.range(n).select(F.col("id").alias("claim_id"), (F.col("id") % 3).alias("artifact_id"), at(7919).alias("start"), (at(7919) + 3).alias("end"))
        red = spark.range(900).select((F.col("id") % 3).alias("artifact_id"), at(1047).alias("start"), (at(1047) + F.col("id") % 12).alias("end"))
        for some in (red, red.where("artifact_id > 0 or start < 200")):
            few = some.groupBy("artifact_id").count().where(F.col("count") <= coverage.FEW).count()
            got = coverage.uncovered_spans(cited, some)
            assert most_dealt_by(got, "artifact_id") < n / 10, few
            want = cited.join(F.broadcast(some.toDF("a", "s", "e")), F.expr("artifact_id = a and s <= start and e >= end"), "left_anti")
            assert sorted(r.claim_id for r in got.collect()) == sorted(r.claim_id for r in want.collect())
        assert few == 1
        box = lambda df: df.withColumns({"x": F.col("start") * 1.0, "y": F.col("start") % 7 * 1.0, "w": F.lit(2.0), "h": F.lit(1.0)})
        assert most_dealt_by(coverage.uncovered_boxes(box(cited), box(red).where("start < 600")), "artifact_id") < n / 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_artifact_with_very_many_spans(spark):
    n = 100_000
    cited = spark.range(n).select(F.col("id").alias("claim_id"), F.lit("a").alias("artifact_id"), (F.col("id") * 7919 % 1_000_000).alias("start"))
    cited = cited.withColumn("end", F.col("start") + 5)
    red = spark.range(n).select(F.lit("a").alias("artifact_id"), (F.col("id") * 104729 % 1_000_000).alias("start"))
    red = red.withColumn("end", F.col("start") + F.col("start") % 11)
    assert rows_of(coverage.uncovered_spans(cited, red)) <= 3 * n


def test_one_artifact_with_very_many_boxes(spark):
    made = {}
    for n in (500, 2000):
        box = lambda k, side: spark.range(n).select(F.col("id").alias("claim_id"), F.lit("a").alias("artifact_id"), (F.col("id") * k % 9973).cast("double").alias("x"), (F.col("id") * (k + 2) % 9967).cast("double").alias("y"), F.lit(side).alias("w"), (F.col("id") % 13 + side).alias("h"))  # noqa: B023, E731
        made[n] = rows_of(coverage.uncovered_boxes(box(7919, 2.0), box(104729, 40.0)))
    assert made[2000] < 4 * 2 * made[500] and made[2000] < 2000 * 2000 / 5  # rows times the square of the logarithm, not pairs


def test_duplicates_over_borders_equal_all_pairs(spark):
    rng = random.Random(6)
    tol = 0.01
    tx = [("s", i, f"2024-{rng.choice((1, 2)):02d}-{rng.choice((1, 7, 8, 9, 16, 28)):02d}", round(rng.choice((1.0, 1.28, 5.12)) + rng.randrange(-4, 5) * rng.choice((0.004, 0.005, 0.0099, 0.01)), 5), rng.choice("ab"), "c") for i in range(400)]
    import datetime

    day = lambda d: datetime.date.fromisoformat(d)
    want = {(x[1], y[1]) for x in tx for y in tx if x[4] == y[4] and (y[2] > x[2] or (y[2] == x[2] and y[1] > x[1])) and abs(x[3] - y[3]) < tol and abs((day(x[2]) - day(y[2])).days) <= 1}
    df = spark.createDataFrame(tx, "statement_id string, ordinal long, date string, amount double, account string, category string")
    got = [(r.ordinal, r.other_ordinal) for r in finance.duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    wide = {(x[1], y[1]) for x in tx for y in tx if x[4] == y[4] and (y[2] > x[2] or (y[2] == x[2] and y[1] > x[1])) and abs(x[3] - y[3]) < tol and abs((day(x[2]) - day(y[2])).days) <= 9}
    assert {(r.ordinal, r.other_ordinal) for r in finance.duplicates(df, max_days=9).collect()} == wide
