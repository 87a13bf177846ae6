"""Which citations redactions contain, without comparing all of an artifact's spans or boxes with one another.

Spans are swept: redactions and citations stand in order of their start, and a citation is covered if the greatest end so far reaches its own.
Boxes are first split so that two of the four comparisons hold by construction, and then swept as spans are. An artifact of any size is spread over tasks.
Columns that begin with two underscores are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, FEW = 1 << 16, 64  # places in one window; boxes of an artifact up to which each is compared with all its citations
SENT = 1 << 18  # rows up to which a small side goes to every task, so that citations aren't dealt by keys that may be three


def _swept(outer: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __b, __at, __reach): within each block the greatest ``__end`` of ``outer`` at or before each place. Equal places are one row before any window."""
    none = F.lit(None).cast(outer.schema["__end"].dataType).alias("__end")
    points = outer.select(*keys, "__b", "__at", "__end").unionByName(places.select(*keys, "__b", "__at", none)).groupBy(*keys, "__b", "__at").agg(F.max("__end").alias("__end"))
    so_far = Window.partitionBy(*keys, "__b").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*keys, "__b", "__at", F.max("__end").over(so_far).alias("__reach"))


def _by_number(outer: DataFrame, keys: list[str], few: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(rows of keys that have up to ``few``, rows of the others, the others' keys), None where there are none; one job over ``outer`` counts them.

    Up to ``SENT`` rows of the first and third are broadcast. Without null keys, which equal none.
    """
    for c in keys:
        outer = outer.where(F.col(c).isNotNull())
    n = outer.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = n.agg(F.sum(F.when(F.col("__n") <= few, F.col("__n"))).alias("rows"), F.count_if(F.col("__n") > few).alias("many")).first()
    sent = lambda df, rows: F.broadcast(df) if rows <= SENT else df
    if not found.many:
        return (sent(outer, found.rows) if found.rows else None), None, None
    many = sent(n.where(F.col("__n") > few).select(*keys), found.many)
    if not found.rows:
        return None, outer, many
    return sent(outer.join(many, keys, "left_anti"), found.rows), outer.join(many, keys, "left_semi"), many


def _compared(inner: DataFrame, outer: DataFrame | None, keys: list[str], held: str, how: str) -> DataFrame:
    """``inner`` semi- or anti-joined with ``outer``, whose columns get an r at their end, by the keys and a condition. Nothing is joined where ``outer`` is None."""
    if outer is None:
        return inner if how == "left_anti" else inner.limit(0)
    outer = outer.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"{c}r") for c in outer.columns if c not in keys])
    same = F.expr(held)
    for i, c in enumerate(keys):
        same = same & (F.col(c) == F.col(f"__k{i}"))
    return inner.join(outer, same, how)


def uncovered_spans(citations: DataFrame, redactions: DataFrame, keys: tuple[str, ...] = ("artifact_id",), block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Citations (keys, start, end, ...) that no redaction (keys, start, end) of the same keys contains. Nulls and negative numbers contain nothing and are in nothing.

    A citation can only be in a redaction that goes on in the block of ``block`` places in which it starts: a redaction stands in each block that it reaches.
    Keys with up to ``few`` different redactions are compared directly, which is linear in their citations; the number decides the way alone.
    """
    keys, whole = list(keys), (F.col("start") >= 0) & (F.col("end") >= 0)
    of = lambda c: F.floor(c / block)
    outer = redactions.where(whole & (F.col("start") <= F.col("end"))).select(*keys, F.col("start").alias("__s"), F.col("end").alias("__end")).distinct()
    little, much, many = _by_number(outer, keys, few)
    cited = citations.withColumn("__at", F.when(whole, F.col("start")))
    if much is None:
        out = _compared(cited, little, keys, "__at >= __sr and end <= __endr", "left_anti")
    else:
        swept = cited if little is None else cited.join(many, keys, "left_semi")
        much = much.select(*keys, "__s", "__end", F.explode(F.sequence(of(F.col("__s")), of(F.col("__end")))).alias("__b"))
        much = much.select(*keys, "__b", F.greatest("__s", F.col("__b") * block).alias("__at"), "__end")
        swept = swept.withColumn("__b", of(F.col("__at")))
        far = _swept(much, swept.where("__at is not null"), keys)
        out = swept.join(far, [*keys, "__b", "__at"], "left").where(~F.coalesce(F.col("__reach") >= F.col("end"), F.lit(False))).select(*citations.columns)
        if little is not None:
            rest = _compared(cited.join(many, keys, "left_anti"), little, keys, "__at >= __sr and end <= __endr", "left_anti")
            out = out.unionByName(rest.select(*citations.columns))
    return out.select(*citations.columns)


def reach(outer: DataFrame, places: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, __b, __at, __reach): the greatest ``__end`` of the rows of ``outer`` (keys, __at, __end) at or before each place (keys, __at). Windows run over blocks; a block takes the greatest end of all before it."""
    outer, places = (df.withColumn("__b", F.floor(F.col("__at") / block)) for df in (outer, places))
    lasts = outer.groupBy(*keys, "__b").agg(F.max("__end").alias("__last")).unionByName(places.select(*keys, "__b").distinct().withColumn("__last", F.lit(None).cast(outer.schema["__end"].dataType)))
    lasts = lasts.groupBy(*keys, "__b").agg(F.max("__last").alias("__last")).withColumn("__last", F.max("__last").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    return _swept(outer, places, keys).join(lasts, [*keys, "__b"]).select(*keys, "__b", "__at", F.greatest("__reach", "__last").alias("__reach"))


def ranks(values: DataFrame, keys: list[str], block: float = BLOCK) -> DataFrame:
    """(keys, __v, __rank, __size): the place of each different value (keys, __v) among those of its keys, from 0, and their number. Windows run over blocks of values."""
    v = values.distinct().withColumn("__b", F.floor(F.col("__v") / block))
    n = v.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    of = Window.partitionBy(*keys)
    n = n.select(*keys, "__b", (F.sum("__n").over(of.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(of).alias("__size"))
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__v")) - 1
    return v.withColumn("__place", place).join(n, [*keys, "__b"]).select(*keys, "__v", (F.col("__place") + F.col("__before")).alias("__rank"), "__size")


_BOX = ["__x0", "__y0", "__x1", "__y1"]


def _corners(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The different boxes without nulls and negative numbers, by their corners."""
    x, y, w, h = map(F.col, "xywh")
    sound = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull() & (F.least(x, y, w, h) >= 0)
    return boxes.where(sound).select(*keys, x.alias("__x0"), y.alias("__y0"), (x + w).alias("__x1"), (y + h).alias("__y1")).distinct()


def _contained(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes of ``inner`` that lie in one of ``outer``.

    Each axis' first corners are ranked. An outer box stands in the node of each level of a binary tree over the ranks that holds its own; the ranks up to an inner box's
    are the union of a few nodes, of different levels. So in each node of both axes that two boxes share the outer one's first corner is not behind the inner one's, and what is left is a sweep
    over the last corners. A box gets as many rows as the product of both trees' heights.
    """
    held = "transform(sequence(0, length(bin(__size)) - 1), l -> struct(l, shiftright(__rank, l) as i))"
    up_to = "transform(filter(sequence(0, length(bin(__rank + 1)) - 1), l -> shiftright(__rank + 1, l) % 2 = 1), l -> struct(l, shiftright(__rank + 1, l) - 1 as i))"
    for axis in ("__x0", "__y0"):
        values = outer.select(*keys, F.col(axis).alias("__v")).unionByName(inner.select(*keys, F.col(axis).alias("__v")))
        rank = ranks(values, keys).withColumnRenamed("__v", axis)
        outer, inner = (df.join(rank, [*keys, axis]).withColumn(f"__n{axis}", F.explode(F.expr(nodes))).drop("__rank", "__size") for df, nodes in ((outer, held), (inner, up_to)))
    node = [*keys, "__n__x0", "__n__y0"]
    outer, inner = (df.withColumn("__at", -F.col("__x1")) for df in (outer, inner))
    far = reach(outer.withColumn("__end", F.col("__y1")), inner, node)
    return inner.join(far.drop("__b"), [*node, "__at"]).where("__reach >= __y1").select(*keys, *_BOX).distinct()


def uncovered_boxes(citations: DataFrame, redactions: DataFrame, keys: tuple[str, ...] = ("artifact_id",), few: int = FEW) -> DataFrame:
    """Citations (keys, x, y, w, h, ...) that no redaction box (keys, x, y, w, h) of the same keys contains. Nulls and negative numbers contain nothing and are in nothing.

    Keys with up to ``few`` different redactions are compared directly, as for spans.
    """
    keys = list(keys)
    inner, outer = _corners(citations, keys), _corners(redactions, keys)
    little, much, many = _by_number(outer, keys, few)
    covered = _compared(inner, little, keys, "__x0r <= __x0 and __y0r <= __y0 and __x1r >= __x1 and __y1r >= __y1", "left_semi")
    if much is not None:
        covered = covered.unionByName(_contained(inner.join(many, keys, "left_semi"), much, keys))
    x, y, w, h = (F.col(c) for c in "xywh")
    cited = citations.withColumns(dict(zip(_BOX, (x, y, x + w, y + h))))
    # equal corners of boxes with a negative side are no boxes
    cited = cited.withColumn("__x0", F.when(F.least(x, y, w, h) >= 0, F.col("__x0")))
    return cited.join(covered, [*keys, *_BOX], "left_anti").select(*citations.columns)
