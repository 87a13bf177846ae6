"""Mixing sources to target weights, with DataFrame functions only.

Source token shares are raised to an exponent and normalised. The exponent is bisected, between proportional (1) and
uniform (0), for the weights that reach a target entropy, or the flattest ones that repeat no source
beyond a limit. A source's budget is realised as whole passes over its documents and a part of one
more: blocks of documents in pseudo-random order, the last block cut at the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

_NEW = ("mix_epoch", "mix_tokens", "mix_order")
_ARMS, _ROUNDS = 32, 4  # the exponent's interval shrinks 32-fold a round


def tokens(text: str | Column) -> Column:
    """Words of a text, at least one for a row (so that empty rows cost something)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")


def exponent(sources: DataFrame, budget: float, entropy: float | None = None, repetition: float | None = None) -> float:
    """The largest exponent whose weights have at least the share ``entropy`` of the greatest possible
    entropy, or the smallest that repeats no source more than ``repetition`` times. ``sources``: (share, tokens).

    All candidates of a round are measured in one aggregation, so the sources may be many.
    """
    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        tries = [lo + (hi - lo) * k / _ARMS for k in range(_ARMS + 1)]
        aggs = [F.count("*").alias("n")]
        for k, a in enumerate(tries):
            x = F.pow("share", F.lit(a))
            aggs += [F.sum(x).alias(f"z{k}"), F.sum(x * F.log("share")).alias(f"l{k}"), F.max(x / F.col("tokens")).alias(f"m{k}")]
        r = sources.where("share > 0").agg(*aggs).first()
        if not r["n"]:
            return 1.0
        if repetition is not None:
            fits = [budget * r[f"m{k}"] / r[f"z{k}"] <= repetition for k in range(len(tries))]
            k = fits.index(True) if True in fits else _ARMS  # even proportional weights may repeat more
            lo, hi = tries[max(k - 1, 0)], tries[k]
        else:
            want = (entropy or 0.0) * math.log(r["n"])
            ents = [math.log(r[f"z{k}"]) - a * r[f"l{k}"] / r[f"z{k}"] for k, a in enumerate(tries)]
            k = max([k for k, e in enumerate(ents) if e >= want - 1e-12], default=0)
            lo, hi = tries[k], tries[min(k + 1, _ARMS)]
    return hi if repetition is not None else lo


def mix_sources(docs: DataFrame, budget_ratio: float = 1.0, entropy: float | None = None, repetition: float | None = 4.0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, block: int = 4096) -> DataFrame:
    """All columns of ``docs`` for each time a row is used, with ``mix_epoch``, ``mix_tokens`` and ``mix_order`` (a random order within the epoch).

    The budget is ``budget_ratio`` times the table's tokens. Weights reach the share ``entropy`` of the greatest
    entropy (None: as flat as can be), unless that would use a source more than ``repetition`` times (None: no limit); a
    ``budget_ratio`` above ``repetition`` can't be met and raises ValueError. A source gets its weight of the budget, to
    within one document, with repeated rows too: equal rows are used equally often but for one use. A null source is one source
    of its own; null and empty texts count one token. Columns of ``docs`` named as the three new ones (in any case) are
    replaced. An empty table gives no rows.
    """
    if repetition is not None and budget_ratio > repetition:
        raise ValueError(f"a budget of {budget_ratio} times the tokens repeats some source more than {repetition} times")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _NEW])
    # equal rows have equal hashes, and only equal rows, so that each may stand for the others; maps, which Spark doesn't hash, count by their text
    hashed = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"}) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    row = F.xxhash64(F.lit(seed), id_col, text_col, *[hashed(f) for f in docs.schema if f.name not in (id_col, text_col)])
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("none")).alias("src"), tokens(F.col(text_col).cast("string")).alias("tokens"), row.alias("h"))
    slim = written(work.select("src", "tokens", "h"), "mix-rows")
    sizes = written(slim.groupBy("src").agg(F.sum("tokens").alias("all"), F.count("*").alias("rows")), "mix-sources")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    shares = sizes.select("*", (F.col("all") / F.lit(max(total, 1))).alias("share"), F.col("all").alias("tokens"))
    budget = budget_ratio * total
    limits = [exponent(shares, budget, entropy=entropy)] * (entropy is not None) + [exponent(shares, budget, repetition=repetition)] * (repetition is not None)
    a = max(limits, default=0.0)
    norm = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    passes = F.pow("share", F.lit(a)) / norm * budget / F.col("all")
    plan = shares.select("src", F.floor(passes).alias("full"), ((passes - F.floor(passes)) * F.col("all")).alias("part"), F.greatest(F.ceil(F.col("rows") / block), F.lit(1)).alias("blocks"))
    plan = written(plan, "mix-plan")
    # blocks: a source's rows by hash; blocks are permuted by another hash and taken until the part is reached
    of = F.pmod("h", F.col("blocks")).alias("block")
    placed = slim.join(plan, "src").select("src", "h", "tokens", "part", of)
    sums = placed.groupBy("src", "block").agg(F.sum("tokens").alias("size"), F.first("part").alias("part"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("part") - F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = written(sums.select("src", "block", "size", left.alias("left")).where("left > 0"), "mix-blocks")
    # the distinct rows of the one block a source that the budget cuts are taken in order of their hash, the last with some of its copies
    groups = placed.join(cut.where("left < size"), ["src", "block"]).groupBy("src", "block", "h").agg(F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("left").alias("left"))
    within = Window.partitionBy("src").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("left") - F.coalesce(F.sum(F.col("copies") * F.col("tokens")).over(within), F.lit(0))
    some = groups.select("src", "block", "h", "copies", F.greatest(F.least(F.floor(rest / F.col("tokens")), F.col("copies")), F.lit(0)).alias("fit"), "left", rest.alias("rest"))
    edge = some.where("rest > 0").groupBy("src", "block").agg(F.max("h").alias("edge"), F.max_by("fit", "h").alias("extra"), F.max_by("copies", "h").alias("copies"))
    # below the edge all rows are taken; of the equal rows at it, one stands for as many as fit
    whole = cut.where("left >= size").select("src", "block", F.lit(None).cast("long").alias("edge"), F.lit(0).cast("long").alias("extra"))
    taken = written(whole.union(edge.select("src", "block", "edge", F.col("extra").cast("long"))), "mix-taken").withColumn("taken", F.lit(True))
    used = work.join(plan, "src").select("row", "src", "tokens", "h", "full", of).join(taken, ["src", "block"], "left")
    more = F.coalesce(F.col("taken") & (F.col("edge").isNull() | (F.col("h") < F.col("edge"))), F.lit(False))
    main = used.withColumn("n", F.col("full") + more.cast("long")).where("n > 0").select("row", "tokens", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("epoch"))
    copies = used.where("h = edge and extra > 0").groupBy("src", "h").agg(*[F.first(c).alias(c) for c in ("row", "tokens", "full", "extra")])
    copies = copies.select("row", "tokens", "h", F.col("full").alias("epoch"), F.explode(F.sequence(F.lit(1).cast("long"), "extra"))).drop("col")
    return main.union(copies.select("row", "tokens", "h", "epoch")).select("row.*", F.col("epoch").alias("mix_epoch"), F.col("tokens").alias("mix_tokens"), F.xxhash64(F.lit(seed + 2), "epoch", "h").alias("mix_order"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents mixed within their own token budget, as flat as four repetitions allow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs.select("doc_id", "text", "source")).drop("text")
