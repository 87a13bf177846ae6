"""SimHash near-dedup with pigeonhole blocks.

Fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of
``blocks`` blocks. Every distinct fingerprint is filed under each choice of so many blocks; those
filed together are verified by their Hamming distance, and links are closed transitively.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import without_ids, written
from .components import connected_components

FINGERPRINTS = "doc_id long, fp long"


def simhash(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of one text (0 for a text without words)."""
    import xxhash

    words = (text or "").encode().lower().split()  # lowers A-Z only; splits at \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - shingle + 1, 1)
    stops = ends[len(words) - n :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(starts, stops)]), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(h[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp is the unsigned fingerprint's bits as a long. A null text counts as one without words."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(each, FINGERPRINTS)


def _filed(blocks: int, radius: int) -> F.Column:
    """The keys under which a fingerprint is filed: a number for the choice of blocks, hashed with their bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])


def _forest(fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join each linked set of a group, without listing all its pairs: a breadth-first walk."""
    left, out = np.arange(len(fp)), []
    while len(left):
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            i = wave.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
            out += [(node[i], node[j]) for j in left[near]]
            wave += left[near].tolist()
            left = left[~near]
    return out


def _links(radius: int, small: int = 16):
    """Links in groups of rows of equal keys (sorted by key); a group may run over batches."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in rows:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.flatnonzero(_changes(now))[-1])
            held = [x[cut:] for x in now]
            if cut:
                yield _linked([x[:cut] for x in now], radius, small)
        if held is not None:
            yield _linked(held, radius, small)

    return each


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    first = np.ones(len(cols[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols[2:]])
    return first


def _linked(cols: list[np.ndarray], radius: int, small: int) -> pa.RecordBatch:
    fp, node = cols[0].view(np.uint64), cols[1]
    starts = np.flatnonzero(_changes(cols))
    sizes = np.diff(np.append(starts, len(fp)))
    group = np.repeat(np.arange(len(starts)), sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.flatnonzero((sizes <= small)[group])
    for d in range(1, min(int(sizes[sizes <= small].max(initial=1)), small)):
        i = few[few + d < len(fp)]
        i = i[(group[i] == group[i + d])]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        a.append(node[i])
        b.append(node[i + d])
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        if found := _forest(fp[s : s + n], node[s : s + n], radius):
            x, y = zip(*found)
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def blocks_for(n: int, radius: int = 4) -> int:
    """The least number of blocks whose keys are so long that of ``n`` random fingerprints some eight or fewer share one. Any number finds all links."""
    return next((b for b in range(radius + 2, 3 * radius + 3) if n >> (64 * (b - radius) // b) < 8), 3 * radius + 2)


def links(nodes: DataFrame, radius: int = 4, blocks: int = 6, tile: int = 2048) -> DataFrame:
    """(a, b): links that connect all ``nodes`` (node, fp; fp distinct) within ``radius`` bits of each other.

    Groups of over ``tile`` fingerprints are dealt as pairs of tiles, so that no task gets an
    unbounded group and no pair is lost.
    """
    filed = nodes.select("fp", "node", F.explode(_filed(blocks, radius)).alias("key"))
    large = filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), tiles.cast("long")).cast("int")
    dealt = filed.join(large, "key").withColumn("t", own).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("fp", "node", "key", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"))
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most ``radius`` bits.

    Null and wordless texts have fingerprint zero and link like any other. Rows that share a doc_id
    share a node for each fingerprint. A row without doc_id gets the component of its fingerprint if
    a document with an id has that fingerprint, else null. An empty table gives no rows. ``blocks`` is chosen by the number of
    fingerprints unless given; it decides the work, not the result.
    """
    fps = written(fingerprints(docs, text_col, id_col, shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-nodes")
    same = fps.join(nodes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    again = fps.groupBy("doc_id").agg(F.countDistinct("fp").alias("k")).where("k > 1").select("doc_id")
    same = same.join(again, F.col("a") == F.col("doc_id"), "left_semi")  # an id with several fingerprints bridges them
    comps = connected_components(links(nodes, radius, blocks or blocks_for(nodes.count(), radius)).union(same))
    known = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component holds a smaller doc_id.

    Rows without doc_id stay, and so do all rows that share the smallest doc_id of their component.
    """
    near = near_duplicates(docs, text_col, id_col, shingle, radius)
    return without_ids(docs, id_col, near.where("component_id < doc_id").select("doc_id"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: 4-word SimHash fingerprints of all documents and their components at 4 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
