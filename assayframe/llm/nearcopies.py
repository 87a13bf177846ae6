"""Near copies by word shingles: SimHash blocks and MinHash bands find candidates, exact Jaccard verifies them.

Fingerprints within four bits are linked by blocks (``simhash.near_duplicates``), and what they link is a group of candidates.
A 64-bit SimHash can't do all at a similarity of 0.8: such texts lie about 9.7 bits apart (standard deviation
2.9), and blocks for a radius of 17 or more bits would be of three bits each; the rest come from bands. With 32 bands of five minima a pair
of similarity 0.8 shares a band with a probability of 1 - 3e-6. Sets that share bands meet in the group of
the smallest of them and are verified by a walk that compares whole sets; only what is verified is closed transitively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import without_ids, written
from .components import connected_components

BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
SKETCH = "doc_id long, hi long, lo long, keys array<long>"
MEMBER = "comp long, node long, size long, shingles binary"
FOUND = "comp long, a long, b long, size long"


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``shingle`` words; of a shorter text the hash of all its words."""
    import xxhash

    words = (text or "").encode().lower().split()  # lowers A-Z only; splits at \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - shingle + 1, 1)
    stops = ends[len(words) - n :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(starts, stops)]), np.uint64))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key for each band of five minima of the set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        x = (s[k : k + 2048, None] ^ _SALTS) * _FACTORS
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=0))
    key = (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hi, lo, keys) for every row of (doc_id, text): the hash of its set and its band keys, none for an empty set."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in rows:
            marks, keys = [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), shingle)
                marks.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16))
                keys.append(band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
            both = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists], ["doc_id", "hi", "lo", "keys"])

    return docs.mapInArrow(each, SKETCH)


def _members(texts: DataFrame, shingle: int) -> DataFrame:
    """(comp, node, size, shingles) of (comp, node, text); empty sets are left out."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            some = np.flatnonzero([len(s) for s in sets])
            kept = batch.take(pa.array(some))
            size = pa.array([len(sets[k]) for k in some], pa.int64())
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), size, pa.array([sets[k].tobytes() for k in some], pa.binary())], ["comp", "node", "size", "shingles"])

    return texts.mapInArrow(each, MEMBER)


def forest(sets: list[np.ndarray], similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join each linked set of a group, by a breadth-first walk, and which sets are linked to the first."""
    sizes = np.array([len(s) for s in sets])
    left, out, of_first = np.arange(len(sets)), [], np.zeros(len(sets), bool)
    while len(left):
        root, wave, left = left[0], [left[0]], left[1:]
        of_first[root] = root == 0
        while wave and len(left):
            i = wave.pop()
            fits = np.minimum(sizes[left], sizes[i]) >= similarity * np.maximum(sizes[left], sizes[i]) - 1e-9
            some = left[fits]
            if not len(some):
                continue
            flat = np.concatenate([sets[j] for j in some])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            near = some[common >= similarity * (sizes[some] + sizes[i] - common) - 1e-9]
            out += [(i, j) for j in near]
            of_first[near] = root == 0
            wave += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return out, of_first


def _walks(similarity: float, rest: bool):
    """Of rows (group, comp, node, size, shingles), sorted by group: links (comp, a, b), and with ``rest`` what isn't linked to the first row, as (comp, a, null, size)."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in rows:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and held:
                    yield walked(held)
                    held = []
                group = g
                held.append(row)
        if held:
            yield walked(held)

    def walked(held: list) -> pa.RecordBatch:
        comp, nodes = held[0][0], [r[1] for r in held]
        links, of_first = forest([np.frombuffer(r[3], np.uint64) for r in held], similarity)
        found = [(nodes[i], nodes[j], None) for i, j in links]
        if rest:
            found += [(nodes[i], None, held[i][2]) for i in np.flatnonzero(~of_first)]
        a, b, size = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([comp] * len(a), pa.int64()), *(pa.array(x, pa.int64()) for x in (a, b, size))], ["comp", "a", "b", "size"])

    return each


def _tiles(tile: int) -> F.Column:
    """Tasks' shares of a group: of so many sets, and of a million shingles, at most on average."""
    return F.ceil(F.greatest(F.count("*") / tile, F.sum("size") / (1 << 20))).cast("int")


def _own(tiles: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(tiles).cast("long")).cast("int")


def _all(tiles: str) -> F.Column:
    return F.sequence(F.lit(0), F.col(tiles) - 1)


def links(members: DataFrame, similarity: float = 0.8, tile: int = 256) -> DataFrame:
    """(a, b): links that connect, within each ``comp`` of ``members``, all sets of at least that similarity. A set may be in several; the node that a comp is named by is in it.

    Of a comp over ``tile`` sets each share is walked together with the comp's first set. Sets linked to that
    are linked to each other; only the rest is then compared with all shares. So a large group of near copies
    takes rows in proportion to its size, and no pair is lost.
    """
    tiles = members.groupBy("comp").agg(_tiles(tile).alias("tiles")).where("tiles > 1")
    large = written(tiles, "near-large")
    row = ["comp", "node", "size", "shingles"]
    placed = members.join(large, "comp", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("t", F.explode(F.when(F.col("node") == F.col("comp"), _all("tiles")).otherwise(F.array(_own("tiles", 1)))))

    def walk(dealt: DataFrame, by: list[str], rest: bool, tag: str) -> DataFrame:
        group = F.concat_ws(":", *by).alias("g")
        sorted_ = dealt.repartition(*by).sortWithinPartitions(*by, F.col("node") != F.col("comp"))
        return written(sorted_.select(group, *row).mapInArrow(_walks(similarity, rest), FOUND), tag)

    many = walk(placed.where("tiles > 1"), ["comp", "t"], True, "near-first")
    out = many.where("b is not null").union(walk(placed.where("tiles = 1"), ["comp"], False, "near-links"))
    rest = many.where("b is null").select("comp", F.col("a").alias("node"), "size").distinct()
    again = written(rest.groupBy("comp").agg(_tiles(tile).alias("parts")), "near-rest")
    if not again.isEmpty():
        both = members.join(large, "comp").join(again, "comp")
        every = both.withColumn("t", _own("tiles", 1)).withColumn("k", F.explode(_all("parts")))
        fresh = both.join(rest.select("comp", "node").distinct(), ["comp", "node"], "left_semi").withColumn("k", _own("parts", 2)).withColumn("t", F.explode(_all("tiles")))
        out = out.union(walk(every.select(*row, "t", "k").union(fresh.select(*row, "t", "k")), ["comp", "t", "k"], False, "near-again"))
    return out.select("a", "b")


def candidates(nodes: DataFrame) -> DataFrame:
    """(comp, node): groups in which any two ``nodes`` (node, keys) that share a key meet: each key's nodes go to the group of the smallest of them, which is in it too.

    Groups are not closed over one another, so texts that share a template, of which some pairs share a key by chance, don't grow together to one group before they are verified.
    """
    filed = nodes.select("node", F.explode("keys").alias("key"))
    hubs = filed.groupBy("key").agg(F.min("node").alias("comp"), F.count("*").alias("n")).where("n > 1").select("key", "comp")
    return filed.join(hubs, "key").select("comp", "node").distinct()


def hashed_groups(texts: DataFrame, nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(comp, node): the ``nodes`` (node, keys) of each component of SimHash fingerprints within ``radius`` bits, named by the smallest of them. Those of empty sets are left out."""
    found = simhash.near_duplicates(texts, radius=radius).select(F.col("doc_id").alias("node"), "component_id")
    own = found.join(nodes.where(F.size("keys") > 0).select("node"), "node").distinct()
    hubs = own.groupBy("component_id").agg(F.min("node").alias("comp"), F.count("*").alias("n")).where("n > 1").select("component_id", "comp")
    return own.join(hubs, "component_id").select("comp", "node")


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, tile: int = 256) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest doc_id reachable over links of shingle sets of that Jaccard similarity or more.

    Null and wordless texts have the empty set, which links to its like alone. A row without doc_id gets the component
    of its set if a document with an id has that set, else null. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(_sketches(texts, shingle), "near-sketches")
    nodes = written(sketches.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")).where("node is not null"), "near-nodes")
    pairs = written(hashed_groups(texts, nodes).union(candidates(nodes)).distinct(), "near-groups")
    some = pairs.select("node").distinct()
    sets = written(_members(texts.join(some, F.col("doc_id") == F.col("node")).select(F.lit(0).cast("long").alias("comp"), "node", "text"), shingle), "near-sets").drop("comp")
    members = written(pairs.join(sets, "node").select("comp", "node", "size", "shingles"), "near-members")
    verified = links(members, similarity, tile)
    ids = sketches.select("doc_id", "hi", "lo")
    again = ids.groupBy("doc_id").agg(F.countDistinct("hi", "lo").alias("k")).where("k > 1").select("doc_id")
    same = ids.join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).where("doc_id <> node").join(again, "doc_id", "left_semi")  # an id with several sets bridges them
    final = connected_components(verified.union(same.select("doc_id", "node")))
    known = nodes.select("hi", "lo", "node").join(final, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component_id"))
    return ids.join(known, ["hi", "lo"], "left").select("doc_id", "component_id")


def keep_one_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component holds a smaller doc_id.

    Rows without doc_id stay, and so do all rows that share the smallest doc_id of their component.
    """
    near = near_copies(docs, text_col, id_col, shingle, similarity)
    return without_ids(docs, id_col, near.where("component_id < doc_id").select("doc_id"))
