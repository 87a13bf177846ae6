"""Document fingerprints: improbable-feature digests.

Every byte window of a text is ranked by how rare the class of its entropy is in the corpus. In each stretch of
neighbouring windows the rarest, leftmost one gets a vote, and windows with many votes are features, at one density
for texts of any size. Features go into a chain of Bloom filters in text order. Two digests are compared
filter by filter, by the overlap of bits beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, text_bytes
from ._words import buffers, hash_spans, slices

WINDOW, NEIGHBOURS, VOTES = 32, 64, 16  # bytes; windows that vote together; votes that make a feature
FILTER_BITS, HASHES, FEATURES, CLASSES = 2048, 5, 160, 256
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_N = np.arange(WINDOW + 1)
_TERMS = np.round(_N * np.log2(np.maximum(_N, 1)) * 4096).astype(np.int32)  # the entropy's terms, whole numbers so that sums are exact
_STEP = np.diff(_TERMS)
_AT_ONCE = 1 << 17


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the byte entropy of the window that starts at each byte (the last ones left out): 0 most even, 255 one byte alone.

    The sum of n log n over a window's bytes is carried from window to window: the byte that leaves and the one that
    enters change it by how often they occur among the bytes between, so a window costs the same whatever it holds.
    """
    n = max(len(raw) - WINDOW + 1, 0)
    out = np.empty(n, np.uint8)
    for lo in range(0, n, _AT_ONCE):
        x = raw[lo : min(lo + _AT_ONCE, n) + WINDOW - 1]
        m = len(x) - WINDOW
        after, before = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
        for d in range(1, WINDOW):
            same = (x[:-d] == x[d:]).view(np.uint8)
            after[:-d] += same
            before[d:] += same
        total = np.empty(m + 1, np.int32)
        total[0] = _TERMS[np.bincount(x[:WINDOW])].sum()
        total[1:] = _STEP[before[WINDOW:]] - _STEP[after[:m]]
        out[lo : lo + m + 1] = np.cumsum(total, dtype=np.int32) // (_TERMS[WINDOW] // (CLASSES - 1) + 1)
    return out


def _most_voted(rank: np.ndarray) -> np.ndarray:
    """Places that are the leftmost lowest rank of at least ``VOTES`` of the stretches of ``NEIGHBOURS`` places."""
    places, votes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(rank) - NEIGHBOURS + 1, _AT_ONCE):
        part = rank[lo : lo + _AT_ONCE + NEIGHBOURS - 1]
        low = (part.astype(np.int32) << 20) | np.arange(len(part), dtype=np.int32)
        size = 1
        while size < NEIGHBOURS:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        starts = np.flatnonzero(np.diff(low, prepend=-1))
        places.append((low[starts] & ((1 << 20) - 1)) + lo)
        votes.append(np.diff(np.append(starts, len(low))))
    places, votes = np.concatenate(places), np.concatenate(votes)
    if not len(places):
        return places
    new = np.flatnonzero(np.diff(places, prepend=-1))  # a place may have votes in two parts
    return places[new][np.add.reduceat(votes, new) >= VOTES]


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy class, the rarest first, from its windows in a corpus."""
    out = np.empty(CLASSES, np.int16)
    out[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return out


def class_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many byte windows of all texts have each entropy class; 256 numbers reach the driver."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in rows:
            for _, part in slices(batch.column(0), 1 << 20):
                raw, at = buffers(part)
                kinds = entropy_classes(raw)
                whole = at[:-1][np.diff(at) >= WINDOW], at[1:][np.diff(at) >= WINDOW] - WINDOW + 1
                total += np.bincount(kinds[_within(*whole, len(kinds))], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total)], ["kind", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(each, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect():
        out[r["kind"]] = r["n"]
    return out


def _within(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, stops, -1)
    return np.cumsum(mark[:-1], dtype=np.int8) > 0


def digests(texts: list[str], rank: np.ndarray) -> list[np.ndarray]:
    """Of each text an array of Bloom filters (n, 256 bytes), none for an empty text; a text shorter than a window is one feature."""
    coded = [t.encode() for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    gap = bytes(NEIGHBOURS - 1)  # so that no stretch reaches from one text into another
    raw = np.frombuffer(gap + gap.join(coded) + gap + bytes(WINDOW), np.uint8)
    at = np.cumsum(sizes + len(gap)) - sizes
    ends, whole = at + sizes, sizes >= WINDOW
    kinds = entropy_classes(raw)
    ranked = np.where(_within(at[whole], ends[whole] - WINDOW + 1, len(kinds)), rank[kinds], np.int16(CLASSES))
    places = _most_voted(ranked)
    places = places[ranked[places] < CLASSES]
    short = np.flatnonzero(~whole & (sizes > 0))
    places = np.sort(np.concatenate([places, at[short]]))
    doc = np.searchsorted(at, places, "right") - 1
    h = hash_spans(raw, places, np.minimum(places + WINDOW, ends[doc]))
    _, once = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1, return_index=True) if len(h) else (None, np.zeros(0, np.int64))
    once.sort()
    doc, h = doc[once], h[once]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    filters = -(-np.diff(first) // FEATURES)
    base = np.concatenate([[0], np.cumsum(filters)])
    which = base[doc] + (np.arange(len(doc)) - first[doc]) // FEATURES
    bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[which, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[base[i] : base[i + 1]] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how far the filters of the shorter digest overlap their best matches in the longer one, beyond chance."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = weight = 0.0
    n_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    for f in a:
        n = int(np.bitwise_count(f).sum(dtype=np.int64))
        common = np.bitwise_count(b & f).sum(1, dtype=np.int64)
        chance, most = n * n_b / FILTER_BITS, np.maximum(n, n_b)
        best = float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        total, weight = total + n * best, weight + n
    return total / weight


def as_string(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rank: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) for every row's whole text; null and empty texts have the empty fingerprint.

    Classes are ranked by all texts of ``docs`` unless ``rank`` is given; digests compare only under equal ranks.
    """
    rank = ranks(class_counts(docs, text_col)) if rank is None else rank

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = [as_string(d) for i, j in _slices(texts) for d in digests(texts[i:j], rank)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(each, "doc_id long, fingerprint string")


def _slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def with_successor(docs: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) in ``n`` partitions of consecutive ids, each followed by the first row of the next.

    Columns: run, after, doc_id, text; sorted. Rows with ``after`` set are the extra ones; the last run gets the very first row.
    Only one id a run reaches the driver. Nulls come first, equal ids in order of their texts; all rows of one id (or
    without one) are in one partition, so ids are taken to be near to unique.
    """
    low = np.iinfo(np.int64).min
    cuts = np.unique(np.array(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], np.int64))

    def run_of(ids: pd.Series) -> np.ndarray:
        return np.searchsorted(cuts, ids.astype("Int64").fillna(low).to_numpy(np.int64), "right")

    run = F.pandas_udf(lambda ids: pd.Series(run_of(ids)), "long")
    ids = docs.select(F.coalesce("doc_id", F.lit(low)).alias("doc_id"))
    firsts = sorted(tuple(r) for r in ids.groupBy(run("doc_id").alias("run")).agg(F.min("doc_id")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        filled = ids.astype("Int64").fillna(low).tolist()
        return pd.Series([[2 * r] + ([2 * before[i] + 1] if i in before else []) for i, r in zip(filled, run_of(ids).tolist())])

    spread = docs.select(F.explode(places("doc_id")).alias("place"), "doc_id", "text").select((F.col("place") / 2).cast("long").alias("run"), (F.col("place") % 2 == 1).alias("after"), "doc_id", "text")
    return spread.repartitionById(n, F.col("run").cast("int")).sortWithinPartitions("run", "after", "doc_id", "text")  # a run is a task


def compare_edited(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, with their likeness and that to the next row's fingerprint.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document in order of doc_id; the last document's next is the first. Nulls are empty texts; rows of equal
    doc_id follow each other in order of their texts, and of the first doc_id of a run of ids the smallest text
    counts as the next. A single row is its own next. Entropy classes are ranked by the texts of ``docs``. An empty table gives no rows.
    """
    spark, rank = docs.sparkSession, ranks(class_counts(docs, text_col))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = with_successor(docs, parts(spark, text_bytes(docs, "text"), 24 << 20))

    def pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, text, next text)."""
        held = None
        for batch in rows:
            for run, after, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == run:
                    yield held[1], held[2], t
                held = None if after else (run, i, t)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, size = [], 0
        for pair in pairs(rows):
            slice_.append(pair)
            size += len(pair[1])
            if size >= 1 << 20:
                yield _compared(slice_, rank)
                slice_, size = [], 0
        if slice_:
            yield _compared(slice_, rank)

    return placed.mapInArrow(each, RESULT)


def _compared(rows: list[tuple], rank: np.ndarray) -> pa.RecordBatch:
    n, texts, edited = len(rows), [], []
    for _, t, after in rows:
        half = len(t) // 2
        edited.append(t[: len(t) - half] + after[:half])
        texts.append(t)
    chained = all(rows[k][2] == rows[k + 1][1] for k in range(n - 1))
    nexts = [rows[-1][2]] if chained else [r[2] for r in rows]
    made = digests(texts + nexts, rank)
    own, new = made[:n], digests(edited, rank)
    following = made[1 : n + 1] if chained else made[n:]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(map(as_string, own), pa.string()), pa.array(map(as_string, new), pa.string()),
        pa.array(map(likeness, own, new), pa.float64()), pa.array(map(likeness, own, following), pa.float64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op5_digests(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents and of their edited texts."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
