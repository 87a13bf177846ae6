"""Benchmark decontamination: size-partitioned MinHash containment search.

A document's shingles that occur in no benchmark item can't add to any item's containment, so only those that do are
kept; documents are then partitioned by the size of what is left. For each pair of a document partition and an item
size class, the band width and number are set so that an item with the wanted containment is
missed with probability ``MISS`` or less; where no setting does that, all items that share a shingle are
candidates. Candidates are verified by the exact containment of their shingle sets.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as words_

HASHES, MISS = 128, 1e-6
BLOCK_BYTES = 8 << 20  # benchmark text that is broadcast at once
RESULT = "doc_id long, item_id long, shared long, item_shingles long, containment double"
_BREAK = np.ones(256, bool)  # words are runs of ASCII letters and digits and of other scripts' bytes
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PERM = words_.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands(doc_size: int, item_size: int, containment: float) -> tuple[int, int] | None:
    """(rows a band, bands) for documents of up to ``doc_size`` shingles and items of at least ``item_size``; None: no setting holds."""
    j = containment * item_size / (doc_size + item_size - containment * item_size)
    for r in (8, 4, 2, 1):
        if j >= 1 or (n := math.ceil(math.log(MISS) / math.log1p(-(j**r)))) * r <= HASHES:
            return r, 1 if j >= 1 else n
    return None


def _signature(shingles: np.ndarray) -> np.ndarray:
    return words_.mix(shingles[None, :] ^ _PERM[:, None]).min(1)


def _band(signature: np.ndarray, r: int, k: int) -> bytes:
    return signature[k * r : k * r + r].tobytes()


class Index:
    """The items of one block, by shingle and by band."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int, containment: float):
        self.shingle, self.containment = shingle, containment
        self.ids, self.sets = [], []
        raw, at, first, h = _hashed(pa.array([t for _, t in items], pa.string()))
        self.short = defaultdict(list)  # items of fewer words than a shingle count as one shingle of all their words
        for k, (i, _) in enumerate(items):
            own = h[first[k] : first[k + 1]]
            if n := min(len(own), shingle):
                self.ids.append(i)
                self.sets.append(np.unique(words_.hash_runs(own, n)))
                if n < shingle:
                    self.short[n].append(self.sets[-1])
        self.lengths = [shingle, *sorted(self.short)]
        self.universe = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        self.bits = np.zeros(1 << 20, bool)  # most shingles fail here
        self.bits[self.universe >> np.uint64(44)] = True
        self.item_class = [len(s).bit_length() for s in self.sets]
        self.classes = sorted(set(self.item_class))
        self.signatures = [_signature(s) for s in self.sets]
        self.tables: dict[int, tuple[list, dict]] = {}
        self.holders = defaultdict(list)
        for n, s in enumerate(self.sets):
            for x in s.tolist():
                self.holders[x].append(n)

    def table(self, doc_class: int) -> tuple[list, dict]:
        """For documents of under 2^doc_class shingles: band settings, and the items of each band; None holds classes without a setting."""
        if doc_class not in self.tables:
            settings = {c: bands((1 << doc_class) - 1, 1 << (c - 1), self.containment) for c in self.classes}
            filed = defaultdict(list)
            for n, c in enumerate(self.item_class):
                if settings[c]:
                    r, b = settings[c]
                    for k in range(b):
                        filed[r, k, _band(self.signatures[n], r, k)].append(n)
            widest = defaultdict(int)
            for r, b in filter(None, settings.values()):
                widest[r] = max(widest[r], b)
            self.tables[doc_class] = sorted(widest.items()), filed, {c for c, s in settings.items() if s is None}
        return self.tables[doc_class]

    def search(self, kept: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of all items contained in a document, given its distinct shingles that items have."""
        settings, filed, rest = self.table(len(kept).bit_length())
        found: set[int] = set()
        if settings:
            signature = _signature(kept)
            for r, b in settings:
                for k in range(b):
                    found.update(filed.get((r, k, _band(signature, r, k)), ()))
        if rest:
            found.update(n for x in kept.tolist() for n in self.holders[x] if self.item_class[n] in rest)
        out = []
        for n in sorted(found):
            shared = int(np.isin(self.sets[n], kept, assume_unique=True).sum())
            if shared >= self.containment * len(self.sets[n]) - 1e-9:
                out.append((n, shared))
        return out

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(row, what it contains) of each text that contains an item."""
        if self.sets:
            for start, part in words_.slices(texts):
                for row, found in self._matches(part):
                    yield start + row, found

    def _matches(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        raw, at, first, h = _hashed(texts)
        doc = words_.doc_of(first)
        docs, shingles = [], []
        for n in self.lengths:
            runs, whole = words_.hash_runs(h, n), words_.whole_runs(first, n)
            x = runs[whole]
            hit = self.bits[x >> np.uint64(44)]
            x, where = x[hit], doc[whole[hit]]
            at_ = np.minimum(np.searchsorted(self.universe, x), len(self.universe) - 1)
            real = self.universe[at_] == x
            docs.append(where[real])
            shingles.append(x[real])
        docs, shingles = np.concatenate(docs), np.concatenate(shingles)
        order = np.argsort(docs, kind="stable")
        docs, shingles = docs[order], shingles[order]
        rows, starts = np.unique(docs, return_index=True)
        for row, own in zip(rows.tolist(), np.split(shingles, starts[1:])):
            if found := self.search(np.unique(own)):
                yield row, found


def _hashed(texts: pa.Array):
    raw, at = words_.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = words_.find_words(raw, at, _BREAK)
    return raw, at, first, words_.hash_spans(raw, starts, ends)


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, shingle: int, containment: float) -> Iterator[Index]:
    """Indexes of the benchmark's items, in blocks of about ``BLOCK_BYTES`` of text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Index([tuple(r) for r in block.collect()], shingle, containment)


def contained_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_id_col: str = "item_id", shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): the items of which a row's whole text contains at least ``containment`` of the distinct shingles.

    Words are lowered runs of letters and digits. An item of fewer words than a shingle is one shingle; null
    items and those without words are in no document, null and empty documents contain nothing. Repeated rows
    of either table give repeated results. The benchmark is broadcast in blocks of bounded size, each against all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark, "text", item_id_col, shingle, containment):
        shared = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(_searcher(shared), RESULT)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def _searcher(shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            got = [(row, n, k) for row, found in index.matches(batch.column(1)) for n, k in found]
            ids = batch.column(0).take(pa.array([row for row, _, _ in got], pa.int64()))
            sizes = [len(index.sets[n]) for _, n, _ in got]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([index.ids[n] for _, n, _ in got], pa.int64()), pa.array([k for _, _, k in got], pa.int64()), pa.array(sizes, pa.int64()),
                pa.array([k / s for (_, _, k), s in zip(got, sizes)], pa.float64()),
            ], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return each


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item."""
    k = docs.columns.index(text_col)
    for index in _blocks(benchmark, "text", item_id_col, shingle, containment):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in shared.value.matches(batch.column(k))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(each, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Query: all benchmark items contained in all documents."""
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
