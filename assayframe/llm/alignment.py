"""Cross-tokenizer alignment: which ids of one vocabulary stand over which ids of another, and how often in the corpus.

Each text is encoded by both tokenizers; two tokens are linked if their bytes overlap. A pair of ids is one packed
int64 key. Keys are counted by ``np.unique`` a partition, put in one order over the corpus by a range partitioning, and summed
by their runs; the sorted counts lie in shards in the shared folder, which tasks map into memory and search.

Both tokenizers cut a text between a character that is no white space and a space: neither has a token across such a place.
So texts are cut there into units, of which each task encodes and aligns the different ones; a text's result is that of its units in turn.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import new_path, parts, small_batches, written
from ._exchange import pack_sorted, planes, unpack_sorted, unplanes
from ._words import buffers, slices

TOKENIZERS = "/opt/tokenizers"
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
PIECE, KEEP, SHARD, PARTIAL = 2 << 20, 1 << 17, 1 << 22, 1 << 22  # bytes of text at a time; units kept by a task; rows of a shard; keys counted at a time
#: How the byte-level vocabulary splits texts before it merges bytes.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """Two tokenizers: ids of texts that start with a space, and the bytes of each id."""

    def __init__(self, folder: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model"):
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, a), encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"] for t in spec.get("added_tokens", ())}
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in added}
        self._a = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self._b = b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, b))
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._space = b.piece_to_id("▁")
        # units may be encoded alone if no piece has a space after other characters and all spaces are kept
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and b"".join(self.bytes_b[i] for i in b.encode("a  b ")) == b" a  b "

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts that start with a space."""
        b = self._b.encode([u[1:] for u in units], num_threads=1)
        return [self._a.encode_ordinary(u) for u in units], [[self._space] if u == " " else ids for u, ids in zip(units, b)]


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary's entry stands for: itself if printable, else the next free one from 256 on."""
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


@cache
def _pair(folder: str) -> Pair:
    return Pair(folder)


def sizes(folder: str = TOKENIZERS) -> tuple[int, int]:
    """Entries of both vocabularies; a pair's key is ``a * size_b + b``."""
    p = _pair(folder)
    return len(p.bytes_a), len(p.bytes_b)


def unit_starts(raw: np.ndarray, at: np.ndarray, cuts: bool) -> np.ndarray:
    """Where units start in texts that each begin with a space: at a text, and at a space after a character that is no white space."""
    start = np.zeros(len(raw) + 1, bool)
    if cuts and len(raw):
        before = np.concatenate([np.zeros(3, np.uint8), raw])[: len(raw) + 2]
        b1, b2, b3 = before[2 : len(raw) + 2], before[1 : len(raw) + 1], before[: len(raw)]
        wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3) & np.isin(b2, (0x80, 0x81, 0x9A)))
        start[:-1] = (raw == 32) & (b1 > 32) & (b1 != 127) & ~wide
    start[at] = True
    start[-1] = False
    return np.flatnonzero(start)


class _Units:
    """The different units met so far: ids, links and groups of each."""

    def __init__(self, pair: Pair):
        self.pair, self.size_b = pair, len(pair.bytes_b)
        self._len_a, self._len_b = (np.array([len(x) for x in t]) for t in (pair.bytes_a, pair.bytes_b))
        # what a token is written as: before another of its side, at the end of a side, at the end of a group
        self._text = [f"{i}{end}" for n, last in ((len(pair.bytes_a), "|"), (len(pair.bytes_b), ";")) for i in range(n) for end in (",", last)]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ok, self.n = np.zeros(0, bool), np.zeros((3, 0), np.int64)
        self.links, self.first, self.groups = np.zeros(0, np.int64), np.zeros(1, np.int64), []

    def of(self, units: list[bytes]) -> np.ndarray:
        """Numbers of different units; those not met before are encoded."""
        if len(self.number) > KEEP:
            self._clear()
        new = [u for u in units if u not in self.number]
        if new:
            self._add(new)
        return np.array([self.number[u] for u in units], np.int64)

    def _add(self, units: list[bytes]) -> None:
        pair = self.pair
        a, b = pair.encode([u.decode() for u in units])
        ok = [b"".join(map(pair.bytes_a.__getitem__, x)) == u and b"".join(map(pair.bytes_b.__getitem__, y)) == u for x, y, u in zip(a, b, units)]
        n_a, n_b, size = (np.array([len(x) if k else 0 for x, k in zip(xs, ok)], np.int64) for xs in (a, b, units))
        ids_a, ids_b = (np.array([i for x, k in zip(xs, ok) if k for i in x], np.int64) for xs in (a, b))
        ends_a, ends_b, last = np.cumsum(self._len_a[ids_a]), np.cumsum(self._len_b[ids_b]), np.cumsum(size)
        every, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        # between two neighbouring ends lies just one overlapping pair
        links = ids_a[np.searchsorted(ends_a, every)] * self.size_b + ids_b[np.searchsorted(ends_b, every)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        end = np.concatenate([np.isin(ends_a, common, assume_unique=True), np.isin(ends_b, common, assume_unique=True)])
        code = (np.concatenate([ids_a * 2, (ids_b + len(pair.bytes_a)) * 2]) + end)[order]
        told, stop = list(map(self._text.__getitem__, code.tolist())), np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(told[i:j]) for i, j in zip([0, *stop], stop)]
        n_links, n_groups = (np.diff(np.searchsorted(x, last, "right"), prepend=0) for x in (every, common))
        self.number |= {u: len(self.number) + k for k, u in enumerate(units)}
        self.ok, self.n = np.append(self.ok, ok), np.concatenate([self.n, [n_a, n_b, n_groups]], axis=1)
        self.links, self.first = np.append(self.links, links), np.append(self.first, self.first[-1] + np.cumsum(n_links))


def _flat(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of rows ``which`` of a ragged array, and the number of entries of each."""
    n = first[which + 1] - first[which]
    return np.arange(n.sum()) + np.repeat(first[which] - np.cumsum(n) + n, n), n


class _Text:
    """One text's result, gathered from its pieces."""

    def __init__(self) -> None:
        self.ok, self.n, self.sha = True, np.zeros(4, np.int64), hashlib.sha256()
        self.keys, self.times, self.tail = np.zeros(0, np.int64), np.zeros(0, np.int64), ""

    def add(self, ok: bool, n: np.ndarray, groups: str, keys: np.ndarray, times: np.ndarray) -> None:
        self.ok &= ok
        self.n += n
        self.sha.update((self.tail + groups[:-1]).encode())
        self.tail = groups[-1:]  # a group's end is written if another follows
        if len(self.keys):
            self.keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            self.times = np.bincount(at, np.concatenate([self.times, times])).astype(np.int64)
        else:
            self.keys, self.times = keys, times

    def row(self) -> tuple:
        if not self.ok or not self.n[0]:
            return 0, 0, 0, 0, "", None, None
        return *self.n.tolist(), self.sha.hexdigest(), pack_sorted(self.keys.view(np.uint64)), planes(self.times)


def _aligned(units: _Units, texts: pa.Array, piece: int = PIECE) -> Iterator[tuple]:
    """A row of ALIGNED for each of a few texts, or for one long text, which is taken in pieces."""
    raw, at = buffers(texts)
    n = len(texts)
    out = [_Text() for _ in range(n)]
    spaced = np.insert(raw, at[:-1], 32)
    at = at + np.arange(n + 1)
    starts = unit_starts(spaced, at[:-1], units.pair.cuts)
    ends, doc = np.append(starts[1:], len(spaced)), np.searchsorted(at, starts, "right") - 1
    for d in np.flatnonzero(np.diff(at) == 1):  # empty texts
        out[d].ok = False
    bounds = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(spaced), piece)), len(starts)))
    span = len(units.pair.bytes_a) * units.size_b
    for lo, hi in zip(bounds, bounds[1:]):
        sub = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.append(starts[lo:hi], ends[hi - 1]).astype(np.int64)), pa.py_buffer(spaced)])
        coded = sub.dictionary_encode()
        which = units.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        of, first = np.unique(doc[lo:hi], return_index=True)
        at_links, n_links = _flat(units.first, which)
        keyed, times = np.unique(np.repeat(doc[lo:hi], n_links) * span + units.links[at_links], return_counts=True)
        cut = np.searchsorted(keyed, np.append(of, of[-1] + 1) * span)
        ok = np.logical_and.reduceat(units.ok[which], first)
        counts = np.add.reduceat(np.vstack([units.n[:, which], n_links]), first, axis=1)
        told = list(map(units.groups.__getitem__, which.tolist()))
        for k, (d, i, j) in enumerate(zip(of, first, [*first[1:], len(which)])):
            out[d].add(ok[k], counts[:, k], "".join(told[i:j]), keyed[cut[k] : cut[k + 1]] - d * span, times[cut[k] : cut[k + 1]])
    return (t.row() for t in out)


def align(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """A row a text, with its id: tokens, groups and links, and its different pairs (``keys``, ``times``, packed and sorted).

    A text that is null, empty or not given back byte for byte by both tokenizers has no tokens. Equal rows give equal rows; other columns are not read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(_pair(folder))
        for batch in rows:
            for start, texts in slices(batch.column(1), PIECE):
                cols = zip(*_aligned(units, texts))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *arrays], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, {ALIGNED}")


def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): how many texts of a partition hold a pair, by ``np.unique``; a partition with very many pairs gives a key more than once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> None:
            nonlocal keys, n, held, size
            new, times = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n, held, size = np.bincount(at, np.concatenate([n, times]), len(keys)).astype(np.int64), [], 0

        for batch in rows:
            for blob in batch.column(0).drop_null():
                held.append(unpack_sorted(blob.as_buffer()).view(np.int64))
                size += len(held[-1])
                if size >= PARTIAL:
                    merged()
                    if len(keys) >= PARTIAL:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                        keys, n = keys[:0], n[:0]
        merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return aligned.select("keys").mapInArrow(run, "key long, n long")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def sorted_shards(counts: DataFrame, size_b: int) -> DataFrame:
    """The summed counts of all keys as sorted shards in the shared folder; a row a shard: where it lies, its first key, its size, and the highest count of each of its first ids.

    Each task writes a shard under a name of its own attempt, so a task that runs again leaves no half shard in the result.
    """
    counts = written(counts, "pairs")
    folder = new_path(counts.sparkSession, "shards")
    n_shards = parts(counts.sparkSession, counts.count(), SHARD)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in rows:
            key, n = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[runs], np.add.reduceat(n, runs)
            if len(keys[-1]) and keys[-1][-1] == key[0]:
                sums[-1][-1] += n[0]
                key, n = key[1:], n[1:]
            if len(key):
                keys.append(key)
                sums.append(n)
        key, n = np.concatenate(keys), np.concatenate(sums)
        if not len(key):
            return
        fs, at = _store(folder)
        fs.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(key.tobytes())
            out.write(n.tobytes())
        firsts = np.flatnonzero(np.append(True, key[1:] // size_b != key[:-1] // size_b))
        best = np.maximum.reduceat(n, firsts)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array(key[:1]), pa.array([len(key)]), pa.array([key[firsts] // size_b]), pa.array([best])], ["path", "low", "size", "a", "best"])

    dealt = counts.repartitionByRange(n_shards, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "path string, low long, size long, a array<long>, best array<long>")


class PairCounts:
    """The counts of all pairs, searched in shards that are mapped into memory. The driver holds a row a shard and a number for each first id."""

    def __init__(self, shards: DataFrame, size_a: int, size_b: int):
        rows = sorted(shards.collect(), key=lambda r: r.low)
        self.size_b, self.paths, self.sizes = size_b, [r.path for r in rows], [r["size"] for r in rows]
        self.lows, self.best = np.array([r.low for r in rows], np.int64), np.zeros(size_a, np.int64)
        for r in rows:
            np.maximum.at(self.best, r.a, r.best)
        self._open: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _shard(self, k: int) -> np.ndarray:
        fs, path = _store(self.paths[k])
        if not isinstance(fs, pafs.LocalFileSystem):  # no file to map: one shard at a time is read
            with fs.open_input_stream(path) as src:
                return np.frombuffer(src.read(), np.int64).reshape(2, -1)
        if k not in self._open:
            self._open[k] = np.memmap(path, np.int64, "r", shape=(2, self.sizes[k]))
        return self._open[k]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, all of which are among those counted."""
        out, place = np.zeros(len(keys), np.int64), np.searchsorted(self.lows, keys, "right") - 1
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(self.lows) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[k] : cuts[k + 1]]
            shard = self._shard(k)
            out[mine] = shard[1][np.searchsorted(shard[0], keys[mine])]
        return out


def look_up(aligned: DataFrame, counts: PairCounts) -> DataFrame:
    """To each row of ``align``: links whose count is the highest of their first id (ties included), and the sum of counts over links."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, (blob, times) in enumerate(zip(batch.column("keys"), batch.column("times"))):
                if blob.is_valid:
                    keys, times = unpack_sorted(blob.as_buffer()).view(np.int64), unplanes(times.as_buffer(), np.int64)
                    n = counts.of(keys)
                    best[i], total[i] = times[n == counts.best[keys // counts.size_b]].sum(), (times * n).sum()
            kept = batch.drop_columns(["keys", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best), pa.array(total)], [*kept.schema.names, "n_best", "count_sum"])

    return aligned.mapInArrow(run, f"id {aligned.schema['id'].dataType.simpleString()}, {ALIGNED.split(', keys')[0]}, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """Each text's alignment held against the counts of the whole corpus. The two tokenizers' files lie in ``folder``, which all executors must have."""
    small_batches(docs.sparkSession)
    aligned = written(align(docs, text_col, id_col, folder), "aligned")
    size_a, size_b = sizes(folder)
    return look_up(aligned, PairCounts(sorted_shards(partial_counts(aligned), size_b), size_a, size_b))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Both tokenizers over the whole table ``documents``."""
    out = align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
