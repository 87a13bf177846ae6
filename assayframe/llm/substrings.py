"""Substring dedup with difference-cover anchors.

Two equal windows of ``window`` words, wherever they start, share an aligned anchor: a run of
``window - period + 1`` words that starts at a cover position (word index modulo ``period`` in the
cover) in both documents. So only runs at cover positions are hashed and compared over the corpus.
Anchors that occur once rule out all windows around them; each repeated anchor is extended to the
windows that contain it, and those are compared by two 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as words_
from ._common import parts, small_batches, text_bytes, written
from ._exchange import by_bucket, pack, pack_sorted, planes, unpack, unpack_sorted, unplanes

#: A perfect difference cover of 13 (every residue is a difference of two members).
PERIOD, COVER = 13, (0, 1, 3, 9)
_NO_ID = np.iinfo(np.int64).min
HOT_WINDOWS, HOT_SAMPLE, _SALTS = 1 << 14, 16, 4096  # hot windows at most; batches in which they are looked for; parts in which their firsts are joined


def salt(batch: int) -> int:
    """The part in which a batch's hot windows are joined; all bits of its number count, the partition's and the running ones."""
    return int(words_.mix(np.array([batch], np.uint64))[0] % np.uint64(_SALTS))


class _Batch:
    """The words of one packed batch."""

    def __init__(self, blob: bytes, window: int, period: int, cover: tuple[int, ...], mask: int):
        self.docs = unpack(blob)
        raw, at = words_.buffers(self.docs.column("text"))
        starts, ends, self.first = words_.find_words(raw, at)
        self.h = words_.hash_spans(raw, starts, ends)
        self.doc = words_.doc_of(self.first)
        self.window, self.run = window, window - period + 1
        at_cover = np.zeros(period, bool)
        at_cover[list(cover)] = True
        p = words_.whole_runs(self.first, self.run)
        self.anchors = p[at_cover[(p - self.first[self.doc[p]]) % period]]
        runs = words_.hash_runs(self.h, self.run)[self.anchors] & np.uint64(mask)
        self.keys, self.which, self.counts = np.unique(runs, return_inverse=True, return_counts=True)

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        p = self.anchors[repeated[self.which]]
        near = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(near, np.maximum(p - (self.window - self.run), self.first[self.doc[p]]), 1)
        np.add.at(near, p + 1, -1)
        whole = words_.whole_runs(self.first, self.window)
        return whole[np.cumsum(near[:-1])[whole] > 0]

    def firsts(self, wins: np.ndarray):
        """The windows in order of (hashes, doc_id, start), the first of each equal set, and of each window the set."""
        ids = self.docs.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)[self.doc[wins]]
        pos = wins - self.first[self.doc[wins]]
        a, b = (words_.hash_runs(self.h, self.window, seed)[wins] for seed in (1, 2))
        order = np.lexsort((pos, ids, b, a))
        a, b, ids, pos, wins = a[order], b[order], ids[order], pos[order], wins[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return wins, a, b, ids, pos, np.flatnonzero(new), np.cumsum(new) - 1


def _matches(hot: np.ndarray, key: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are hot, and the places of these among the hot ones (rows of both hashes, sorted)."""
    at = np.minimum(np.searchsorted(hot[0], key), max(hot.shape[1] - 1, 0))
    is_hot = (hot[0][at] == key) & (hot[1][at] == key2) if hot.shape[1] else np.zeros(len(key), bool)
    return is_hot, at[is_hot]


def _bits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _in_order(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(_bits(x, n) for x, n in pdf.sort_values("bucket")[["flags", "n"]].itertuples(index=False))])


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 20, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row: each word covered by a window of ``window``
    words that also starts earlier (smaller doc_id, or same doc_id and earlier start) is removed.

    Words are runs outside ``\\x20\\x09-\\x0D``; kept words are joined by one space. Null and empty texts
    have no words; texts shorter than a window lose none. Rows that share a doc_id and a start don't remove
    each other; a null doc_id comes before all others. An empty table gives no rows.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or not 1 < period <= window:
        raise ValueError("cover must be a difference cover of period, and period at most window")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = text_bytes(docs, "text")
    n_buckets = parts(spark, n_bytes)
    mask = ((1 << 64) - 1) ^ ((1 << max(0, 52 - n_bytes.bit_length())) - 1)  # false repeats only cost work
    packed = pack(docs, "substrings")

    def read(blob: bytes) -> _Batch:
        return _Batch(blob, window, period, cover, mask)

    def ask_anchors(rows):
        for batch in rows:
            for number, blob in zip(batch.column("batch").to_pylist(), batch.column("docs")):
                b = read(blob.as_py())
                at = [(k, i, j) for k, (i, j) in enumerate(zip(*by_bucket(b.keys, n_buckets))) if j > i]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([k for k, _, _ in at], pa.int32()), "batch": pa.array([number] * len(at), pa.int64()),
                    "keys": pa.array([pack_sorted(b.keys[i:j]) for _, i, j in at], pa.binary()),
                    "many": pa.array([np.packbits(b.counts[i:j] > 1).tobytes() for _, i, j in at], pa.binary()),
                })

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in pdf["keys"]]
        _, which, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        again = np.split(counts[which] > 1, np.cumsum([len(k) for k in keys])[:-1])
        flags = [np.packbits(f | _bits(m, len(k))).tobytes() for f, m, k in zip(again, pdf["many"], keys)]
        return pd.DataFrame({"kind": "anchor", "batch": pdf["batch"], "bucket": pdf["bucket"], "n": [len(k) for k in keys], "flags": flags})

    answer = "kind string, batch long, bucket int, n int, flags binary"
    asked = packed.mapInArrow(ask_anchors, "bucket int, batch long, keys binary, many binary")
    anchors = written(asked.groupBy("bucket").applyInPandas(repeated, answer), "anchors")

    def some_windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in left["docs"]:
            b = read(blob)
            _, key, key2, _, _, new, _ = b.firsts(b.windows(_in_order(right)))
            out.append(pd.DataFrame({"a": key[new].view(np.int64), "b": key2[new].view(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    # windows that more than half of a bounded sample of batches hold: their firsts are joined in salted parts, so that a passage of the
    # whole corpus reaches no bucket once a batch. The sample decides that way alone; results are exact whatever it holds
    n_batches = packed.count()
    drawn = F.pmod(F.xxhash64("batch"), F.lit(1 << 20)) < int(min(1.0, HOT_SAMPLE / max(n_batches, 1)) * (1 << 20))
    sampled = packed.where(drawn).groupBy("batch").cogroup(anchors.where(drawn).groupBy("batch")).applyInPandas(some_windows, "a long, b long")
    many = sampled.groupBy("a", "b").count().where(F.col("count") > max(min(n_batches, HOT_SAMPLE) // 2, 2))
    many = many.orderBy(F.desc("count"), "a", "b").limit(HOT_WINDOWS).collect()  # bounded
    hot = np.array([(r["a"], r["b"]) for r in many], np.int64).reshape(-1, 2).view(np.uint64)
    hot = hot[np.lexsort((hot[:, 1], hot[:, 0]))].T.copy()
    hot = hot[:, np.diff(hot[0], prepend=hot[0][:1] + np.uint64(1)) != 0]  # of windows of one first hash one
    hot_windows = spark.sparkContext.broadcast(hot)

    def ask_windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, blob in zip(left["batch"], left["docs"]):
            b = read(blob)
            _, key, key2, ids, pos, new, _ = b.firsts(b.windows(_in_order(right)))
            key, key2, ids, pos = key[new], key2[new], ids[new], pos[new]
            is_hot, place = _matches(hot_windows.value, key, key2)
            if len(place):
                out.append((-1 - salt(number), -1, planes(place.astype(np.int64)), b"", planes(ids[is_hot]), planes(pos[is_hot].astype(np.int64))))
            key, key2, ids, pos = key[~is_hot], key2[~is_hot], ids[~is_hot], pos[~is_hot]
            for k, (i, j) in enumerate(zip(*by_bucket(key, n_buckets))):
                if j > i:
                    out.append((k, number, pack_sorted(key[i:j]), key2[i:j].tobytes(), planes(ids[i:j]), planes(pos[i:j].astype(np.int64))))
        return pd.DataFrame(out, columns=["bucket", "batch", "keys", "keys2", "ids", "pos"])

    def earliest(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:  # of hot windows the first in some batches
            place, ids, pos = (np.concatenate([unplanes(x, np.int64) for x in pdf[c]]) for c in ("keys", "ids", "pos"))
            order = np.lexsort((pos, ids, place))
            order = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
            return pd.DataFrame({"kind": "hot", "batch": -1, "bucket": pdf["bucket"].iloc[:1], "n": len(order), "flags": [np.stack([place[order], ids[order], pos[order]]).tobytes()]})
        keys = [unpack_sorted(x) for x in pdf["keys"]]
        a = np.concatenate(keys)
        b = np.frombuffer(b"".join(pdf["keys2"]), np.uint64)
        ids, pos = (np.concatenate([unplanes(x, np.int64) for x in pdf[c]]) for c in ("ids", "pos"))
        order = np.lexsort((pos, ids, b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        is_first = np.zeros(len(a), bool)
        is_first[order] = (ids[order] == ids[lead]) & (pos[order] == pos[lead])
        flags = [np.packbits(f).tobytes() for f in np.split(is_first, np.cumsum([len(k) for k in keys])[:-1])]
        return pd.DataFrame({"kind": "window", "batch": pdf["batch"], "bucket": pdf["bucket"], "n": [len(k) for k in keys], "flags": flags})

    asked = packed.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInPandas(ask_windows, "bucket int, batch long, keys binary, keys2 binary, ids binary, pos binary")
    windows = written(asked.groupBy("bucket").applyInPandas(earliest, answer), "windows")

    def hot_firsts(rows):
        for batch in rows:
            for flags in batch.column("flags").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(flags, np.int64).reshape(3, -1)], ["place", "id", "pos"])

    firsts = windows.where("kind = 'hot'").mapInArrow(hot_firsts, "place long, id long, pos long").groupBy("place").agg(F.min(F.struct("id", "pos")).alias("f")).collect()  # at most HOT_WINDOWS
    lead_of = np.zeros((2, hot.shape[1]), np.int64)
    for r in firsts:
        lead_of[:, r["place"]] = r["f"]["id"], r["f"]["pos"]
    hot_leads = spark.sparkContext.broadcast(lead_of)
    windows = windows.where("kind = 'window'")

    def remove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in left["docs"]:
            b = read(blob)
            wins, key, key2, ids, pos, new, group = b.firsts(b.windows(_in_order(right[right["kind"] == "anchor"])))
            is_hot, place = _matches(hot_windows.value, key[new], key2[new])
            own = np.zeros(len(new), bool)
            own[~is_hot] = _in_order(right[right["kind"] == "window"])
            own[is_hot] = (ids[new][is_hot] == hot_leads.value[0][place]) & (pos[new][is_hot] == hot_leads.value[1][place])
            lead = new[group] if len(group) else group
            gone = wins[~(own[group] & (ids == ids[lead]) & (pos == pos[lead]))] if len(group) else wins
            cover_ = np.zeros(len(b.h) + 1, np.int32)
            np.add.at(cover_, gone, 1)
            np.add.at(cover_, gone + window, -1)
            keep = np.cumsum(cover_[:-1]) == 0
            for k, (i, t) in enumerate(zip(b.docs.column("doc_id").to_pylist(), b.docs.column("text").to_pylist())):
                lo, hi = b.first[k], b.first[k + 1]
                kept = keep[lo:hi]
                ws = (t or "").encode().split()
                out.append((i, hi - lo, hi - lo - int(kept.sum()), b" ".join(ws if kept.all() else compress(ws, kept.tolist())).decode()))
        pdf = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"])
        return pdf.astype({"doc_id": "Int64"})

    both = anchors.union(windows)
    return packed.groupBy("batch").cogroup(both.groupBy("batch")).applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Query: repeated 20-word windows removed from all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
