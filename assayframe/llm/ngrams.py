"""Deleted-interpolation language model over words.

A token's probability mixes the uniform, unigram and bigram estimates; the mixture weights depend on
how often the context was seen (power-of-two buckets) and are learned by expectation-maximisation on
the counts of a held-out fold of the training documents. Counts cover all training documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as words_
from ._common import fold, parts, text_bytes, written
from ._exchange import answers_in_order, by_bucket, pack, pack_sorted, planes, unpack, unpack_sorted, unplanes

_END = np.uint64(0x0123456789ABCDEF)
_TRAIN, _DEV, _HELD = 0, 1, 2
N_BUCKETS, ROUNDS, STILL = 64, 40, 1e-3  # context-frequency buckets; rounds of EM at most; the change of a weight at which it ends
START = (0.01, 0.49, 0.5)
FEW_CELLS = 1 << 20  # cells of about 32 bytes that one task takes
HOT_KEYS, HOT_SAMPLE, _CHUNK = 1 << 16, 16, 4096  # hot keys of a kind at most; batches in which they are looked for; hot keys a row


class _Batch:
    """The tokens of one packed batch and its distinct unigram and bigram keys."""

    def __init__(self, blob: bytes):
        self.docs = unpack(blob)
        raw, at = words_.buffers(self.docs.column("text"))
        raw = words_.LOWER[raw]
        starts, ends, first = words_.find_words(raw, at)
        n = len(first) - 1
        tokens = np.empty(len(starts) + n, np.uint64)
        self.ends = first[1:] + np.arange(n)  # where each document's end token stands
        inner = np.ones(len(tokens), bool)
        inner[self.ends] = False
        tokens[inner], tokens[~inner] = words_.hash_spans(raw, starts, ends), _END
        self.lens = np.diff(first) + 1
        self.doc = np.repeat(np.arange(n), self.lens)
        before = np.concatenate([[_END], tokens[:-1]]).astype(np.uint64)
        pairs = words_.mix(before * np.uint64(0x9E3779B97F4A7C15) ^ words_.mix(tokens + np.uint64(1)))
        self.fold = np.asarray(self.docs.column("fold").to_numpy(zero_copy_only=False))[self.doc]
        self.uni, self.u = np.unique(tokens, return_inverse=True)
        self.bi, self.b = np.unique(pairs, return_inverse=True)
        self.h = np.concatenate([[np.searchsorted(self.uni, _END)], self.u[:-1]]) if n else self.u

    def counts(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: occurrences in training documents, and in those of the learning fold."""
        return tuple(np.bincount(which, weights=w, minlength=n).astype(np.uint64) for w in (self.fold != _HELD, self.fold == _DEV))


def _rounds(cells: pa.Table, uniform: float) -> pa.RecordBatch:
    """All rounds of EM over cells held in one task: (bucket, w0, w1, w2, size)."""
    bucket, p1, p2, n = (cells.column(c).to_numpy() for c in ("bucket", "p1", "p2", "n"))
    size = np.bincount(bucket, n, N_BUCKETS)
    weights, some = np.tile(START, (N_BUCKETS, 1)), size > 0
    for _ in range(ROUNDS):
        shares = weights[bucket] * np.stack([np.full(len(n), uniform), p1, p2], 1)
        shares *= (n / shares.sum(1))[:, None]
        new = weights.copy()
        new[some] = np.stack([np.bincount(bucket, shares[:, k], N_BUCKETS)[some] for k in range(3)], 1) / size[some, None]
        moved, weights = np.abs(new - weights).max(), new
        if moved < STILL:
            break
    return pa.RecordBatch.from_arrays([pa.array(range(N_BUCKETS), pa.int64()), *[pa.array(weights[:, k].copy()) for k in range(3)], pa.array(size)], ["bucket", "w0", "w1", "w2", "size"])


def _mixture(cells: DataFrame, uniform: float, few: int = FEW_CELLS) -> np.ndarray:
    """EM: weights of (uniform, unigram, bigram) for each context-frequency bucket, from ``cells`` (bucket, p1, p2, n).

    Up to ``few`` cells all rounds run in one task. Of more, each round is one aggregation over all held-out counts, of which a row a bucket reaches the driver; both give the same. Rounds end when no weight
    changes by ``STILL`` or more, or after ``ROUNDS``: the likelihood rises in each, and what is left of its rise then is not looked for. Buckets without
    held-out tokens get the mean of the others' weights by their tokens.
    """
    weights, sizes = np.tile(START, (N_BUCKETS, 1)), np.zeros(N_BUCKETS)
    if cells.count() <= few:

        def whole(rows):
            held = list(rows)
            if held:
                yield _rounds(pa.Table.from_batches(held), uniform)

        for r in cells.coalesce(1).mapInArrow(whole, "bucket long, w0 double, w1 double, w2 double, size double").collect():
            weights[r["bucket"]], sizes[r["bucket"]] = [r["w0"], r["w1"], r["w2"]], r["size"]
    else:
        for _ in range(ROUNDS):
            w = [F.element_at(F.lit(weights[:, k].tolist()), (F.col("bucket") + 1).cast("int")) for k in range(3)]
            parts_ = [w[0] * F.lit(uniform), w[1] * F.col("p1"), w[2] * F.col("p2")]
            total = parts_[0] + parts_[1] + parts_[2]
            rows = cells.groupBy("bucket").agg(F.sum("n").alias("all"), *[F.sum(F.col("n") * x / total).alias(f"s{k}") for k, x in enumerate(parts_)]).collect()
            new = weights.copy()
            for r in rows:
                sizes[r["bucket"]], new[r["bucket"]] = r["all"], [r["s0"] / r["all"], r["s1"] / r["all"], r["s2"] / r["all"]]
            moved, weights = np.abs(new - weights).max(), new
            if moved < STILL:
                break
    weights = np.maximum(weights, 1e-6)
    if sizes.any():
        weights[sizes == 0] = np.average(weights, axis=0, weights=sizes)
    weights[0, 2] = 0.0  # a context never seen has no bigrams
    return weights / weights.sum(1, keepdims=True)


def _hot_keys(packed: DataFrame) -> dict[str, np.ndarray]:
    """Sorted unigram and bigram keys that more than half of a bounded sample of batches hold, at most ``HOT_KEYS`` of each.

    They only decide the way that counts take: those of hot keys are summed by each task, so that a key of the whole corpus reaches
    no bucket once a batch. All counts are exact whatever the sample.
    """
    n = packed.count()
    sample = packed.where(F.pmod(F.xxhash64("batch"), F.lit(1 << 20)) < int(min(1.0, HOT_SAMPLE / max(n, 1)) * (1 << 20)))

    def keys(rows):
        for batch in rows:
            for blob in batch.column("docs"):
                b = _Batch(blob.as_py())
                for bi, own in ((False, b.uni), (True, b.bi)):
                    for k in range(0, len(own), 1 << 16):
                        part = own[k : k + (1 << 16)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bi)), pa.array(part)], ["bi", "key"])

    least = max(min(n, HOT_SAMPLE) // 2, 2)
    many = sample.mapInArrow(keys, "bi boolean, key long").groupBy("bi", "key").count().where(F.col("count") > least)
    top = F.row_number().over(Window.partitionBy("bi").orderBy(F.desc("count"), "key"))
    found = many.withColumn("r", top).where(F.col("r") <= HOT_KEYS).collect()  # bounded
    return {kind: np.unique(np.array([r["key"] for r in found if r["bi"] == (kind == "b")], np.int64).view(np.uint64)) for kind in "ub"}


def _places(hot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are hot, and the places of these among the hot ones."""
    at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
    is_hot = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
    return is_hot, at[is_hot]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, N_BUCKETS - 1), 0)


def score_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folds: int = 7, held: int = 2, learn: int = 3) -> DataFrame:
    """Log10 probabilities of every row's whole text under a model of the rows whose crc32(id) mod ``folds`` isn't ``held``.

    Mixture weights are learned on the rows with remainder ``learn``. Tokens are words (A-Z lowered) and
    one end a text; a null or empty text is an end alone. Columns: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigram), score. Without training rows every token is unknown and
    both scores are uniform. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rest = fold(id_col, folds)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.when(rest == held, _HELD).when(rest == learn, _DEV).otherwise(_TRAIN).alias("fold"))
    docs = docs.withColumn("learn", F.col("fold") == _DEV)
    n_bytes = text_bytes(docs, "text")
    n_buckets = parts(spark, n_bytes, 10 << 20)
    packed = pack(docs, "ngrams", 4 << 20, apart="learn")
    hot = spark.sparkContext.broadcast(_hot_keys(packed))  # at most HOT_KEYS a kind

    def ask(rows):
        from pyspark import TaskContext

        sums = {kind: np.zeros((2, len(own)), np.uint64) for kind, own in hot.value.items()}
        for batch in rows:
            for number, apart, blob in zip(batch.column("batch").to_pylist(), batch.column("apart").to_pylist(), batch.column("docs")):
                b = _Batch(blob.as_py())
                for kind, keys, which in (("u", b.uni, b.u), ("b", b.bi, b.b)):
                    train, dev = b.counts(which, len(keys))
                    is_hot, place = _places(hot.value[kind], keys)
                    sums[kind][0][place] += train[is_hot]
                    sums[kind][1][place] += dev[is_hot]
                    keys, train, dev = keys[~is_hot], train[~is_hot], dev[~is_hot]
                    at = [(k, i, j) for k, (i, j) in enumerate(zip(*by_bucket(keys, n_buckets))) if j > i]
                    yield pa.RecordBatch.from_pydict({
                        "kind": pa.array([kind] * len(at), pa.string()), "bucket": pa.array([k for k, _, _ in at], pa.int32()), "batch": pa.array([number] * len(at), pa.int64()), "apart": pa.array([apart] * len(at), pa.bool_()),
                        "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in at], pa.binary()),
                        "train": pa.array([planes(train[i:j]) for _, i, j in at], pa.binary()), "dev": pa.array([planes(dev[i:j]) for _, i, j in at], pa.binary()),
                    })
        salt = TaskContext.get().partitionId() % 64
        for kind, both in sums.items():
            for k in range(0, both.shape[1], _CHUNK):
                part = [planes(np.ascontiguousarray(x[k : k + _CHUNK])) for x in both]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind], pa.string()), "bucket": pa.array([-1 - (k // _CHUNK * 64 + salt)], pa.int32()), "batch": pa.array([-1], pa.int64()), "apart": pa.array([False], pa.bool_()),
                    "keys": pa.array([b""], pa.binary()), "train": pa.array([part[0]], pa.binary()), "dev": pa.array([part[1]], pa.binary()),
                })

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:  # hot keys' sums of several tasks
            first = pdf.iloc[:1]
            train, dev = (planes(np.sum([unplanes(x, np.uint64) for x in pdf[c]], axis=0, dtype=np.uint64)) for c in ("train", "dev"))
            return pd.DataFrame({"kind": first["kind"], "bucket": first["bucket"], "batch": first["batch"], "apart": first["apart"], "train": [train], "dev": [dev], "tokens": 0, "types": 0, "learned": 0})
        keys = [unpack_sorted(x) for x in pdf["keys"]]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for c in ("train", "dev"):
            s = np.zeros(which.max() + 1, np.uint64)
            np.add.at(s, which, np.concatenate([unplanes(x, np.uint64) for x in pdf[c]]))
            sums.append(s)
        train, dev = ([planes(x) for x in np.split(s[which], cuts)] for s in sums)
        out = pd.DataFrame({"kind": pdf["kind"], "bucket": pdf["bucket"], "batch": pdf["batch"], "apart": pdf["apart"], "train": train, "dev": dev, "tokens": 0, "types": 0, "learned": 0})
        if pdf["kind"].iloc[0] == "u":
            out.loc[out.index[0], ["tokens", "types", "learned"]] = [int(sums[0].sum()), int((sums[0] > 0).sum()), int(sums[1].sum())]
        return out

    answers = packed.mapInArrow(ask, "kind string, bucket int, batch long, apart boolean, keys binary, train binary, dev binary").groupBy("kind", "bucket")
    answers = written(answers.applyInPandas(total, "kind string, bucket int, batch long, apart boolean, train binary, dev binary, tokens long, types long, learned long"), "ngram-counts")
    n_tokens, n_types, n_learn = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types"), F.sum("learned")).first())

    def hot_counts(rows):
        for batch in rows:
            for kind, bucket, *both in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "train", "dev"))):
                train, dev = (unplanes(x, np.int64) for x in both)
                places = (-1 - bucket) // 64 * _CHUNK + np.arange(len(train))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(train), pa.string()), pa.array(places), pa.array(train), pa.array(dev)], ["kind", "place", "train", "dev"])

    counted = {kind: np.zeros((2, len(own)), np.uint64) for kind, own in hot.value.items()}
    for r in answers.where("bucket < 0").mapInArrow(hot_counts, "kind string, place long, train long, dev long").groupBy("kind", "place").agg(F.sum("train"), F.sum("dev")).collect():
        counted[r[0]][:, r[1]] = r[2], r[3]
    answers = answers.where("bucket >= 0")
    n_tokens, n_types, n_learn = n_tokens + int(counted["u"][0].sum()), n_types + int((counted["u"][0] > 0).sum()), n_learn + int(counted["u"][1].sum())
    counted = spark.sparkContext.broadcast(counted)
    uniform = 1.0 / (n_types + 1)

    def looked_up(b: _Batch, right: pd.DataFrame, main: bool):
        """Counts of each token, its context, and the two together; main: without the learning fold."""
        out = []
        for kind, keys in (("u", b.uni), ("b", b.bi)):
            is_hot, place = _places(hot.value[kind], keys)
            part = right[right["kind"] == kind]
            both = np.zeros((2, len(keys)), np.uint64)
            both[:, is_hot] = counted.value[kind][:, place]
            both[:, ~is_hot] = [answers_in_order(part, c, np.uint64) for c in ("train", "dev")]
            out.append((both[0] - both[1] if main else both[0]).astype(float))
        return out[0][b.u], out[0][b.h], out[1][b.b]

    def learn_cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in left["docs"]:
            b = _Batch(blob)
            c, h, ch = looked_up(b, right, True)
            cell, n = np.unique(np.stack([h, c, ch]).astype(np.int64), axis=1, return_counts=True)
            out.append(pd.DataFrame({"bucket": _bucket(cell[0]), "h": cell[0], "c": cell[1], "ch": cell[2], "n": n}))
        return pd.concat(out)

    both = packed.where("apart").groupBy("batch").cogroup(answers.where("apart").groupBy("batch"))
    cells = both.applyInPandas(learn_cells, "bucket long, h long, c long, ch long, n long").groupBy("bucket", "h", "c", "ch").agg(F.sum("n").alias("n"))
    p1, p2 = F.col("c") / F.lit(float(max(n_tokens - n_learn, 1))), F.col("ch") / F.greatest("h", F.lit(1))
    weights = _mixture(written(cells.select("bucket", p1.alias("p1"), p2.alias("p2"), "n"), "ngram-cells"), uniform)

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in left["docs"]:
            b = _Batch(blob)
            c, h, ch = looked_up(b, right, False)
            w = weights[_bucket(h)]
            p = w[:, 0] * uniform + w[:, 1] * c / max(n_tokens, 1) + w[:, 2] * ch / np.maximum(h, 1)
            per_doc = lambda x: np.bincount(b.doc, weights=x, minlength=len(b.lens))
            out.append(pd.DataFrame({
                "doc_id": pd.array(b.docs.column("doc_id").to_pylist(), "Int64"), "held_out": np.asarray(b.docs.column("fold").to_numpy(zero_copy_only=False)) == _HELD,
                "n_tokens": b.lens, "n_known": per_doc(c > 0).astype(np.int64), "train_tokens": n_tokens,
                "base_score": per_doc(np.log10((c + 1) / (n_tokens + n_types + 1))), "score": per_doc(np.log10(p)),
            }))
        return pd.concat(out)

    both = packed.groupBy("batch").cogroup(answers.groupBy("batch"))
    return both.applyInPandas(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_ngrams(spark, sf_dir: str) -> DataFrame:
    """Query: every document's log10 probability under the deleted-interpolation model."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
