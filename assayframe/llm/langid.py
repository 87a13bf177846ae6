"""Language identification by interpolated Kneser-Ney character models.

One model a language, over the letters of single words (start and end marks included), is trained on a
bounded sample of labelled documents. Every n-gram's discounted probability and every context's
back-off weight are stored in sorted arrays of 64-bit hashes, each with the languages that have it. A text gets the language with the
lowest cross-entropy per symbol; a text that is worse than its language's calibrated limit is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, written
from ._words import mix

ORDER = 4
START, END = "\x02", "\x03"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # a letter, then letters and their marks
_SLICE = 1 << 19  # characters whose words are held at once
RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def words_of(text: str | None) -> list[str]:
    """The lowered words of a text."""
    return _WORD.findall(text.lower()) if text else []


def _keys(grams: np.ndarray, n: int, last: int = 1) -> np.ndarray:
    """Hashes of the last ``n`` columns (code points) without the last ``1 - last``: ``last=0`` gives contexts."""
    cols = range(grams.shape[1] - n, grams.shape[1] - (1 - last))
    h = np.full(len(grams), n * 2 + last, np.uint64)
    for c in cols:
        h = mix((h ^ grams[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


class Model:
    """Sorted hash arrays: for each order the n-grams' and the contexts' keys, and of each key the languages that have it, with their values."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        """counts: lang, gram (``order`` characters), n."""
        self.order, self.langs, per = order, sorted(counts["lang"].unique()), []
        symbols = set()
        for lang in self.langs:
            part = counts[counts["lang"] == lang]
            grams = np.array([[ord(c) for c in g] for g in part["gram"]], np.uint32).reshape(-1, order)
            symbols |= set(grams[:, -1].tolist())
            per.append(self._estimate(grams, part["n"].to_numpy(float)))
        self.letters = sorted(symbols - {ord(END)})
        self.uniform = 1.0 / (len(symbols) + 1)
        self.tables = []
        for k in range(order):
            self.tables.append([self._table([p[k][what] for p in per]) for what in (0, 1)])
        self.limits = np.zeros((len(self.langs), 2))

    @staticmethod
    def _table(by_lang: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(keys, where each key's entries start, their languages, their values)."""
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in by_lang)])
        langs = np.repeat(np.arange(len(by_lang), dtype=np.int16), [len(k) for k, _ in by_lang])
        values = np.concatenate([np.zeros(0), *(v for _, v in by_lang)])
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        return keys, np.append(first, len(order)), langs[order], values[order]

    @staticmethod
    def _estimate(grams: np.ndarray, n: np.ndarray) -> list:
        out, rows = [], np.arange(len(grams))
        order = grams.shape[1]
        for k in range(order, 0, -1):
            keys, at, which = np.unique(_keys(grams[rows], k), return_index=True, return_inverse=True)
            # the highest order counts occurrences, lower ones the different n-grams they continue
            c = np.bincount(which, weights=n if k == order else None, minlength=len(keys)).astype(float)
            rows = rows[at]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, ctx = np.unique(_keys(grams[rows], k, 0), return_inverse=True)
            total, kinds = np.bincount(ctx, weights=c), np.bincount(ctx)
            out.append(((keys, np.maximum(c - discount, 0) / total[ctx]), (contexts, discount * kinds / total)))
        return out[::-1]

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of each n-gram's last symbol, a column for each language."""
        keys, at, which = np.unique(_keys(grams, self.order), return_index=True, return_inverse=True)
        some = grams[at]
        p = np.full((len(some), len(self.langs)), self.uniform)
        for k, (direct, back) in enumerate(self.tables, 1):
            p = self._at(direct, _keys(some, k), 0.0) + self._at(back, _keys(some, k, 0), 1.0) * p
        return np.log(p)[which]

    def _at(self, table: tuple[np.ndarray, ...], wanted: np.ndarray, absent: float) -> np.ndarray:
        """The values of the keys ``wanted``, a column for each language."""
        keys, first, langs, values = table
        out = np.full((len(wanted), len(self.langs)), absent)
        i = np.searchsorted(keys, wanted)
        rows = np.flatnonzero(keys[np.minimum(i, max(len(keys) - 1, 0))] == wanted) if len(keys) else np.zeros(0, np.int64)
        start = first[i[rows]]
        n = first[i[rows] + 1] - start
        entries = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(rows, n), langs[entries]] = values[entries]
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: log probability by language, symbols, words."""
        found = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in found], np.int64)
        coded = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        logs = np.zeros((len(texts), len(self.langs)))
        symbols = np.zeros(len(texts), np.int64)
        if words:
            grams, size = word_grams(words, self.order)
            by_word = np.add.reduceat(self.log_probs(grams), np.cumsum(size) - size)
            doc = np.repeat(np.arange(len(texts)), sizes)
            symbols = np.bincount(doc, weights=size[code], minlength=len(texts)).astype(np.int64)
            for j in range(len(self.langs)):
                logs[:, j] = np.bincount(doc, weights=by_word[code, j], minlength=len(texts))
        return logs, symbols, sizes

    def calibrate(self, sample: pd.DataFrame, z: float, reach: float) -> None:
        """Limits from labelled texts not trained on (lang, cross_entropy, words) and from noise, words of random letters.

        A language's limit lies at the part ``reach`` of the way from its texts' mean to the noise; short texts
        may lie beyond it by ``z`` times the spread of a word's share.
        """
        rng = np.random.default_rng(0)
        noise = " ".join("".join(map(chr, rng.choice(self.letters, n))) for n in rng.integers(2, 10, 2000))
        logs, symbols, _ = self.score([noise])
        worst = -logs[0] / symbols[0]
        for j, lang in enumerate(self.langs):
            part = sample[(sample["lang"] == lang) & (sample["words"] > 0)]
            ce, n = part["cross_entropy"].to_numpy(float), part["words"].to_numpy(float)
            mean = np.average(ce, weights=np.minimum(n, 100)) if len(ce) else 0.0
            spread = np.sqrt(np.mean((ce - mean) ** 2 * np.minimum(n, 100))) if len(ce) else 0.0
            self.limits[j] = mean + reach * max(worst[j] - mean, 0) if len(ce) else np.inf, z * max(spread, 0.1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        logs, symbols, words = self.score(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce = -logs / np.maximum(symbols, 1)[:, None]
        best = ce.argmin(1)
        lowest = ce[np.arange(len(ce)), best]
        share = np.exp(-(ce - lowest[:, None]) * np.minimum(symbols, 100)[:, None])
        limit, spread = self.limits[best].T
        none = symbols == 0
        rejected = none | (lowest > limit + spread / np.sqrt(np.clip(words, 1, 100)))
        return ["und" if x else self.langs[k] for x, k in zip(none, best)], np.where(none, 0.0, 1 / share.sum(1)), np.where(none, 0.0, lowest), rejected


def word_grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the n-gram that ends at every letter and at the end of every word; how many each word has."""
    pad = START * (order - 1)
    codes = np.frombuffer("".join(f"{pad}{w}{END}" for w in words).encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes != ord(START))
    return codes[ends[:, None] + np.arange(1 - order, 1)], np.array([len(w) + 1 for w in words], np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list]]:
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + _SLICE)))
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000, z: float = 3.0, reach: float = 0.6, order: int = ORDER) -> Model:
    """Fit models on labelled rows of ``docs``: about ``docs_per_lang`` different whole texts a language, chosen by a hash of
    the text (all, where there are fewer); a fifth of them only calibrates the rejection limits.

    Rows with null text or language are not learned from; repeated texts count once, whatever their ids. Without any labelled
    row the model knows no language. The number of languages is taken to be small, as is that of ISO codes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    mark = F.xxhash64("text")
    sizes = docs.groupBy("lang").agg(F.approx_count_distinct(mark).alias("n")).collect()
    if not sizes:
        return Model(pd.DataFrame({"lang": [], "gram": [], "n": []}), order)
    share = spark.createDataFrame([(r["lang"], min(1.0, docs_per_lang / max(r["n"], 1))) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("mark", F.lit("draw")), F.lit(1_000_000)) / 1_000_000
    drawn = docs.withColumn("mark", mark).join(F.broadcast(share), "lang").where(draw < F.col("share"))  # a row a language
    sample = drawn.groupBy("lang", "mark").agg(F.first("text").alias("text"))
    sample = written(sample.select("lang", "text", (F.pmod(F.xxhash64("mark", F.lit("test")), F.lit(5)) == 0).alias("test")), "langid-sample")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column("text").filter(pa.array(langs == lang))
                for _, part in _slices(texts):
                    words = pd.Series([w for t in part for w in words_of(t)], dtype=object).value_counts()
                    if len(words):
                        grams, size = word_grams(list(words.index), order)
                        keys, at, which = np.unique(_keys(grams, order), return_index=True, return_inverse=True)
                        n = np.bincount(which, weights=np.repeat(words.to_numpy(), size)).astype(np.int64)
                        text = ["".join(map(chr, g)) for g in grams[at].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(text), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.where("not test").select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    model = Model(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas(), order)  # bounded by the sample

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start, part in _slices(batch.column("text")):
                logs, symbols, words = model.score(part)
                langs = batch.column("lang").slice(start, len(part)).to_pylist()
                own = [logs[i, model.langs.index(x)] if x in model.langs else np.nan for i, x in enumerate(langs)]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(-np.array(own) / np.maximum(symbols, 1)), pa.array(words)], ["lang", "cross_entropy", "words"])

    model.calibrate(sample.where("test").select("text", "lang").mapInArrow(measure, "lang string, cross_entropy double, words long").toPandas().dropna(), z, reach)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every row, from its whole text alone.

    A null text or one without letters is ``und`` with score 0, and rejected. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start, part in _slices(batch.column(1)):
                lang, score, ce, rejected = shared.value.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(lang), pa.array(score), pa.array(ce), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(each, RESULT)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start, part in _slices(batch.column(k)):
                yield batch.slice(start, len(part)).filter(pa.array(~shared.value.predict(part)[3]))

    return docs.mapInArrow(each, docs.schema)


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document, learned from those whose crc32(doc_id) mod 3 isn't 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs.where(fold("doc_id", 3) != 1)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
