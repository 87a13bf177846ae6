import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.llm._words import hash_spans
from assayframe.llm.digests import CLASSES, FEATURES, FILTER_BITS, HASHES, NEIGHBOURS, VOTES, WINDOW, as_string, class_counts, compare_edited, digests, entropy_classes, fingerprint, from_string, likeness, op5_digests, ranks, with_successor

RANK = ranks(np.abs(np.arange(CLASSES) - 40) * -7)


def kind_of(window):
    terms = sum(round(n * math.log2(n) * 4096) for n in Counter(window).values())
    return terms // (round(WINDOW * math.log2(WINDOW) * 4096) // (CLASSES - 1) + 1)


def plain_digest(text, rank):
    """The digest of one text, window by window."""
    data = text.encode()
    kinds = [kind_of(data[k : k + WINDOW]) for k in range(len(data) - WINDOW + 1)]
    votes = Counter()
    for start in range(1 - NEIGHBOURS, len(kinds)) if kinds else ():
        votes[min(range(max(start, 0), min(start + NEIGHBOURS, len(kinds))), key=lambda k: (rank[kinds[k]], k))] += 1
    features = [data[k : k + WINDOW] for k in sorted(votes) if votes[k] >= VOTES] or ([data] if data else [])
    features = list(dict.fromkeys(features))
    out = []
    for k in range(0, len(features), FEATURES):
        bits = np.zeros(FILTER_BITS, bool)
        for f in features[k : k + FEATURES]:
            h = int(hash_spans(np.frombuffer(f, np.uint8), np.array([0]), np.array([len(f)]))[0])
            for i in range(HASHES):
                bits[h >> (11 * i) & (FILTER_BITS - 1)] = True
        out.append(np.packbits(bits))
    return np.array(out, np.uint8).reshape(len(out), FILTER_BITS // 8)


def test_digest_equals_brute_force(spark, sf):
    rng = random.Random(1)
    texts = ["", "a", "x" * 31, "x" * 32, "x" * 700, "short text of some words, thirty-two", "é" * 40] + ["".join(rng.choice("abcde fgh") for _ in range(n)) for n in (33, 95, 96, 500)]
    texts += [" ".join(f"w{i * i % 97} {rng.random()}" for i in range(700))] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect() if len(r.text) < 8000]
    for t, d in zip(texts, digests(texts, RANK)):
        assert np.array_equal(d, plain_digest(t, RANK)), t[:40]


def test_class_counts_cover_all_windows(spark, make_docs, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    want = Counter(kind_of(t.encode()[k : k + WINDOW]) for t in texts for k in range(len(t.encode()) - WINDOW + 1))
    got = class_counts(make_docs([(k, t) for k, t in enumerate([*texts, None, "", "abc"])]))
    assert {k: n for k, n in enumerate(got.tolist()) if n} == want
    raw = np.frombuffer("".join(texts).encode() * 3, np.uint8)
    assert [kind_of(raw[k : k + WINDOW].tobytes()) for k in range(0, 300_000, 4999)] == entropy_classes(raw)[0:300_000:4999].tolist()
    assert class_counts(make_docs([])).sum() == 0


def test_no_step_at_any_size():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    mean = {}
    for n in (200, 255, 256, 600, 1023, 1024, 2000, 4000, 4095, 4096, 4200, 8000, 20000):
        own, half = [], []
        for _ in range(12):
            t = " ".join(rng.choice(words) for _ in range(n // 2))[:n]
            a, grown, b, other = digests([t, t + " and more", t[: n // 2], " ".join(rng.choice(words) for _ in range(n // 2))[:n]], RANK)
            own.append(likeness(a, grown))
            half.append(likeness(a, b) - likeness(a, other))
        mean[n] = np.mean(own), np.mean(half)
    assert all(own > 0.7 for own, _ in mean.values()) and all(own > 0.9 for n, (own, _) in mean.items() if n > 1000), mean
    for a, b in ((255, 256), (1023, 1024), (4095, 4096)):
        assert abs(mean[a][0] - mean[b][0]) < 0.1 and abs(mean[a][1] - mean[b][1]) < 0.15, mean


def edited(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op5_digests(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == edited(rows)
    texts, by = dict(rows), {}
    for r in got:
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    order = sorted(got, key=lambda r: r.doc_id)
    for a, b in zip(order[:40], order[1:]):
        assert a.near_next == pytest.approx(likeness(from_string(a.fingerprint), from_string(b.fingerprint)))


def test_digest_does_not_depend_on_its_batch():
    texts = ["", "a", "short text", "word " * 400, "x" * 5000, " ".join(f"w{i * i}" for i in range(3000)), "é" * 31]
    alone = [as_string(digests([t], RANK)[0]) for t in texts]
    assert alone == [as_string(d) for d in digests(texts, RANK)] == [as_string(d) for d in digests(texts[::-1], RANK)][::-1]
    assert alone[0] == "" and all(alone[1:])
    assert all(likeness(d, d) == 1 for d in digests(texts, RANK))


def test_odd_rows(odd_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = compare_edited(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == edited(rows)
    assert fingerprint(odd_docs).count() == len(rows)
    one = compare_edited(make_docs([(1, "abcdef")])).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(1, 6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    assert compare_edited(odd_docs.limit(0)).collect() == []


def test_every_run_of_ids_is_a_task_of_its_own(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    placed = with_successor(docs, 6).select("run", F.spark_partition_id().alias("task"), "doc_id").collect()
    assert len({r.run for r in placed}) == 6 and all(r.run == r.task for r in placed)
    assert {r.doc_id for r in placed} == set(range(600)) and len(placed) == 606
