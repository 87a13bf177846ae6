import math
import re
import zlib
from collections import Counter

from assayframe.llm import ngrams
from assayframe.llm.ngrams import N_BUCKETS, ROUNDS, START, STILL, op10_ngrams, score_texts


def brute(rows):
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(t for i, ts in toks.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for i, ts in toks.items()}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = op10_ngrams(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, k, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, k, total) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    # the interpolated model predicts unseen documents better than add-one unigrams
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def plain_model(rows, folds=7, held=2, learn=3):
    """(p(word, context), score of each row): the model by dictionaries; None is the end."""
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % folds for i, _ in rows}

    def counts(keep):
        uni, bi = Counter(), Counter()
        for i, ts in toks.items():
            if keep(fold[i]):
                uni.update(ts)
                bi.update(zip([None, *ts], ts))
        return uni, bi

    bucket = lambda n: min(n.bit_length(), N_BUCKETS - 1)
    uni, bi = counts(lambda f: f != held)
    main_uni, main_bi = counts(lambda f: f not in (held, learn))
    n_main, n, v = sum(main_uni.values()), sum(uni.values()), len(uni)
    heldout = Counter()
    for i, ts in toks.items():
        if fold[i] == learn and learn != held:
            for h, w in zip([None, *ts], ts):
                heldout[h, w] += 1
    weights = {b: list(START) for b in range(N_BUCKETS)}
    cells = [(bucket(main_uni[h]), 1 / (v + 1), main_uni[w] / max(n_main, 1), main_bi[h, w] / max(main_uni[h], 1), k) for (h, w), k in heldout.items()]
    alls = Counter()
    for _ in range(ROUNDS):
        sums, alls = {}, Counter()
        for b, *p, k in cells:
            x = [wt * q for wt, q in zip(weights[b], p)]
            for j in range(3):
                sums[b, j] = sums.get((b, j), 0.0) + k * x[j] / sum(x)
            alls[b] += k
        new = {b: [sums[b, j] / alls[b] for j in range(3)] if alls[b] else weights[b] for b in weights}
        moved = max(abs(x - y) for b in weights for x, y in zip(new[b], weights[b]))
        weights = new
        if moved < STILL:
            break
    weights = {b: [max(x, 1e-6) for x in ws] for b, ws in weights.items()}
    if alls:
        mean = [sum(alls[b] * weights[b][j] for b in alls) / sum(alls.values()) for j in range(3)]
        weights = {b: ws if alls[b] else list(mean) for b, ws in weights.items()}
    weights[0][2] = 0.0
    weights = {b: [x / sum(ws) for x in ws] for b, ws in weights.items()}

    def p(w, h):
        u, v1, v2 = weights[bucket(uni[h])]
        return u / (v + 1) + v1 * uni[w] / max(n, 1) + v2 * bi[h, w] / max(uni[h], 1)

    return p, {i: sum(math.log10(p(w, h)) for h, w in zip([None, *ts], ts)) for i, ts in toks.items()}, uni


def test_scores_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    p, want, uni = plain_model(rows)
    for r in op10_ngrams(spark, sf).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 * -want[r.doc_id]
    for h in (None, *list(uni)[:40], "never seen before"):
        assert abs(sum(p(w, h) for w in uni) + p("an unknown word", h) - 1) < 1e-9


def test_hot_keys_change_no_score(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    _, want, _ = plain_model(rows)
    real = ngrams.pack
    for size, hot in ((4 << 20, 0), (20_000, 1 << 16), (20_000, 50)):
        monkeypatch.setattr(ngrams, "pack", lambda d, tag, _, apart: real(d, tag, size, apart=apart))
        monkeypatch.setattr(ngrams, "HOT_KEYS", hot)
        got = score_texts(docs).collect()
        assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 * -want[r.doc_id] for r in got)


def test_small_corpora_equal_brute_force(make_docs):
    """Over all words after a context, the model's probabilities and the unknown word's sum to one."""
    for rows in ([(i, t) for i, t in enumerate(["a b a c", "a B", "b c a", "c a b a", None, ""] * 9)], [(i, "a b") for i in range(3)], [(i, f"w{i}") for i in range(50)]):
        p, want, uni = plain_model(rows)
        got = {r.doc_id: r.score for r in score_texts(make_docs(rows)).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 * max(1, -want[i]) for i, _ in rows)
        for h in (None, "a", "b", "unseen"):
            total = sum(p(w, h) for w in uni) + p("unknown", h)
            assert abs(total - 1) < 1e-9


def test_odd_rows(odd_docs):
    got = score_texts(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.n_tokens >= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].n_tokens == by[5].n_tokens == by[6].n_tokens == 1


def test_empty_and_no_training(make_docs):
    docs = make_docs([(i, "a b") for i in range(60)])
    assert score_texts(docs.limit(0)).collect() == []
    alone = score_texts(docs, folds=1, held=0).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 for r in alone)


def test_both_ways_of_em_agree(spark):
    import numpy as np

    from assayframe.llm.ngrams import _mixture

    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(int(b), float(x), float(y), int(n)) for b, x, y, n in zip(rng.integers(0, 6, 500), rng.random(500) / 50, rng.random(500) * (rng.random(500) < 0.5), rng.integers(1, 9, 500))], "bucket long, p1 double, p2 double, n long")
    for some in (cells, cells.limit(0)):
        assert np.allclose(_mixture(some, 1e-4), _mixture(some, 1e-4, few=-1), rtol=1e-9)
