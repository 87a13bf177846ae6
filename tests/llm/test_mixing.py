import math
from collections import Counter

import pytest

from assayframe.llm.mixing import exponent, mix_sources, op3_mixing


def use(df):
    return [(r.doc_id, r.source, r.mix_epoch, r.mix_tokens) for r in df.collect()]


def test_query_meets_weights(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    have = {r.doc_id: max(len(r.text.split()), 1) for r in docs}
    size = Counter()
    for r in docs:
        size[r.source] += have[r.doc_id]
    used = use(op3_mixing(spark, sf))
    total = sum(size.values())
    got = Counter()
    for d, s, e, n in used:
        assert n == have[d]
        got[s] += n
    assert max(Counter(d for d, *_ in used).values()) <= 4 + 1
    longest = max(have.values())
    # flat weights are within the repetition limit here
    for s in size:
        assert total / len(size) - longest <= got[s] <= total / len(size)


@pytest.mark.parametrize("kind", [{"entropy": 0.9, "repetition": None}, {"repetition": 1.5}, {"entropy": 1.0, "repetition": None}, {"entropy": 0.0, "repetition": None}])
def test_weights_against_brute_force(spark, make_docs, kind):
    rows, k = [], 0
    for s, n in (("a", 600), ("b", 90), ("c", 30), (None, 12)):
        for _ in range(n):
            rows.append((k, "w " * (1 + k % 5), "en", s))
            k += 1
    tokens = Counter()
    for i, t, _, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def weights(a):
        z = sum(p**a for p in shares.values())
        return {s: p**a / z for s, p in shares.items()}

    grid = [k / 20000 for k in range(20001)]
    if kind.get("repetition"):
        a = next(a for a in grid if max(weights(a)[s] * total / tokens[s] for s in shares) <= kind["repetition"])
    else:
        ent = lambda a: -sum(w * math.log(w) for w in weights(a).values())
        a = max(a for a in grid if ent(a) >= kind["entropy"] * math.log(len(shares)) - 1e-9)
    out = mix_sources(make_docs(rows), block=16, **kind)
    got = Counter()
    for _, s, e, n in use(out):
        got[s] += n
    for s, w in weights(a).items():
        assert w * total - 6 - total * 1e-3 <= got[s] <= w * total + total * 1e-3
    counts = Counter(d for d, *_ in use(out))
    by_source = {}
    for i, _, _, s in rows:
        by_source.setdefault(s, set()).add(counts[i])
    assert all(max(c) - min(c) <= 1 for c in by_source.values())  # whole passes and a part of one


def test_same_result_again_and_odd_rows(odd_docs):
    one, two = (sorted(use(mix_sources(odd_docs, budget_ratio=2.5)), key=str) for _ in range(2))
    assert one == two and one
    assert mix_sources(odd_docs.limit(0)).collect() == []


def test_exponent_of_one_source(spark):
    assert 0 <= exponent(spark.createDataFrame([(1.0, 10)], "share double, tokens long"), 10.0, repetition=4.0) <= 1


@pytest.mark.parametrize("ratio, entropy", [(0.5, 0.0), (1.0, 1.0), (2.5, None), (3.7, None)])
def test_repeated_rows_are_cut_to_the_token(spark, make_docs, ratio, entropy):
    rows = [(7, "one two three four", "en", "big")] * 400 + [(k, "w", "en", "small") for k in range(20)]
    rows += [(8, "a b", "en", "big")] * 37
    got = Counter()
    for _, s, _, n in use(mix_sources(make_docs(rows), budget_ratio=ratio, entropy=entropy, repetition=4.0, block=8)):
        got[s] += n
    total = 400 * 4 + 20 + 74
    assert ratio * total - 2 * 4 <= sum(got.values()) <= ratio * total
    if entropy == 0.0:
        assert got["big"] >= ratio * (total - 20) - 4


def test_impossible_limits_and_clashing_columns(spark, make_docs):
    docs = make_docs([(k, "a b c", "en", "s") for k in range(30)])
    with pytest.raises(ValueError):
        mix_sources(docs, budget_ratio=6.0, repetition=4.0)
    assert Counter(n for n in Counter(d for d, *_ in use(mix_sources(docs, budget_ratio=6.0, repetition=None))).values()) == {6: 30}
    again = mix_sources(mix_sources(docs).withColumnRenamed("mix_tokens", "MIX_tokens"))
    assert again.columns == [*docs.columns, "mix_epoch", "mix_tokens", "mix_order"] and again.count() == 30


def test_rows_that_differ_in_a_map_alone(spark):
    rows = [(1, "one two three", "s", {"k": None if i == 0 else str(i)}, [{"a": {"b": i}}]) for i in range(40)] + [(1, "one two three", "s", {}, [{"a": {"b": 0}}])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,string>, more array<struct<a:map<string,int>>>")
    for ratio, times in ((0.5, 1), (2.0, 2)):
        used = [(r.mix_epoch, str(r.tags), str(r.more)) for r in mix_sources(docs, budget_ratio=ratio, repetition=4.0).collect()]
        assert len(used) == len(set(used)) == int(41 * ratio)
        assert max(sum(u[1:] == x[1:] for u in used) for x in used) == times
