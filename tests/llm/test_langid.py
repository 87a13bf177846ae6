from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from assayframe.llm.langid import ORDER, Model, identify, keep_identified, op1_langid, train, words_of


def plain_kneser_ney(words, symbols, order):
    """p(symbol, context) by dictionaries: interpolated Kneser-Ney over the letters of words."""
    counts, grams = [None] * (order + 1), Counter()
    for w in words:
        t = "\x02" * (order - 1) + w + "\x03"
        grams.update(t[k : k + order] for k in range(len(t) - order + 1))
    for k in range(order, 0, -1):
        counts[k], grams = grams, Counter(g[1:] for g in grams)  # below the top: in how many different n-grams

    def p(symbol, context, k):
        if not k:
            return 1 / (len(symbols) + 1)
        context = context[len(context) - k + 1 :]
        c = counts[k]
        once, twice = (sum(n == x for n in c.values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        after = [n for g, n in c.items() if g[:-1] == context]
        lower = p(symbol, context, k - 1)
        return (max(c[context + symbol] - d, 0) + d * len(after) * lower) / sum(after) if after else lower

    return lambda symbol, context: p(symbol, context, order)


def test_probabilities_equal_brute_force():
    texts = {"aa": ["banana", "bandana", "anna", "an", "ban", "banana", "nab"], "bb": ["otto", "tot", "tott", "o"], "cc": ["x"]}
    symbols = sorted({c for ws in texts.values() for w in ws for c in w} | {"\x03"})
    rows = defaultdict(int)
    for lang, ws in texts.items():
        for w in ws:
            t = "\x02" * (ORDER - 1) + w + "\x03"
            for k in range(len(t) - ORDER + 1):
                rows[lang, t[k : k + ORDER]] += 1
    model = Model(pd.DataFrame([(a, g, n) for (a, g), n in rows.items()], columns=["lang", "gram", "n"]))
    contexts = ["\x02\x02\x02", "\x02\x02b", "ban", "ana", "tto", "xyz", "\x02xx"]
    grams = [c + s for c in contexts for s in [*symbols, "\u4e00"]]
    got = np.exp(model.log_probs(np.array([[ord(c) for c in g] for g in grams], np.uint32)))
    for j, lang in enumerate(model.langs):
        p = plain_kneser_ney(texts[lang], symbols, ORDER)
        assert np.allclose(got[:, j], [p(g[-1], g[:-1]) for g in grams]), lang


def test_letters():
    assert words_of("²½ ① Ⅷ 3 _ ') ٣") == [] and words_of("Ab1é_हिन्दी x̄Y") == ["ab", "é", "हिन्दी", "x̄y"]


def test_sample_is_bounded_by_different_texts(spark, make_docs):
    rows = [(None, "the one text of all these", "en")] * 300 + [(7, f"und noch ein wort {'x' * k}", "de") for k in range(300)]
    model = train(make_docs(rows), docs_per_lang=20)
    assert "en" in model.langs or model.langs == ["de"]
    by = identify(make_docs([(1, "²½"), (2, "und noch")]), train(make_docs(rows))).collect()
    assert {r.doc_id: r.lang_pred for r in by} == {1: "und", 2: "de"}


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = op1_langid(spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02


def test_model_is_a_distribution(spark, sf):
    """After any context, the probabilities of all known symbols and of one unknown sum to one."""
    model = train(spark.read.parquet(f"{sf}/documents.parquet"))
    symbols = [*model.letters, 3]
    for context in ("\x02\x02t", "the", "qzx", "\x02\x02\x02"):
        grams = np.array([[*map(ord, context), s] for s in symbols] + [[*map(ord, context), 0x4E00]], np.uint32)
        assert np.allclose(np.exp(model.log_probs(grams)).sum(0), 1)


def test_rejects_noise_and_keeps_columns(spark, sf, make_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs)
    rng = np.random.default_rng(1)
    noise = " ".join("".join(rng.choice(list("qxzjkvwyü"), 7)) for _ in range(80))
    rows = [(1, "the and of that are with ing tion the and"), (2, noise), (3, "12345 %%% ---"), (4, None), (5, ""), (6, "THE!! AND!! OF!! THAT!!")]
    made = make_docs(rows)
    by = {r.doc_id: r for r in identify(made, model).collect()}
    assert by[1].lang_pred == by[6].lang_pred == "en" and not by[1].rejected and not by[6].rejected
    assert by[2].rejected and by[2].lang_pred != "und"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (3, 4, 5))
    kept = keep_identified(made, model)
    assert kept.columns == made.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6]


def test_odd_rows(odd_docs, make_docs):
    got = identify(odd_docs, train(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    none = train(make_docs([(1, "abc", None)]))
    assert isinstance(none, Model) and none.langs == []
    assert {r.lang_pred for r in identify(odd_docs, none).collect()} == {"und"}
    assert identify(odd_docs.limit(0), none).collect() == []
