import math
import re
from collections import Counter

import pytest

from assayframe.llm import licenses
from assayframe.llm.licenses import PHRASES, RARE, SLACK, TEMPLATES, op13_licenses, rare_index, scan_licenses
from assayframe.llm.sql import license_base


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_idf(texts):
    held = Counter(w for t in texts for w in set(plain_words(t)))
    return {w: math.log((len(texts) + 1) / (held[w] + 0.5)) for _, p, _ in TEMPLATES for w in p.split()}


def brute(texts):
    """Without an index: every place of every template at which one of its key phrases stands is tried."""
    idf, out = plain_idf(texts), []
    for text in texts:
        ws = plain_words(text)
        at = lambda p: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        base = sorted((i, label) for p, label in PHRASES.items() for i in at(p))
        found, best = set(), 0.0
        for label, passage, phrases in TEMPLATES:
            words = passage.split()
            ranked = [sorted(set(p.split()), key=lambda w: (-idf[w], w))[:RARE] for p in phrases]
            key = phrases[max(range(len(phrases)), key=lambda k: sum(map(idf.get, ranked[k])) / len(ranked[k]))]
            start = f" {passage} ".index(f" {key} ")
            start = len(passage[:start].split())
            # any two of the key phrase's index words are enough to try a place
            rare, tries = ranked[phrases.index(key)], Counter()
            for i, w in enumerate(ws):
                for k, x in enumerate(key.split()):
                    if w == x and w in rare:
                        tries[i - start - k, w] += 1
            for s in {s for s, _ in tries if len({w for o, w in tries if o == s}) > 1}:
                near = ws[max(s - SLACK, 0) : max(s + len(words) + 2 * SLACK, 0)]
                if all(f" {p} " in f" {' '.join(near)} " for p in phrases):
                    found.add(label)
                    share = sum(max(idf[w], 1e-9) for w in set(words) & set(near)) / sum(max(idf[w], 1e-9) for w in set(words))
                    best = max(best, min(share, 1.0))
        labels = ",".join(sorted({x for _, x in base} | found))
        out.append((len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), labels, 1.0 if base else best))
    return out


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def assert_same(got, want):
    assert [tuple(r[f] for f in FIELDS[:6]) for r in got] == [w[:6] for w in want]
    assert [r.score for r in got] == pytest.approx([w[6] for w in want])


def run(spark, rows, tmp_path, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return op13_licenses(spark, str(tmp_path))


def test_query_equals_brute_force(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(op13_licenses(spark, sf).collect(), key=lambda r: r.doc_id)
    assert list(got[0].asDict()) == ["doc_id", *FIELDS] and [r.doc_id for r in got] == [i for i, _ in rows]
    assert_same(got, brute([t for _, t in rows]))


def test_every_template_whole_broken_and_far_apart(spark, tmp_path):
    texts = []
    for _, passage, phrases in TEMPLATES:
        texts += [passage, "Some words.\n " + passage.upper().replace(" ", ",\n * ") + " more", " filler ".join(phrases), (" x" * 400).join(phrases), passage.replace(phrases[-1], phrases[-1].replace(" ", " not ", 1)), passage + " " + passage]
    texts += ["Licensed under the Apache License, Version 2.0; under the MIT license", "CC-BY-NC cc by nc", "under the mit licenses", "mit license under the", "the " * 3000, "license " * 3000 + "public " * 500, "UNDER THE MIT LICENSE İ K", "under the mit license", "x" * 5000 + "-under-the-mit-license"]
    got = sorted(run(spark, list(enumerate(texts)), tmp_path).collect(), key=lambda r: r.doc_id)
    assert_same(got, brute(texts))
    for k, (label, _, phrases) in enumerate(TEMPLATES):
        whole, loud = got[6 * k], got[6 * k + 1]
        assert label in whole.labels.split(",") and label in loud.labels.split(",") and whole.score == pytest.approx(1)
        if len(phrases) > 1:
            assert label not in got[6 * k + 3].labels.split(",")  # key phrases far apart are not a licence


def test_index_holds_the_rarest_words(spark):
    idf = {w: 1.0 for w in licenses._vocabulary()} | {"gnu": 9.0, "lesser": 8.0, "foundation": 7.0, "published": 6.5}
    index = rare_index(idf)
    lgpl = next(t for t, x in enumerate(TEMPLATES) if x[0] == "lgpl")
    assert {w for w, at in index.items() if any(t == lgpl for t, _ in at)} == {"gnu", "lesser", "foundation"}
    assert all(TEMPLATES[t][1].split()[p] == w for w, at in index.items() for t, p in at)
    assert all(f" {p} " in f" {passage} " for _, passage, phrases in TEMPLATES for p in phrases)


def test_odd_rows(odd_docs, make_docs, spark, tmp_path):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted(run(spark, rows, tmp_path).collect(), key=lambda r: repr((r.doc_id, r.n_words)))
    want = [w for _, w in sorted(zip(rows, brute([r.text for r in rows])), key=lambda x: repr((x[0].doc_id, x[1][0])))]
    assert_same(got, want)
    clash = odd_docs.withColumns({c: odd_docs["extra"] for c in ("ws", "votes", "base", "k0", "found", "n_words")})
    assert scan_licenses(clash, keep=("doc_id", "ws", "k0")).count() == len(rows)
    assert scan_licenses(make_docs([(1, "x")]).limit(0)).collect() == []


def test_no_python_worker(spark, sf):
    plan = op13_licenses(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_phrases_alone_count_no_words_of_the_corpus(spark, sf, monkeypatch):
    want = sorted(map(tuple, op13_licenses(spark, sf).drop("labels", "score").collect()), key=repr)

    def counted(*a):
        raise AssertionError("phrases need no document frequencies")

    monkeypatch.setattr(licenses, "document_frequencies", counted)
    assert sorted(map(tuple, license_base(spark, sf).collect()), key=repr) == want


def test_words_of_all_characters(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i : i + 997]) for i in range(0, len(every), 997)] + [f"a{c}b{c}{c}c" for c in every[:700]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select(licenses.folded(df.text).alias("folded"), licenses.words("text").alias("ws")).collect()
    assert len(got) == len(texts) and all(r.ws == plain_words(r.folded) for r in got)
