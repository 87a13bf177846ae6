import hashlib
import re

import pytest

from assayframe.llm import substrings
from assayframe.llm.substrings import op6_substrings, remove_repeats


def brute(rows, window=20):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), ws in zip(rows, words):
        for p in range(len(ws) - window + 1):
            k, at = tuple(ws[p : p + window]), (-(1 << 63) if i is None else i, p)
            first[k] = min(first.get(k, at), at)
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        for p in range(len(ws) - window + 1):
            if (-(1 << 63) if i is None else i, p) > first[tuple(ws[p : p + window])]:
                gone |= set(range(p, p + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)]
    got = [tuple(r) for r in op6_substrings(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(r[2] for r in got)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in remove_repeats(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("shift", range(13))
def test_every_alignment(make_docs, shift):
    a = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "p " * 5 + a), (2, "q " * shift + a + " r")]
    got = {r.doc_id: r.n_removed for r in remove_repeats(make_docs(rows)).collect()}
    assert got == {1: 0, 2: 20}


def test_empty(make_docs):
    assert remove_repeats(make_docs([(1, "x")]).limit(0)).collect() == []


def test_hot_windows_change_no_result(make_docs, monkeypatch):
    common = " ".join(f"licence{k}" for k in range(45))
    rows = [(None if k == 7 else k * 3 % 97, f"{'own ' * (k % 5)}text{k} {common} tail{k % 3} " + " ".join(f"z{k % 4}_{j}" for j in range(30))) for k in range(97)]
    want = sorted(brute(rows), key=str)
    real = substrings.pack
    for size, hot in ((3000, 1 << 14), (3000, 5), (3000, 0), (1 << 22, 1 << 14)):
        monkeypatch.setattr(substrings, "pack", lambda d, tag: real(d, tag, size))
        monkeypatch.setattr(substrings, "HOT_WINDOWS", hot)
        assert sorted((tuple(r) for r in remove_repeats(make_docs(rows)).collect()), key=str) == want, (size, hot)


def test_salts_spread_over_all_parts():
    from assayframe.llm.substrings import _SALTS, salt

    assert len({salt(partition << 28 | k) for partition in range(10_000) for k in range(21)}) == _SALTS
