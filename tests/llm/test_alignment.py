import hashlib
import os
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest

from assayframe.llm import alignment
from assayframe.llm.alignment import TOKENIZERS, PairCounts, _aligned, _pair, _shown_bytes, _Units, align_tokenizers, op11_alignment, sorted_shards

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "x", " ", "  ", "a b", "a  b", " a", "a ", "a  ", "foo\n\n bar", "foo\n  bar", "foo \n bar\t\t x", "it's  we'll 'S", "tab\t space", "nbsp  x   y", "wide　 x 　y", "  em    x", "\u0085 nel", "  ogham  ",
    "a▁b", "▁", "<s> </s> <unk> <0x41>", "<|endoftext|> x<|endoftext|>", "İstanbul \U0001f600 é ß", "中文 文本 한국어", "\x00 nul \x01", "é combining", "\x7f del \x7f x", "​ zero ​", "a" * 400, "  lots   of    spaces     ", "12345 67,890.12", "﻿ bom", "\r\n \r\n x",
]


@pytest.fixture(scope="module")
def plain():
    """A text's tokens by both libraries on whole texts, groups and links by walking bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, shown = sentencepiece.SentencePieceProcessor(model_file=os.path.join(TOKENIZERS, "piece_bpe_32k.model")), _shown_bytes()

    def of(text):
        if not text:
            return None
        ids_a, ids_b, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return None
        over = [[t for t, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b)]
        links = list(dict.fromkeys(zip(*over)))
        ends = [set(accumulate(map(len, side))) for side in (bytes_a, bytes_b)]
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            x, y = [], []
            while at_a < end:
                x.append(ids_a[i])
                at_a, i = at_a + len(bytes_a[i]), i + 1
            while at_b < end:
                y.append(ids_b[j])
                at_b, j = at_b + len(bytes_b[j]), j + 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        return len(ids_a), len(ids_b), len(groups), [(ids_a[x], ids_b[y]) for x, y in links], hashlib.sha256(";".join(groups).encode()).hexdigest()

    return of


def brute(of, texts):
    got = [of(t) for t in texts]
    count, best = Counter(p for g in got if g for p in set(g[3])), Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0,) * 6 + ("",) if g is None else (*g[:3], len(g[3]), sum(count[p] == best[p[0]] for p in g[3]), sum(count[p] for p in g[3]), g[4]) for g in got]


def test_query_equals_brute_force(spark, sf, plain):
    rows = [(i, t[:4000] if t else t) for i, t in sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())]
    want = {i: w for (i, _), w in zip(rows, brute(plain, [t for _, t in rows]))}
    got = align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.id: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(rows)
    query = {r.doc_id: r for r in op11_alignment(spark, sf).collect()}
    assert sorted(query) == sorted(want) and list(next(iter(query.values())).asDict()) == ["doc_id", *COLUMNS[:6], "groups_sha256"]
    same = [i for i, t in rows if t and len(t) < 4000]
    assert all(query[i].groups_sha256 == want[i][6] for i in same) and len(same) > 100


def test_odd_texts_and_pieces(plain):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "Word", " ", "  ", "\n", "\t", " ", "　", "'s", "9", "é", "▁", "\U0001f600", ", "]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for piece in (alignment.PIECE, 7):
        units = _Units(_pair(TOKENIZERS))
        got = list(_aligned(units, pa.array(texts), piece))
        for text, g in zip(texts, got):
            w = plain(text)
            want = (0, 0, 0, 0, "") if w is None else (*w[:3], len(w[3]), w[4])
            assert g[:5] == want, (piece, text)


def test_units_are_forgotten_and_met_again(plain, monkeypatch):
    monkeypatch.setattr(alignment, "KEEP", 3)
    units = _Units(_pair(TOKENIZERS))
    for _ in range(2):
        for text in ("one two three four five", "five six seven", "one two"):
            assert next(_aligned(units, pa.array([text])))[:5] == (*plain(text)[:3], len(plain(text)[3]), plain(text)[4])


def test_shards_sum_keys_that_many_partitions_hold(spark):
    rng = random.Random(1)
    rows = [(rng.choice((7, rng.randrange(5000))), rng.randrange(1, 9)) for _ in range(4000)]
    want, best = Counter(), {}
    for k, n in rows:
        want[k] += n
    for k, n in want.items():
        best[k // 10] = max(best.get(k // 10, 0), n)
    counts = PairCounts(sorted_shards(spark.createDataFrame(rows, "key long, n long").repartition(16), 10), 500, 10)
    keys = np.array(rng.sample(sorted(want), len(want)))
    assert len(counts.paths) > 1 and counts.of(keys).tolist() == [want[k] for k in keys.tolist()]
    assert {a: int(n) for a, n in enumerate(counts.best) if n} == best


def test_odd_rows(odd_docs, make_docs, spark, plain):
    got = align_tokenizers(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(zip([repr(r.doc_id) for r in rows], brute(plain, [r.text for r in rows])))
    assert sorted((repr(r.id), tuple(r[c] for c in COLUMNS)) for r in got) == want
    assert align_tokenizers(make_docs([(1, "x")]).limit(0)).collect() == []
    assert align_tokenizers(spark.createDataFrame([("k", None)], "doc_id string, text string")).collect()[0].n_links == 0


def test_a_long_text_is_taken_in_pieces(spark):
    words = ["alpha", "beta", "gamma,", "delta\n", "42"]
    text = " ".join(words[i * i % 5] for i in range(1_000_000))
    got = align_tokenizers(spark.createDataFrame([(1, text), (2, "alpha beta")], "doc_id long, text string")).collect()
    long = next(r for r in got if r.id == 1)
    whole = list(_aligned(_Units(_pair(TOKENIZERS)), pa.array([text]), 1 << 40))[0]
    assert len(text) > 2 * alignment.PIECE and tuple(long[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == whole[:5]
