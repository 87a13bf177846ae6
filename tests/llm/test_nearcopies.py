import random

import corpus_pipeline
from assayframe.llm.nearcopies import near_copies
from tests.llm.test_simhash import classes


def shingles(t):
    ws = (t or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def near(a, b):
    return a == b or (bool(a and b) and 5 * len(a & b) >= 4 * len(a | b))


def brute(rows):
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    comp = classes([(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])], len(rows))
    return {rows[k][0]: rows[c][0] for k, c in enumerate(comp)}


def edited_copies(rng, groups, copies):
    """Texts with copies of which 0 to 7 words are changed: similarities of 0.5 to 1."""
    out = []
    for _ in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(copies):
            now = list(words)
            for _ in range(rng.randrange(8)):
                now[rng.randrange(len(now))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(now))
    rng.shuffle(out)
    return list(enumerate(out))


def test_edited_copies_equal_brute_force(spark, make_docs):
    rows = edited_copies(random.Random(5), 60, 5)
    want = brute(rows)
    assert 60 < len(set(want.values())) < 250
    assert {r.doc_id: r.component_id for r in near_copies(make_docs(rows)).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, make_docs(rows), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_groups_over_tiles(make_docs):
    rows = edited_copies(random.Random(6), 3, 60)
    want = brute(rows)
    for tile in (4, 256):
        assert {r.doc_id: r.component_id for r in near_copies(make_docs(rows), tile=tile).collect()} == want


def test_odd_rows(odd_docs, make_docs):
    got = near_copies(odd_docs).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == odd_docs.count()
    assert by[4] == by[5] == by[12] == 4 and by[2] == by[None] == by[3] == 1 and by[7] == by[8] == 7
    assert near_copies(make_docs([(1, "x")]).limit(0)).collect() == []


def test_columns_of_any_name_stay(odd_docs):
    from assayframe.llm.nearcopies import keep_one_each

    wide = odd_docs.withColumns({c: odd_docs["extra"] for c in ("__gone", "gone", "component_id", "hi", "node")})
    kept = keep_one_each(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in keep_one_each(odd_docs).collect())


def test_texts_of_one_template_make_no_giant_group(spark):
    from assayframe.llm.nearcopies import _sketches, candidates

    compared = {}
    for n in (500, 2000):
        rng = random.Random(n)
        template = [f"t{k}" for k in range(60)]
        rows = [(i, " ".join(template + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in range(n)]
        nodes = _sketches(spark.createDataFrame(rows, "doc_id long, text string"), 5).selectExpr("doc_id as node", "keys")
        groups = [r["count"] for r in candidates(nodes).groupBy("comp").count().collect()]
        compared[n] = sum(g * (g - 1) // 2 for g in groups)
        assert max(groups, default=0) < n / 2
    assert compared[2000] < 2000 * 2000 / 2 / 10


def test_simhash_blocks_find_candidates_of_their_own(make_docs, monkeypatch):
    from assayframe.llm import nearcopies
    from assayframe.llm.simhash import simhash

    monkeypatch.setattr(nearcopies, "candidates", lambda nodes: nodes.select(nodes.node.alias("comp"), "node").limit(0))  # no bands
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(20)]
    rows = list(enumerate(texts + [f"{t} end" for t in texts] + [None, "", " "]))
    assert all((simhash(t) ^ simhash(f"{t} end")).bit_count() <= 4 for t in texts)
    assert {r.doc_id: r.component_id for r in near_copies(make_docs(rows)).collect()} == brute(rows)
