import random
import re

import numpy as np
import xxhash

from assayframe.llm.components import connected_components
from assayframe.llm.simhash import blocks_for, links, near_duplicates, op9_simhash


def fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(pairs_of, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs_of:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_query_equals_brute_force(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 4]
    comp = classes(near, len(rows))
    want = [(i, f"{int(f):016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, comp)]
    assert sorted(tuple(r) for r in op9_simhash(spark, sf).collect()) == want


def test_links_of_a_dense_group_over_tiles(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = list({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)})
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = classes(near, len(fps))
    for tile in (7, 2048):
        found = links(nodes, tile=tile).distinct().collect()
        assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in found)
        assert classes([(r.a, r.b) for r in found], len(fps)) == want


def test_components_of_a_chain(spark):
    e = spark.range(200).selectExpr("id + 1 as a", "id as b").union(spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_odd_rows(odd_docs, make_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == by[5].component_id == by[12].component_id == 4 and by[4].fp == 0
    assert by[2].component_id == 1 and by[None].component_id == 1
    assert near_duplicates(make_docs([(1, "x")]).limit(0)).collect() == []


def test_blocks_decide_the_work_alone(spark, sf):
    assert [blocks_for(n) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**13)] == sorted(blocks_for(n) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**13)) and blocks_for(0) == 6 and blocks_for(10**11) > 7
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    six, eight = (sorted(tuple(r) for r in near_duplicates(docs, blocks=b).collect()) for b in (6, 8))
    assert six == eight


def test_columns_of_any_name_stay(odd_docs):
    from assayframe.llm.simhash import keep_one_each

    wide = odd_docs.withColumns({c: odd_docs["extra"] for c in ("__gone", "gone", "component_id", "hi", "node")})
    kept = keep_one_each(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in keep_one_each(odd_docs).collect())
