import random
import re

from assayframe.llm.decontaminate import contained_items, drop_contaminated, op2_decontaminate


def shingles(t, n=None):
    ws = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    n = n or min(len(ws), 5)
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def brute(docs, items):
    out = []
    for d, t in docs:
        by_n = {n: shingles(t, n) for n in range(1, 6)}
        for i, x in items:
            own = shingles(x)
            if own and (k := len(own & by_n[len(next(iter(own)))])) >= 0.8 * len(own) - 1e-9:
                out.append((d, i, k, len(own)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert want and got(op2_decontaminate(spark, sf)) == want


def test_long_documents_with_many_items(spark, make_docs):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(rng.randrange(3, 90)))) for i in range(120)]
    items += [(500, None), (501, "..."), (502, "lone"), (503, "Two Words!")]

    def part(t):
        ws = t.split()
        k = int(len(ws) * rng.uniform(0.75, 1))
        return " ".join(ws[:k])

    docs = []
    for d in range(60):
        chosen = rng.sample(items[:120], rng.choice([0, 1, 2, 40]))
        fill = [" ".join(f"f{rng.randrange(10**6)}" for _ in range(30)) for _ in chosen] + ["end two, words"]
        docs.append((d, "\n".join(x for pair in zip([part(t) for _, t in chosen] + [""], fill) for x in pair)))
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, shared string")
    assert got(contained_items(make_docs(docs), table)) == brute(docs, items)


def test_odd_rows(spark, odd_docs, sf):
    items = spark.createDataFrame([(1, "x"), (2, " ".join(f"alpha{i}" for i in range(8, 30))), (2, "x")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(contained_items(odd_docs, items)) == brute(rows, [tuple(r) for r in items.collect()])
    kept = drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 10, 11, 12]
    assert contained_items(odd_docs, items.limit(0)).collect() == [] and contained_items(odd_docs.limit(0), items).collect() == []
    assert drop_contaminated(odd_docs, items.limit(0)).count() == len(rows)
