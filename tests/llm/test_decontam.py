import random

from loomset.llm import decontam as D


def slow(pattern, text):
    """Least edit distance to any substring, and the first end of one, by the whole table."""
    row = list(range(len(pattern) + 1))
    best = row[-1], 0
    for at, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best[0]:
            best = row[-1], at + 1
    return best


def test_myers_is_the_whole_table():
    rng = random.Random(1)
    for _ in range(500):
        p = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 60))) + (p[: rng.randrange(len(p) + 1)] + p[rng.randrange(len(p)) :]) + "ba"
        want = slow(p, t)
        got = D.myers(p, t, len(p))
        assert got[0] == want[0] or want[1] == 0
        assert (D.myers(p, t, 2) is not None) == (want[0] <= 2)


def test_items_are_found_where_all_pairs_find_them():
    rng = random.Random(7)
    words = ["the", "heon", "reatsh", "therin", "ble", "onat", "é", "stea"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = D.Items(list(range(8)), [D.normalised(some(14)) for _ in range(8)], 0.1)
    for _ in range(150):
        text = list(some(10) + " " + rng.choice(items.texts) + " " + some(10))
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(len(text))] = rng.choice(["x", "", "yy"])
        text = D.normalised("".join(text))
        got = {i: d for i, d, _ in items.find(text)}
        want = {i: d for i, t in enumerate(items.texts) if (d := slow(t, text)[0]) <= items.budget[i]}
        assert got == want


def test_tables(spark, docs_of, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog while the others look on"
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, ""), (5, "short"), (None, item + " again and again and again")], "item_id long, text string")
    edited = item.replace("quick", "quik").replace("others", "other")
    docs = docs_of([(1, None), (2, ""), (3, f"x y {item}\n z"), (4, f"a {edited} b"), (4, f"a {edited} b"), (None, item), (5, "clean text " * 5000), (6, item[:40])])
    docs = docs.selectExpr("*", "1 as item_id").unionByName(docs_of([(7, "come SHORT, of it"), (8, "shortly or unshort")]).selectExpr("*", "1 as item_id"))
    want = [(None, 1, 0), (3, 1, 0), (4, 1, 2), (4, 1, 2), (7, 5, 0)]
    key = lambda x: (x[0] or 0, x)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in D.matches(docs, bench).collect()), key=key) == want
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 8]
    monkeypatch.setattr(D, "BLOCK_CHARS", 60)  # several blocks, the same result
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in D.matches(docs, bench).collect()), key=key) == want
    assert D.matches(docs_of([]), bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 10
    assert D.matches(docs, bench, least=24).where("doc_id = 7").count() == 0
