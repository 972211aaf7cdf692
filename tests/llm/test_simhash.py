import re

import numpy as np
import xxhash

from loomset.llm import simhash
from tests.llm.conftest import ODD


def slow_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprint_is_the_majority_of_all_shingles():
    for text in ["", "One", "one TWO", "Öne two three É", "a b c d e f a b c", "x\x1cy z\xa0w u", "n " * 70000]:
        assert simhash.simhash(text) == slow_fp(text)


def test_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {0, 1, 2**64 - 1}
    for b in base.tolist():
        fps.add(b)
        for _ in range(6):
            b ^= sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(b)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    from loomset.llm.common import components

    linked = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(simhash.links(frame)).collect()}
    slow, groups = roots(fps), {}
    for v in fps:
        groups.setdefault(linked.get(v, v), set()).add(v)
    want = {}
    for v in fps:
        want.setdefault(slow[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_rows_of_odd_tables(spark, docs_of):
    rows = simhash.near_duplicates(docs_of(ODD).selectExpr("*", "1 as fp", "2 as bucket")).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 2, 3, 7)} == {1} and by[1].fingerprint == "0" * 16
    assert by[5].component_id == 5 and sum(r.doc_id == 5 for r in rows) == 2
    kept = simhash.drop_near_duplicates(docs_of(ODD).selectExpr("*", "7 as _kept_id"))
    assert {r._kept_id for r in kept.collect()} == {7}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark, docs_of):
    texts = ["red fox runs over hills", "cold rain on tin roofs at night", "nine ships left port", "bread rises in warm rooms"]
    pairs = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[3]), (8, texts[1]), (None, "a lone text without id")]
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs_of(pairs)).collect()]
    want = [(None, texts[0]), (None, "a lone text without id"), (7, texts[2]), (7, texts[3]), (8, texts[1])]
    assert sorted(got, key=str) == sorted(want, key=str)
