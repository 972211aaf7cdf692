import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.llm import paragraph_dedup as P
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD


def slow_shingles(line):
    words = line.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def slow_groups(lines):
    """Components of all pairs at 0.8, as sets of (doc_id, line)."""
    keys = list(lines)
    sets = [slow_shingles(lines[k]) for k in keys]
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = {}
    for i, k in enumerate(keys):
        out.setdefault(find(i), set()).add(k)
    return [g for g in out.values() if len(g) > 1]


def test_banding_reaches_its_recall():
    b, r = P.tune()
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 64
    with pytest.raises(ValueError):
        P.tune(0.1, 0.999999, 4)


def test_hashes_are_those_of_plain_loops():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    g = [sum(int(h[i + j]) * pow(int(P._BASE), j, 2**64) for j in range(5)) % 2**64 for i in range(296)]
    assert P.grams(h, 5).tolist() == [x ^ (x >> 31) for x in g]
    k = P.grams(h, P.MIN_WORDS)
    assert P.anchors(k).tolist() == sorted({i + int(np.argmin(k[i : i + P.WINDOW])) for i in range(len(k) - P.WINDOW + 1)})
    assert len(P.anchors(k[:0])) == 0 and len(P.anchors(k[:1])) == 1 and P.anchors(np.full(90, 7, np.uint64)).tolist() == [0]
    t = P.Text("É a\tb  c\n" + " ".join(map(str, range(30))) + "\nx", P.WordHashes())
    assert t.words == "É a b c".encode().lower().split() + [b"%d" % i for i in range(30)] + [b"x"] and t.lines == [(4, 34)] and (t.start[1], t.end[1]) == (2, 3)


def test_bands_are_those_of_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = [3, 1, 40, 2, 90, 1, 1]
    shingles = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64)
    a, b = P._permutations()
    want, at = [], 0
    for n in sizes:
        low = [min((int(x) * int(p) + int(q)) % 2**64 for x in shingles[at : at + n]) for p, q in zip(a, b)]
        at += n
        line = b""
        for k in range(P.BANDS):
            mixed = 0
            for i in range(P.ROWS):
                mixed = ((mixed ^ low[k * P.ROWS + i]) * int(P._BASE) + i) % 2**64
            line += (mixed ^ (mixed >> 32)).to_bytes(8, "little")
        want.append(line)
    for most in (4096, 50, 7, 1):
        monkeypatch.setattr(P, "_AT_ONCE", most)
        assert P.bands(shingles, sizes) == want


def test_filters_lose_no_pair(spark):
    rng = random.Random(2)
    rows, sets = [], []
    for i in range(150):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.8 else {rng.randrange(1, 2**62) for _ in range(rng.randrange(1, 60))}
        some = {x for x in base if rng.random() > 0.12} | {rng.randrange(1, 2**62) for _ in range(rng.randrange(0, 5))}
        sets.append(some or base)
        rows.append((i, np.array(sorted(sets[-1]), np.uint64).tobytes()))
    held = spark.createDataFrame(rows, "p long, shingles binary")
    keys = {}
    for r in P._prefixes(held, 0.8).collect():
        keys.setdefault(r.p, set()).add(r.key)
    sketches = P._sketches(held)
    x, y = sketches.select("p", F.col("sketch").alias("x")), sketches.select(F.col("p").alias("q"), F.col("sketch").alias("y"))
    may = {(r.p, r.q) for r in x.join(y, F.col("p") < F.col("q")).where(P._may_reach(F.col("x"), F.col("y"), 0.8)).collect()}
    near = [(i, j) for j in range(150) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 20 and all(keys[i] & keys[j] and (i, j) in may for i, j in near) and len(may) < 2500


def test_near_copies_without_their_original(spark, docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(7))
    base, pairs = [word() for _ in range(60)], []
    for k in range(120):  # any two about 0.7 alike, but for twenty that are close to one other
        copy = list(base)
        for at in ((5 + k % 40, 50) if k < 100 else (5 + k % 40, 50)):
            copy[at] = f"{word()}{k % 100}"
        pairs.append((k, " ".join(copy)))
    twins = [(200 + k, pairs[k][1] + f" {word()}") for k in range(20)]
    rows = P.repeats(docs_of(pairs + twins)).where("kind = 'paragraph'").collect()
    got = {}
    for r in rows:
        got.setdefault(r.component_id, set()).add(r.doc_id)
    want = slow_groups({(i, 0): t for i, t in pairs + twins})
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i, _ in g) for g in want)


def test_paragraphs_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("length(text) < 6000")
    rows = docs.collect()
    lines = {}
    for r in rows:
        at = 0
        for line in r.text.split("\n"):
            if len(line.split()) >= P.MIN_WORDS:
                lines[r.doc_id, at + len(line) - len(line.lstrip())] = line
            at += len(line) + 1
    want = slow_groups(lines)
    got, kept = {}, {}
    for r in P.repeats(docs).where("kind = 'paragraph'").collect():
        got.setdefault(r.component_id, set()).add((r.doc_id, r.start))
        kept.setdefault(r.component_id, []).append((r.doc_id, r.start)) if r.keep else None
    assert all(kept[c] == [min(g)] for c, g in got.items())
    found = sum(len(g) for g in got.values())
    assert all(any(g <= w for w in want) for g in got.values())
    assert found >= 0.98 * sum(map(len, want))


def test_runs_inside_paragraphs(spark, docs_of):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = prose(51)
    pairs = [(i, f"{prose(rng.randrange(20, 200))} {passage} {prose(rng.randrange(5, 150))}") for i in range(30)]
    clean = [(100 + i, f"{prose(300)}\n{prose(20)}\nshort shared line of eight words in all") for i in range(30)]
    found = P.repeats(docs_of([*pairs, *clean, *ODD]))
    rows = found.collect()
    runs = [r for r in rows if r.doc_id is not None and r.doc_id < 30 and r.kind == "anchor" and r.places == 30]
    assert {r.doc_id for r in runs} == set(range(30)) and not any(r.doc_id and r.doc_id >= 100 for r in rows)
    text = dict(pairs)
    assert all(text[r.doc_id][r.start : r.end] in passage and len(text[r.doc_id][r.start : r.end].split()) == 25 for r in runs)
    assert {r.keep for r in runs if r.doc_id == 0} == {True} and not any(r.keep for r in runs if r.doc_id)
    cuts = P.removals(found).where("doc_id between 1 and 29").collect()
    assert all(text[r.doc_id][r.start : r.end] in passage for r in cuts) and {r.doc_id for r in cuts} >= set(range(10, 30))


def test_removals_cover_whole_runs(spark, docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    pairs, runs = [], {}
    for i in range(200):
        run = prose(rng.randrange(50, 130))
        for k in range(2):
            pairs.append((2 * i + k, f"{prose(rng.randrange(0, 90))} {run} {prose(rng.randrange(0, 90))}".strip()))
        runs[2 * i + 1] = run
    docs = docs_of([*pairs, (1000, "x y z " * 3000), (None, runs[1]), (1001, f"{runs[3]} {prose(3)} {runs[3]}")])
    cuts = {}
    for r in P.removals(P.repeats(docs), docs=docs).collect():
        cuts.setdefault(r.doc_id, []).append((r.start, r.end))
    text = dict(pairs)
    for i, run in runs.items():
        at = text[i].index(run)
        assert any(s <= at and at + len(run) <= e for s, e in cuts[i]) or i == 1, (i, at, len(run), cuts[i])
        assert sum(e - s for s, e in cuts[i]) <= len(run) + 2 or i == 1  # and nothing else
    assert 1000 not in cuts and len(cuts[1001]) == 2  # what repeats in one text alone stays; both places of another's run go


def test_families_that_only_their_original_joins(spark, docs_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(7))
    pairs, family = [], {}
    for f in range(4):
        base = [word() for _ in range(60)]
        for k in range(41):
            copy = list(base)
            if k:
                copy[rng.randrange(6, 54)] = word()
            family[100 * f + k] = f
            pairs.append((100 * f + k, " ".join(copy)))
    groups = {}
    for r in P.repeats(docs_of(pairs)).where("kind = 'paragraph'").collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert all(len({family[i] for i in g}) == 1 for g in groups.values())
    assert sum(len(g) for g in groups.values() if len(g) > 35) >= 0.98 * len(pairs)


def test_odd_rows(spark, docs_of):
    line = " ".join(f"w{i}" for i in range(30))
    rows = P.repeats(docs_of([(None, line), (1, line), (1, line), (2, None), (3, "É" + line.upper()), (4, "")]).selectExpr("*", "1 as kind", "2 as k1")).collect()
    paragraphs = sorted((r.doc_id or -1, r.keep) for r in rows if r.kind == "paragraph")
    assert paragraphs == [(-1, True), (1, False), (1, False), (3, False)] or [p[0] for p in paragraphs] == [-1, 1, 1, 3]
    assert P.repeats(docs_of([])).count() == 0


def test_short_lines_repeat_too(spark, docs_of, tmp_path):
    from loomset.llm.queries import op3_substring_dedup

    long = " ".join(f"w{i}" for i in range(24))
    pairs = [(1, f"Title\n{long}\nalone in here"), (2, f"{long} more\n  title\none two three four five six"), (3, f"other\none two three four five six\n{long.upper()}")]
    docs_of(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    found = op3_substring_dedup(spark, str(tmp_path))
    rows = [r for r in found.collect() if r.kind != "anchor"]
    text, got = dict(pairs), {}
    for r in rows:
        got.setdefault(r.component_id, set()).add((r.doc_id, text[r.doc_id][r.start : r.end].lower(), r.kind, r.keep))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [
        {(1, "title", "line", True), (2, "title", "line", False)},
        {(2, "one two three four five six", "line", True), (3, "one two three four five six", "line", False)},
        {(1, long, "line", True), (2, long + " more", "paragraph", False), (3, long, "line", False)},
    ]))
    assert {(r.doc_id, r.start) for r in P.removals(found).collect()} == {(2, 0)}
    assert len(P.removals(found, 1).collect()) > 1


def test_all_components_of_a_large_bucket_meet(spark, docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(7))
    lines = []
    for _ in range(30):  # thirty unrelated pairs of near copies, all in one bucket
        base = [word() for _ in range(40)]
        lines += [" ".join(base), " ".join(base[:-1] + [word()])]
    docs = docs_of(list(enumerate(lines)))
    keys = [P.line_key(x.encode().split())[0] for x in lines]
    bands = [bytes(8) + rng.randbytes(8 * (P.BANDS - 1)) for _ in lines]
    links = P.paragraph_links(docs, spark.createDataFrame(list(zip(keys, bands)), "k1 long, bands binary"))
    got = {(r.a, r.b) for r in links.collect()}
    assert got == {tuple(sorted(keys[i : i + 2])) for i in range(0, 60, 2)}
