import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomset.llm import lm_score as L
from tests.conftest import SF
from tests.llm.conftest import ODD


def slow_tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w] + [""]


def slow_base(rows):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in slow_tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        words = slow_tokens(t)
        out.append((i, held[i], len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return out


@pytest.mark.parametrize("head", [1 << 18, 64, 2])
def test_base_is_that_of_plain_counts(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)  # most tokens beyond the head, or none: the same counts
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in L.scored(docs).collect()}
    for i, held, n, known, total, base in slow_base(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert len(got) == len(rows)


M = 2**64
P1, P2, P3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class SlowModel:
    """The model token by token, in plain Python: classes, their digits' softmaxes, two rounds of steps."""

    def __init__(self, rows, tenth_of):
        train = [(i, slow_tokens(t)) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
        self.c = Counter(w for _, words in train for w in words)
        by_count = sorted(self.c, key=lambda w: (-self.c[w], w.encode()))
        self.place = {w: i for i, w in enumerate(by_count[: L.OWN])}
        self.mass = Counter({2 * i + 1: 0.1 for i in range(L.OWN)})
        for w, n in self.c.items():
            self.mass[self.cls(w)] += n + 0.1
        self.node = [Counter() for _ in range(L.LEVELS + 1)]
        for c, m in self.mass.items():
            for k in range(L.LEVELS + 1):
                self.node[k][c % 8**k] += m
        self.w = {}
        first = 0
        for share in L.ROUNDS:
            seen, want = Counter(), Counter()
            for i, words in train:
                if first <= tenth_of[i] < first + share:
                    for w, h in zip(words, self.histories(words)):
                        for k in range(L.LEVELS):
                            rows_, p = self.softmax(k, self.cls(w) % 8**k, h)
                            for r in rows_:
                                seen[k, r, self.cls(w) // 8**k % 8] += 1
                                for d in range(8):
                                    want[k, r, d] += p[d]
            for key in want:
                self.w[key] = self.w.get(key, 0) + 0.5 * math.log((seen[key] + 4) / (want[key] + 4))
            first += share

    def number(self, w):
        return self.place[w] if w in self.place else L.OWN + zlib.crc32(w.encode()) % 2**20

    def cls(self, w):
        return 2 * self.place[w] if w in self.place else 2 * (zlib.crc32(w.encode()) % L.OWN) + 1

    def histories(self, words):
        line = [-1, -2, *map(self.number, words)]
        for two, one in zip(line, line[1:-1]):
            yield [x ^ (x >> 29) for x in (one * P1 % M, (one * P2 % M) ^ ((two * P3 + P1) % M), (two * P2 + P3) % M)]

    def softmax(self, k, node, h):
        rows = [((x + node * P3) * P2 % M) >> 48 for x in h]
        total = self.node[k][node]
        z = []
        for d in range(8):
            share = self.node[k + 1][node + d * 8**k] / total if total else 1 / 8
            z.append(share * math.exp(sum(self.w.get((k, r, d), 0) for r in rows)))
        return rows, [x / sum(z) for x in z]

    def score(self, text):
        words, out = slow_tokens(text), 0.0
        for w, h in zip(words, self.histories(words)):
            c = self.cls(w)
            out += sum(math.log10(self.softmax(k, c % 8**k, h)[1][c // 8**k % 8]) for k in range(L.LEVELS)) + math.log10((self.c[w] + 0.1) / self.mass[c])
        return out


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_score_is_that_of_a_plain_model(spark, docs_of, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)  # 3: most tokens are beyond the head, and meet their counts in the join
    rng = np.random.default_rng(2)
    words = "a bb c dd e".split()
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 9))))) for i in range(60)] + [(200 + i, f"a bb w{841 + i} c") for i in range(6)] + [(None, "Bb é"), (300, None)]
    docs = docs_of(rows)
    tenths = {r.doc_id: r.t for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'round'), 10) t").collect()}
    if head > 3:
        slow = SlowModel(rows, tenths)
        got = {r.doc_id: r.score for r in L.scored(docs).collect()}
        assert {i: s for i, s in got.items()} == {i: pytest.approx(slow.score(t), rel=2e-4) for i, t in rows}
    else:  # tokens beyond the head keep their shared classes; scores stay whole and the model a distribution
        assert all(r.score < 0 and math.isfinite(r.score) for r in L.scored(docs).collect())


def test_unseen_tokens_of_a_small_table_score_alike(spark, docs_of):
    counts = L.count_tokens(docs_of([(1, "x y z x")]))
    model = L.build(counts)
    rows = L.score(docs_of([(i, f"x w{i}") for i in range(800, 900)]), model, counts).collect()
    assert max(r.score for r in rows) - min(r.score for r in rows) < 1e-3


def prose(rng, n, words=60):
    after = {w: [f"w{(7 * w + k) % 40}" for k in range(3)] for w in range(40)}
    for _ in range(n):
        w, out = int(rng.integers(40)), []
        for _ in range(words):
            word = after[w][int(rng.integers(3))]
            out.append(word)
            w = int(word[1:])
        yield " ".join(out)


def test_model_is_a_distribution_and_beats_the_base(spark, docs_of):
    docs = docs_of(list(enumerate(prose(np.random.default_rng(0), 400))))
    counts = L.count_tokens(docs)
    model = L.train(docs, L.build(counts))
    which = np.concatenate([2 * np.arange(L.OWN), 2 * np.arange(L.OWN) + 1])  # each class
    for history in ([3, 5], [L.OWN + 77, 0]):
        hashes = np.repeat(L.histories([np.array(history)])[1][:, 1:], len(which), 1)
        assert sum(10 ** L.log10_classes(model, which, hashes)) == pytest.approx(1, abs=1e-4)
    shares = Counter()
    for t, n in counts.collect():
        c = int(L.classes(L.Ids(model).of([bytes(t)])[1])[0])
        shares[c] += (n + 0.1) / model.mass[c]
    assert all(s == pytest.approx(1 if c % 2 == 0 else 1 - 0.1 / model.mass[c]) for c, s in shares.items())  # odd classes: the rest is for unseen tokens
    rows = L.scored(docs).collect()
    assert sum(r.score for r in rows if r.held_out) > 0.75 * sum(r.base_score for r in rows if r.held_out)


def test_what_is_learned_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = L.count_tokens(docs).cache()
    one, many = (L.train(docs.repartition(n), L.build(counts)).weights for n in (1, 40))
    assert np.abs(one - many).max() < 0.01 and np.abs(one).max() > 0.5
    counts.unpersist()


def test_gradient_is_that_of_the_log_likelihood(spark, docs_of):
    model = L.build(L.count_tokens(docs_of([(i, "a b c d e f g " * 5) for i in range(9)])))
    numbers, hashes = L.histories([np.array([0, 1, 2, 3, 1, 0, L.OWN + 9])])
    which = L.classes(numbers)
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape)
    sums = L.Sums(model)
    sums.add(which, hashes)
    list_of = {b: np.frombuffer(v, np.float16).reshape(2, L.WAYS, -1) * L._SCALE for b, v in sums.blocks()}
    for level in range(L.LEVELS):
        r, d = int(L._level(model, level, which, hashes)[0][1, 2]), 1
        observed, expected = list_of[level * L._BLOCKS + r // (L.ROWS // L._BLOCKS)][:, d, r % (L.ROWS // L._BLOCKS)].astype(float)
        before = L.log10_classes(model, which, hashes).sum() * math.log(10)
        model.weights[level, r, d] += 1e-2
        assert (L.log10_classes(model, which, hashes).sum() * math.log(10) - before) / 1e-2 == pytest.approx(observed - expected, abs=3e-2)
        model.weights[level, r, d] -= 1e-2


def test_odd_rows(spark, docs_of):
    rows = ODD + [(6, "a b c d " * 20000)]
    got = L.scored(docs_of(rows).selectExpr("*", "1 as h", "2 as token", "3 as n")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, want in zip(sorted(got, key=key), sorted(slow_base(rows), key=key)):
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5], rel=1e-9) and math.isfinite(r.score)
    assert L.scored(docs_of([])).count() == 0
    only = L.scored(docs_of([(1, "x y")])) if zlib.crc32(b"1") % 10 == 0 else L.scored(docs_of([(i, "x y") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:1]))
    r = only.first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0
