import itertools
import random
import zlib

import numpy as np
import pytest

from loomset.llm import packing
from tests.llm.conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(4)
    parts = ["The", "don't", "É", "é", "́", " ", "\n", "\xa0", " ", "\x1c", "\x85", "ΣΑΣ", "İ", "42", "<|endoftext|>", "<|", "'s", "…", "ß", "😀", "日本", "a-b", "\t "]
    tokens = packing.Tokens(PATH)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 20))) for _ in range(600)]
    for text, got in zip(texts, tokens.batch(texts)):
        assert np.frombuffer(got, "<u4").tolist() == slow_ids(text)[:-1], repr(text)


def test_fullest_is_the_best_of_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 60)
        counts = {x: lengths.count(x) for x in lengths}
        best = max(s for r in range(len(lengths) + 1) for c in itertools.combinations(lengths, r) if (s := sum(c)) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_plan_uses_every_piece_and_few_bins():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 20000).astype(int) + 1)
    counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    made = packing.plan(counts)
    used = {}
    for bin_, times in made:
        assert sum(bin_) <= 4096
        for x in bin_:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in made) <= -(-int(lengths.sum()) // 4096) + 3


def test_pieces_have_places_without_gaps(spark, docs_of):
    docs = docs_of([*ODD, (6, "a b c d " * 20000), *[(20 + i, "word " * (i * 37 % 900)) for i in range(200)]])
    rows = packing.packed(docs.selectExpr("*", "1 as length", "2 as _salt"), PATH).collect()
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in rows)
    assert len(at) <= -(-total // 4096) + 2
    long = sorted((r for r in rows if r.doc_id == 6), key=lambda r: (r.piece, r.sequence_id))
    ids = slow_ids("a b c d " * 20000)
    assert len(long) == 2 * -(-len(ids) // 4096)
    for r in long:
        part = ids[r.start : r.start + 4096]
        assert r.start == 4096 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.packed(docs_of([]), PATH).count() == 0
