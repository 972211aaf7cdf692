"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomset.llm import common

CAPACITY = 4096
END = 1
_CACHE, _CACHE_BYTES = 200_000, 8_000_000  # words that a task remembers, and bytes of their ids
_SALTS = 4096  # parts of the pieces of one length that are numbered apart


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?*%$&#|]*)")
#: Words on which the short way must give what the tokenizer gives, or it isn't used.
_PROBES = ("The", "the.", "ÉCOLE,", "straße!!", "a", "AndANothEr***", "ciónque;", "x%%%", "Größe?", "ththeon|", "ÿÿ$$$", "don.", "s,", "re:", "qqqzzzxx&&&")


class Tokens:
    """Token ids of texts by a tokenizer file whose tokens never cross ASCII white space.

    A text is split there and each word's ids are remembered, since words repeat; what has one of the tokenizer's special
    strings is left to the tokenizer. Where the tokenizer lower-cases and parts letters from signs, which is tried with
    _PROBES, a word of Latin-1 letters and signs after them is looked up as the two, and new letters go straight to the model.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.room = 0
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha() and c == c.lower()]
        self.spelling = str.maketrans({c: spelled.pre_tokenize_str(c)[0][0] for c in letters})
        self.short = True
        self.short = all(self._new(w) == self._ids(w) for w in _PROBES)
        self.cores.clear()

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, word: str) -> bytes:
        found = _PLAIN.fullmatch(word) if self.short else None
        if not found:
            return self._ids(word)
        core, signs = found[1].lower(), found[2]
        ids = self.cores.get(core)
        if ids is None:
            spelled = core if core.isascii() else core.translate(self.spelling)
            ids = self.cores[core] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            self.room += len(ids)
        if signs:
            more = self.cores.get(signs)
            if more is None:
                more = self.cores[signs] = self._ids(signs)
            ids += more
        return ids

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE or self.room > _CACHE_BYTES:
            self.known, self.room = {}, 0
        if len(self.cores) > _CACHE:
            self.cores = {}
        split = [None if any(s in t for s in self.special) else _words(t) for t in texts]
        for word in {w for words in split if words for w in words}.difference(self.known):
            self.known[word] = ids = self._new(word)
            self.room += len(ids)
        get = self.known.__getitem__
        return [self._ids(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]


_SPLIT = re.compile("[ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _words(text: str) -> list[str]:
    """Split at ASCII white space only. str.split() also splits at other white space, where a tokenizer may look across."""
    return [w for w in _SPLIT.split(text) if w] if _OTHER_SPACE.search(text) else text.split()


@cache
def _tokens(path: str) -> Tokens:
    """One for a worker's life: what it remembers serves its later tasks."""
    return Tokens(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: its ids and an end, cut only where there are more than `capacity`. Null texts count as empty."""
    common.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _tokens(tokenizer), np.array([END], "<u4").tobytes()
        for batch in common.small(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.batch(common.texts_of(batch))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield from common.batches(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used at most as often as it is there, whose sum is the greatest that is at most `room`.

    Subset sums as the bits of one integer, by decreasing length and by powers of two of each length's copies; the sums before
    each step are kept to walk back from the greatest.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen += [length] * take
            best -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many bins are filled so).

    Minimum bin slack: each bin gets the longest length left and then the fullest feasible combination of the others. A
    combination is taken as often as its lengths allow, so the plan depends on how many lengths there are, at most
    `capacity`, and not on how many pieces.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    done = []
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items() if n > (x == longest)}
        bin_ = (longest, *sorted(fullest(rest, capacity - longest), reverse=True))
        use = {x: bin_.count(x) for x in set(bin_)}
        times = min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        done.append((bin_, times))
    return done


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, list[int]]]]:
    """By length, in order: (first number of a piece of that length, first sequence, pieces of it in a bin, their offsets)."""
    out: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    sequence, used = 0, {}
    for lengths, times in plan_:
        at, offsets = 0, {}
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            out.setdefault(x, []).append((used.get(x, 0), sequence, len(places), places))
            used[x] = used.get(x, 0) + len(places) * times
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to `capacity`.

    The driver gets the number of pieces of each length (at most `capacity` numbers) and plans with those. Pieces of one
    length are alike to the plan, so they only need numbers: within a part by hash (a window over a bounded share of any
    length, however many copies it has) after the parts before it. Empty tables give none; repeated rows get places of their own.
    """
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(_SALTS)))
    held = common.kept(salted)
    sizes = common.kept(held.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    by_length = slots(plan(counts, capacity))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = held.withColumn("_at", F.row_number().over(order) - 1).join(before, ["length", "_salt"])
    numbered = numbered.select(*parts.columns, (F.col("_at") + F.col("_before")).alias("_number"))
    starts = {x: [s[0] for s in rows] for x, rows in by_length.items()}
    lengths_at = parts.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, number in zip(batch.column(lengths_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                first, base, each, places = by_length[length][bisect_right(starts[length], number) - 1]
                sequence.append(base + (number - first) // each)
                offset.append(places[(number - first) % each])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of `docs` with their places; see pieces() and pack(). Null ids and extra columns change nothing."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
