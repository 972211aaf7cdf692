"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import common

#: Errors allowed, as a share of an item's normalised characters.
ERROR_RATE = 0.1
#: Items with fewer normalised characters have no budget: they match exactly, as whole words. Others are told from chance with errors too.
MIN_CHARS = 24
#: Characters of benchmark text that one pass over the documents takes: what is sent to the tasks has this bound.
BLOCK_CHARS = 4_000_000

_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normalised(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def cut(item: str, errors: int) -> list[tuple[str, int, list[tuple[int, int, int]]]]:
    """errors + 1 pieces, one of which stands unchanged in any text within the budget: (piece, place, the parts around it).

    A part with a budget of k is halved, with budgets that sum to k - 1: one half or the other keeps its own. So some unchanged
    piece lies in parts (start, end, budget), here from the smallest to the whole item, each of which keeps its budget there.
    """
    out = []

    def halve(start: int, end: int, k: int, around: list[tuple[int, int, int]]) -> None:
        if k == 0:
            out.append((item[start:end], start, around))
            return
        around = [(start, end, k), *around]
        left = (k - 1) // 2
        middle = start + (end - start) * (left + 1) // (k + 1)
        halve(start, middle, left, around)
        halve(middle, end, k - 1 - left, around)

    halve(0, len(item), errors, [])
    return out


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edit distance of the pattern to any substring, first end of such a one), if that is at most `most`.

    Myers 1999, the pattern's rows as the bits of one integer.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    rows: dict[str, int] = {}
    for i, c in enumerate(pattern):
        rows[c] = rows.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = rows.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        grow, fall = down | ~(d | up) & full, up & d
        if grow & top:
            score += 1
        elif fall & top:
            score -= 1
        grow, fall = grow << 1 & full, fall << 1 & full  # a match may start anywhere: nothing enters at row 0
        up, down = fall | ~(x | grow) & full, grow & x
        if score <= most and (best is None or score < best[0]):
            best = score, at + 1
            if score == 0:
                break
    return best


@dataclass
class Items:
    """A block of benchmark items, ready to be searched for."""

    ids: list[int | None]
    texts: list[str]
    rate: float

    def __post_init__(self) -> None:
        self.budget = [int(len(t) * self.rate) if len(t) >= MIN_CHARS else 0 for t in self.texts]
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "texts": self.texts, "rate": self.rate}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def build(self) -> ahocorasick.Automaton:
        where: dict[str, list[tuple[int, int, list[tuple[int, int, int]]]]] = {}
        for i, (text, errors) in enumerate(zip(self.texts, self.budget)):
            for piece, place, around in cut(text, errors):
                where.setdefault(piece, []).append((i, place, around))
        out = ahocorasick.Automaton()
        for piece, uses in where.items():
            out.add_word(piece, (len(piece), uses))
        out.make_automaton()
        return out

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of the best match of each item in a normalised text.

        From each hit of a piece the parts around it are verified, the smallest first, until one is beyond its budget.
        """
        if not self.texts:
            return []
        if self.automaton is None:
            self.automaton = self.build()
        found: dict[int, tuple[int, int]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for i, place, around in uses:
                held = found.get(i)
                if held and held[0] == 0:
                    continue
                item, origin = self.texts[i], last + 1 - size - place
                if len(item) < MIN_CHARS and (text[origin - 1 : origin].isalnum() or text[last + 1 : last + 2].isalnum()):
                    continue  # inside a word
                if origin >= 0 and text.startswith(item, origin):
                    found[i] = 0, origin + len(item)
                    continue
                for start, end, k in around:
                    lo = max(0, origin + start - k)
                    got = myers(item[start:end], text[lo : origin + end + k], k)
                    if got is None:
                        break
                else:
                    if around and (held is None or got[0] < held[0]):
                        found[i] = got[0], got[1] + lo
        return [(i, *x) for i, x in found.items()]


def _blocks(benchmark: DataFrame, rate: float, least: int) -> Iterator[Items]:
    """The distinct normalised items of `least` characters or more, each with its smallest id, in blocks of a bounded size. One block is held at a time."""
    schema = pa.schema([("item_id", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalised(t) for t in common.texts_of(batch)], pa.string())], schema=schema)

    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = plain.mapInArrow(run, "item_id long, item string").where(F.length("item") >= max(1, least))
    items = common.kept(items.groupBy("item").agg(F.min("item_id").alias("item_id")))
    n = -(-(items.agg(F.sum(F.length("item"))).first()[0] or 0) // BLOCK_CHARS)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).orderBy("item").collect()
        yield Items([r["item_id"] for r in rows], [r["item"] for r in rows], rate)


FOUND = "doc_id long, item_id long, distance int, budget int, item_chars int, end_norm int"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = 1) -> DataFrame:
    """One row per document and item that stands in it with at most rate x its length in edits (insert, delete, substitute).

    Both are lower-cased and their white space is made single spaces; a match may start and end anywhere. distance is the least
    one; end_norm the first place after such a match in the normalised text (of several equally near, one of them, the same each time). The benchmark is the query set: it goes to the
    tasks in blocks of at most about BLOCK_CHARS characters, one pass over the documents each. Null and empty texts and
    items match nothing. Items under MIN_CHARS match exactly and as whole words only, those under `least` not at all; items with equal normalised text count once, by the smallest id;
    repeated documents give repeated rows. No shuffle.
    """
    spark = docs.sparkSession
    common.tune(spark)
    names = ("doc_id", "item_id", "distance", "budget", "item_chars", "end_norm")
    schema = pa.schema([(n, pa.int64() if n.endswith("_id") else pa.int32()) for n in names])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], FOUND)

    def searched(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = (
                    (doc_id, items.ids[i], d, items.budget[i], len(items.texts[i]), end)
                    for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_of(batch)) for i, d, end in items.find(normalised(text))
                )
                yield from common.batches(rows, schema)

        return run

    for n, items in enumerate(_blocks(benchmark, rate, least)):
        found = plain.mapInArrow(searched(items), FOUND)
        out = found if n == 0 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """The rows of `docs`, in its columns, in whose text no item is found; rules and odd cases as in matches(). No shuffle."""
    spark = docs.sparkSession
    common.tune(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for items in _blocks(benchmark, ERROR_RATE, least):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not items.find(normalised(t)) for t in common.texts_of(batch)], pa.bool_()))

        out = out.mapInArrow(run, fields)
    return out
