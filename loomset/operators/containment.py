"""Containment joins: a set of needles against a large table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of needles that go to the tasks at a time. More are searched for in several passes.
BLOCK_BYTES = 8_000_000


def contained_in(needles: DataFrame, texts: DataFrame, needle: str, text: str, fold: bool = False) -> DataFrame:
    """Pairs (text row, needle row) where the text has the needle; null and empty needles stand in none.

    One automaton over a block of needles reads each text once, so time doesn't grow with the number of needles as comparing all
    pairs would. The needles' size is measured, and bounds each block that is sent out. No shuffle.
    """
    import ahocorasick

    held = needles.where(F.coalesce(needle, F.lit("")) != "")
    size = held.agg(F.coalesce(F.sum(F.octet_length(needle)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    low = str.lower if fold else str
    at = texts.columns.index(text)
    names = [*texts.columns, *held.columns]
    schema = T.StructType([*texts.schema.fields, *held.schema.fields])
    out = None
    for b in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64(needle), F.lit(blocks)) == b)
        table = part.toArrow().combine_chunks()
        words = [low(x) for x in table.column(needle).to_pylist()]

        def run(batches: Iterator[pa.RecordBatch], table: pa.Table = table, words: list[str] = words) -> Iterator[pa.RecordBatch]:
            places: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            found = ahocorasick.Automaton()
            for w in places:
                found.add_word(w, w)
            found.make_automaton()
            if not words:
                return
            for batch in batches:
                pairs = [(r, i) for r, x in enumerate(batch.column(at).to_pylist()) if x for w in dict.fromkeys(w for _, w in found.iter(low(x))) for i in places[w]]
                if pairs:
                    left, right = (pa.array(x, pa.int64()) for x in zip(*pairs))
                    some = table.take(right).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*(c.take(left) for c in batch.columns), *some.columns], names=names)

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
