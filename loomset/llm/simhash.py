"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import common

BITS = 64
#: Variants that one bucket expands at a time, and so the memory of a task: 8 bytes each, three times.
BUCKET_VARIANTS = 1 << 21

_SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned. No word: zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, _SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[s:e], _SEED) for s, e in zip(start, end[shingle - 1 :].tolist())), np.uint64, len(start))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # a block at a time: very long texts
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, **keys: Column) -> DataFrame:
    """(doc_id, the given columns of longs, fp): fp is the fingerprint's 64 bits as a signed long. A null text counts as empty."""
    common.tune(docs.sparkSession)
    names = ["doc_id", *keys, "fp"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle) for t in common.texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], schema=schema)

    given = [c.alias(n) for n, c in keys.items()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *given, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _prefix_masks(bits: int, flips: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(bits), n)]


def _suffix_masks(bits: int, flips: int) -> np.ndarray:
    """Masks of exactly `flips` bits among those from `bits` on."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits, BITS), flips)], np.uint64)


def bucket_links(fps: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    """Pairs of one bucket that meet in a variant, as rows (a, b), unsigned.

    The variants of a fingerprint of even weight are those one flip away; of odd weight, itself and those two flips
    away. All variants are odd, and two fingerprints up to three flips apart have one in common: one and two flips when
    their weights differ, one and one when both are even, and when both are odd (two apart) each is a variant of the
    other. In a variant's group the first member is the variant itself if it is a fingerprint, else an even one; every
    other member lies within three flips of it, and a group of odd ones only, without the variant itself, has no link
    that its members' own groups don't have. So a star around the first member keeps all links' connectivity, and a
    group has at most 1 + 64 + 2016 members however many documents there are.
    """
    if len(fps) < 2:
        return np.empty((0, 2), np.uint64)
    fps = np.unique(fps)
    index_bits = max(1, int(len(fps) - 1).bit_length())
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    away = np.bitwise_count((fps & np.uint64((1 << bits) - 1)) ^ np.uint64(bucket)).astype(int)
    inside = (fps & ~np.uint64((1 << bits) - 1)) | np.uint64(bucket)
    tags = np.uint64((1 << (index_bits + 2)) - 1)
    keys = []

    def add(which: np.ndarray, masks: np.ndarray, rank: int) -> None:
        at = np.flatnonzero(which)
        if len(at) and len(masks):
            tag = (at.astype(np.uint64) | np.uint64(rank << index_bits))[:, None]
            keys.append(((((inside[at][:, None] ^ masks[None, :]) * _MIX) & ~tags) | tag).ravel())

    none = np.zeros(1, np.uint64)
    add(odd & (away == 0), none, 0)
    add(odd & (away == 0), _suffix_masks(bits, 2), 2)
    add(odd & (away == 1), _suffix_masks(bits, 1), 2)
    add(odd & (away == 2), none, 2)
    add(~odd & (away == 0), _suffix_masks(bits, 1), 1)
    add(~odd & (away == 1), none, 1)
    if not keys:
        return np.empty((0, 2), np.uint64)
    keys = np.concatenate(keys)
    keys.sort()
    same = (keys[1:] & ~tags) == (keys[:-1] & ~tags)
    if not same.any():
        return np.empty((0, 2), np.uint64)
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    first = keys[np.flatnonzero(np.concatenate([[True], ~same]))]
    later = np.flatnonzero(np.concatenate([[False], same]))
    head = first[group[later]]
    later = keys[later]
    linked = ((head >> np.uint64(index_bits)) & np.uint64(3)) < 2
    index = np.uint64((1 << index_bits) - 1)
    pairs = np.stack([fps[(head[linked] & index).astype(np.int64)], fps[(later[linked] & index).astype(np.int64)]], 1)
    wrong = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) > 3
    if wrong.any():  # two variants with the same key bits: all pairs of that key, of which there are a few
        for key in np.unique(head[linked][wrong] & ~tags):
            at = np.searchsorted(keys, np.array([key, key | tags], np.uint64))
            members = np.unique(fps[(keys[at[0] : at[1] + 1] & index).astype(np.int64)])
            some = np.array(list(combinations(members.tolist(), 2)), np.uint64).reshape(-1, 2)
            pairs = np.concatenate([pairs, some])
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 3]
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) at most `radius` = 3 bits apart; connects all that are linked.

    What is shuffled is a variant's leading bits with the fingerprint: the variants of a fingerprint lie in the buckets
    whose prefix is at most two flips away, and a bucket expands and groups the variants that fall into it. So a
    fingerprint costs some tens of rows of shuffle and not its 1,040 variants. The prefix has as many bits as keep a bucket
    of average size at BUCKET_VARIANTS; the result is the same for any. Pairs are verified by their Hamming distance.
    """
    if radius != 3:
        raise ValueError("the ball's halves are built for a radius of 3")
    spark = fps.sparkSession
    n = fps.count()
    bits = min(30, max(3, math.ceil(math.log2(max(1, n) * 1040 / BUCKET_VARIANTS))))
    near, far = (F.array(*[F.lit(m).cast("long") for m in _prefix_masks(bits, flips)]) for flips in (1, 2))
    prefix = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    dealt = fps.select("fp", F.explode(F.when(F.bit_count("fp") % 2 == 0, near).otherwise(far)).alias("mask")).select(prefix.bitwiseXOR(F.col("mask")).alias("bucket"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        values = group.column("fp").to_numpy().view(np.uint64)
        found = bucket_links(values, int(group.column("bucket")[0].as_py()), bits).view(np.int64)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    common.tune(spark)
    met = dealt.groupBy("bucket").applyInArrow(run, "a long, b long")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _rooted(nodes: DataFrame) -> DataFrame:
    """`nodes`, one row for each fingerprint (column fp), with the root of its component."""
    roots = common.components(links(nodes.select("fp")))
    return nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id, group_rows.

    Texts are lower-cased (A-Z) and split at white space (\\x20, \\x09-\\x0D); the fingerprint is the majority of the
    XXH64 of the 3-word shingles. Fingerprints at most three bits apart are linked; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and are linked like any other; a null doc_id gets a row, never
    becomes a component's id unless all of the component's are null. Repeated rows stay. An empty table gives none.
    Copies count as one fingerprint before anything is paired.
    """
    marked = common.kept(fingerprints(docs, shingle))
    nodes = common.kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    rooted = _rooted(nodes)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("group_rows"))
    named = common.kept(rooted.join(ids, "root").select("fp", "component_id", "group_rows"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "group_rows")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Exactly one row of each group, in the columns of `docs`: that of the smallest doc_id, null last, and of rows that share it one by content.

    A row is known by a 128-bit hash of its id and all its columns (nulls marked, since the hash skips them), so rows without an id or
    with the same one are decided by their own groups. The least row of each fingerprint is found before components are; rows meet
    their group's decision, and their exact repeats, in one shuffle by that hash.
    """
    names = ["_kept_a", "_kept_b"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    known = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]  # Spark can't hash maps
    a, b = (F.xxhash64(F.lit(n), *[c.isNull() for c in known], *known) for n in range(2))
    marked = common.kept(fingerprints(docs, a=a, b=b))
    nodes = common.kept(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "a", "b")).alias("row")))
    first = _rooted(nodes).groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.a").alias(names[0]), F.col("row.b").alias(names[1]))
    keyed = docs.withColumns(dict(zip(names, (a, b))))
    return keyed.join(first, names, "left_semi").dropDuplicates(names).select(*docs.columns)
