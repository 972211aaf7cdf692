"""Repeated passages: paragraph MinHash banding with exact Jaccard, and exact runs of words inside paragraphs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomset.llm import common

THRESHOLD = 0.8
SHINGLE = 5
#: Words of the shortest paragraph that counts as a passage, and of an anchor.
MIN_WORDS = 25
#: A run of at least MIN_WORDS + WINDOW - 1 = 50 equal words has an anchor in common wherever it stands.
WINDOW = 26
#: Further centres of a bucket whose members fall into several components, in the first round; each round takes four times as many.
CENTRES = 8
_FILTER_BITS = 24  # of the filter for paragraphs that collide: 2 MB
_CACHE = 300_000
_COUNTERS = 1 << 20  # of shingles, 8 MB
_AT_ONCE = 2048  # shingles whose MinHash values are in memory together

_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_ID = -(1 << 63)


def tune(threshold: float = THRESHOLD, recall: float = 0.999, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest chance collisions, with which a pair at the threshold collides with the given
    probability, for at most `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with that many hashes")
    return best


BANDS, ROWS = tune()


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 3)
        return h


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... up to n at least, modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << max(10, n.bit_length()), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held)
    return held


_POWERS: dict[int, np.ndarray] = {}


@cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def grams(hashes: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of every n words in a row (polynomial in the words' hashes); of all words where there are fewer.

    By running sums: the base is odd, so the power that a run's sum begins with can be divided out.
    """
    m = len(hashes)
    if m < n:
        return (hashes * _powers(int(base), n)[:m]).sum(keepdims=True, dtype=np.uint64) if m else np.empty(0, np.uint64)
    running = np.zeros(m + 1, np.uint64)
    np.cumsum(hashes * _powers(int(base), m)[:m], out=running[1:])
    total = (running[n:] - running[:-n]) * _powers(_inverse(int(base)), m)[: m - n + 1]
    return total ^ (total >> np.uint64(31))


def bands(shingles: np.ndarray, sizes: list[int]) -> list[bytes]:
    """The MinHash band values, 8 bytes each, of lines whose shingles stand one line after the other, `sizes` of each (none of them 0)."""
    a, b = (x[:, None] for x in _permutations())
    first, out = np.concatenate([[0], np.cumsum(sizes)]), np.empty((BANDS * ROWS, len(sizes)), np.uint64)
    done = 0
    while done < len(sizes):
        until = max(done + 1, int(np.searchsorted(first, first[done] + _AT_ONCE, "right")) - 1)
        if until == done + 1:  # maybe a very long line: in parts
            parts = (shingles[at : min(at + _AT_ONCE, first[until])] for at in range(first[done], first[until], _AT_ONCE))
            out[:, done] = np.minimum.reduce([(x * a + b).min(1) for x in parts])
        else:
            np.minimum.reduceat(shingles[first[done] : first[until]] * a + b, first[done:until] - first[done], axis=1, out=out[:, done:until])
        done = until
    low = out.reshape(BANDS, ROWS, len(sizes))
    mixed = np.zeros((BANDS, len(sizes)), np.uint64)
    for i in range(ROWS):
        mixed = (mixed ^ low[:, i]) * _BASE + np.uint64(i)
    raw = np.ascontiguousarray((mixed ^ (mixed >> np.uint64(32))).T, "<u8").tobytes()
    return [raw[i : i + 8 * BANDS] for i in range(0, len(raw), 8 * BANDS)]


def _rolling(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of every `width` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(gram: np.ndarray) -> np.ndarray:
    """Places of the hashes that are least in some WINDOW neighbours (Schleimer et al. 2003, winnowing); of equal neighbours the first.

    A hash is least in a window that it lies in if it equals the greatest of those windows' least hashes.
    """
    if not len(gram):
        return np.empty(0, np.int64)
    wide = min(WINDOW, len(gram))
    low = _rolling(gram, wide, np.minimum)
    padded = np.concatenate([np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)])
    chosen = _rolling(padded, wide, np.maximum) == gram
    chosen[1:] &= gram[1:] != gram[:-1]
    return np.flatnonzero(chosen)


def line_key(words: list[bytes]) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


class Text:
    """The words of a text with their places, and its lines as ranges of words: those with a shingle, and the shorter ones."""

    def __init__(self, text: str, cache_: WordHashes):
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        space = np.concatenate([[True], _SPACE[data], [True]])
        self.start, self.end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        self.words = raw.lower().split()
        self.hashes = np.fromiter(map(cache_.__getitem__, self.words), np.uint64, len(self.words))
        cuts = np.searchsorted(self.start, np.flatnonzero(data == 0x0A))
        bounds = np.unique(np.concatenate([[0], cuts, [len(self.words)]])).tolist()
        lines = list(zip(bounds, bounds[1:]))
        self.lines = [(a, b) for a, b in lines if b - a >= SHINGLE]
        self.short = [(a, b) for a, b in lines if 0 < b - a < SHINGLE]
        if len(raw) != len(text):  # places in code points
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            self.start, self.end = points[self.start], points[self.end]
        self.fives = grams(self.hashes, SHINGLE) if self.lines else None

    def bands(self) -> list[bytes]:
        """Of the lines that have a shingle."""
        if not self.lines:
            return []
        return bands(np.concatenate([self.fives[a : b - SHINGLE + 1] for a, b in self.lines]), [b - a - SHINGLE + 1 for a, b in self.lines])


UNITS = "doc_id long, kind string, start int, end int, words int, k1 long, k2 long, bands binary, fresh boolean"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def units(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The lines of at least `least` words with their bands (null without a shingle), and the anchors, of every whole text. fresh: not an anchor that
    stood before in the same text."""
    common.tune(docs.sparkSession)
    kinds = (pa.int64(), pa.string(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    schema = pa.schema(list(zip([x.split()[0] for x in UNITS.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = WordHashes()
        for batch in batches:
            rows, parts = [], []
            for at, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), common.texts_of(batch))):
                t = Text(text, cache_)
                for (a, b), banded in [*zip(t.lines, t.bands()), *((x, None) for x in t.short)]:
                    if b - a >= least:
                        kind = "paragraph" if b - a >= MIN_WORDS else "line"
                        rows.append((doc_id, kind, int(t.start[a]), int(t.end[b - 1]), b - a, *line_key(t.words[a:b]), banded, True))
                if len(t.hashes) >= MIN_WORDS:
                    gram = grams(t.hashes, MIN_WORDS)
                    places = anchors(gram)
                    fresh = np.zeros(len(places), bool)
                    fresh[np.unique(gram[places], return_index=True)[1]] = True
                    other = grams(t.hashes, MIN_WORDS, _OTHER)[places]
                    parts.append((np.full(len(places), at), t.start[places], t.end[places + MIN_WORDS - 1], gram[places], other, fresh))
            yield from common.batches(rows, schema)
            if parts:
                whose, start, end, k1, k2, fresh = (np.concatenate(x) for x in zip(*parts))
                n = len(whose)
                columns = [batch.column(0).take(pa.array(whose)), pa.array(["anchor"]).take(pa.array(np.zeros(n, np.int32))), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(n, MIN_WORDS, np.int32))]
                columns += [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.nulls(n, pa.binary()), pa.array(fresh)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return _plain(docs).mapInArrow(run, UNITS)


def _colliding(pairs: DataFrame) -> np.ndarray:
    """A bit for each 2^24th of the paragraphs' keys: set where one is in a pair. Its size is fixed; more pairs only let more through."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("p")).distinct()
    place = F.pmod("p", F.lit(1 << _FILTER_BITS))
    words = ends.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(p, {1 << _FILTER_BITS}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros((1 << _FILTER_BITS) // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _shingle_sets(docs: DataFrame, passes: np.ndarray) -> DataFrame:
    """(p, shingles) of the distinct paragraphs that the filter lets through."""
    packed = np.packbits(passes)
    schema = pa.schema([("p", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_, on = WordHashes(), np.unpackbits(packed).astype(bool)
        for batch in batches:
            rows = {}
            for text in common.texts_of(batch):
                for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
                    words = line.split()
                    if len(words) >= SHINGLE and (p := line_key(words)[0]) not in rows and on[p % len(on)]:
                        rows[p] = np.unique(grams(np.fromiter(map(cache_.__getitem__, words), np.uint64, len(words)), SHINGLE)).tobytes()
            yield from common.batches(iter(rows.items()), schema, 256)

    return _plain(docs).mapInArrow(run, "p long, shingles binary").groupBy("p").agg(F.any_value("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of the threshold or more."""
    left, right = sets.select(F.col("p").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("p").alias("b"), F.col("shingles").alias("y"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


_WORDS = [f"b{i}" for i in range(8)]  # of a bitmap of 512 bits
SKETCH = f"struct<n: bigint, {', '.join(f'{w}: bigint' for w in _WORDS)}>"


def _sketches(held: DataFrame) -> DataFrame:
    """(p, sketch): the number of a paragraph's shingles, and a bitmap in which each sets one bit."""
    schema = pa.schema([("p", pa.int64()), ("sketch", pa.struct([(c, pa.int64()) for c in ("n", *_WORDS)]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            bits = np.zeros((len(sets), 64 * len(_WORDS)), np.uint8)
            for row, x in zip(bits, sets):
                row[(x >> np.uint64(40)) % np.uint64(len(row))] = 1
            words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            columns = [pa.array([len(x) for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(_WORDS)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, fields=list(schema.field(1).type))], schema=schema)

    return held.select("p", "shingles").mapInArrow(run, f"p long, sketch {SKETCH}")


def _may_reach(x: Column, y: Column, threshold: float) -> Column:
    """False only where the sketches prove that two sets are below the threshold: bits in which they differ are fewer than shingles in which the sets do
    (a bitmap filter, Sandes et al. 2020)."""
    differ = sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in _WORDS[1:]), F.bit_count(x[_WORDS[0]].bitwiseXOR(y[_WORDS[0]])))
    return differ <= (x["n"] + y["n"]) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


def _prefixes(held: DataFrame, threshold: float) -> DataFrame:
    """(p, key): for each paragraph of `held` (p, shingles) the shingles of which two sets at the threshold must have one in common.

    Prefix filtering (Chaudhuri et al. 2006): with the shingles in one order for all, the first n - ceil(t n) + 1 of n. Rare ones come first, by
    counters of a fixed number, so what unlike paragraphs have in common seldom becomes a key.
    """
    slot = lambda x: x % np.uint64(_COUNTERS)
    counted, keyed = pa.schema([("slot", pa.int64()), ("n", pa.int64())]), pa.schema([("p", pa.int64()), ("key", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(n, slot(np.frombuffer(x, np.uint64)), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], schema=counted)

    told = held.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(_COUNTERS, np.int64)
    order[told.column("slot").to_numpy()] = told.column("n").to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, keys = [], []
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint64)
                n = len(x) - math.ceil(threshold * len(x) - 1e-9) + 1
                keys.append(x[np.lexsort((x, order[slot(x)]))[:n]].view(np.int64))
                who.append(np.full(n, p))
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(keys))], schema=keyed)

    return held.select("p", "shingles").mapInArrow(first, "p long, key long")


def _starred(members: DataFrame) -> DataFrame:
    """(p, key, degree, centres) for members (p, key) of buckets with two or more: the member that collides most over all its buckets, and two by hash."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    multi = common.kept(members.join(sizes, "key"))
    met = multi.join(multi.groupBy("p").agg(F.sum("n").alias("degree")), "p").select("p", "key", "degree")
    by_hash = lambda n: F.min_by("p", F.xxhash64("p", "key", F.lit(n)))
    centres = met.groupBy("key").agg(F.max_by("p", F.struct("degree", "p")).alias("c1"), by_hash(2).alias("c2"), by_hash(3).alias("c3"))
    return common.kept(met.join(centres, "key").select("p", "key", "degree", F.array_distinct(F.array("c1", "c2", "c3")).alias("centres")))


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    return rows.where(F.col("p") != F.col(other)).select(F.least("p", other).alias("a"), F.greatest("p", other).alias("b")).distinct()


def paragraph_links(docs: DataFrame, paragraphs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): keys of different paragraphs at the threshold or more, enough to connect whatever all pairs of each bucket connect."""
    return linked(docs, paragraphs, threshold)[0]


def linked(docs: DataFrame, paragraphs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) of paragraph_links(), and the components (node, root) that they make.

    A bucket's members are compared with three of them and not with each other. One is the member that collides most over all its buckets:
    copies that were each changed on their own are near their original and not each other, and it is the original that they all collide with.
    The others are by hashes of member and bucket. Where members then still fall into several components, those that were no centre go on to
    buckets by the shingles of which similar ones must share one (see _prefixes), in which unlike members part. These are compared in
    the same way, but for pairs whose sketches prove them unlike; then with further centres, CENTRES at first and four times as many each round, until no bucket holds two members of different
    components of which neither was a centre. So no pair that could join components goes unmet.
    """
    keyed = paragraphs.where("bands is not null").select("k1", "bands").groupBy("k1").agg(F.any_value("bands").alias("bands"))
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    members, path = common.write_shared(keyed.select(F.col("k1").alias("p"), "bands", band).select("p", F.xxhash64("band", F.expr("substring(bands, 8 * band + 1, 8)")).alias("key")))
    met = _starred(members)
    common.drop_shared(docs.sparkSession, path)
    with_centres = lambda m: m.select("p", F.explode("centres").alias("c"))
    pairs = common.kept(_pairs(with_centres(met), "c"))
    sets = common.kept(_shingle_sets(docs, _colliding(pairs)))
    links = common.kept(_verified(pairs, sets, threshold))
    roots = common.kept(common.components(links))

    def rooted_of(m: DataFrame, roots: DataFrame) -> DataFrame:
        out = m.join(roots, m.p == roots.node, "left")
        return out.select("p", "key", "degree", F.coalesce("root", "p").alias("root"), F.array_contains("centres", F.col("p")).alias("centre"))

    def open_buckets(rooted: DataFrame) -> DataFrame:
        waiting = F.when(~F.col("centre"), F.col("root"))
        return rooted.groupBy("key").agg(F.min(waiting).alias("r1"), F.max(waiting).alias("r2"), F.max_by("root", F.struct("degree", "p")).alias("main")).where("r1 <> r2").select("key", "main")

    rooted = rooted_of(met, roots)
    waiting = common.kept(rooted.join(open_buckets(rooted), "key").where("not centre").select("p", "root").distinct())
    if waiting.isEmpty():
        return links, roots
    held = common.kept(sets.join(waiting.select("p").distinct(), "p"))
    sketches = common.kept(_sketches(held))
    met = _starred(_prefixes(held, threshold))
    other = sketches.select(F.col("p").alias("c"), F.col("sketch").alias("c_sketch"))
    more = _pairs(with_centres(met), "c").select(F.col("a").alias("p"), F.col("b").alias("c")).join(pairs, [F.col("p") == pairs.a, F.col("c") == pairs.b], "left_anti")
    more = common.kept(_pairs(more.join(sketches, "p").join(other, "c").where(_may_reach(F.col("sketch"), F.col("c_sketch"), threshold)), "c"))
    found = common.kept(_verified(more, sets, threshold))
    pairs, links = pairs.unionByName(more), links.unionByName(found)
    roots, _ = common.joined(roots, found)
    rooted, n = common.kept(rooted_of(met, roots).join(sketches, "p")), CENTRES
    while True:
        split = common.kept(rooted.join(open_buckets(rooted), "key"))
        if split.isEmpty():
            return links, roots
        order = Window.partitionBy("key").orderBy(F.col("root") == F.col("main"), F.desc("degree"), F.xxhash64("p", "key"), "p")
        chosen = common.kept(split.where("not centre").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("key", F.col("p").alias("c"), F.col("root").alias("c_root"), F.col("sketch").alias("c_sketch")))
        more = _pairs(split.join(chosen, "key").where((F.col("root") != F.col("c_root")) & _may_reach(F.col("sketch"), F.col("c_sketch"), threshold)).select("p", "c"), "c")
        more = common.kept(more.join(pairs, ["a", "b"], "left_anti"))
        found = common.kept(_verified(more, sets, threshold))
        pairs, links = pairs.unionByName(more), links.unionByName(found)
        roots, merged = common.joined(roots, found)
        asked = chosen.select("key", F.col("c").alias("p"), F.lit(True).alias("asked"))
        rooted = split.drop("main").join(merged, "root", "left").join(asked, ["key", "p"], "left")
        rooted = rooted.select("p", "key", "degree", "sketch", F.coalesce("to", "root").alias("root"), (F.col("centre") | F.coalesce("asked", F.lit(False))).alias("centre"))
        n *= 4


def repeats(docs: DataFrame, threshold: float = THRESHOLD, least: int = MIN_WORDS) -> DataFrame:
    """One row for each place in `docs` whose passage stands in more than one place (a paragraph) or document (an anchor).

    doc_id, kind, start, end (code points, end exclusive), words, component_id, first_doc_id, places, keep. Paragraphs are lines of at least MIN_WORDS
    words; of kind line are those of `least` up to that. Both are linked where their sets of 5-word shingles (lower case) have a Jaccard similarity of the threshold or more: equal texts
    are one paragraph, the others meet by MinHash bands and are verified exactly, and components are removed but for the place of the smallest
    (doc_id, start). Anchors are runs of MIN_WORDS equal words that stand in several rows' texts, at all their places, chosen by their content, so that any 50 words in a row that
    repeat, wherever in a paragraph, have one in common. Lines without a 5-word shingle meet equal ones only. Null and empty texts and lines under `least` words give none; repeated rows are two
    places, kept or not together since they share id and start; a null id counts as the least, and comes out as null; an empty table gives none.
    """
    found = common.kept(units(docs, least).withColumn("anchored", F.col("kind") == "anchor"))
    lines = found.where("not anchored")
    _, roots = linked(docs, lines, threshold)
    place = F.struct("doc_id", "start")
    classes = lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    rooted = classes.join(roots, classes.k1 == roots.node, "left").withColumn("root", F.coalesce("root", "k1"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("places")).where("places > 1")
    named = rooted.select("k1", "k2", "root").join(groups, "root").select("k1", "k2", F.col("root").alias("component_id"), "first", "places")
    runs = found.where("anchored").groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count_if("fresh").alias("texts"), F.count("*").alias("places"))
    runs = runs.where("texts > 1").select("k1", "k2", F.col("k1").alias("component_id"), "first", "places")
    told = found.drop("bands").join(named.withColumn("anchored", F.lit(False)).unionByName(runs.withColumn("anchored", F.lit(True))), ["k1", "k2", "anchored"])
    back = lambda c: F.nullif(c, F.lit(NO_ID))
    return told.select(
        back(F.col("doc_id")).alias("doc_id"), "kind", "start", "end", "words", "component_id", back(F.col("first.doc_id")).alias("first_doc_id"), "places",
        (place == F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"))).alias("keep"),
    )


CONTEXT = "component_id long, doc_id long, start int, end int, keep boolean, left_words array<long>, right_words array<long>, left_starts array<int>, right_ends array<int>"


def _contexts(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """The anchors' places with the hashes of up to MIN_WORDS words on each side, nearest first, and where those begin or end. A place whose text isn't
    the anchor's (another row with the same id) gives none."""
    common.tune(docs.sparkSession)
    spots = anchors.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).agg(F.collect_set(F.struct("component_id", "start", "keep")).alias("spots"))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2)
    schema = pa.schema(list(zip([x.split()[0] for x in CONTEXT.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = WordHashes()

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, text, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = Text(text or "", cache_)
                signed = t.hashes.view(np.int64)
                gram = grams(t.hashes, MIN_WORDS).view(np.int64) if len(signed) >= MIN_WORDS else signed[:0]
                for spot in held:
                    a = int(np.searchsorted(t.start, spot["start"]))
                    b = a + MIN_WORDS
                    if a < len(gram) and t.start[a] == spot["start"] and gram[a] == spot["component_id"]:
                        low = max(0, a - MIN_WORDS)
                        left, right = signed[low:a][::-1].tolist(), signed[b : b + MIN_WORDS].tolist()
                        yield spot["component_id"], doc_id, spot["start"], int(t.end[b - 1]), spot["keep"], left, right, t.start[low:a][::-1].tolist(), t.end[b : b + MIN_WORDS].tolist()

        for batch in batches:
            yield from common.batches(rows(batch), schema, 256)

    return _plain(docs).join(spots, "doc_id").select("doc_id", "text", "spots").mapInArrow(run, CONTEXT)


def extended(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start, end: the places of anchors that aren't kept, grown on both sides as far as their words equal those beside the kept place.

    Up to MIN_WORDS words a side: a longer run has further anchors there. Two equi-joins, texts by document and places by anchor; a frequent
    anchor's places meet its one kept place, so its rows can be split.
    """
    around = common.kept(_contexts(anchors, docs))
    kept = around.where("keep").groupBy("component_id").agg(F.min(F.struct("doc_id", "start", "left_words", "right_words")).alias("k"))
    met = around.where("not keep").join(kept, "component_id")

    def reach(own: str, other: str) -> Column:
        """How many words from the nearest on are equal: the place of the first pair that isn't."""
        equal = F.zip_with(own, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(equal, False)
        return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")

    left, right = reach("left_words", "k.left_words"), reach("right_words", "k.right_words")
    grown = lambda n, at, own: F.when(n > 0, F.element_at(at, F.greatest(n, F.lit(1)))).otherwise(F.col(own))
    back = F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id")
    return met.select("doc_id", "start", "end", left.alias("l"), right.alias("r"), "left_starts", "right_ends").select(back, grown(F.col("l"), "left_starts", "start").alias("start"), grown(F.col("r"), "right_ends", "end").alias("end"))


def removals(found: DataFrame, least: int = MIN_WORDS, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end: what repeats() doesn't keep of at least `least` words, overlapping and adjoining places as one.

    With `docs`, anchors grow to the whole run that they share with the kept place, so that no words of a removed run stay behind at its ends.
    """
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    gone = found.where(~F.col("keep") & (F.col("words") >= least)).select("doc_id", "start", "end")
    if docs is not None:
        gone = gone.unionByName(extended(found.where("kind = 'anchor'"), docs))
    gone = gone.distinct()
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = gone.withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("start") - 1).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
