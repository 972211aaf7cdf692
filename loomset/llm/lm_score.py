"""Language-model scores: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import common

ADD = 0.1
#: Tokens with at least a HEAD-th of all are sent to every task: there can be no more than HEAD of them.
HEAD = 1 << 20
#: A class is LEVELS digits of WAYS values. The OWN most frequent tokens have the even classes, one each; all others, unseen ones included, share the odd ones by hash.
WAYS, LEVELS = 8, 5
CLASSES = WAYS**LEVELS
OWN = CLASSES // 2
#: Rounds of training by their tenths of the training documents, together all.
ROUNDS = (3, 7)
FEATURES = 3
ROWS = 1 << 16  # of weights, for each digit
STEP = 0.5  # of a round, in logarithms
PRIOR_COUNT = 4.0  # added to what is observed and expected: a row that few tokens meet moves little
_BOUND = 20.0  # of a weight
_BLOCKS = 64  # pieces of a digit's weights in which tasks hand over their sums
_SCALE = 1024.0  # sums are handed over as half floats of this unit
_FLUSH = 1 << 25  # tokens after which a task hands over its sums
_MERGED = 256  # tasks whose sums are added up together
_CHUNK = 1 << 17  # tokens that are scored or learned from at once
_COUNTED = 400_000  # distinct tokens that a task counts before it hands them on
_OTHERS = 1 << 20  # numbers of tokens without a class of their own

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at \\x20 and \\x09-\\x0D; the end, b"", comes last."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    return words


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over the texts of `docs`. Tasks count in a bounded dictionary, so a token is shuffled about once a task."""
    common.tune(docs.sparkSession)
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            tokens, n = list(held), list(held.values())
            for at in range(0, len(tokens), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at : at + (1 << 16)], pa.binary()), pa.array(n[at : at + (1 << 16)], pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for text in common.texts_of(batch):
                held.update(words_of(text))
            if len(held) > _COUNTED:
                yield from out()
        yield from out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """The head's counts and places by frequency, corpus totals, the classes' counts, and learned weights."""

    place: dict[bytes, int]
    count: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray  # by class: what a token of it divides its smoothed count by
    priors: list[np.ndarray]  # by level, node and digit: logarithms of the classes' shares
    weights: np.ndarray  # by level, row and digit

    @property
    def base_log(self) -> float:
        return math.log10(self.total + ADD * (self.distinct + 1))


def _priors(mass: np.ndarray) -> list[np.ndarray]:
    out, which = [], np.arange(CLASSES)
    for level in range(LEVELS):
        nodes = WAYS**level
        shares = np.bincount(_digit(which, level) * nodes + which % nodes, mass, nodes * WAYS).reshape(WAYS, nodes).T
        whole = shares.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(whole > 0, np.log(shares / whole), -math.log(WAYS))
        out.append(np.ascontiguousarray(np.maximum(logs, -1e4), np.float32))
    return out


def build(counts: DataFrame) -> Model:
    """Totals, the head and the classes' counts, and a model without weights: its score is that of the class-factored unigrams."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.col("n") * HEAD >= total).toArrow() if total else counts.limit(0).toArrow()
    pairs = sorted(zip(head.column("token").to_pylist(), head.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    place = {t: i for i, (t, _) in enumerate(pairs)}
    count = np.array([n for _, n in pairs], np.float64)
    shared = counts.groupBy(F.pmod(F.crc32("token"), F.lit(OWN)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    tokens, kinds = np.zeros(OWN), np.zeros(OWN)
    tokens[shared.column("c").to_numpy()], kinds[shared.column("c").to_numpy()] = shared.column("n").to_numpy(), shared.column("v").to_numpy()
    own = pairs[:OWN]
    for t, n in own:
        c = zlib.crc32(t) % OWN
        tokens[c] -= n
        kinds[c] -= 1
    mass = np.zeros(CLASSES)
    mass[: 2 * len(own) : 2] = count[: len(own)] + ADD
    mass[1::2] = tokens + ADD * (kinds + 1)
    return Model(place, count, int(total), int(distinct), mass, _priors(mass), np.zeros((LEVELS, ROWS, WAYS), np.float32))


class Ids:
    """Places of tokens in the head (-1 beyond it), and their numbers: the place of those with a class of their own, from OWN on one by hash."""

    def __init__(self, model: Model):
        self.get = model.place.get
        self.numbers = np.arange(len(model.place))
        self.numbers[OWN:] = [OWN + zlib.crc32(t) % _OTHERS for t, i in model.place.items() if i >= OWN]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        places = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        beyond = np.flatnonzero(places < 0)
        numbers = np.take(self.numbers, places) if len(self.numbers) else np.empty(len(places), np.int64)
        if len(beyond):
            crc = zlib.crc32
            numbers[beyond] = np.fromiter([crc(words[i]) for i in beyond.tolist()], np.int64, len(beyond)) % _OTHERS + OWN
        return places, numbers


def classes(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers < OWN, 2 * numbers, 2 * (numbers % OWN) + 1)


def _digit(which: np.ndarray, level: int) -> np.ndarray:
    return which // WAYS**level % WAYS


def histories(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens of some documents and, for each, its feature hashes (a line for each feature): the word before, the two before,
    and the one before the last (a skip)."""
    parts = [np.concatenate([np.array([-1, -2]), d]) for d in docs]
    line = np.concatenate(parts) if parts else np.empty(0, np.int64)
    starts = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.empty(0, np.int64)
    inside = np.ones(len(line), bool)
    inside[starts], inside[starts + 1] = False, False
    at = np.flatnonzero(inside)
    one, two = line[at - 1].astype(np.uint64), line[at - 2].astype(np.uint64)
    hashes = np.stack([one * _P1, (one * _P2) ^ (two * _P3) + _P1, two * _P2 + _P3])
    return line[at], hashes ^ (hashes >> np.uint64(29))


def _level(model: Model, level: int, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At one digit: the rows of the features (a row belongs to a feature and the digits before), the digits, and the exponents of all its values."""
    node = which & (WAYS**level - 1)
    rows = (((hashes + node.astype(np.uint64) * _P3) * _P2) >> np.uint64(48)).astype(np.int64)
    z = np.take(model.priors[level], node, axis=0)
    for r in rows:
        z += np.take(model.weights[level], r, axis=0)
    return rows, (which >> (3 * level)) & (WAYS - 1), z


_ONES = np.ones(WAYS, np.float32)


def log10_classes(model: Model, which: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log10 of each token's class given its history."""
    out = np.zeros(len(which))
    for at in range(0, len(which), _CHUNK):
        some = slice(at, at + _CHUNK)
        for level in range(LEVELS):
            _, digits, z = _level(model, level, which[some], hashes[:, some])
            own = np.take(z.ravel(), np.arange(0, z.size, WAYS) + digits)
            np.exp(z, out=z)
            out[some] += own - np.log(z @ _ONES)
    return out * math.log10(math.e)


class Sums:
    """What a task adds up for a round: how often a row's digits are observed, and how often the model expects them. Their difference is the gradient."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.observed = np.zeros((LEVELS, WAYS * ROWS), np.int64)
        self.expected = np.zeros((LEVELS, WAYS, ROWS))
        self.tokens = 0

    def add(self, which: np.ndarray, hashes: np.ndarray) -> None:
        for at in range(0, len(which), _CHUNK):
            some = slice(at, at + _CHUNK)
            for level in range(LEVELS):
                rows, digits, p = _level(self.model, level, which[some], hashes[:, some])
                self.observed[level] += np.bincount((rows + digits * ROWS).ravel(), minlength=WAYS * ROWS)
                np.exp(p, out=p)
                p *= (1 / (p @ _ONES))[:, None]
                columns = np.ascontiguousarray(p.T, np.float64)
                for k in range(WAYS - 1):
                    for r in rows:
                        np.add.at(self.expected[level, k], r, columns[k])
        self.tokens += len(which)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """By block: the observed and the expected counts of its rows. The last digit's expected count is what the others leave."""
        size = ROWS // _BLOCKS
        for level in range(LEVELS):
            observed = self.observed[level].reshape(WAYS, ROWS)
            self.expected[level, -1] = np.maximum(observed.sum(0) - self.expected[level, :-1].sum(0), 0)
            both = np.stack([observed, self.expected[level]]) / _SCALE
            for b in range(_BLOCKS):
                part = both[:, :, b * size : (b + 1) * size]
                if part.any():
                    yield level * _BLOCKS + b, part.astype(np.float16).tobytes()
        self.clear()


def _summed(sums: DataFrame, kind: str, by: tuple[str, ...]) -> DataFrame:
    schema = pa.schema([*((c, pa.int64()) for c in by), ("v", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        total = 0.0
        for v in group.column("v"):
            total = total + np.frombuffer(v.as_py(), kind).astype(np.float64)
        return pa.Table.from_pydict({c: [group.column(c)[0].as_py()] for c in by} | {"v": [total.astype(np.float32).tobytes()]}, schema=schema)

    return sums.groupBy(*by).applyInArrow(run, ", ".join([*(f"{c} long" for c in by), "v binary"]))


def train(docs: DataFrame, model: Model, rounds: tuple[int, ...] = ROUNDS) -> Model:
    """Every round: tasks add up the gradient over another share of the documents, all at the same weights, and the weights take one step. All
    documents are learned from once.

    The gradient of a weight is the observed less the expected count of its row and digit, and the step is scaled by both, as in iterative
    scaling: STEP times the logarithm of their quotient, PRIOR_COUNT added to each. What is learned depends on the documents alone and not
    on how they are dealt to tasks. Sums are added up by block in two steps, so that no group grows with the number of tasks beyond _MERGED-ths;
    the driver gets one set of weights, whose size is fixed.
    """
    common.tune(docs.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("v", pa.binary())])

    def learner(shared: Model) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            ids, sums, task = Ids(shared), Sums(shared), TaskContext.get().partitionId() // _MERGED
            for batch in common.small(batches):
                numbers, hashes = histories([ids.of(words_of(t))[1] for t in common.texts_of(batch)])
                sums.add(classes(numbers), hashes)
                if sums.tokens > _FLUSH:
                    yield from common.batches(((b, task, v) for b, v in sums.blocks()), schema, 64)
            yield from common.batches(((b, task, v) for b, v in sums.blocks()), schema, 64)

        return run

    tenth, first = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(sum(rounds))), 0
    for share in rounds:
        own = docs.where((tenth >= first) & (tenth < first + share)).select(F.col("text").cast("string").alias("text"))
        first += share
        parts = own.mapInArrow(learner(model), "block long, task long, v binary")
        whole = _summed(_summed(parts, "<f2", ("block", "task")).select("block", "v"), "<f4", ("block",)).toArrow()
        weights, size = model.weights.copy(), ROWS // _BLOCKS
        for block, v in zip(whole.column("block").to_pylist(), whole.column("v")):
            observed, expected = _SCALE * np.frombuffer(v.as_py(), np.float32).astype(np.float64).reshape(2, WAYS, size) + PRIOR_COUNT
            weights[block // _BLOCKS, block % _BLOCKS * size : (block % _BLOCKS + 1) * size] += (STEP * np.log(observed / expected)).T
        model = replace(model, weights=np.clip(weights, -_BOUND, _BOUND))
    return model


_SUMS = "n_tokens long, known long, base double, model double"


def _first_pass(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document with what the head and the model tell (column sums), and a row for each of its distinct tokens beyond the head.

    The document's own row has a token with a blank, which no token has, and which is spread by its content.
    """
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    inner = pa.struct(list(zip([x.split()[0] for x in _SUMS.split(", ")], kinds)))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("token", pa.binary()), ("tf", pa.int64()), ("sums", inner)])
    logs, mass = np.log10(model.count + ADD), np.log10(np.maximum(model.mass, 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(model)
        for batch in common.small(batches):
            words = [words_of(t) for t in common.texts_of(batch)]
            found = [ids_of.of(w) for w in words]
            numbers, hashes = histories([n for _, n in found])
            which = classes(numbers)
            modelled = log10_classes(model, which, hashes) - np.take(mass, which)
            tokens, times, n_rest, sums = [], [], [], []
            at = 0
            for own, (places, _), h in zip(words, found, batch.column(1).to_pylist()):
                head = np.take(logs, places[places >= 0]).sum()
                tail = Counter([own[i] for i in np.flatnonzero(places < 0).tolist()])
                n = len(places)
                sums.append((n, n - tail.total(), head - model.base_log * n, modelled[at : at + n].sum() + head))
                at += n
                n_rest.append(len(tail))
                tokens.append(b" %d" % h)
                tokens.extend(tail)
                times.append(0)
                times.extend(tail.values())
            each = np.array(n_rest) + 1
            first = np.cumsum(each) - each
            whose = pa.array(np.repeat(np.arange(len(each)), each))
            told = np.full(len(tokens), -1)
            told[first] = np.arange(len(each))
            per_doc = pa.StructArray.from_arrays([pa.array(np.array(c), k) for c, k in zip(zip(*sums), kinds)], fields=list(inner))
            columns = [batch.column(0).take(whose), batch.column(1).take(whose), pa.array(tokens, pa.binary()), pa.array(times, pa.int64()), per_doc.take(pa.array(told, mask=told < 0))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, h long, token binary, tf long, sums struct<{_SUMS.replace(' ', ': ').replace(',:', ',')}>")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of `docs`.

    Counts of the head are in the model; other tokens meet theirs in a join by token, of which none has more than a HEAD-th of
    all rows, and a document's parts meet by its id and text. Repeated rows (same id and text) come out as often as they went in.
    """
    common.tune(docs.sparkSession)
    rare = counts.where(F.col("n") * HEAD < model.total).select("token", "n")
    met = _first_pass(docs, model).join(rare, "token", "left")
    c = F.coalesce("n", F.lit(0))
    parts = met.groupBy("doc_id", "h").agg(
        F.count("sums").alias("copies"), F.sum("sums.n_tokens").alias("n_tokens"), F.sum(F.coalesce("sums.known", F.when(c > 0, F.col("tf")).otherwise(0))).alias("known"),
        F.sum(F.col("tf") * F.log10(c + F.lit(ADD))).alias("tail"), F.sum("sums.base").alias("base"), F.sum("sums.model").alias("model"),
    )
    each = lambda x: x / F.col("copies")
    out = parts.select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"), each(F.col("n_tokens")).cast("long").alias("n_tokens"), each(F.col("known")).cast("long").alias("n_known"),
        each(F.col("base") + F.col("tail")).alias("base_score"), each(F.col("model") + F.col("tail")).alias("score"),
    )
    return out.drop("_copy")


def held_out(doc_id: Column) -> Column:
    return F.pmod(common.id_crc(doc_id), F.lit(10)) == 0


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Learns from the whole texts of all rows that aren't held out: counts of all their tokens, and one pass of gradient steps.
    score is the log10 probability of the text and its end: of each token's class, digit by digit, given the words before, and of the token
    among those of its class by smoothed counts, where each shared class keeps a place for tokens that weren't seen. So it is normalised over
    all tokens, whatever the size of the table.
    Null and empty texts have one token, the end; a null id counts as empty text for its hash; an empty table gives none.
    """
    learned = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = common.kept(count_tokens(learned))
    model = train(learned, build(counts))
    out = score(docs, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
