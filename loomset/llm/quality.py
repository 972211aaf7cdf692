"""Quality: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import common

#: Labelled rows that are learned from at most, in expectation: where there are more, a share of them chosen by hash.
MAX_LABELLED = 20_000
BUCKETS = 4096  # words share a learned vector by hash
SHAPES = 256
WIDTH = 64
HIDDEN = 32
_WINDOW = 2
_CACHE = 200_000  # words that a task remembers

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_ASCII = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+")
_FOREIGN = re.compile(r"[^\x00-\x7f]")


def _place(word: bytes) -> int:
    """bucket * SHAPES + shape of a word. The shape: letters, digits and signs with runs collapsed, the last six."""
    text = _FOREIGN.sub(lambda m: "X" if m[0].isupper() else "x", word[-24:].decode("utf-8", "replace").translate(_ASCII))
    shape = _RUNS.sub(r"\1", text)[-6:]
    return zlib.crc32(word.lower()) % BUCKETS * SHAPES + zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES


class Places(dict):
    """Remembers the places of words, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = place = _place(word)
        return place

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()), np.int64)


def index_vectors(n: int, seed: int, ones: int = 4) -> np.ndarray:
    """Sparse ternary index vectors: each of n things has `ones` places with +1 or -1, drawn from its seed."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((n, WIDTH), np.float32)
    for _ in range(ones):
        rows[np.arange(n), rng.integers(0, WIDTH, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return rows


_BUCKET_INDEX = index_vectors(BUCKETS, 1)
_SHAPE_INDEX = index_vectors(SHAPES, 2)
_RELATION_INDEX = index_vectors(2 * _WINDOW + 2, 3)


def contexts(places: np.ndarray, into: np.ndarray) -> None:
    """Adds to each word's vector the index vectors of its neighbours: their words, their shapes, and whether they are the word itself."""
    bucket, shape = places // SHAPES, places % SHAPES
    for away in range(1, _WINDOW + 1):
        if len(places) <= away:
            break
        for here, there, relation in ((slice(None, -away), slice(away, None), away), (slice(away, None), slice(None, -away), away + _WINDOW)):
            vectors = _BUCKET_INDEX[bucket[there]] + _SHAPE_INDEX[shape[there]]
            same = places[here] == places[there]
            vectors[same] += 2 * _RELATION_INDEX[relation]
            np.add.at(into, bucket[here], vectors)


def pooled(places: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's vector: the means of its words' learned vectors and of their shapes' and repetitions' index vectors, and its length."""
    out = np.zeros(3 * WIDTH + 1, np.float32)
    n = len(places)
    if n:
        words, count = np.unique(places, return_counts=True)
        share = (count / n).astype(np.float32)
        out[:WIDTH] = share @ vectors[words // SHAPES]
        out[WIDTH : 2 * WIDTH] = share @ _SHAPE_INDEX[words % SHAPES]
        repeats = np.array([(places[a:] == places[:-a]).mean() if n > a else 0.0 for a in range(1, _WINDOW + 1)], np.float32)
        out[2 * WIDTH : 3 * WIDTH] = repeats @ _RELATION_INDEX[1 : _WINDOW + 1] + len(words) / n * _RELATION_INDEX[0]
        out[3 * WIDTH] = np.log1p(n)
    return out


@dataclass
class Model:
    """vectors: of words, by bucket; the network's weights; prior where there was nothing to learn."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        z = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -60, 60).astype(np.float64)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Two layers by Adam on four fifths of the rows; the temperature by the log-likelihood of the rest."""
    wide = x.shape[1] if x.ndim == 2 else 3 * WIDTH + 1
    rng = np.random.default_rng(7)
    w1, w2 = rng.normal(0, wide**-0.5, (wide, HIDDEN)), rng.normal(0, HIDDEN**-0.5, HIDDEN)
    parts = [w1, np.zeros(HIDDEN), w2, np.zeros(1)]
    model = Model(vectors, np.zeros(wide), np.ones(wide), *parts[:3], 0.0, 1.0, None)
    if len(y) == 0 or y.min() == y.max():
        model.prior = float((y.sum() + 1) / (len(y) + 2))
        return model
    order = rng.permutation(len(y))
    held, learned = order[: len(y) // 5], order[len(y) // 5 :]
    if len(np.unique(y[learned])) < 2 or len(held) < 20:
        held, learned = order, order
    mean, scale = x[learned].mean(0), x[learned].std(0) + 1e-3
    x = (x - mean) / scale
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        rng.shuffle(learned)
        for at in range(0, len(learned), 128):
            some = learned[at : at + 128]
            h = np.tanh(x[some] @ parts[0] + parts[1])
            d = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -60, 60))) - y[some]) / len(some)
            back = np.outer(d, parts[2]) * (1 - h * h)
            grads = [x[some].T @ back + decay * parts[0], back.sum(0), h.T @ d + decay * parts[2], d.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(parts, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, t = np.tanh(x[held] @ parts[0] + parts[1]) @ parts[2] + parts[3], y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(t > 0, -z, z) / g).mean() for g in grid]
    return Model(vectors, mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]), float(grid[int(np.argmin(loss))]), None)


def _sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and y of the labelled rows that are learned from. The labels are bounded before they meet the texts, so they are broadcast."""
    held = F.pmod(common.id_crc(F.col("doc_id")), F.lit(4)) == 2
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where(F.col("q").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    y = clean.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    n = y.count()
    if n > most:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < int((1 << 20) * most / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(y), "doc_id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Learns from at most about `most` labelled rows outside the held-out quarter, chosen by a hash of their ids.

    Executors gather the words' context vectors from those rows' texts, summed by bucket in a shuffle; the driver gets the
    BUCKETS x WIDTH sums, and then a pooled vector of each row. Without labels of both kinds the model is a constant.
    """
    spark = docs.sparkSession
    common.tune(spark)
    sample = common.kept(_sampled(docs, labels, most))
    vector = pa.list_(pa.float32())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = np.zeros((BUCKETS, WIDTH), np.float32), Places()
        for batch in batches:
            for text in common.texts_of(batch):
                contexts(places.of(text), total)
        touched = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(touched), pa.array(list(total[touched]), vector)], names=["bucket", "v"])

    parts = sample.select("text").mapInArrow(gather, "bucket long, v array<float>")
    sums = parts.select("bucket", F.posexplode("v").alias("at", "x")).groupBy("bucket", "at").agg(F.sum("x").alias("x"))
    vectors = np.zeros((BUCKETS, WIDTH), np.float32)
    got = sums.toArrow()
    vectors[got.column("bucket").to_numpy(), got.column("at").to_numpy()] = got.column("x").to_numpy()
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            rows = [pooled(places.of(t), vectors).tolist() for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, vector)], names=["y", "x"])

    rows = sample.mapInArrow(pool, "y int, x array<float>").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("x").combine_chunks().flatten(), np.float64).reshape(len(y), -1) if len(y) else np.zeros((0, 3 * WIDTH + 1))
    order = np.lexsort((*x.T[:3], y))  # the order in which rows arrive is not fixed
    return fit_network(x[order], y[order], vectors)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of `docs`, and quality_score: the probability of label 1, from the whole text alone.

    Null and empty texts are scored as texts without words; repeated rows, null ids, extra columns and empty tables pass
    through; a column quality_score is replaced. One pass, no shuffle; what tasks share is the model, about 1 MB.
    """
    common.tune(docs.sparkSession)
    plain = docs.drop("quality_score") if "quality_score" in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            x = np.array([pooled(places.of(t), model.vectors) for t in common.texts_of(batch)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, "quality_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, quality_score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fits and scores: the columns of `docs`, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    taken = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "quality_score")]
    return scored.select(
        *taken, (F.pmod(common.id_crc(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
