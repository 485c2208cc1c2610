"""Quality classifier: random-indexing word vectors, pooled over a document, and a two-layer network in numpy.

1. Random indexing. A token falls into one of `buckets` buckets by crc32. Each bucket has a fixed sparse index vector (a
   few +1 and -1); its context vector is the sum of the index vectors of the neighbours of its tokens over all documents.
   A task adds these up for its rows and sends on one compressed table of fixed size; two rounds of sums (salted, then by
   block) give the whole, a table of fixed size.
2. Pooling. A document's features are mean and deviation of its tokens' unit vectors, for words and for marks (upper-case
   letters and punctuation) apart, and the log counts.
3. Training. A hidden layer of tanh units, Adam, on at most `most` labelled documents (a hash sample); a fifth of them is
   set aside to fit the temperature that calibrates the probabilities.

Only the text is read for a score. Defined cases: null or empty text (no tokens) gets the share of good labels; without
labels every score is 0.5; with labels of one kind the score is their value's smoothed share; repeated rows are scored one
by one; other columns are kept as they are, whatever their names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import append, free_name, id_fold, offsets, slices, table, texts, with_fields
from millrace.llm.sampling import labelled_rows, labelled_sample

DIM = 64
BUCKETS = 1 << 14
BLOCKS = 64
NONZERO = 4

_LOWER = bytes(b for b in range(256) if 97 <= b <= 122 or b >= 128)
_TO_WORDS = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TO_MARKS = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def streams(batch_texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words, and of the marks, of some texts; each with the offsets of the texts."""
    out = []
    for words in (
        [t.translate(_TO_WORDS).split() for t in batch_texts],
        [t.translate(_TO_MARKS, _LOWER).split() for t in batch_texts],
    ):
        at = offsets([len(w) for w in words])
        own = np.fromiter((h for w in words for h in map(zlib.crc32, w)), dtype=np.uint32, count=int(at[-1]))
        out.append(((own & np.uint32(BUCKETS - 1)).astype(np.int64), at))
    return out


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], size=places.shape)


def add_contexts(total: np.ndarray, own: np.ndarray, at: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to total (buckets x dim, flat) the index vectors of the left and right neighbours of each token."""
    if len(own) < 2:
        return
    inside = np.ones(len(own), dtype=bool)
    starts = at[:-1]
    inside[starts[starts < len(own)]] = False
    right = np.flatnonzero(inside)
    a, b = own[right - 1], own[right]
    for k in range(NONZERO):
        key = np.concatenate([a * DIM + places[b, k], b * DIM + places[a, k]])
        total += np.bincount(key, weights=np.concatenate([signs[b, k], signs[a, k]]), minlength=len(total)).astype(np.int64)


def _block_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("raw").to_pylist()):
            x = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
            sums[block] = sums[block] + x if block in sums else x
    if sums:
        raws = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(raws, pa.binary())], ["block", "raw"])


def word_vectors(docs: DataFrame, text_col: str = "text", seed: int = 11, fan_in: int = 32) -> np.ndarray:
    """Unit context vectors of all buckets (float32), from all documents; a bucket that never occurs has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = index_vectors(seed)
        total, some = np.zeros(BUCKETS * DIM, dtype=np.int64), False
        for batch in slices(batches, "t"):
            some = True
            for own, at in streams(texts(batch.column(0))):
                add_contexts(total, own, at, places, signs)
        if some:
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(BLOCKS, -1)]
            salt = TaskContext.get().partitionId() % fan_in
            columns = [pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([salt] * BLOCKS, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "raw", "salt"])

    parts = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "block int, raw binary, salt int")
    some = parts.repartition("block", "salt").mapInArrow(_block_sum, "block int, raw binary")
    whole = some.repartition("block").mapInArrow(_block_sum, "block int, raw binary")
    out = np.zeros((BLOCKS, BUCKETS // BLOCKS * DIM))
    for r in whole.collect():  # BLOCKS rows of fixed size
        out[r.block] = np.frombuffer(zlib.decompress(bytes(r.raw)), dtype=np.int64)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(batch_texts: list[bytes], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (float32), and the number of its tokens."""
    n = len(batch_texts)
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    for own, at in streams(batch_texts):
        count = np.diff(at)
        sizes += count
        sums = np.zeros((n, 2, DIM), dtype=np.float64)
        step = 1 << 12
        for a in range(0, len(own), step):
            b = min(len(own), a + step)
            first, last = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b, side="left")
            docs = np.arange(first, last)
            docs = docs[(np.minimum(at[docs + 1], b) > np.maximum(at[docs], a))]
            starts = np.maximum(at[docs], a) - a
            v = vectors[own[a:b]]
            sums[docs, 0] += np.add.reduceat(v, starts, axis=0, dtype=np.float64)
            sums[docs, 1] += np.add.reduceat(v * v, starts, axis=0, dtype=np.float64)
        mean, square = (sums / np.maximum(count, 1)[:, None, None]).transpose(1, 0, 2)
        parts += [mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(count)[:, None] / 10]
    return np.concatenate(parts, axis=1).astype(np.float32), sizes


@dataclass
class Network:
    """x standardised and clipped -> tanh layer -> logit / temperature -> probability."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 30, decay: float = 1e-3, seed: int = 5) -> Network:
    """Fit the network by Adam; the temperature on a fifth of the rows."""
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))), 1.0, float(prior))
    if len(set(y.tolist())) < 2:
        return net
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[own].mean(0), np.maximum(x[own].std(0), 1e-3)
    z = np.clip((x - net.mean) / net.scale, -6, 6).astype(np.float32)
    w = [net.w1, net.b1, rng.normal(0, hidden**-0.5, hidden), np.array([net.b2])]
    m1, m2 = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[at] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3][0], -40, 40)))
            g = (p - y[at]) / len(at)
            back = g[:, None] * w[2] * (1 - h * h)
            grads = [z[at].T @ back + decay * w[0], back.sum(0), h.T @ g + decay * w[2], np.array([g.sum()])]
            step += 1
            for p_, a, b, d in zip(w, m1, m2, grads):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = w[0], w[1], w[2], float(w[3][0])
    if len(held):
        raw, t = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(t > 0, -raw, raw) / k).mean() for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = 20_000) -> Model:
    """Vectors from all of docs; the network from at most `most` labelled rows that `allowed` (a condition on labels) admits."""
    vectors = word_vectors(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            x, _ = pooled(texts(batch.column(0)), vectors)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "y"])

    sample = labelled_sample(labels, label, allowed, most, id_col)
    got = labelled_rows(docs, sample, id_col, text_col).mapInArrow(run, "x binary, y int").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.float32).reshape(got.num_rows, 4 * DIM + 2).astype(np.float64)
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x[:, :3].T, y))  # the same rows give the same model, in whatever order they arrive
    return Model(vectors, train(x[order], y[order]))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> tuple[DataFrame, str]:
    """docs with one more column, the probability of a good document; and the column's name."""
    name = free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            x, sizes = pooled(texts(batch.column(batch.schema.get_field_index(text_col))), model.vectors)
            score = np.where(sizes > 0, model.network.score(x.astype(np.float64)), model.network.prior)
            yield append(batch, [pa.field(name, pa.float64())], [pa.array(score)])

    return docs.mapInArrow(run, with_fields(docs.schema, (name, T.DoubleType()))), name


HELD = (4, 2)  # folds, and the fold whose labels are never learnt from


def _fit(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels, id_fold(F.col("doc_id"), HELD[0]) != HELD[1])


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs with a score of at least `least`."""
    scored, name = add_score(docs, _fit(docs, labels))
    return scored.where(F.col(name) >= least).select(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name = add_score(docs, _fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.7).cast("int").alias("predicted"))
