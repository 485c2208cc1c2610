"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words of the text with A-Z in lower case, and one end. A token has a class: the `top` most frequent words and the
end are classes of their own, any other word falls into one of `shapes` classes by its last two bytes. The model is

    P(token | two tokens before) = P(class | classes of the two before) * P(word | class)

The first factor is log-bilinear (Mnih and Hinton): the context vector is the sum of the two classes' vectors, each times
the weights of its position; its product with a class's output vector, plus a bias, is the log weight of the class, and
batched matrix products give the sum over all classes. The second is (count + 1) / (class tokens + class words + 1).

1. Counts of all words of the training documents: summed in each task, then by word. Words above a count that at most
   `frequent` words reach are given to the tasks, so most tokens need no join.
2. Training (Mnih and Teh, 2012): a short start on a bounded sample (`pilot` texts, `pilot_bytes`), then each task goes over all its training tokens from
   there, and the parameters are averaged by tokens (Zinkevich et al., 2010). A task sends on one set of parameters, of
   fixed size, whatever its rows; two rounds of sums (salted, then whole) add them up.
3. Scoring: a task sums a document's terms for the frequent words, and lists its other words; these meet their counts in a
   join by word, which gives the rest of the sums.

Defined cases: null or empty text is one end token; a null id is scored but not learnt from; repeated rows are scored one
by one; without training documents counts are zero and the model knows nothing but its classes; other columns are ignored."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import id_fold, offsets, slices, table, texts
from millrace.session import materialize

END = b"\n"  # no word holds white space
LN10 = float(np.log(10))


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


@dataclass
class Classes:
    """Classes 0.. of the top words and the end, then of the shapes; `start` stands before a text."""

    own: dict[bytes, int]
    shapes: int

    @property
    def number(self) -> int:
        return len(self.own) + self.shapes

    @property
    def start(self) -> int:
        return self.number

    def of(self, word: bytes) -> int:
        at = self.own.get(word)
        return len(self.own) + zlib.crc32(word[-2:]) % self.shapes if at is None else at


@dataclass
class Bilinear:
    """inputs (classes + 1, dim), places (2, dim), outputs (classes, dim), bias (classes)."""

    inputs: np.ndarray
    places: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.places, self.outputs, self.bias)])

    @classmethod
    def unpack(cls, flat: np.ndarray, classes: int, dim: int) -> Bilinear:
        cuts = np.cumsum([(classes + 1) * dim, 2 * dim, classes * dim])
        a, b, c, d = np.split(np.asarray(flat, dtype=np.float32), cuts)
        return cls(a.reshape(-1, dim).copy(), b.reshape(2, dim).copy(), c.reshape(-1, dim).copy(), d.copy())

    @classmethod
    def fresh(cls, share: np.ndarray, dim: int, seed: int) -> Bilinear:
        rng = np.random.default_rng(seed)
        n = len(share)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(f(n + 1, dim), np.ones((2, dim), dtype=np.float32), f(n, dim), np.log(share).astype(np.float32))

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.inputs[one] * self.places[0] + self.inputs[two] * self.places[1]

    def log_total(self, one: np.ndarray, two: np.ndarray, step: int = 4096) -> np.ndarray:
        """Log of the sum of all classes' weights after each context."""
        out = np.empty(len(one), dtype=np.float32)
        for a in range(0, len(one), step):
            z = self.context(one[a : a + step], two[a : a + step]) @ self.outputs.T
            z += self.bias
            top = z.max(1, keepdims=True)
            z -= top
            np.exp(z, out=z)
            out[a : a + step] = np.log(z.sum(1)) + top[:, 0]
        return out


def contexts(cls: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each token of the texts whose offsets are `at` (no text is empty: each has an end)."""
    one, two = np.empty_like(cls), np.empty_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    first = at[:-1]
    two[:2] = start
    two[np.minimum(first + 1, len(cls) - 1)[np.diff(at) > 1]] = start
    one[first] = start
    two[first] = start
    return one, two


def _scatter(where: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of rows by index, as a sorted run-length sum."""
    order = np.argsort(where, kind="stable")
    own = where[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[own[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad; the noise of a batch is shared by its rows."""

    def __init__(self, model: Bilinear, share: np.ndarray, rate: float, noise: int = 64, batch: int = 4096, seed: int = 1):
        self.m, self.rate, self.k, self.batch = model, rate, noise, batch
        self.log_noise = np.log(share * noise).astype(np.float32)
        self.pick = np.cumsum(share)
        self.rng = np.random.default_rng(seed)
        self.square = Bilinear(*(np.full_like(x, 1e-2) for x in (model.inputs, model.places, model.outputs, model.bias)))
        self.seen = 0

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, len(w)
        noise = np.searchsorted(self.pick, self.rng.random(self.k) * self.pick[-1]).clip(0, len(m.bias) - 1)
        a, b = m.inputs[one], m.inputs[two]
        q = a * m.places[0] + b * m.places[1]
        r, rn = m.outputs[w], m.outputs[noise]
        true = (q * r).sum(1) + m.bias[w] - self.log_noise[w]
        fake = q @ rn.T + (m.bias[noise] - self.log_noise[noise])
        g = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - sigmoid
        gn = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        scale = np.float32(1 / n)
        dq = (g[:, None] * r + gn @ rn) * scale
        douts = _scatter(np.concatenate([w, noise]), np.concatenate([g[:, None] * q * scale, gn.T @ q * scale]), len(m.bias))
        dbias = np.bincount(w, g, len(m.bias)) * scale + np.bincount(noise, gn.sum(0), len(m.bias)) * scale
        dins = _scatter(np.concatenate([one, two]), np.concatenate([dq * m.places[0], dq * m.places[1]]), len(m.inputs))
        dplaces = np.stack([(dq * a).sum(0), (dq * b).sum(0)])
        for p, d, s in ((m.inputs, dins, self.square.inputs), (m.places, dplaces, self.square.places), (m.outputs, douts, self.square.outputs), (m.bias, dbias.astype(np.float32), self.square.bias)):
            s += d * d * n
            p += self.rate * d * np.float32(n**0.5) / np.sqrt(s)
        self.seen += n

    def text(self, cls: np.ndarray, at: np.ndarray) -> None:
        one, two = contexts(cls, at, len(self.m.bias))
        order = self.rng.permutation(len(cls))
        for i in range(0, len(order), self.batch):
            own = order[i : i + self.batch]
            self.step(cls[own], one[own], two[own])


class Numbered:
    """Distinct words of a slice, and the texts as numbers."""

    def __init__(self, batch_texts: list[bytes]):
        each = [tokens(t) for t in batch_texts]
        self.at = offsets([len(w) for w in each])
        number: dict[bytes, int] = {}
        self.token = np.fromiter((number.setdefault(w, len(number)) for ws in each for w in ws), dtype=np.int64, count=int(self.at[-1]))
        self.words = list(number)


def count_words(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word binary, c long) over column t of docs. A task keeps at most about `most` words before it sends them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in slices(batches, "t"):
            for t in texts(batch.column(0)):
                held.update(tokens(t))
            if len(held) > most:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    classes: Classes
    bilinear: Bilinear
    frequent: dict[bytes, int]
    n: int
    v: int
    log_class: np.ndarray  # log10 of the second factor's denominator, 0 for classes of their own
    counts: DataFrame


def _sum_parameters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for raw, tokens_ in zip(batch.column("raw").to_pylist(), batch.column("n").to_pylist()):
            x = np.frombuffer(raw, dtype=np.float64) if batch.schema.get_field_index("summed") >= 0 else np.frombuffer(raw, dtype=np.float32) * np.float64(tokens_)
            total, n = x + (0 if total is None else total), n + tokens_
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([True])], ["raw", "n", "summed"])


def fit(
    docs: DataFrame,
    allowed: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    top: int = 1023,
    shapes: int = 64,
    dim: int = 24,
    frequent: int = 1 << 17,
    pilot: int = 1500,
    pilot_bytes: int = 6 << 20,
    fan_in: int = 32,
    seed: int = 9,
) -> Model:
    """Learn from the rows of docs that `allowed` admits."""
    own = docs.where(F.coalesce(allowed, F.lit(False))).select(F.col(text_col).alias("t"), F.xxhash64(id_col, F.lit(seed)).alias("h"))
    counts = materialize(count_words(own.select("t")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bin_ = F.floor(F.log2("c") * 8)
    bins = sorted(((r.b, r.n) for r in counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, taken = 1 << 30, 0
    for b, size in bins:
        if taken + size > frequent:
            break
        least, taken = b, taken + size
    known = {bytes(r.word): r.c for r in counts.where(bin_ >= least).collect()} if taken else {}
    tops = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))[:top]
    classes = Classes({w: i for i, w in enumerate([END, *tops])}, shapes)
    fixed = len(classes.own)
    share = np.ones(classes.number)
    for w, i in classes.own.items():
        share[i] += known.get(w, 0)
    shape = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(shapes)).cast("int")
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in classes.own], "word binary")), "word", "left_anti")
    sums = {r.s: (r.c, r.v) for r in rest.groupBy(shape.alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    log_class = np.zeros(classes.number)
    for s in range(shapes):
        c, words = sums.get(s, (0, 0))
        share[fixed + s] += c
        log_class[fixed + s] = np.log10(c + words + 1)
    share /= share.sum()

    first = Bilinear.fresh(share, dim, seed)
    chance = min(1.0, 2 * pilot / max(1, known.get(END, 0) or pilot))  # as many ends as texts
    sample = own.where(F.pmod("h", F.lit(1 << 20)) < int(chance * (1 << 20))).select("t").limit(pilot)
    trainer, start, size = Trainer(first, share, 0.1), [], 0
    for row in sample.toLocalIterator():
        start.append((row.t or "").encode())
        size += len(start[-1])
        if size > pilot_bytes:
            break
    for _ in range(2):
        for a in range(0, len(start), 300):
            made = Numbered(start[a : a + 300])
            trainer.text(np.array([classes.of(w) for w in made.words], dtype=np.int64)[made.token], made.at)
    flat = first.pack()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        model = Bilinear.unpack(flat, classes.number, dim)
        trainer = Trainer(model, share, 0.03, seed=part)
        for batch in slices(batches, "t"):
            made = Numbered(texts(batch.column(0)))
            trainer.text(np.array([classes.of(w) for w in made.words], dtype=np.int64)[made.token], made.at)
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([model.pack().tobytes()], pa.binary()), pa.array([trainer.seen], pa.int64()), pa.array([part % fan_in], pa.int32())], ["raw", "n", "salt"])

    parts = own.select("t").mapInArrow(run, "raw binary, n long, salt int")
    sums_ = parts.repartition("salt").mapInArrow(_sum_parameters, "raw binary, n long, summed boolean")
    whole = sums_.repartition(1).mapInArrow(_sum_parameters, "raw binary, n long, summed boolean").collect()
    if whole:
        flat = (np.frombuffer(bytes(whole[0].raw), dtype=np.float64) / whole[0].n).astype(np.float32)
    return Model(classes, Bilinear.unpack(flat, classes.number, dim), known, int(n), int(v), log_class, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of docs."""
    classes, bilinear, frequent, n, v, log_class = model.classes, model.bilinear, model.frequent, model.n, model.v, model.log_class
    width = classes.number + 1
    fixed = len(classes.own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 36
        total = np.full(width * width, np.nan, dtype=np.float32)  # log sums of the contexts met so far
        for batch in slices(batches, "t"):
            made = Numbered(texts(batch.column(1)))
            own = np.array([classes.of(w) for w in made.words], dtype=np.int64)
            count = np.array([frequent.get(w, -1) for w in made.words], dtype=np.int64)
            log_count = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1), 0.0)
            cls = own[made.token]
            one, two = contexts(cls, made.at, classes.start)
            pair = one * width + two
            new = np.unique(pair[np.isnan(total[pair])])
            total[new] = bilinear.log_total(new // width, new % width)
            logp = np.empty(len(cls))
            for a in range(0, len(cls), 1 << 16):
                s = slice(a, a + (1 << 16))
                logp[s] = (bilinear.context(one[s], two[s]) * bilinear.outputs[cls[s]]).sum(1) + bilinear.bias[cls[s]]
            logp = (logp - total[pair]) / LN10 - log_class[cls]
            lc = log_count[made.token]
            starts = made.at[:-1]
            size = np.diff(made.at)
            base0 = np.add.reduceat(lc, starts) - size * np.log10(n + v + 1)
            score0 = np.add.reduceat(logp + np.where(cls >= fixed, lc, 0.0), starts)
            known0 = np.add.reduceat((count[made.token] > 0).astype(np.int64), starts)
            rare = np.flatnonzero(count[made.token] < 0)
            doc = np.searchsorted(made.at, rare, side="right") - 1
            both, tf = np.unique(doc * len(made.words) + made.token[rare], return_counts=True)
            cuts = np.searchsorted(both // len(made.words), np.arange(len(size) + 1)).astype(np.int32)
            words = pa.array([made.words[i] for i in (both % len(made.words)).tolist()], pa.binary())
            rows = [
                pa.array(np.arange(key, key + len(size))), batch.column(0), pa.array(size), pa.array(known0), pa.array(base0), pa.array(score0),
                pa.ListArray.from_arrays(pa.array(cuts), words), pa.ListArray.from_arrays(pa.array(cuts), pa.array(tf)),
            ]
            key += len(size)
            yield pa.RecordBatch.from_arrays(rows, ["key", "doc_id", "n_tokens", "known0", "base0", "score0", "words", "tf"])

    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    made = materialize(src.mapInArrow(run, "key long, doc_id long, n_tokens long, known0 long, base0 double, score0 double, words array<binary>, tf array<long>"), "lm-parts")
    rare = made.select("key", F.explode(F.arrays_zip("words", "tf")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.tf").alias("tf"))
    met = rare.join(model.counts, "word", "left")
    sums = met.groupBy("key").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("k")
    )
    more = F.coalesce("s", F.lit(0.0))
    return made.join(sums, "key", "left").select(
        "doc_id", "n_tokens", (F.col("known0") + F.coalesce("k", F.lit(0))).alias("n_known"), (F.col("base0") + more).alias("base_score"), (F.col("score0") + more).alias("score")
    )


HELD = (7, 2)  # folds, and the fold that isn't learnt from


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_fold(F.col("doc_id"), HELD[0])
    model = fit(docs, fold != HELD[1])
    out = score(docs, model)
    return out.select("doc_id", (fold == HELD[1]).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
