"""Toxic spans by a linear-chain conditional random field over the tags "clean" and "toxic".

1. Labelled tokens. The labels are of documents, so tokens are labelled first: sentences of a bounded sample of labelled
   documents are made distinct (copies of a passage count once), and words and stems are counted over sentences of toxic and of
   other documents: words first, then the stems of words not marked yet. A feature whose G statistic passes a threshold corrected
   for the number of features, and whose sentences are nearly all from toxic documents, marks its tokens there as toxic.
2. Training. Weights of hashed features and the transitions maximise the conditional likelihood of the tags of at most
   `most_sentences` marked and as many other sentences: gradients from forward-backward marginals, AdaGrad.
3. Scoring. Each task runs forward-backward over the sentences of its rows, all sentences of a slice at once, one token
   position after another. A document's largest marginal and expected number of toxic tokens give its score through a
   logistic function fitted on the sampled documents; spans are runs of tokens with a marginal of at least a half.

Whole texts are scored. Defined cases: null or empty text scores as a text without toxic tokens; without labels of both
kinds every score is the smoothed share of toxic labels (0.5 without any); repeated rows are scored one by one; other
columns are kept as they are, whatever their names."""

from __future__ import annotations

import re
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
from millrace.session import drop_materialized, materialize

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STOPS = (b".", b"!", b"?", b".\"", b"!\"", b"?\"")
SLOTS = 1 << 18
LIMIT = 30.0


def features(word: bytes) -> list[bytes]:
    """The word without marks, its prefixes of 4 and 5 bytes, its last 3 bytes."""
    core = word.lower().strip(_MARKS)
    return [b"w" + core, b"4" + core[:4], b"5" + core[:5], b"s" + core[-3:]]


def slots(word: bytes) -> list[int]:
    return [zlib.crc32(f) & (SLOTS - 1) for f in features(word)]


def sentences(text: bytes) -> list[bytes]:
    """Runs of words up to one that ends with a full stop, an exclamation or a question mark; words joined by spaces."""
    out, run = [], []
    for w in text.split():
        run.append(w)
        if w.endswith(_STOPS):
            out.append(b" ".join(run))
            run = []
    if run:
        out.append(b" ".join(run))
    return out


@dataclass
class Field:
    """weights: log odds of toxic for each hashed feature; bias; moves[a, b]: score of tag b after tag a."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray


def odds(words: list[bytes], field: Field) -> np.ndarray:
    if not words:
        return np.zeros(0)
    at = np.array([slots(w) for w in words], dtype=np.int64)
    return field.weights[at].sum(1) + field.bias


def _layers(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Starts and lengths of the nonempty runs, longest first; how many runs reach each position."""
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes = sizes[order]
    reach = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    return at[:-1][order], sizes, reach.tolist()


def forward_backward(u: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of toxic from the tokens up to each one (with it), and from those after it.

    u: a token's own log odds; at: offsets of the sentences. Their sum is the log odds of the marginal."""
    fore, back = np.zeros(len(u)), np.zeros(len(u))
    starts, sizes, reach = _layers(at)
    e = np.exp(moves)
    for t, n in enumerate(reach):
        own = starts[:n] + t
        if t == 0:
            fore[own] = u[own]
        else:
            x = np.exp(fore[own - 1])
            fore[own] = np.clip(u[own] + np.log((e[0, 1] + x * e[1, 1]) / (e[0, 0] + x * e[1, 0])), -LIMIT, LIMIT)
    for t in range(len(reach) - 2, -1, -1):
        own = starts[: reach[t + 1]] + t  # sentences that go on after t
        x = np.exp(np.clip(u[own + 1] + back[own + 1], -LIMIT, LIMIT))
        back[own] = np.log((e[1, 0] + x * e[1, 1]) / (e[0, 0] + x * e[0, 1]))
    return fore, back


def marginals(u: np.ndarray, at: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds of toxic of each token."""
    fore, back = forward_backward(u, at, moves)
    return np.clip(fore + back, -LIMIT, LIMIT)


def train(tagged: list[tuple[list[bytes], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
    """Fit the field to tagged sentences (words, tags 0 or 1)."""
    field = Field(np.zeros(SLOTS), -4.0, np.zeros((2, 2)))
    known: dict[bytes, int] = {}
    rows: list[list[int]] = []
    coded = []
    for words, tags in tagged:
        for w in words:
            if w not in known:
                known[w] = len(rows)
                rows.append(slots(w))
        coded.append((np.array([known[w] for w in words]), np.array(tags)))
    if not rows:
        return field
    where = np.array(rows, dtype=np.int64)
    square, square_b, square_m = np.full(SLOTS, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 256)):
            at = offsets([len(coded[i][0]) for i in part])
            word = np.concatenate([coded[i][0] for i in part])
            y = np.concatenate([coded[i][1] for i in part])
            u = field.weights[where[word]].sum(1) + field.bias
            fore, back = forward_backward(u, at, field.moves)
            p = 1 / (1 + np.exp(-np.clip(fore + back, -LIMIT, LIMIT)))
            inner = np.ones(len(u), dtype=bool)
            inner[at[:-1]] = False
            b = np.flatnonzero(inner)
            a = b - 1
            # log weights of the four tag pairs, from the odds on either side
            right = u[b] + back[b]
            pair = np.stack([np.stack([np.zeros(len(b)), right]), np.stack([fore[a], fore[a] + right])]) + field.moves[:, :, None]
            pair = np.exp(pair - pair.max((0, 1)))
            pair /= pair.sum((0, 1))
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[a], y[b]), 1)
            scale = 1 / len(part)
            g = (y - p) * scale
            grad = np.zeros(SLOTS)
            np.add.at(grad, where[word].ravel(), np.repeat(g, where.shape[1]))
            touched = np.flatnonzero(grad)
            step = grad[touched] - decay * field.weights[touched]
            square[touched] += step * step
            field.weights[touched] += rate * step / np.sqrt(square[touched])
            gb, gm = g.sum(), (seen - pair.sum(2)) * scale - decay * field.moves
            square_b += gb * gb
            square_m += gm * gm
            field.bias += rate * gb / np.sqrt(square_b)
            field.moves = np.clip(field.moves + rate * gm / np.sqrt(square_m), -8, 8)
    return field


def summary(batch_texts: list[bytes], field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the largest log odds and the expected number of toxic tokens; all tokens' log odds and the texts' offsets."""
    own = [t.split() for t in batch_texts]
    at = offsets([len(w) for w in own])
    number: dict[bytes, int] = {}
    token = np.fromiter((number.setdefault(w, len(number)) for ws in own for w in ws), dtype=np.int64, count=int(at[-1]))
    distinct = list(number)
    u = odds(distinct, field)[token]
    stop = np.array([w.endswith(_STOPS) for w in distinct], dtype=bool)[token] if distinct else np.zeros(0, dtype=bool)
    cuts = np.union1d(np.flatnonzero(stop) + 1, at)
    z = marginals(u, cuts, field.moves)
    p = 1 / (1 + np.exp(-z))
    n = len(batch_texts)
    most, total = np.full(n, -LIMIT), np.zeros(n)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        most[full] = np.maximum.reduceat(z, at[:-1][full])
        total[full] = np.add.reduceat(p, at[:-1][full])
    return most, total, z, at


@dataclass
class Model:
    field: Field | None
    prior: float
    line: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.field is None:
            return np.full(len(most), self.prior)
        a, b, c = self.line
        return 1 / (1 + np.exp(-np.clip(a + b * most / 5 + c * np.log(total + 1e-3), -LIMIT, LIMIT)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the first column; x has a first column of ones."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * len(y) / 100)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    allowed,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    most: int = 20_000,
    most_features: int = 5_000,
    most_sentences: int = 20_000,
    pure: float = 0.95,
    most_bytes: int = 2048,
) -> Model:
    """Learn from at most `most` labelled documents that `allowed` (a condition on labels) admits.

    most_features, most_sentences, most_bytes bound what reaches the driver: marking features of each round, sentences of each
    kind that train the field, and the length of those."""
    sample = labelled_sample(labels, label, allowed, most, id_col)
    own = materialize(labelled_rows(docs, sample, id_col, text_col), "toxic-sample")
    kinds = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), sum(kinds.values()) - kinds.get(1, 0)
    prior = (n1 + 1) / (n1 + n0 + 2)
    if not n1 or not n0:
        return Model(None, prior)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            each = [sentences(t) for t in texts(batch.column(0))]
            y = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array([s for x in each for s in x], pa.binary()), pa.array(y, pa.int32())], ["s", "y"])

    parts = materialize(own.mapInArrow(cut, "s binary, y int").groupBy("s").agg(F.min("y").alias("y")), "toxic-sentences")

    share = parts.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0

    def strong(kinds: slice, marked: set[bytes], pure: float) -> set[bytes]:
        """Features of these kinds that single out toxic documents, among words that `marked` doesn't hold."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: dict[bytes, list[int]] = {}
                for s, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for f in {f for w in s.split() for own in [features(w)] if own[0] not in marked for f in own[kinds]}:
                        seen.setdefault(f, [0, 0])[int(y == 1)] += 1
                if seen:
                    zero, one = zip(*seen.values())
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(one, pa.int64()), pa.array(zero, pa.int64())], ["f", "one", "zero"])

        tested = parts.mapInArrow(count, "f binary, one long, zero long").groupBy("f").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
        tested = materialize(tested, "toxic-features")
        number = max(1, tested.count())
        both = F.col("one") + F.col("zero")
        xlog = lambda x, m: F.when(x > 0, x * F.log(x / (both * m))).otherwise(F.lit(0.0))
        g = 2 * (xlog(F.col("one"), max(share, 1e-9)) + xlog(F.col("zero"), max(1 - share, 1e-9)))
        found = tested.where((F.col("one") >= pure * both) & (g >= 2 * float(np.log(20.0 * number)))).orderBy(F.desc(g), "f").limit(most_features)
        out = {bytes(r.f) for r in found.select("f").collect()}
        drop_materialized(tested)
        return out

    marked = strong(slice(0, 1), set(), pure)
    marked |= strong(slice(1, 3), marked, 1 - (1 - pure) / 4)  # stems of words that are too rare themselves

    def marks(s: bytes) -> list[int]:
        return [int(any(f in marked for f in features(w)[:3])) for w in s.split()]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [int(v == 1 and any(marks(s))) for s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.int32())], ["s", "y"])

    tagged = parts.where(F.octet_length("s") <= most_bytes).mapInArrow(tag, "s binary, y int")
    mixed = tagged.withColumn("h", F.xxhash64("s"))
    got = [mixed.where(F.col("y") == y).orderBy("h", "s").limit(most_sentences).select("s").toArrow().column(0).to_pylist() for y in (1, 0)]
    field = train([(s.split(), marks(s) if y else [0] * len(s.split())) for y, rows in ((1, got[0]), (0, got[1])) for s in rows])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            a, b, _, _ = summary(texts(batch.column(0)), field)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(1)], ["a", "b", "y"])

    x = own.mapInArrow(sum_up, "a double, b double, y int").toArrow()
    a, b, y = (x.column(c).to_numpy() for c in ("a", "b", "y"))
    drop_materialized(own, parts)
    order = np.lexsort((y, b, a))
    a, b, y = a[order], b[order], (y[order] == 1).astype(float)
    line = logistic(np.stack([np.ones(len(a)), a / 5, np.log(b + 1e-3)], axis=1), y)
    return Model(field, prior, tuple(line.tolist()))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", spans: str | None = None, least: float = 0.5) -> tuple[DataFrame, str]:
    """docs with the probability of a toxic document; with `spans` also a column of that name, array<struct<begin, stop, p>>:
    character offsets of runs of toxic tokens and the run's largest marginal."""
    name = free_name(docs, name)
    more = [(name, T.DoubleType())]
    kind = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("p", T.DoubleType())]))
    if spans:
        more.append((free_name(docs, spans), kind))
    cut = float(np.log(least / (1 - least)))

    def runs(text: bytes, z: np.ndarray) -> list[dict]:
        hit = np.flatnonzero(z >= cut)
        if not len(hit):
            return []
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        chars = lambda i: len(text[:i].decode("utf-8", "replace"))
        groups = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
        return [{"begin": chars(places[g[0]][0]), "stop": chars(places[g[-1]][1]), "p": float(1 / (1 + np.exp(-z[g].max())))} for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            own = texts(batch.column(batch.schema.get_field_index(text_col)))
            if model.field is None:
                most, total, z, at = np.full(len(own), -LIMIT), np.zeros(len(own)), np.zeros(0), np.zeros(len(own) + 1, dtype=np.int64)
            else:
                most, total, z, at = summary(own, model.field)
            arrays, fields = [pa.array(model.score(most, total))], [pa.field(name, pa.float64())]
            if spans:
                span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))
                arrays.append(pa.array([runs(t, z[a:b]) for t, a, b in zip(own, at, at[1:])], span))
                fields.append(pa.field(more[1][0], span))
            yield append(batch, fields, arrays)

    return docs.mapInArrow(run, with_fields(docs.schema, *more)), name


HELD = (5, 0)  # folds, and the fold whose labels are never learnt from


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), id_fold(F.col("doc_id"), HELD[0]) != HELD[1])
    scored, name = add_score(docs, model)
    return scored.select("doc_id", (id_fold(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
