"""Nearest neighbours by randomly rotated one-bit codes (RaBitQ, Gao and Long, 2024).

Index. A vector o is centred at the mean c and turned by a fixed random rotation; its code is the sign of each coordinate, a
bit each, with two scalars: |o - c|, and the inner product of the unit vector with its code. Codes of all vectors are made
in one pass, with nothing fitted but the mean.

Search. For a query q the inner product of the unit vectors is estimated from the code alone: the query's turned
coordinates are rounded to 8 bits at random, and each bit plane meets the packed code by AND and a count of bits. The
estimate divided by the code's scalar is unbiased, and its error is under eps * sqrt((1 - s^2) / s^2 / (d - 1)) but for a
small chance, so each candidate has a lower bound of its distance. A block keeps for each query the k-th smallest exact
distance among the candidates of least estimate, and reranks with exact distances all whose lower bound is not above it.

Plan. Vectors are dealt by hash into blocks of about block_rows, queries into chunks of chunk_rows; each block meets each
chunk in one task (the stated query set against all rows, in blocks), which returns k rows for each query. A window over
the k rows of each block picks the best. Nothing is broadcast, and no group grows with the table.

Defined cases: null or zero vectors, those with null or non-finite entries or with a length other than the commonest take
no part, neither as queries nor as candidates; null ids neither; a repeated id is searched once as a query (its first
vector by value) and found as often as it occurs, other than for its own query; ties go to the smaller id; fewer than k
candidates are all returned; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

_PAIRS = 1 << 21


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>): rows that can take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (n, words of 64 bits), distances from the mean, and the codes' own inner products."""
    n, dim = x.shape
    y = (x - mean) @ turn
    norm = np.sqrt((y * y).sum(1))
    unit = y / np.where(norm > 0, norm, 1)[:, None]
    own = np.abs(unit).sum(1) / np.sqrt(dim)
    words = -(-dim // 64)
    bits = np.zeros((n, words * 64), dtype=np.uint8)
    bits[:, :dim] = y > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), norm, np.where(norm > 0, own, 1.0)


def index(vectors: DataFrame, dim: int, mean: list[float], seed: int = 17) -> DataFrame:
    """(id, v, code binary, norm, own) for rows of usable() that have dim entries."""
    turn, centre = rotation(dim, seed), np.array(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, norm, own = encode(_matrix(batch.column(1), dim), centre, turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(own)], ["id", "v", "code", "norm", "own"])

    return vectors.where(F.size("v") == dim).select("id", "v").mapInArrow(run, "id long, v array<double>, code binary, norm double, own double")


def estimate(query: np.ndarray, code: np.ndarray, own: np.ndarray, rng: np.random.Generator, bits: int = 8) -> np.ndarray:
    """Inner products of turned unit queries with coded unit vectors, from the packed bits: (queries, codes)."""
    m, dim = query.shape
    low = query.min(1)
    step = np.maximum((query.max(1) - low) / (2**bits - 1), 1e-300)
    level = np.floor((query - low[:, None]) / step[:, None] + rng.random(query.shape)).astype(np.int64).clip(0, 2**bits - 1)
    width = code.shape[1] * 64
    planes = np.zeros((bits, m, width), dtype=np.uint8)
    for j in range(bits):
        planes[j, :, :dim] = level >> j & 1
    planes = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
    set_bits = np.bitwise_count(code).sum(1, dtype=np.int64)
    dot = np.zeros((m, len(code)), dtype=np.int64)
    for j in range(bits):
        for w in range(code.shape[1]):
            dot += np.bitwise_count(planes[j][:, w, None] & code[None, :, w]).astype(np.int64) << j
    total = level.sum(1)
    # sum over set bits minus sum over the others, of low + step * level
    signed = low[:, None] * (2 * set_bits[None, :] - dim) + step[:, None] * (2 * dot - total[:, None])
    return signed / np.sqrt(dim) / own[None, :]


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to the rows of v; squares are added in the order of the coordinates."""
    d = q - v
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def nearest_in_block(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, eps: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of at most k rows of the block for each query."""
    dim = v.shape[1]
    width = eps * np.sqrt(np.maximum(1 - own * own, 0)) / own / np.sqrt(max(dim - 1, 1))
    y = (q - mean) @ turn
    far = np.sqrt((y * y).sum(1))
    unit = y / np.where(far > 0, far, 1)[:, None]
    rng = np.random.default_rng(seed)
    out = []
    step = max(1, _PAIRS // max(1, len(ids)))
    for a in range(0, len(qid), step):
        b = min(len(qid), a + step)
        cosine = estimate(unit[a:b], code, own, rng)
        reach = 2 * far[a:b, None] * norm[None, :]
        square = far[a:b, None] ** 2 + norm[None, :] ** 2 - reach * cosine
        lower = square - reach * (width[None, :] + 1e-12)
        other = ids[None, :] != qid[a:b, None]
        square = np.where(other, square, np.inf)
        first = np.argpartition(square, min(k, len(ids)) - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (b - a, 1))
        for i in range(b - a):
            near = first[i][other[i, first[i]]]
            if not len(near):
                continue
            d = distances(q[a + i], v[near])
            if len(near) == k:
                worst = d.max()
                more = np.flatnonzero((lower[i] <= worst * worst * (1 + 1e-9)) & other[i])
                near = np.union1d(near, more)
                d = distances(q[a + i], v[near])
            best = np.lexsort((ids[near], d))[:k]
            out.append((np.full(len(best), qid[a + i]), ids[near[best]], d[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", eps: float = 3.0, seed: int = 17, block_rows: int = 8192, chunk_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row that is_query (a condition on column `id`) admits."""
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = common["dim"], common["count"]
    rows = rows.where(F.size("v") == dim)
    means = rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # one row a coordinate
    mean = [r.m for r in sorted(means, key=lambda r: r.pos)]
    n_queries = rows.where(is_query).count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-n_queries // chunk_rows))
    centre, turn = np.array(mean), rotation(dim, seed)

    coded = index(rows, dim, mean, seed).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    coded = coded.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint64).reshape(right.num_rows, -1)
        col = lambda t, name: t.column(name).to_numpy()
        found = nearest_in_block(col(left, "id"), _matrix(left.column("v"), dim), col(right, "id"), _matrix(right.column("v"), dim), code, col(right, "norm"), col(right, "own"), centre, turn, k, eps, seed)
        return pa.table(dict(zip(none.column_names, map(pa.array, found))))

    met = queries.groupBy("block", "chunk").cogroup(coded.groupBy("block", "chunk")).applyInArrow(meet, "query_id long, vec_id long, score double")
    by = "row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)"
    return met.withColumn("rank", F.expr(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


#: The exact ten nearest, by all distances.
OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), met AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM met
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
