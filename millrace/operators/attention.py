"""Softmax-weighted sums (attention) as a tiled join with a mergeable aggregate.

softmax(q . k * scale) . v over the keys of each query. Queries and keys of a head are cut into tiles by position; each pair
of tiles that the mask admits meets in one task, which returns one partial state for each query: the largest score, the sum
of weights and the weighted vectors, both relative to that largest score. Partial states of a query merge by rescaling, so
no task ever holds all keys of a query. A query has one partial state for each tile of keys; the merge gathers and folds them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b):
    """Inner product of two array columns, on the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def attention(q: DataFrame, k: DataFrame, v: DataFrame, causal: bool = True, scale: float | None = None, tile: int = 1024) -> DataFrame:
    """(head, pos, out array<double>). q, k, v: (head long, pos long, vec array of numbers); causal: only keys with pos <= the query's.

    A query without any key has no row. scale: 1 / sqrt(width) by default."""
    keys = k.select("head", "pos", F.col("vec").alias("k")).join(v.select("head", "pos", F.col("vec").alias("v")), ["head", "pos"])
    keys = keys.withColumn("kt", F.floor(F.col("pos") / tile))
    queries = q.select("head", "pos", F.col("vec").alias("q")).withColumn("qt", F.floor(F.col("pos") / tile))
    pairs = queries.select("head", "qt").distinct().join(keys.select("head", "kt").distinct(), "head")
    if causal:
        pairs = pairs.where("kt <= qt")
    left = queries.join(pairs, ["head", "qt"])
    right = keys.join(pairs, ["head", "kt"])
    fresh = lambda df, mark, *names: df.select(*(F.col(n).alias(f"{n}_{mark}") for n in ("head", "qt", "kt", *names)))
    left, right = fresh(left, "a", "pos", "q"), fresh(right, "b", "pos", "k", "v")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["head", "pos", "top", "total", "acc"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        x, y, z = _matrix(a.column("q_a")), _matrix(b.column("k_b")), _matrix(b.column("v_b"))
        s = x @ y.T * (scale if scale is not None else x.shape[1] ** -0.5)
        if causal:
            s = np.where(b.column("pos_b").to_numpy()[None, :] <= a.column("pos_a").to_numpy()[:, None], s, -np.inf)
        top = s.max(1)
        seen = np.flatnonzero(top > -np.inf)
        w = np.exp(s[seen] - top[seen, None])
        own = [a.column("head_a").to_numpy()[seen], a.column("pos_a").to_numpy()[seen], top[seen], w.sum(1), list(w @ z)]
        return pa.table([pa.array(c, t) for c, t in zip(own, kinds)], names)

    parts = left.groupBy("head_a", "qt_a", "kt_a").cogroup(right.groupBy("head_b", "qt_b", "kt_b")).applyInArrow(meet, "head long, pos long, top double, total double, acc array<double>")
    return merge(parts)


def merge(parts: DataFrame) -> DataFrame:
    """Join partial states (head, pos, top, total, acc) of each query."""
    state = F.struct("top", "total", "acc")

    def step(s, x):
        top = F.greatest(s["top"], x["top"])
        a, b = F.exp(s["top"] - top), F.exp(x["top"] - top)
        acc = F.when(F.size(s["acc"]) == 0, F.transform(x["acc"], lambda y: y * b)).otherwise(F.zip_with(s["acc"], x["acc"], lambda y, z: y * a + z * b))
        return F.struct(top.alias("top"), (s["total"] * a + x["total"] * b).alias("total"), acc.alias("acc"))

    first = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("acc"))
    merged = parts.groupBy("head", "pos").agg(F.aggregate(F.collect_list(state), first, step).alias("s"))
    return merged.select("head", "pos", F.transform("s.acc", lambda y: y / F.col("s.total")).alias("out"))


def gap_stats(x: Column, y: Column) -> list[Column]:
    """Aggregates: largest, mean and mean relative difference of two columns of one frame."""
    gap = F.abs(x - y)
    return [F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"), F.avg(gap / F.greatest(F.abs(y), F.lit(1e-6))).alias("mean_relative_error")]


def error_stats(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """gap_stats() of two frames' columns, joined by keys."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return both.agg(*gap_stats(F.col("x"), F.col("y")))
