"""Order-preserving packing: cut a stream of documents into windows by dynamic programming.

Documents stay in the order of the table. A cut may lie at the end of a document, at the end of a sentence, or, in a run of
tokens without either, at fixed steps. Over these cuts the programme minimises

    sum over windows of padding + window_cost, plus a penalty for each cut inside a document.

A window of length n has padding window - n, or none where n is a power of two. The best predecessor of a cut is the
minimum of (best + position) over the last `window` tokens, kept by a monotone queue, or one of the few predecessors at a
power-of-two distance: each cut enters and leaves the queue once.

Every task packs its own rows as they stream by: no shuffle, and memory for one run of about a million tokens. Sequence ids
hold the partition number and a counter, so a repeated task gives the same ids.

Defined cases: null text is an empty document (its end id alone); a null doc_id is carried along; equal rows are packed one
by one; an empty table gives no pieces; other columns are ignored. A document of any length is cut, each id lies in exactly
one piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.common import give_back, slices, table



def cuts(places: np.ndarray, penalty: np.ndarray, window: int, window_cost: int) -> list[int]:
    """Chosen cuts among ascending places (the first is 0, the last must be taken; gaps are at most window)."""
    n = len(places)
    index = np.full(int(places[-1]) + 1, -1, dtype=np.int64)
    index[places] = np.arange(n)
    later, earlier = [], []
    step = 1
    while step <= window:
        back = places - step
        hit = index[back[np.searchsorted(places, step) :]]  # places ascend
        at = np.flatnonzero(hit >= 0)
        later.append(at + n - len(hit))
        earlier.append(hit[at])
        step *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    short = earlier[np.argsort(later, kind="stable")].tolist()  # the predecessors at a power of two of each cut
    ends = np.cumsum(np.bincount(later, minlength=n)).tolist()
    place, extra = places.tolist(), (penalty + window_cost).tolist()
    best = [0] * n
    came = [0] * n
    done = 0
    queue, keys, head = [0], [0], 0  # indices and best + place, both ascending
    for j in range(1, n):
        p = place[j]
        least = p - window
        while place[queue[head]] < least:
            head += 1
        i = queue[head]
        b = keys[head] + window - p
        end = ends[j]
        while done < end:
            k = short[done]
            if best[k] < b:
                b, i = best[k], k
            done += 1
        b += extra[j]
        best[j] = b
        came[j] = i
        b += p
        while len(keys) > head and keys[-1] >= b:
            keys.pop()
            queue.pop()
        keys.append(b)
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return out[::-1]


def places(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, window: int, inside: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts and their penalties."""
    total = len(ids)
    cost = np.full(total + 1, -1, dtype=np.int64)
    cost[1:][ends[ids]] = inside
    stops = np.cumsum(lengths)
    cost[stops] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    step = max(1, window // 8)
    for a, b in zip(at[:-1][np.diff(at) > 2 * step].tolist(), at[1:][np.diff(at) > 2 * step].tolist()):
        cost[np.arange(a + step, b, step)] = hard
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    end_id: int = 0,
    inside: int = 4,
    hard: int = 32,
    window_cost: int = 8,
    as_array: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit
    integers, or an array of ints). path: a byte-level BPE file of the tokenizers library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        memo, marks = bpe.memo(path), bpe.marks_end(path)
        for batch in slices(batches, "t"):
            ids, lengths = memo.encode(batch.column(1), end_id)
            at, penalty = places(ids, lengths, marks, window, inside, hard)
            chosen = at[cuts(at, penalty, window, window_cost)]
            stops = np.cumsum(lengths)
            edges = np.union1d(chosen, stops)
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(stops, a, side="right")
            seq = np.searchsorted(chosen, a, side="right") - 1
            if as_array:
                own = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
            else:
                own = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(a - (stops - lengths)[doc]), pa.array(b - a), pa.array(lengths[doc]), pa.array(first + seq), pa.array(a - chosen[seq]), own],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            first += len(chosen) - 1
        give_back()

    kind = "array<int>" if as_array else "binary"
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids {kind}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
