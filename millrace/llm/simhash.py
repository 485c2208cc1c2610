"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by a binary trie over the fingerprints.

Plan. One narrow pass makes the fingerprints. Equal fingerprints fold into one vertex with a number of its own before any
comparison, so exact copies cost nothing. Two fingerprints that differ in at most `budget` bits agree in at least one of
budget + 1 blocks of bits: each vertex goes to the groups of its blocks, and a group with very many vertices is dealt out
again by blocks of its remaining bits, so that no group grows with the table. Inside a group a binary trie over the sorted
fingerprints is joined with itself: pairs of nodes go down together, add up the bits in which their paths differ, and stop
when that exceeds the budget. Each task sends on a spanning forest of the links found, never all pairs; components.py
joins the forests. trie_join() goes down the tries of two sides in the same way; near_copies.py uses it with a wide budget.

Defined cases: null or empty text has fingerprint zero and is linked like any other; a null doc_id keeps its fingerprint
but takes no part in links (component null); repeated rows are equal fingerprints; an id with several texts is in the component
of each of them, and joins none of them; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import slices, table, texts, whole_groups
from millrace.llm.components import components, numbered
from millrace.session import materialize

BITS = 64
#: Node pairs that the trie join keeps at once.
FRONTIER = 1 << 20


def fold(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Majority bits over each run of hashes: a bit is 1 where more than half of the run have it; an empty run gives 0.

    Bits are counted in the eight byte lanes of a word, over at most 255 hashes at once so that no lane runs over."""
    n = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    n = n[full]
    pieces = -(-n // 255)
    run = np.repeat(np.arange(len(n)), pieces)
    starts = (np.cumsum(n) - n)[run] + 255 * (np.arange(len(run)) - (np.cumsum(pieces) - pieces)[run])
    count = np.zeros((len(n), BITS), dtype=np.int64)
    step = 1 << 10
    for a in range(0, len(starts), step):
        own = starts[a : a + step]
        part = hashes[own[0] : starts[a + step] if a + step < len(starts) else None]
        sums = np.empty((len(own), 8, 8), dtype=np.int64)  # piece, byte, bit
        for bit in range(8):
            lanes = (part >> np.uint64(bit)) & np.uint64(0x0101010101010101)
            sums[:, :, bit] = np.add.reduceat(lanes, own - own[0]).view(np.uint8).reshape(-1, 8)
        edge = np.flatnonzero(np.diff(run[a : a + step], prepend=-1))
        count[run[a : a + step][edge]] += np.add.reduceat(sums.reshape(-1, BITS), edge, axis=0)
    major = (2 * count > n[:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each run of `width` words (the whole sequence if there are fewer; none without words)."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)] if words else []
    ends = list(accumulate(map((1).__add__, map(len, words)), initial=0))
    cuts = map(slice, ends, [e - 1 for e in ends[width:]])
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long. A-Z are lower-cased; words are split at ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            each = [shingle_hashes(t, width, seed) for t in texts(batch.column(1))]
            flat = np.fromiter((h for hs in each for h in hs), dtype=np.uint64)
            fp = fold(flat, [len(hs) for hs in each])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, bounds: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys that differ in at most budget bits, within each run [bounds[i], bounds[i+1]) of ascending distinct keys.

    A trie node is a range of the sorted keys. All node pairs of a chunk go down one bit at a time."""
    ones = np.zeros(len(keys) + 1, dtype=np.int64)
    first = np.stack([bounds[:-1], bounds[1:], bounds[:-1], bounds[1:], np.zeros(len(bounds) - 1, dtype=np.int64)])
    stack = [(0, first[:, first[1] - first[0] > 1])]
    cached = -1
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        if not pairs.shape[1]:
            continue
        la, ha, lb, hb, diff = pairs
        small = (ha - la) * (hb - lb) <= 4  # leaves, or next to it: compare what is left
        if depth == BITS or small.any():
            done = pairs[:, small] if depth < BITS else pairs
            a0, a1, b0, b1, _ = done
            for i in range(4):
                for j in range(4):
                    x, y = a0 + i, b0 + j
                    keep = (x < a1) & (y < b1) & (x < y)
                    x, y = x[keep], y[keep]
                    near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
                    if near.any():
                        yield x[near], y[near]
            pairs = pairs[:, ~small] if depth < BITS else pairs[:, :0]
            if not pairs.shape[1]:
                continue
            la, ha, lb, hb, diff = pairs
        if cached != depth:
            np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), out=ones[1:], dtype=np.int64)
            cached = depth
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        same = la == lb
        low = np.stack([la, ma, lb, mb, diff])
        high = np.stack([ma, ha, mb, hb, diff])
        cross = np.stack([la, ma, mb, hb, diff + 1])
        back = np.stack([ma, ha, lb, mb, diff + 1])[:, ~same]
        new = np.concatenate([low, high, cross, back], axis=1)
        alive = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        alive &= ~((new[0] == new[2]) & (new[1] - new[0] == 1))
        stack.append((depth + 1, new[:, alive]))


def _products(pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of pairs of ranges [la, ha) x [lb, hb), in chunks of about FRONTIER."""
    la, ha, lb, hb = pairs[:4]
    sizes = (ha - la) * (hb - lb)
    a = 0
    while a < len(sizes):
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), FRONTIER, side="right")))
        own = sizes[a:b]
        for first in range(0, int(own.sum()), FRONTIER):  # one step but for a pair of very large ranges
            if b - a == 1:
                at = np.arange(first, min(first + FRONTIER, int(own[0])))
                k = np.full(len(at), a)
            else:
                k = np.repeat(np.arange(a, b), own)
                at = np.arange(len(k)) - np.repeat(np.cumsum(own) - own, own)
            wide = (hb - lb)[k]
            yield la[k] + at // wide, lb[k] + at % wide
            if b - a > 1:
                break
        a = b


def trie_join(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) in chunks with at most budget bits between a[i] and b[j], both in the same run.

    a_at and b_at: offsets of the runs; keys ascend within a run and may repeat. The tries of both sides go down together."""
    keys = (a, b)
    ones = [np.zeros(len(k) + 1, dtype=np.int64) for k in keys]
    first = np.stack([a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], np.zeros(len(a_at) - 1, dtype=np.int64)])
    stack = [(0, first[:, (first[0] < first[1]) & (first[2] < first[3])])]
    cached = -1
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        small = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= 16) | (depth == BITS)
        for i, j in _products(pairs[:, small]):
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if near.any():
                yield i[near], j[near]
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if cached != depth:
            for k, one in zip(keys, ones):
                np.cumsum((k >> np.uint64(BITS - 1 - depth)) & np.uint64(1), out=one[1:], dtype=np.int64)
            cached = depth
        la, ha, lb, hb, diff = pairs
        ma, mb = ha - (ones[0][ha] - ones[0][la]), hb - (ones[1][hb] - ones[1][lb])
        new = np.concatenate(
            [np.stack([la, ma, lb, mb, diff]), np.stack([ma, ha, mb, hb, diff]), np.stack([la, ma, mb, hb, diff + 1]), np.stack([ma, ha, lb, mb, diff + 1])], axis=1
        )
        alive = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        stack.append((depth + 1, new[:, alive]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n vertices; pairs come in chunks and aren't kept."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            open_ = rx != ry
            if not open_.any():
                break
            x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _links(budget: int):
    def links(group: np.ndarray, key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((key, group))
        group, key, node = group[order], key[order], node[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        root = forest(len(key), trie_pairs(key, bounds, budget))
        at = np.flatnonzero(root != np.arange(len(root)))
        return node[at], node[root[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, key, node in whole_groups(batches):  # rows of a group come together
            a, b = links(group, key.view(np.uint64), node)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def hamming_links(vertices: DataFrame, budget: int = 3, most: int = 100_000) -> DataFrame:
    """(a, b): links that connect the same vertices as all pairs within budget bits do.

    vertices: (fp long, distinct; node long). A group of more than `most` vertices that share a block of bits is dealt out by
    budget + 1 blocks of its other bits."""
    n = budget + 1
    width = BITS // n
    fp = F.col("fp")

    def turned(by) -> object:  # a block of bits to the front
        return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp

    keyed = F.array(
        *(
            F.struct(
                (F.shiftrightunsigned(turned(i * width), BITS - width) * n + i).alias("g"),
                turned(i * width).alias("k"),
            )
            for i in range(n)
        )
    )
    dealt = vertices.select("node", F.explode(keyed).alias("x")).select(F.col("x.g").alias("g"), F.col("x.k").alias("k"), "node")
    hot = dealt.groupBy("g").count().where(F.col("count") > most).select("g", F.lit(True).alias("hot"))
    rest = BITS - width
    inner = rest // n
    low = F.array(*(((F.shiftrightunsigned("k", rest - (j + 1) * inner).bitwiseAND((1 << inner) - 1)) * n + j + 1) for j in range(n)))
    dealt = (
        dealt.join(hot, "g", "left")
        .withColumn("s", F.explode(F.when(F.col("hot"), low).otherwise(F.array(F.lit(0).cast("long")))))
        .select(F.xxhash64("g", "s").alias("h"), "k", "node")
    )
    return dealt.repartition("h").sortWithinPartitions("h").mapInArrow(_links(budget), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, budget: int = 3, most: int = 100_000
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    marks = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    vertices = materialize(numbered(marks.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))), "vertices")
    roots = components(hamming_links(vertices, budget, most))
    classes = vertices.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("c"))
    smallest = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    out = marks.join(classes.join(smallest, "c").select("fp", "component_id"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
