"""Near copies by SimHash and exact Jaccard similarity of word shingles: every pair at or above a threshold is linked, no other is.

Plan. One narrow pass makes each text's set of shingle hashes and a SimHash fingerprint of 128 bits of it. Equal sets fold into
one vertex before any comparison. Vertices meet in the groups of prefix filtering, which loses no pair: in one order of all
shingles, two sets of n and m members with similarity s or more share one of their first n - ceil(s n) + 1 and m - ceil(s m) + 1
members. The order puts rare shingles first, so that a passage that many texts share brings few of them together; the
frequencies come from a bounded sample, and any order gives the same links. Set sizes and the places in the prefixes rule out
more pairs, by the same bound.

In a group, first each member meets a few others of near size, in an order of the group's own, and is compared with the closest
that it meets in all its groups. That links a large family of near copies, each of which is similar to many of the others, without
all its pairs. Then the tries of the fingerprints of those that the first round's components leave apart go down together (simhash.trie_join)
within a Hamming budget; members of the group's largest component meet the others only. That happens twice: first each of the
others is compared with the closest, then those that are still apart with all that is left. Sets that resemble each other share many
groups, in the same order; so each row names the set's last shared shingles before the group's own, and two rows that name the
same one are left to that earlier group, where they meet as well: of all the groups of a pair the first brings it. Pairs whose sketches, counts of the
sets' members in 256 buckets, differ too much can't reach the similarity; all others are compared by their exact sets. At a similarity of 0.8 or more a bit differs with a probability of at most 0.188, and 0.162 for sets of ten or more
(computed over all sizes); so the budgets, 48 of 128 bits and 30 of the first 64, miss a pair at the threshold with a chance
under 1e-6, and under 1e-8 for sets of ten or more. SimHash alone, with few enough bits for blocks, would miss most such pairs.

Defined cases: a text of fewer words than a shingle is one shingle, null or empty text is the empty set, equal to other empty
ones; a null id takes no part in links; an id with several texts is a row for each of them, linked like the rows of several ids;
A-Z are lower-cased, words split at ASCII white space; other columns are kept as they are, whatever their names."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import screened, slices, texts, whole_groups
from millrace.llm.components import components, numbered
from millrace.llm.shingles import mixed, shingle_sets
from millrace.llm.simhash import fold, trie_join
from millrace.session import drop_materialized, materialize

#: Texts in the sample that orders the shingles, and most shingles that it ranks.
SAMPLE, RANKED = 10_000, 50_000
#: Most differing bits of a pair that is compared: of both words of a fingerprint, and of the first.
BUDGET, HALF = 48, 30
#: Members of its groups that a set meets in the first round, and how many of them it is compared with, the closest.
MEETINGS, CLOSE = 32, 12
#: Shared shingles before the group's own that a row names.
BACK = 4
#: Buckets of a sketch.
BUCKETS = 256


def least_shared(n, m, similarity: float):
    """Members that sets of n and m members share at least where their similarity is reached."""
    return similarity * (n + m) / (1 + similarity) - 1e-9


def frequent(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, rank of each): the shingles found in four sampled texts or more, the most frequent last."""
    scale = 1 << 20
    n = docs.count()
    if n > SAMPLE:
        docs = docs.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(scale)) < int(scale * SAMPLE / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts(batch.column(0)), width, seed)))], ["h"])

    seen = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "h long").groupBy("h").count().where("count >= 4")
    top = seen.orderBy(F.desc("count"), "h").limit(RANKED).select("h").toArrow().column(0).to_numpy()
    order = np.argsort(top)
    return top[order], (len(top) - order).astype(np.int64)


def prefixes(docs: DataFrame, ranked: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, width: int, seed: int, similarity: float) -> DataFrame:
    """(doc_id, sig, key, n, f, g, sketch, prefix): a hash of the text; a digest, the size, the fingerprint and the sketch of its
    set, and the set's first members in the common order."""
    known, rank = ranked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = shingle_sets(texts(batch.column(2)), width, seed)
            keys, firsts = [], []
            for own in sets:
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    later = np.where(known[at] == own, rank[at], 0)
                    own = own[np.argsort(later, kind="stable")]
                firsts.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1])
            sizes = [len(s) for s in sets]
            members = np.concatenate(sets).view(np.uint64)
            f, g = fold(members, sizes), fold(mixed(members + np.uint64(1)), sizes)
            ends = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts), pa.int64()))
            made = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.array(sketches(members, sizes), pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "sig", "key", "n", "f", "g", "sketch", "prefix"])

    src = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("s"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "doc_id long, sig long, key binary, n int, f long, g long, sketch binary, prefix array<long>")


def sketches(members: np.ndarray, sizes: list[int]) -> list[bytes]:
    """How many members of each set fall into each of BUCKETS buckets, at most 255."""
    of = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes)
    own = np.bincount(of + (members % np.uint64(BUCKETS)).astype(np.int64), minlength=len(sizes) * BUCKETS)
    return [x.tobytes() for x in np.minimum(own, 255).astype(np.uint8).reshape(-1, BUCKETS)]


def possible(pairs: DataFrame, vertices: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity: two sets differ in at least as many members as their buckets do, and
    may differ in at most (1 - s) / (1 + s) of the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch.column(2).to_numpy() + batch.column(3).to_numpy().astype(np.int64)) * (1 - similarity) / (1 + similarity)
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in (4, 5))
            yield batch.filter(pa.array(np.abs(x - y).sum(1) <= n + 1e-9)).select(["a", "b"])

    of = lambda name: vertices.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column -> those whose value in it occurs more than once."""
    for columns in whole_groups(batches):
        same = columns[0][1:] == columns[0][:-1]
        shared = np.zeros(len(columns[0]), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in columns], ["h", "n", "node", "pos"])


def preceded(shared: DataFrame) -> DataFrame:
    """Rows (h, node, pos, ...) with h1, h2, ...: the shingles of the node's BACK rows before in its prefix, h where there is none."""
    by = Window.partitionBy("node").orderBy("pos")
    return shared.select("*", *(F.coalesce(F.lag("h", k).over(by), "h").alias(f"h{k}") for k in range(1, BACK + 1)))


def met_before(h: np.ndarray, before: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows of one group name the same shingle before its own, so that they meet in that one's group too."""
    out = np.zeros(len(i), dtype=bool)
    for x in before:
        own = x[i]
        some = own != h[i]
        for y in before:
            out |= some & (own == y[j])
    return out


def distance(f: np.ndarray, g: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[i] ^ f[j]).astype(np.int64) + np.bitwise_count(g[i] ^ g[j])


def met(similarity: float) -> Callable:
    """Rows (h, n, node, pos, f, g) sorted by h -> (node, other, bits): each member of a group and the next MEETINGS ones in an
    order of the group's own among those of near size, where size, place and fingerprints allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node, pos, f, g in whole_groups(batches):
            at = np.lexsort((n, h))
            kind, number, group, most = np.zeros(len(at), dtype=np.int64), -1, None, 0.0
            for i, (own, size) in enumerate(zip(h[at].tolist(), n[at].tolist())):
                if own != group or similarity * size > most:
                    number, group, most = number + 1, own, size + 1e-9
                kind[i] = number
            order = np.lexsort((mixed(h[at].view(np.uint64) ^ mixed(node[at].view(np.uint64))), kind))
            at, kind = at[order], kind[order]
            node, f, g, n, pos = node[at], f[at].view(np.uint64), g[at].view(np.uint64), n[at].astype(np.int64), pos[at].astype(np.int64)
            for k in range(1, MEETINGS + 1):
                i = np.flatnonzero(kind[k:] == kind[:-k])
                j = i + k
                bits = distance(f, g, i, j)
                keep = (bits <= BUDGET) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least_shared(n[i], n[j], similarity))
                i, j = i[keep], j[keep]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(bits[keep])], ["node", "other", "bits"])

    return run


def candidates(h: np.ndarray, n: np.ndarray, node: np.ndarray, pos: np.ndarray, c: np.ndarray, f: np.ndarray, g: np.ndarray, before: list[np.ndarray], similarity: float, closest: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one group (h ascending) and different components c that size, place and fingerprints allow, but for those
    that an earlier group brings; with `closest` so many at most for each node outside the group's largest component.

    What is asked of a pair is the same in all its groups but for the places, which allow most in the first one; so it is lost
    in none by being left to an earlier one."""
    n, pos, f, g = n.astype(np.int64), pos.astype(np.int64), f.view(np.uint64), g.view(np.uint64)
    order = np.lexsort((c, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(h)))
    by_size = np.lexsort((-counts, h[order][begins]))  # of each group the largest component first
    tops = by_size[np.concatenate([[True], np.diff(h[order][begins][by_size]) != 0])]
    inside = np.zeros(len(h), dtype=bool)
    largest = np.zeros(len(begins), dtype=bool)
    largest[tops] = True
    inside[order] = np.repeat(largest, counts)
    _, group = np.unique(h, return_inverse=True)
    open_ = np.zeros(group[-1] + 1, dtype=bool)
    open_[group[~inside]] = True
    rows = np.flatnonzero(open_[group])
    rows = rows[np.lexsort((f[rows], group[rows]))]
    outer = rows[~inside[rows]]
    runs = np.arange(group[-1] + 2)
    a_at, b_at = np.searchsorted(group[outer], runs), np.searchsorted(group[rows], runs)
    for i, j in trie_join(f[outer], a_at, f[rows], b_at, HALF):
        i, j = outer[i], rows[j]
        keep = (c[i] != c[j]) & (inside[j] | (node[i] < node[j]))
        keep &= distance(f, g, i, j) <= BUDGET
        i, j = i[keep], j[keep]
        keep = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        keep &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least_shared(n[i], n[j], similarity)
        i, j = i[keep], j[keep]
        keep = ~met_before(h, before, i, j)
        i, j = i[keep], j[keep]
        if closest:
            order = np.lexsort((distance(f, g, i, j), i))
            i, j = i[order], j[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) < closest
            i, j = i[near], j[near]
        if len(i):
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])


def apart(similarity: float, closest: int | None) -> Callable:
    """Rows (h, n, node, pos, c, f, g, h1, ...) sorted by h -> pairs (a, b) of one group in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, node, pos, c, f, g, *before in whole_groups(batches):
            for pair in candidates(h, n, node, pos, c, f, g, before, similarity, closest):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, pair)), ["a", "b"])

    return run


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h")


def occurrences(vertices: DataFrame) -> DataFrame:
    """(h, n, node, pos, f, g, h1, ...): a row for each shingle h of a vertex's prefix that stands in another one's prefix too."""
    postings = grouped(vertices.select("n", "node", F.posexplode("prefix").alias("pos", "h")).select("h", "n", "node", "pos"))
    shared = postings.mapInArrow(shared_only, "h long, n int, node long, pos int").join(vertices.select("node", "f", "g"), "node")
    return preceded(shared.select("h", "n", "node", "pos", "f", "g"))


def still_apart(shared: DataFrame, roots: DataFrame, similarity: float, closest: int | None) -> DataFrame:
    """Pairs (a, b) in different components of the table (node, root) that a group brings; few of them more than once."""
    before = shared.columns[6:]
    marked = shared.join(roots, "node", "left").select("h", "n", "node", "pos", F.coalesce("root", "node").alias("c"), "f", "g", *before)
    return grouped(marked).mapInArrow(apart(similarity, closest), "a long, b long")


def similar(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of vertices whose sets reach the similarity. Only texts that stand in a pair are moved."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(vertices, "node").select("node", F.col("doc_id").alias("d"), F.col("sig").alias("s"))
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("s"), F.col(text_col).alias("t"))
    needed = materialize(needed, "needed")
    src, may = screened(src, F.xxhash64("d", "s"), needed, F.xxhash64("d", "s"))
    held = materialize(src.where(may).join(needed, ["d", "s"]).dropDuplicates(["node"]).select("node", "t"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s"):
            left, right = texts(batch.column(2)), texts(batch.column(3))
            distinct = {t: i for i, t in enumerate(dict.fromkeys(left))}
            of_left, of_right = shingle_sets(list(distinct), width, seed), shingle_sets(right, width, seed)
            keep = []
            for x, q in zip(left, of_right):
                p = of_left[distinct[x]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = held.select(F.col("node").alias("a"), F.col("t").alias("s"))
    right = held.select(F.col("node").alias("b"), "t")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Tables of the rows (doc_id, sig, key, ...) with an id, and of the sets (key, node, c, ...): c is equal for linked ones."""
    how = (id_col, text_col, width, seed)
    marks = materialize(prefixes(docs.where(F.col(id_col).isNotNull()), frequent(docs, *how), *how, similarity), "prefixes")
    first = [F.first(c).alias(c) for c in ("n", "f", "g", "sketch", "prefix")]
    sets = marks.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"), F.count("*").alias("rows"), *first)
    vertices = materialize(numbered(sets), "vertices")
    shared = materialize(occurrences(vertices), "shared")
    pairs = grouped(shared.select("h", "n", "node", "pos", "f", "g")).mapInArrow(met(similarity), "node long, other long, bits long").groupBy("node", "other").agg(F.min("bits").alias("bits"))
    both = pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"), "bits"))
    closest = both.withColumn("rank", F.expr("row_number() OVER (PARTITION BY node ORDER BY bits, other)")).where(F.col("rank") <= CLOSE)
    pairs = closest.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    pairs = materialize(possible(pairs, vertices, similarity), "pairs")
    links = materialize(similar(pairs, vertices, docs, *how, similarity), "links")
    roots = components(links)
    for closest in (CLOSE, None):
        rest = still_apart(shared, roots, similarity, closest).distinct()
        rest = materialize(possible(rest, vertices, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = materialize(links.union(similar(rest, vertices, docs, *how, similarity)), "links")
        roots = components(links)
        pairs = pairs.union(rest)
    drop_materialized(shared, pairs, links)
    return marks, materialize(vertices.join(roots, "node", "left").select("key", "node", "doc_id", "rows", F.coalesce("root", "node").alias("c")), "classes")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs for each component, that with its smallest id; rows without id stay.

    Of several texts with that id the one with the smallest hash stays, and of equal rows one; where rows equal in id and text
    differ in other columns, that with the smallest JSON. Texts are moved only where a screen says that they may be a copy."""
    marks, classes = linked(docs, id_col, text_col, **how)
    sizes = classes.groupBy("c").agg(F.min("doc_id").alias("least"), F.sum("rows").alias("rows")).where("rows > 1")
    rows = materialize(marks.select("doc_id", "sig", "key").join(classes.join(sizes.select("c", "least"), "c").select("key", "c", "least"), "key"), "members")
    stay = rows.where("doc_id = least").groupBy("c").agg(F.min("sig").alias("stay"))
    each = rows.join(stay, "c").groupBy("doc_id", "sig").agg(F.max((F.col("doc_id") == F.col("least")) & (F.col("sig") == F.col("stay"))).alias("stays"), F.count("*").alias("n"))
    out = materialize(each.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_d"), F.col("sig").alias("_s"), "stays"), "copies")
    drop_materialized(rows, marks, classes)
    here = lambda df, other: (df[id_col] == other["_d"]) & (F.xxhash64(df[text_col]) == other["_s"])
    own_key = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))
    marked, may = screened(docs, own_key, out, F.xxhash64("_d", "_s"))
    maybe = marked.where(may).select(docs.columns)
    single = marked.where(~F.col(may)).select(docs.columns).union(maybe.join(out, here(maybe, out), "left_anti").select(docs.columns))
    again = out.where("stays")  # rows that occur more than once as they are
    whole = F.struct(*(maybe[c] for c in docs.columns))
    one = maybe.join(again, here(maybe, again), "left_semi").select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t"), whole.alias("_row"))
    one = one.groupBy("_d", "_t").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return single.union(one.select(docs.columns))
