import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents_match_brute_force(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op7_simhash"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fp(r.text) for r in rows}
    assert {i: x[0] for i, x in got.items()} == fps
    assert {i: x[1] for i, x in got.items()} == brute_components(fps)


def test_spark_hash_is_the_same_function(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_edge_rows(spark):
    long = "Word " * 50_000
    docs = spark.createDataFrame(
        [(5, "a", None), (3, "a", ""), (9, "b", " \t\n"), (7, "b", "ONE two"), (1, "c", "one TWO"), (None, "c", "one two"), (7, "b", "ONE two"), (8, "x", long)],
        "doc_id long, fp string, text string",
    )
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    ids = {d: c for d, _, c in got}
    assert len(got) == 8 and ids[5] == ids[3] == ids[9] == 3 and ids[7] == ids[1] == 1 and ids[8] == 8 and ids[-1] is None
    assert {f for d, f, _ in got if d in (3, 5, 9)} == {0}
    twice = spark.createDataFrame([(1, "a b c d"), (5, "e f g h"), (5, "i j k l"), (5, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(1, 1), (5, 1), (5, 5), (5, 5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("most", [100_000, 20])
def test_links_connect_as_all_pairs_do(spark, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base[:60] for k in (1, 2, 3, 4, 5)]
    block = [np.uint64((7 << 48) | int(x)) for x in rng.integers(0, 2**48, 200)]  # one block of bits that many share
    fps = sorted({int(x) for x in [*base, *near, *block]})
    rows = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)]
    vertices = spark.createDataFrame(rows, "fp long, node long")
    roots = {r.node: r.root for r in simhash.components(simhash.hamming_links(vertices, 3, most)).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: roots.get(i, i) for i in want} == want
    assert len(set(want.values())) < len(want)
