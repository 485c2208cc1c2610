import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ann


def brute(rows, is_query, k):
    """Exact neighbours, nearest first, ties to the smaller id."""
    out = {}
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    for i, q in {i: q for i, q in rows if is_query(i)}.items():
        d = np.sqrt(((v - np.array(q, dtype=np.float64)) ** 2).sum(1))
        keep = np.flatnonzero(ids != i)
        keep = keep[np.lexsort((ids[keep], d[keep]))][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in keep]
    return out


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    got = {}
    for r in ann.op1_nearest(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = [len({x for x, _ in want[q]} & {x for x, _ in got[q].values()}) / 10 for q in want]
    assert np.mean(hits) >= 0.98
    exact = dict(rows)
    for q, g in got.items():
        for x, d in g.values():
            assert abs(d - np.linalg.norm(np.array(exact[q], dtype=np.float64) - np.array(exact[x], dtype=np.float64))) < 1e-12


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 96))
    q = rng.normal(size=(20, 96))
    mean, turn = x.mean(0), ann.rotation(96, 1)
    code, norm, own = ann.encode(x, mean, turn)
    y = (q - mean) @ turn
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    got = ann.estimate(unit, code, own, rng)
    want = unit @ ((x - mean) @ turn / norm[:, None]).T
    bound = 3.0 * np.sqrt(1 - own**2) / own / np.sqrt(95)
    assert abs((got - want).mean()) < 2e-3 and (np.abs(got - want) <= bound[None, :]).mean() > 0.99


def test_many_blocks_and_chunks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda i: i % 7 == 0, 5)
    got = {}
    for r in ann.search(df, F.col("id") % 7 == 0, 5, block_rows=100, chunk_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([len(set(got[q]) & {x for x, _ in w}) / 5 for q, w in want.items()]) > 0.95


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, code string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("id").isin(0, 3, 6, 7), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (3, 1, 1, 0.0), (3, 2, 0, 1.0), (3, 3, 2, 2.0)]
    assert ann.search(df.where("false"), F.col("id") == 0).count() == 0
    one = ann.search(df.where("vec_id = 0"), F.col("id") == 0)
    assert one.count() == 0


def test_query_matches_sql(spark):
    from millrace.llm.queries import ORACLE_SQL, QUERIES
    from tests.llm.oracle import same

    for sf in ("sf0.01", "sf0.1"):
        same(spark, QUERIES["op1_nearest"], ORACLE_SQL["op1_nearest"], f"/root/testdata/{sf}")
