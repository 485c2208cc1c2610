import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality_classifier as q
from millrace.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.93


def test_contexts_match_a_plain_count():
    places, signs = q.index_vectors(11)
    texts = [b"a b a", b"", b"c", b"The cat, the hat!!"]
    total = np.zeros(q.BUCKETS * q.DIM, dtype=np.int64)
    want = np.zeros((q.BUCKETS, q.DIM), dtype=np.int64)
    for own, at in q.streams(texts):
        q.add_contexts(total, own, at, places, signs)
        for a, b in zip(at, at[1:]):
            run = own[a:b].tolist()
            for x, y in [*zip(run, run[1:]), *zip(run[1:], run)]:
                want[x, places[y]] += signs[y]
    assert (total.reshape(want.shape) == want).all() and want.any()


def test_pooling_in_steps():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(q.BUCKETS, q.DIM)).astype(np.float32)
    texts = [b"one two three", b"", b"w " * 200_000, b"last. One"]
    x, sizes = q.pooled(texts, vectors)
    for i, t in enumerate(texts):
        alone, n = q.pooled([t], vectors)
        assert np.allclose(alone[0], x[i], atol=2e-3) and n[0] == sizes[i]
    assert sizes[1] == 0 and not x[1].any()


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = q.train(x[:3000], y[:3000])
    score = net.score(x[3000:])
    assert abs(score.mean() - y[3000:].mean()) < 0.06 and np.corrcoef(score, p[3000:])[0, 1] > 0.9


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b", 1), (3, "a b", 1), (None, "x " * 100_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1), (77, 0)], "doc_id long, quality int")
    model = q.fit(docs, labels, F.lit(True))
    scored, name = q.add_score(docs, model)
    rows = scored.collect()
    assert name == "score_" and scored.columns == ["doc_id", "text", "score", "score_"] and len(rows) == 5
    assert {r[name] for r in rows if not r.text} == {model.network.prior}
    none = q.fit(docs.where("false"), labels.where("false"), F.lit(True))
    assert q.add_score(docs, none)[0].agg(F.min("score_"), F.max("score_")).first() == (0.5, 0.5)
    assert q.add_score(docs.where("false"), none)[0].count() == 0
