import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity as t
from millrace.llm.common import offsets


def brute_marginals(u, moves):
    """Log odds of tag 1 by summing over all taggings."""
    weight = {}
    for tags in itertools.product((0, 1), repeat=len(u)):
        s = sum(x for x, y in zip(u, tags) if y) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))
        weight[tags] = np.exp(s)
    return [np.log(sum(w for k, w in weight.items() if k[i]) / sum(w for k, w in weight.items() if not k[i])) for i in range(len(u))]


def test_marginals_match_all_taggings():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 0, 6, 2]
    u, moves = rng.normal(size=sum(sizes)) * 2, rng.normal(size=(2, 2))
    at = offsets(sizes)
    got = t.marginals(u, at, moves)
    for a, b in zip(at, at[1:]):
        if a < b:
            assert np.allclose(got[a:b], brute_marginals(u[a:b], moves), atol=1e-9)


def test_training_finds_tags():
    rng = np.random.default_rng(1)
    bad = [b"vile", b"Vile!", b"awful"]
    rows = []
    for _ in range(400):
        words = [b"w%d" % rng.integers(60) for _ in range(8)]
        tags = [0] * 8
        if rng.random() < 0.4:
            i = int(rng.integers(8))
            words[i], tags[i] = bad[rng.integers(3)], 1
        rows.append((words, tags))
    field = t.train(rows[:300])
    for words, tags in rows[300:]:
        z = t.marginals(t.odds(words, field), offsets([8]), field.moves)
        assert ((z > 0) == np.array(tags)).all()


def test_held_out_accuracy_and_spans(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: (r.toxic, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in t.op9_toxicity(spark, sf).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())

    def rates(keep):
        held = [(got[d].predicted, y) for d, (y, q) in labels.items() if got[d].held_out and keep(q)]
        hit = sum(p == y == 1 for p, y in held)
        return hit / sum(p for p, _ in held), hit / sum(y for _, y in held)

    # precision and recall over all held-out labels: some junk (quality 0) is labelled toxic though none of its words are
    precision, recall = rates(lambda q: True)
    assert precision > 0.95 and recall > 0.85
    precision, recall = rates(lambda q: q == 1)
    assert precision > 0.97 and recall > 0.95
    model = t.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    text = "Étre bon. You are a scum and that is it, moron."
    one = spark.createDataFrame([(1, text), (2, "All is well here.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in t.add_score(one, model, spans="spans")[0].collect()}
    assert [text[s.begin : s.stop] for s in rows[1].spans] == ["scum", "moron."] and rows[1].score > 0.5
    assert rows[2].spans == [] and rows[2].score < 0.5


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a b. c", 1.0), (3, "a b. c", 1.0), (None, "x " * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, 0), (None, 1), (2, None), (77, 0)], "doc_id long, toxic int")
    model = t.fit(docs, labels, F.lit(True))
    scored, name = t.add_score(docs, model, spans="spans")
    rows = scored.collect()
    assert name == "score_" and scored.columns == ["doc_id", "text", "score", "score_", "spans"] and len(rows) == 5
    assert len({r[name] for r in rows if not r.text}) == 1 and all(0 <= r[name] <= 1 for r in rows)
    none = t.fit(docs.where("false"), labels.where("false"), F.lit(True))
    assert {r.score_ for r in t.add_score(docs, none)[0].collect()} == {0.5}
    assert t.add_score(docs.where("false"), model)[0].count() == 0
