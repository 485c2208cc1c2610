import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lm


def brute(docs, trained):
    """(n_tokens, n_known, base) of each text, and the number of training tokens."""
    own = {d: lm.tokens((t or "").encode()) for d, t in docs.items()}
    c = Counter(w for d, ws in own.items() if trained(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in own.items()}, n


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want, n = brute(docs, lambda d: not held(d))
    got = {r.doc_id: r for r in lm.op6_lm_scoring(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, (size, known, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), size, known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    own = [r for r in got.values() if r.held_out]
    per = lambda c: sum(r[c] for r in own) / sum(r.n_tokens for r in own)
    assert per("score") > per("base_score") + 0.05, (per("score"), per("base_score"))


def test_probabilities_add_up(spark):
    """With a small vocabulary, the scores of all words after a context are a distribution (unseen words share one part a class)."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c a", "dd ee a"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs, F.lit(True), top=2, shapes=3, frequent=4)
    words = ["a", "b", "c", "dd", "ee"]
    probe = spark.createDataFrame([(i, w) for i, w in enumerate(["", *words])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(probe, model).collect()}
    bil, cls = model.bilinear, model.classes
    one = np.array([cls.start])
    logits = bil.context(one, one) @ bil.outputs.T + bil.bias
    p = np.exp(logits - bil.log_total(one, one)[:, None])[0]
    assert abs(p.sum() - 1) < 1e-4 and abs(10 ** got[0] - p[0]) < 1e-5
    counts = {bytes(r.word): r.c for r in model.counts.collect()}
    for s in range(len(cls.own), cls.number):
        inside = [c for w, c in counts.items() if cls.of(w) == s]
        assert abs(10 ** model.log_class[s] - (sum(inside) + len(inside) + 1)) < 1e-9
    after = lambda w: np.exp(bil.context(np.array([cls.of(w)]), one) @ bil.outputs.T + bil.bias - bil.log_total(np.array([cls.of(w)]), one)[:, None])[0, 0]
    for i, w in enumerate(x.encode() for x in words):
        c = cls.of(w)
        inner = 1.0 if c < len(cls.own) else (counts[w] + 1) / 10 ** model.log_class[c]
        assert abs(10 ** got[i + 1] - p[c] * inner * after(w)) < 1e-5


def test_contexts():
    cls = np.array([5, 6, 0, 0, 7, 0])
    one, two = lm.contexts(cls, np.array([0, 3, 4, 6]), 9)
    assert one.tolist() == [9, 5, 6, 9, 9, 7] and two.tolist() == [9, 9, 5, 9, 9, 9]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "A a", 1), (3, "A a", 1), (None, "new words", 1), (4, "x " * 100_000, 1)], "doc_id long, text string, score int")
    fold = lm.id_fold(F.col("doc_id"), 7)
    model = lm.fit(docs, fold >= 0)
    rows = lm.score(docs, model).collect()
    by = {r.doc_id: r for r in rows}
    want, n = brute({1: None, 2: "", 3: "a a", 30: "a a", -1: "new words", 4: "x " * 100_000}, lambda d: d > 0)
    assert len(rows) == 6 and model.n == n
    for d, k in ((1, 1), (2, 2), (3, 3), (None, -1), (4, 4)):
        assert (by[d].n_tokens, by[d].n_known) == want[k][:2] and abs(by[d].base_score - want[k][2]) < 1e-6 * max(1, -want[k][2])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    empty = lm.fit(docs.where("false"), F.lit(True))
    assert {r.base_score for r in lm.score(docs, empty).collect()} == {0.0}
    assert lm.score(docs.where("false"), empty).count() == 0
