import re
from collections import Counter

import numpy as np

from millrace.llm import quality_rules as q
from millrace.llm.queries import QUERIES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))
    return counts, n < 50 or 100 * len(inside) > 50 * n


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        g, (counts, failed) = got[r.doc_id], brute(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == counts
        assert g.base_failed == failed and not (failed and g.kept)
    good = [got[r.doc_id].kept for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect() if not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.9


def test_certified_cutoffs_reject_and_keep_their_bound(spark):
    """On sf0.1 a rule rejects labelled bad documents that pass the base rule, the holdout loses at most alpha of its good ones
    in each stratum, and `kept` is what a plain reading of the cutoffs gives."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held, counts, shares, own, found = q._fitted(docs, labels, "doc_id", "text", "lang")
    label = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    rejected, seen = {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in docs.collect():
        (_, measures), (_, failed) = q.measure(r.text.encode()), brute(r.text)
        cuts = found.by_stratum.get(r.lang, found.pooled)
        beyond = any(int(m * q.BINS) >= c for m, c in zip(measures, cuts))
        assert got[r.doc_id].kept == (not failed and not beyond)
        if r.doc_id in label and not failed:
            seen[label[r.doc_id]] += 1
            rejected[label[r.doc_id]] += beyond
    assert rejected[0] >= 0.9 * seen[0] and rejected[1] <= 0.02 * seen[1]


def test_exact_bound():
    from math import comb, log

    for k, n, p in ((0, 30, 0.1), (3, 40, 0.2), (10, 10, 0.3), (25, 40, 0.2), (0, 5, 0.9), (900, 50_000, 0.02)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 1000 else None
        got = q.log_binomial_cdf(k, n, p)
        if want is None:
            from fractions import Fraction

            a = Fraction(p)
            term, total = (1 - a) ** n, Fraction(0)
            term = float(term)
            logs = [np.log1p(-p) * n]
            for i in range(1, k + 1):
                logs.append(logs[-1] + np.log((n - i + 1) / i * p / (1 - p)))
            want = np.exp(np.logaddexp.reduce(logs))
        assert abs(got - log(want)) < 1e-9
    assert q.certified(0, 300, 0.01, 0.05) and not q.certified(0, 298 - 1, 0.01, 0.05)
    assert not q.certified(0, 0, 0.5, 0.5)
    assert isinstance(q.certified(10_000_000, 10**9, 0.02, 0.01), bool)


def test_risk_is_controlled():
    """Good and bad documents share two measures; over many draws the true joint loss rarely exceeds alpha."""
    rng = np.random.default_rng(2)
    excess = gained = 0
    empty = np.zeros((len(q.RULES), q.BINS + 1), dtype=np.int64)
    for _ in range(200):
        good = np.minimum(rng.exponential(12, (2, 4000)).astype(int), q.BINS)
        bad = np.minimum(rng.exponential(60, (2, 4000)).astype(int), q.BINS)
        path, alive_g, alive_b = [], np.ones(2000, bool), np.ones(4000, bool)
        for _ in range(4):
            g, b = empty.copy(), empty.copy()
            for i in range(2):
                g[i] = np.bincount(good[i, :2000][alive_g], minlength=q.BINS + 1)
                b[i] = np.bincount(bad[i][alive_b], minlength=q.BINS + 1)
            found = q.propose(g, b, 0.5)
            if found is None:
                break
            path.append(q.Stage(*found, q.steps(path)))
            alive_g &= good[found[0], :2000] < found[2]
            alive_b &= bad[found[0]] < found[2]
        losses = np.zeros(q.steps(path), dtype=np.int64)
        for x in good[:, 2000:].T:
            at = [s.first + s.lax - min(x[s.rule], s.lax) for s in path if x[s.rule] >= s.strict]
            if at:
                losses[min(at)] += 1
        cuts = q.cutoffs_after(path, q.walk(losses, 2000, 0.02, 0.1))
        true = 1 - np.prod([1 - np.exp(-c / 12) if c <= q.BINS else 1 for c in cuts[:2]])
        excess += true > 0.02
        gained += min(cuts) <= q.BINS
    assert excess <= 30  # 10 % of 200, with room for chance
    assert gained > 150


def test_steps_of_a_path_are_its_cutoffs():
    path = [q.Stage(2, 90, 88, 0), q.Stage(0, 40, 40, 3), q.Stage(2, 85, 84, 4)]
    assert q.steps(path) == 6
    at = lambda n: [q.cutoffs_after(path, n)[i] for i in (0, 2)]
    none = q.BINS + 1
    assert [at(n) for n in range(7)] == [[none, none], [none, 90], [none, 89], [none, 88], [40, 88], [40, 85], [40, 84]]


def test_edge_rows(spark):
    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, None, "en", 0, 1), (2, "", None, 0, 1), (3, good, "en", 0, 1), (3, good, "en", 0, 1), (None, good, None, 0, 1), (4, "x y z " * 200_000, "en", 0, 1), (5, "é é \x1c", "fr", 9, 1)],
        "doc_id long, text string, lang string, n_words int, kept int",
    )
    labels = spark.createDataFrame([(3, 1, None), (3, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = q.judged(docs, labels).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == 0 and not by[1].kept and by[3].kept and by[None].kept
    assert by[4].n_words == by[4].n_repeat_words == 600_000 and by[4].base_failed
    assert by[5].n_words == 2 and by[5].word_chars == 4
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 3]
    assert q.judged(docs.where("false"), labels.where("false")).count() == 0
    assert q.judged(docs, labels.where("false")).where("kept").count() == 3


def test_few_labels_still_certify_and_copies_count_once(spark, tmp_path):
    """Some 230 distinct good holdout texts are enough; the same number of rows made of copies isn't."""
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", 1) for i in range(700)]
    bad = [(i, " ".join(f"#$%{i}x{k}" for k in range(60)), "en", 0) for i in range(700, 800)]
    copies = [(i, good[i % 100][1], "en", 1) for i in range(700)]
    for name, rows in (("own", good), ("copied", copies)):
        made = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, quality int")
        made.drop("quality").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        made.select("doc_id", "quality").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, f"{tmp_path}/{name}").where("kept").collect()}
        assert kept == set(range(700 if name == "own" else 800))


def test_own_strata_can_certify():
    sizes = {"a": 500, "b": 220, "c": 200, None: 180}
    own, level = q.own_strata(sizes, 1100, 0.02, 0.05)
    assert own == ["a", "b"] and level == 0.05 / 3  # c and the null stratum share a pool of 380
    assert q.own_strata(sizes, 1120, 0.02, 0.05)[0] == ["a", "b"]
    assert q.own_strata({"a": 180}, 180, 0.02, 0.05) == ([], 0.05)
    assert q.own_strata({"a": 500, "b": 240}, 840, 0.02, 0.05)[0] == ["a"]  # 100 others alone could certify nothing
    assert q.own_strata({"a": 500, "b": 240}, 740, 0.02, 0.05)[0] == ["a", "b"]
