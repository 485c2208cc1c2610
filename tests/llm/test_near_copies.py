import numpy as np

import corpus_pipeline as p
from millrace.llm import near_copies


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids that stay when all pairs of Jaccard similarity 0.8 or more are linked."""
    sets = {d: shingles(t) for d, t in rows.items()}
    root = {d: d for d in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def made():
    """Copies with up to 12 % of words changed, chains of edits, a large group of near copies, a passage that many share."""
    rng = np.random.default_rng(5)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 3000, k)]
    out = []
    for n in (6, 20, 60, 112, 300):
        for _ in range(12):
            base = word(n)
            out.append(base)
            for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.12):
                copy = list(base)
                for i in rng.integers(0, n, max(1, int(share * n))):
                    copy[i] = f"x{rng.integers(1e6)}"
                out.append(copy)
            out.append(base[: int(n * 0.9)])
    base = word(150)
    for _ in range(120):
        copy = list(base)
        for i in rng.integers(0, 150, rng.integers(1, 9)):
            copy[i] = f"y{rng.integers(1e6)}"
        out.append(copy)
    passage = word(40)
    out += [passage + word(int(k)) for k in rng.integers(5, 60, 120)]
    return {int(i): " ".join(w) for i, w in zip(rng.permutation(len(out)), out)}


def test_stage_links_what_brute_force_links(spark):
    rows = made()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = p.near_duplicates_stage(spark, docs, "")
    want = brute_kept(rows)
    assert len(want) < len(rows) - 100
    assert {r.doc_id for r in out.collect()} == want


def test_order_of_shingles_changes_nothing(spark, monkeypatch):
    rows = dict(list(made().items())[::2])
    monkeypatch.setattr(near_copies, "SAMPLE", 50)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == brute_kept(rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(5, None), (3, ""), (9, " \t\n"), (7, "ONE two"), (1, "one TWO"), (None, "one two"), (7, "ONE two"), (8, "Word " * 50_000), (2, "word " * 9)],
        "doc_id long, text string",
    )
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3]
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_one_id_with_several_texts(spark):
    """No text is lost that resembles no other, whatever its id; equal rows leave one; other columns don't matter."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near_b = b + " more"
    rows = [(1, a, "x", 0), (5, b, "x", 1), (5, c, "x", 2), (5, a, "x", 3), (6, near_b, "x", 4), (7, c, "y", 5), (7, c, "x", 5), (8, c + " z", "q", 0), (9, "d " * 30, "q", 1), (9, "d " * 30, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string, _d int")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[1], rows[2], rows[8]])
    only = spark.createDataFrame([(7, c, "y", 5), (7, c, "x", 6), (7, c, "x", 6)], docs.schema)
    assert [tuple(r) for r in near_copies.keep_one(only).collect()] == [(7, c, "x", 6)]


def test_shingle_sets_are_those_of_words():
    """As many distinct hashes as distinct shingles; equal shingles have equal hashes wherever they stand."""
    from millrace.llm.shingles import shingle_sets

    rng = np.random.default_rng(1)
    bits = ["a", "B", "word", "Word", "\xe9", "\xc9", "x" * 70, "1"]
    gaps = [" ", "\n", "\t ", "\x0b", "\x0c\r", "  "]
    made = ["".join(bits[i] + gaps[j] for i, j in zip(rng.integers(0, len(bits), k), rng.integers(0, len(gaps), k))) for k in rng.integers(0, 40, 300)]
    made += ["", " ", "q" * 3_000_000, "w " * 600_000 + "z"]
    sets = shingle_sets([t.encode() for t in made], 5, 42)
    number = {}
    for text, own in zip(made, sets):
        want = shingles(text)
        assert len(own) == len(want) and (own[1:] > own[:-1]).all()
        number.setdefault(frozenset(want), own.tobytes())
        assert number[frozenset(want)] == own.tobytes()
    alone = {s: shingle_sets([s], 5, 42)[0][0] for t in made[:100] for s in shingles(t)}
    for text, own in zip(made[:100], sets):
        assert set(own.tolist()) == {alone[s] for s in shingles(text)}
    assert len(set(alone.values())) == len(alone)


def test_trie_join_matches_all_pairs():
    from millrace.llm.simhash import trie_join

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = lambda n: np.array([rng.choice(base) ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 14), replace=False))) for _ in range(n)], dtype=np.uint64)
    sizes = [(0, 3), (1, 1), (60, 90), (5, 0), (200, 130), (3, 400)]
    a, b = [np.sort(near(x)) for x, _ in sizes], [np.sort(near(y)) for _, y in sizes]
    a[4][:100] = a[4][0]  # many equal keys
    b[4][:60] = a[4][0]
    a[4].sort()
    b[4].sort()
    at = lambda parts: np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    for budget in (0, 6, 30):
        found = [(i, j) for x, y in trie_join(np.concatenate(a), at(a), np.concatenate(b), at(b), budget) for i, j in zip(x.tolist(), y.tolist())]
        want = {(o + i, q + j) for o, q, x, y in zip(at(a), at(b), a, b) for i in range(len(x)) for j in range(len(y)) if int(x[i] ^ y[j]).bit_count() <= budget}
        assert len(found) == len(set(found)) and set(found) == want


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: int(n * rng.uniform(0.7, 1))], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)])
        x, y = (np.frombuffer(s, dtype=np.uint8).astype(int) for s in near_copies.sketches(np.concatenate([a, b]), [len(a), len(b)]))
        assert np.abs(x - y).sum() <= len(set(a) ^ set(b))


def test_groups_bring_a_pair_about_once(spark, monkeypatch):
    """Texts of a family share many groups; a pair comes from the first of them, and none is lost by that."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 3000, 200).tolist()
    texts = []
    for _ in range(60):
        copy = [f"w{x}" for x in base]
        for i in rng.integers(0, 200, rng.integers(2, 6)):
            copy[i] = f"y{rng.integers(1e6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate([*texts, *made().values()])), "doc_id long, text string")
    how = ("doc_id", "text", 5, 42)
    sets = near_copies.prefixes(docs, near_copies.frequent(docs, *how), *how, 0.8).dropDuplicates(["key"])
    vertices = near_copies.materialize(near_copies.numbered(sets), "vertices")
    roots = spark.createDataFrame([], "node long, root long")

    def brought(back):
        monkeypatch.setattr(near_copies, "BACK", back)
        rows = near_copies.still_apart(near_copies.occurrences(vertices), roots, 0.8, None).collect()
        return len(rows), {tuple(r) for r in rows}

    n, pairs = brought(near_copies.BACK)
    every, same = brought(0)
    assert pairs == same and len(pairs) > 1000
    assert n < 1.5 * len(pairs) and every > 4 * len(pairs)
