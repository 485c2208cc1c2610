import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, packing
from millrace.llm.queries import QUERIES

PATH = packing.tokenizer_path()


def test_ids_are_those_of_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    bits = ["word", "Word", "re", "'s", "don't", ".", ",", "...", "?!", "12", "3rd", "é", "ñandú", "日本", "#", "<|endoftext|>", "a b", "\x00", "x́.", "…", "²."]
    gaps = [" ", " ", " ", "\n", "", "  ", "\n\n", " \n", "\t", " ", "　"]
    texts = ["", " ", "\n", "a ", " a", "a\n", "\na", "a\n b"]
    texts += ["".join(rng.choice(bits) + rng.choice(gaps[: rng.choice([4, 5, 11])]) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    memo = bpe.Memo(PATH, most_bytes=60_000)
    at = 0
    while at < len(texts):
        part = texts[at : at + 37]
        ids, lengths = memo.encode(pa.array(part), 0)
        o = 0
        for x, n in zip(part, lengths):
            assert ids[o : o + n].tolist() == t.encode(x, add_special_tokens=False).ids + [0], repr(x)
            o += n
        at += 37


def test_ids_of_documents_with_a_kept_memo(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()]
    memo, t = bpe.Memo(PATH), Tokenizer.from_file(PATH)
    for a in range(0, 150, 30):  # later slices find words that earlier ones left
        ids, lengths = memo.encode(pa.array(texts[a : a + 30]))
        own = [t.encode(x, add_special_tokens=False).ids for x in texts[a : a + 30]]
        assert ids.tolist() == [i for x in own for i in x] and lengths.tolist() == list(map(len, own))


def test_ids_of_words_that_merge_alone():
    """Words of Latin letters with marks on either side of them, at the start of texts and lines and inside."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, (0xC0, 0xD6, 0xD7, 0xD8, 0xDF, 0xE9, 0xF7, 0xFF, 0x120, 0x10A, 0x1BB, 0x1C0, 0x24F, 0x250, 0xAA, 0xB5, 0x2B0, 0x301, 0x416, 0x4E2D)))
    marks = ["", "", ".", "'", "'s", "''", "s'", "!?", "#$%", "`~", "(", ")", "\\", "_", "^", "&&&", "'ll", "'re", "'t."]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n"]).join(rng.choice(marks[:4]) + word() + rng.choice(marks) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    memo, t = bpe.Memo(PATH), Tokenizer.from_file(PATH)
    ids, lengths = memo.encode(pa.array([*texts, None, ""]))
    assert lengths[-2:].tolist() == [0, 0]
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        gaps = rng.integers(1, 12, rng.integers(1, 30))
        places = np.concatenate([[0], np.cumsum(gaps)])
        cost = rng.integers(0, 6, len(places))
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= 16:
                    pad = 0 if n & (n - 1) == 0 else 16 - n
                    best[j] = min(best[j], best[i] + pad + 2 + int(cost[j]))
        got = packing.cuts(places, cost, 16, 2)
        total = 0
        for i, j in zip(got, got[1:]):
            n = int(places[j] - places[i])
            assert 0 < n <= 16
            total += (0 if n & (n - 1) == 0 else 16 - n) + 2 + int(cost[j])
        assert got[0] == 0 and got[-1] == len(places) - 1 and total == best[-1]


def check(rows, texts):
    """Every id lies in one piece, in order; sequences are gapless and at most 1024 long. Returns the share of padding."""
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array(t.encode(texts[d] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        pad += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    return pad / total


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(QUERIES["op10_packing"](spark, sf).collect(), texts) < 0.02


def test_edge_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "x" * 20_000, 5: "One. Two.\nThree"}
    docs = spark.createDataFrame([(i, 7, t) for i, t in texts.items()], "doc_id long, length long, text string").repartition(2)
    rows = packing.pack(docs, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, texts)
    twice = packing.pack(docs.union(docs).where("doc_id = 5"), PATH, as_array=True).collect()
    assert sum(r.length for r in twice) == sum(len(r.ids) for r in twice) == 2 * twice[0].doc_tokens
    nameless = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.length) for r in packing.pack(nameless, PATH).collect()] == [(None, 2)]
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_a_full_memo_keeps_recurring_words():
    memo, t = bpe.Memo(PATH, most_bytes=200_000), Tokenizer.from_file(PATH)
    often = [f"common{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    learned, learn = [], memo._learn
    memo._learn = lambda units: (learned.extend(units.to_pylist()), learn(units))
    rng, most = random.Random(6), 0
    for _ in range(30):
        text = " ".join([*often, *("".join(rng.choices("abcdefghij", k=9)) for _ in range(600))])
        ids, _ = memo.encode(pa.array([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        most = max(most, memo.bytes)
    assert len(learned) > 15_000 and most < 400_000  # it was full several times
    assert [learned.count(w) for w in often[1:]] == [1] * (len(often) - 1)


def test_units_of_one_beginning_are_told_apart():
    words = ["x" * n for n in range(1, 40)] + ["é" * n for n in range(1, 20)] + ["a" * 16 + c for c in "abc"] + ["日本" * n for n in range(1, 9)]
    memo, t = bpe.Memo(PATH), Tokenizer.from_file(PATH)
    own = bpe.keys(pa.array(words))
    assert len(set(zip(*own.tolist()))) == len(words)
    assert bpe.keys(pa.array(["left out", *words]).slice(1)).tolist() == own.tolist()
    for _ in range(2):
        assert memo.encode(pa.array([" ".join(words)]))[0].tolist() == t.encode(" ".join(words), add_special_tokens=False).ids
