import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_quality_rules import brute
from tests.llm.test_near_copies import brute_kept


def test_stages_on_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = []
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.read.parquet(path)
        seen.append((name, before, docs))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (_, raw, ruled), (_, _, scored), (_, near, single), (_, last, packed) = seen
    good = {d for d, q in labels.items() if q == 1 and not brute(raw[d])[1]}
    assert not any(brute(raw[d])[1] for d in ids(ruled)) and len(good & ids(ruled)) >= 0.97 * len(good)
    kept = ids(scored)
    assert len(good & kept) >= 0.95 * len(good) and sum(q == 0 and d in kept for d, q in labels.items()) <= 0.05 * sum(q == 0 for q in labels.values())
    assert ids(single) == brute_kept(near) < set(near)
    rows = packed.collect()
    for r in rows:
        assert r.length == len(r.ids)
    assert ids(packed) == set(last)


def test_run_is_the_stages(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_on_edge_rows(spark):
    """Nulls in any column, empty and very long texts, equal rows, ids with several texts, clashing names, empty tables."""
    sf = "/root/testdata/sf0.001"
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 1500").orderBy("doc_id").limit(4).collect()]
    long = " ".join(f"{w}{i}" for i in range(200) for w in prose[3].split())
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, ids array<int>, sig string, _d int, component_id int"
    more = ("w", "s", [1], "sig", 2, 3)
    rows = [
        (1, prose[0], "en", "a", 1, *more), (1, prose[0], "en", "a", 1, *more), (1, prose[1], None, None, None, *(None,) * 6), (None, prose[0], "en", "a", 1, *more),
        (2, None, None, None, None, *more), (3, "", "xx", "b", 0, *more), (4, long, "de", "c", 9, *more), (5, prose[2], "fr", "c", 9, *more), (6, "short", "en", "c", 9, *more),
    ]
    docs = spark.createDataFrame(rows, kind)
    left = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert stage(spark, docs.where("false"), sf).count() == 0
        if name == "packing":
            assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
            assert sorted(r.doc_id or -1 for r in got if r.start == 0) == sorted(r[0] or -1 for r in rows)
        else:
            assert out.columns == docs.columns
            left[name] = sorted((r.doc_id or -1, len(r.text or "")) for r in got)
    every = sorted((r[0] or -1, len(r[1] or "")) for r in rows)
    assert left["quality_rules"] == [x for x in every if x[1] > 100]
    assert set(left["quality_classifier"]) <= set(every)
    once = sorted({x for x in every if x[0] != 3})  # the empty text of document 3 is a copy of document 2's null
    assert left["near_duplicates"] == once


def test_stages_write_small_row_groups(spark, monkeypatch):
    """Tasks hold a row group each; at Parquet's default of 128 MB a heap of 1 GB is too small for eight of them."""
    text = F.expr("array_join(transform(sequence(1, 300), x -> sha2(concat(id, '-', x), 256)), ' ')")
    monkeypatch.setattr(p, "STAGES", [("bulky", lambda spark, docs, sf_dir: spark.range(0, 2400, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")))])
    files = p.run(spark, "/root/testdata/sf0.001").inputFiles()
    sizes = [group.total_byte_size for f in files for group in map(pq.ParquetFile(f.removeprefix("file://")).metadata.row_group, range(pq.ParquetFile(f.removeprefix("file://")).num_row_groups))]
    assert sum(sizes) > 40 << 20 and max(sizes) < 24 << 20
