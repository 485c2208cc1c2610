import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc
from tests.llm.oracle import same


def test_sql(spark):
    got = same(spark, warc.op3_warc, warc.OP3_SQL, "/root/testdata/sf0.01")
    assert got.num_rows == 250


def records(spark):
    rows = [(1, b"same"), (2, b"same"), (3, b"other \r\n\r\nWARC/1.1"), (4, None), (5, b""), (6, b"x" * 3_000_000), (None, b"same"), (2, b"same")]
    df = spark.createDataFrame([(i, f"urn:page:{'' if i is None else i}", f"http://h{(i or 0) % 2}/\n{i}", p, "no") for i, p in rows], "page_id long, record_id string, target_uri string, payload binary, html string")
    return df.repartition(3)


def test_round_trip_and_revisits(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_warc(warc.with_revisits(records(spark), "page_id"), path, rollbytes=1000)
    rows = warc.read_warc(spark, path).collect()
    by = {(r.record_id, r.record_type): r for r in rows}
    assert len(rows) == 8
    assert by["urn:page:1", "revisit"].refers_to == "urn:page:2" and by["urn:page:1", "revisit"].payload is None and by["urn:page:1", "revisit"].payload_length == 4
    assert by["urn:page:4", "revisit"].refers_to == "urn:page:5" and by["urn:page:5", "response"].payload == b""
    assert by["urn:page:6", "response"].payload == b"x" * 3_000_000 and by["urn:page:", "response"].payload == b"same"
    assert by["urn:page:3", "response"].payload == b"other \r\n\r\nWARC/1.1"
    assert sum(r.record_id == "urn:page:2" for r in rows) == 2 and {r.payload_digest for r in rows if r.payload_length == 4} == {warc.sha1_base32(b"same")}
    assert len(glob.glob(f"{path}/*.warc.gz")) > 3
    none = warc.with_revisits(records(spark), "page_id", least=5).where("record_type = 'revisit'")
    assert none.count() == 0


def test_pushdown_skips_payloads(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    warc.write_warc(warc.with_revisits(records(spark), "page_id"), path)
    df = warc.read_warc(spark, path).where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1") & (F.col("payload_length") > 3))
    assert sorted(r.record_id for r in df.collect()) == ["urn:page:3"]
    wanted = []

    class Watched(warc.Gzipped):
        def block(self, length, want):
            wanted.append(want)
            return super().block(length, want)

    monkeypatch.setattr(warc, "Gzipped", Watched)
    reader = warc.WarcReader({"path": path, "payload": "none"})
    fs, _ = warc.file_system(path)
    kept = [r for p in reader.partitions() for f in p.paths for r in reader.rows(f, fs)]
    assert len(kept) == 8 and sum(wanted) == sum(r[1] == "revisit" for r in kept)


def test_orphans_are_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_warc(warc.with_revisits(records(spark), "page_id"), path)
    with open(f"{path}/part-orphan.warc.gz", "wb") as f:
        f.write(b"broken")
    assert warc.read_warc(spark, path, payload="none").count() == 8


@pytest.mark.parametrize("form", ["plain", "gzip"])
def test_foreign_archives(spark, tmp_path, form):
    """Files without manifest; gzip members that don't state their length."""
    own = [warc.record({"record_id": f"r{i}", "target_uri": "u", "payload": bytes([65 + i]) * (10**i)}) for i in range(6)]
    os.makedirs(tmp_path / "b")
    name = "x.warc" if form == "plain" else "x.warc.gz"
    (tmp_path / "b" / name).write_bytes(b"".join(own if form == "plain" else map(gzip.compress, own)))
    for payload in ("bytes", "none"):
        rows = warc.read_warc(spark, str(tmp_path / "b"), payload=payload).collect()
        assert [r.record_id for r in rows] == [f"r{i}" for i in range(6)]
        assert [r.payload for r in rows] == [bytes([65 + i]) * (10**i) if payload == "bytes" else None for i in range(6)]
    some = warc.read_warc(spark, str(tmp_path / "b")).where("record_id IN ('r4', 'r0')").collect()
    assert [len(r.payload) for r in some] == [1, 10_000]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_warc(records(spark).where("false"), path)
    assert warc.read_warc(spark, path).count() == 0
