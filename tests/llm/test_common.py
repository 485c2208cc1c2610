import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm.common import screened, whole_groups


def test_screen_passes_all_that_is_wanted(spark):
    rows = spark.range(5000).select("id", F.lit("x").alias("_key"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("_may"))
    wanted = spark.range(0, 5000, 100)
    out, name = screened(rows, F.xxhash64("id"), wanted, F.xxhash64("id"))
    assert out.columns == [*rows.columns, name] and name not in rows.columns
    got = {r.id: r[name] for r in out.collect()}
    assert len(got) == 5000 and all(got[i] for i in range(0, 5000, 100)) and sum(got.values()) < 100
    none, name = screened(rows, F.xxhash64("id"), wanted.where("false"), F.xxhash64("id"))
    assert none.where(name).count() == 0 and none.count() == 5000


def test_groups_come_whole():
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([rng.integers(0, 300, 2000), np.full(5000, 150)]))
    at = 0
    batches = []
    while at < len(keys):
        size = int(rng.integers(0, 400))
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + size]), pa.array(np.arange(at, min(len(keys), at + size)))], ["k", "i"]))
        at += size
    got = list(whole_groups(iter(batches), rows=500))
    assert np.array_equal(np.concatenate([g[0] for g in got]), keys) and np.array_equal(np.concatenate([g[1] for g in got]), np.arange(len(keys)))
    assert sum(len(np.unique(g[0])) for g in got) == len(np.unique(keys)) and len(got) > 3
