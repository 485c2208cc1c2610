import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric, text
from millrace.operators import attention, calls, topology
from millrace.operators.position import counted
from millrace.plans.catalog import QUERIES


@pytest.mark.parametrize("causal", [True, False])
def test_attention(spark, causal):
    rng = np.random.default_rng(7)
    q, k, v = (rng.normal(size=(2, 37, 8)) for _ in range(3))
    frame = lambda x: spark.createDataFrame([(h, i, x[h, i].tolist()) for h in range(2) for i in range(x.shape[1])], "head long, pos long, vec array<double>")
    got = {(r.head, r.pos): r.out for r in attention.attention(frame(q), frame(k), frame(v), causal, tile=10).collect()}
    for h in range(2):
        s = q[h] @ k[h].T / math.sqrt(8)
        if causal:
            s = np.where(np.tri(37, dtype=bool), s, -np.inf)
        w = np.exp(s - s.max(1, keepdims=True))
        want = (w / w.sum(1, keepdims=True)) @ v[h]
        for i in range(37):
            assert np.allclose(got[h, i], want[i], atol=1e-12)


def test_error_stats(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, x double")
    b = spark.createDataFrame([(1, 1.5), (2, 4.0)], "k long, x double")
    r = attention.error_stats(a, b, ["k"], "x").first()
    assert (r.max_error, r.mean_error) == (2.0, 1.25) and abs(r.mean_relative_error - (0.5 / 1.5 + 0.5) / 2) < 1e-12


@pytest.mark.parametrize("world,data,pipeline,tensor", [(8, 2, 2, 2), (16, 2, 4, 2), (12, 3, 2, 2)])
def test_topology(spark, world, data, pipeline, tensor):
    ranks = topology.groups(spark, world, data, pipeline, tensor)
    rows = topology.ring(ranks).collect()
    assert len(rows) == 4 * world
    by = {}
    for r in rows:
        by.setdefault((r.mode, r.group_id), []).append(r)
    for (mode, _), own in by.items():
        own.sort(key=lambda r: r.local_rank)
        assert [r.local_rank for r in own] == list(range(own[0].size))
        assert len(own) == {"data": data, "model": tensor * pipeline, "tensor": tensor, "pipeline": pipeline}[mode]
        assert [r.next_rank for r in own] == [r.rank for r in own[1:] + own[:1]] and [r.prev_rank for r in own] == [r.rank for r in own[-1:] + own[:-1]]
        assert own[0].is_first and own[-1].is_last
    seeds = {r.rank: r for r in topology.seeds(ranks, 5).collect()}
    place = {(r.rank, r.mode): r.local_rank for r in rows}
    assert all(s.data_seed == 5 and s.tensor_seed == 5 + place[i, "tensor"] + 1024 * place[i, "pipeline"] for i, s in seeds.items())
    to = topology.ranks_to_device(ranks, 0, pipeline=pipeline - 1).collect()
    assert [(r.rank, place[r.device, "pipeline"]) for r in to] == [(0, pipeline - 1)]
    with pytest.raises(ValueError):
        topology.check_world(world + 1, data, pipeline, tensor)


def test_remote_calls(spark):
    args = spark.createDataFrame([(i, i) for i in range(5)], "a long, b long")
    add = calls.remote("bigint")(lambda a, b: a + b)
    assert sorted(r.result for r in add.call(args).collect()) == [0, 2, 4, 6, 8]
    square = calls.Remote(lambda a, b: a * a, "bigint").options(partitions=2, env={"SOME_SETTING": "1"})
    assert sorted(r.result for r in calls.get(square.call(args))) == [0, 1, 4, 9, 16]
    where = calls.Remote(lambda a, b: __import__("os").environ.get("SOME_SETTING"), "string").options(env={"SOME_SETTING": "x"})
    assert {r.result for r in where.call(args).collect()} == {"x"}
    ref = calls.put(spark, [1, 2])
    assert calls.get(ref) == [1, 2]
    with pytest.raises(ValueError):
        calls.put(spark, b"x" * 100, most=50)


def test_fold(spark):
    rows = [("c", 1, 3), ("c", 2, 5), ("d", 2, 1), ("d", 1, 7), ("d", 3, 1)]
    df = spark.createDataFrame(rows, "actor string, seq long, add long").repartition(3)
    out = calls.fold(df, "actor", "seq", lambda: 0, lambda s, r: (s + r["add"], s + r["add"]), "bigint")
    assert sorted((r.actor, r.seq, r.result) for r in out.collect()) == [("c", 1, 3), ("c", 2, 8), ("d", 1, 7), ("d", 2, 8), ("d", 3, 9)]
    words = ["a b a", "b a c", "c c c a"]
    df = spark.createDataFrame([("k", i, w) for i, w in enumerate(words)], "actor string, seq long, text string")

    def count(state, row):
        for w in row["text"].split():
            state[w] = state.get(w, 0) + 1
        return state, [f"{w}{n}" for w, n in sorted(state.items(), key=lambda x: -x[1])[:2]]

    got = {r.seq: r.result for r in calls.fold(df, "actor", "seq", dict, count, "array<string>").collect()}
    assert got == {0: ["a2", "b1"], 1: ["a3", "b2"], 2: ["a4", "c4"]}


def test_placement(spark):
    tasks = spark.createDataFrame([(i, i % 2, i // 4) for i in range(8)], "seq long, bundle long, grp long").repartition(3)
    owners = lambda df: [r.owner for r in df.orderBy("seq").collect()]
    assert owners(calls.round_robin(tasks, ["A", "B"], "seq")) == list("ABABABAB")
    assert owners(calls.fifo(tasks, ["A", "B"])) == ["A"] * 8
    assert owners(calls.pack(tasks, ["A", "B"], "grp", "seq")) == list("AAAABBBB")
    assert owners(calls.spread(tasks, ["A", "B"], "grp", "bundle")) == list("ABABABAB")
    odd = spark.createDataFrame([(0, 2, 0), (1, 4, 0), (2, 2, 0), (3, 4, 1)], "seq long, bundle long, grp long")
    assert owners(calls.spread(odd, ["A", "B"], "grp", "bundle")) == list("ABAA")  # bundles of one group don't share a node
    hist = {r.owner: r.n for r in calls.owner_histogram(calls.round_robin(tasks, ["A", "B", "C"], "seq")).collect()}
    assert hist == {"A": 3, "B": 3, "C": 2}
    nodes = spark.createDataFrame([("x", 1.0, 0.0), ("y", 4.0, 1.0)], "node string, cpu double, gpu double")
    need = spark.createDataFrame([(1, 1.0, 0.0, None), (2, 2.0, 1.0, None), (3, 1.0, 0.0, "y"), (4, 9.0, 0.0, None)], "task long, cpus double, gpus double, pin string")
    got = calls.eligible(need, nodes, "task", "node", {"cpu": "cpus", "gpu": "gpus"}, "pin")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (1, "y"), (2, "y"), (3, "y")]


def test_placer():
    from millrace.operators.scheduling import PACK, SPREAD, Cluster, Node, Placer

    two = (Node("A", {"cpu": 1}), Node("B", {"cpu": 1}))
    runs = lambda cluster, tasks: (lambda p: [p.place(*t) for t in tasks])(Placer(cluster))
    one = {"cpu": 1}
    assert runs(Cluster(two), [(one,)] * 8) == list("ABABABAB")
    assert runs(Cluster(two, "fifo"), [(one,)] * 8) == ["A"] * 8
    assert len(set(runs(Cluster(two, groups={"g": PACK}), [(one, None, "g", i % 2) for i in range(6)]))) == 1
    assert runs(Cluster(two, groups={"g": SPREAD}), [(one, None, "g", i % 2) for i in range(8)]) == list("ABABABAB")
    assert runs(Cluster(two), [(one,), (one, "B"), (one,), ({"cpu": 2},), ({"gpu": 1},), (one,)]) == ["A", "B", "B", None, None, "A"]
    three = (Node("A", {"cpu": 4}), Node("B", {"cpu": 2}), Node("C", {"cpu": 4}))
    assert runs(Cluster(three), [({"cpu": 3},), ({"cpu": 3},), ({"cpu": 1},), ({"cpu": 3},)]) == ["A", "C", "A", "C"]
    assert runs(Cluster(three, groups={"g": PACK}), [(one, None, "g"), ({"cpu": 9}, None, "g"), (one, None, "g"), (one,)]) == ["A", None, "A", "B"]
    with pytest.raises(ValueError):
        Placer(Cluster(two)).place(one, None, "unknown")
    with pytest.raises(ValueError):
        Cluster(two, "any")


def test_queue(spark):
    from millrace.operators.scheduling import Cluster, Node, Queue

    args = spark.createDataFrame([(i,) for i in range(3)], "a long")
    square = calls.remote("bigint")(lambda a: a * a)
    queue = Queue(Cluster((Node("A", {"cpu": 1}), Node("B", {"cpu": 4}))))
    assert [queue.submit(square, args, {"cpu": n}) for n in (1, 9, 2)] == [0, 1, 2]
    done = queue.drain()
    assert [{(r.a, r.result, r.owner) for r in d.collect()} for d in done] == [{(i, i * i, o) for i in range(3)} for o in "AB"]
    assert len(queue) == 1 and queue.drain() == []


def test_actor_methods(spark):
    from millrace.operators.scheduling import Actor

    class Counter:
        def __init__(self, start=0):
            self.n = start

        def add(self, k=1):
            self.n += k
            return self.n

        def get(self):
            return self.n

    rows = [("c", 1, "add", 3, 10), ("c", 2, "add", 5, None), ("d", 1, "add", None, None), ("c", 3, "get", None, 7), ("d", 2, "get", None, None)]
    df = spark.createDataFrame(rows, "actor string, seq long, method string, k long, start long").repartition(3)
    out = Actor(Counter, "bigint").call(df, "actor", "seq", "method", ["k"], ["start"])
    assert sorted((r.actor, r.seq, r.result) for r in out.collect()) == [("c", 1, 13), ("c", 2, 18), ("c", 3, 18), ("d", 1, 1), ("d", 2, 1)]


def test_runtime_settings(spark, tmp_path):
    (tmp_path / "own_module_of_a_test.py").write_text("x = 5")
    args = spark.range(1).select(F.lit(1).alias("a"))
    fn = calls.Remote(lambda a: [str(__import__("own_module_of_a_test").x), __import__("os").getcwd()], "array<string>")
    got = fn.options(cwd=str(tmp_path), python_path=[str(tmp_path)]).call(args).first().result
    assert got == ["5", str(tmp_path)]
    with pytest.raises(TypeError):
        fn.options(nothing=1)


def test_expressions(spark):
    pad = " \t\n　\x1c x y \r\x85"
    df = spark.createDataFrame([(pad, 0.5), (None, -40.0)], "t string, x double")
    rows = df.select(text.strip(F.col("t")).alias("s"), text.or_empty(F.col("t")).alias("e"), F.size(text.tokens(F.col("t"))).alias("n"), numeric.sigmoid(F.col("x")).alias("g"), numeric.clamp(F.col("x"), -1.0, 0.25).alias("c")).collect()
    assert rows[0].s == pad.strip() == "x y" and rows[1].s is None and rows[1].e == "" and [r.n for r in rows] == [2, 0]
    assert abs(rows[0].g - 1 / (1 + math.exp(-0.5))) < 1e-12 and [r.c for r in rows] == [0.25, -1.0]
    x = 1
    for _ in range(5):
        x = (1103515245 * x + 12345) & 2147483647
    assert spark.range(1).select(numeric.lcg(F.lit(1).cast("long"), 5).alias("x")).first().x == x
    assert spark.range(1).select(numeric.to_int(F.lit(True)).alias("x"), numeric.to_int(F.lit(7).cast("long"), 32).alias("y")).first() == (1, 7)
    with pytest.raises(Exception):
        spark.range(1).select(numeric.to_int(F.lit(2147483648).cast("long"), 32)).collect()
    assert len(spark.range(1).select(numeric.short_id("obj-").alias("i")).first().i) == 12


def test_short_ids_of_many_rows_are_distinct(spark):
    """Random digits alone repeat among a million rows with a probability over 1 - 1e-50."""
    rows = counted(spark.range(0, 1_000_000, 1, 7), "n")
    ids = rows.select("n", numeric.short_id("obj-", F.col("n"), key=12345).alias("i"))
    found = ids.agg(F.count_distinct("i").alias("distinct"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.col("i").rlike("^obj-[0-9a-f]{8}$").cast("int")).alias("shaped")).first()
    assert found == (1_000_000, 0, 999_999, 1_000_000)
    edge = spark.createDataFrame([(0,), (2**32 - 1,), (None,)], "n long").select(numeric.short_id("", F.col("n"), key=2**32 - 1).alias("i"))
    assert len({r.i for r in edge.collect()}) == 3
    with pytest.raises(Exception, match="2\\^32 rows"):
        spark.range(2**32, 2**32 + 1).select(numeric.short_id("obj-", F.col("id"))).collect()


def test_short_ids_query_beyond_random_digits(spark, tmp_path):
    spark.range(0, 1_000_000, 1, 3).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["short_ids"](spark, str(tmp_path)).collect() == [(1_000_000, 1_000_000, 12, 12)]


def test_streams(spark, tmp_path):
    from millrace.streaming.keyed import keyed_fold, windowed_counts

    src = str(tmp_path / "in")
    rng = random.Random(1)
    rows = [(i, f"k{i % 3}", float(rng.randrange(10)), 60 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, k string, x double, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.where("seq < 30").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = keyed_fold(stream, "k", "seq", lambda s, x: s / 2 + x, "x").writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c1")).start()
    w = windowed_counts(stream, "ts", "k").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
        w.processAllAvailable()
        df.where("seq >= 30").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
        w.processAllAvailable()
        got = {(r.key, r.n): r.state for r in spark.table("folded").collect()}
        for k in ("k0", "k1", "k2"):
            s = 0.0
            for _, _, x, _ in (r for r in rows if r[1] == k):
                s = s / 2 + x
            assert abs(got[k, 20] - s) < 1e-9
        done = spark.table("windows").groupBy("window_start").agg(F.sum("n").alias("n")).collect()
        assert done and all(r.n == 5 for r in done)
    finally:
        q.stop()
        w.stop()
