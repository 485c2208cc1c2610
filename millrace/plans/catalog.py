"""The registered queries of the dataset engine and their SQL oracles.

Each runs an operator of the library over whole driver tables. Queries whose operator only needs part of a table's columns
read those columns alone; order-dependent operators take their order from a key, so results don't depend on file layout."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.dataset import Dataset, load_dataset
from millrace.functions import numeric
from millrace.functions.text import or_empty, strip, tokens
from millrace.operators import attention as att
from millrace.operators import calls, scheduling, topology
from millrace.operators.position import POS, counted, dense
from millrace.session import scratch_path
from millrace.sources import readers, writers

NODES = ["A", "B", "C"]
QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, name))


def _data(spark: SparkSession, sf_dir: str, name: str, order: str | None = None) -> Dataset:
    """A table as a dataset; `order`: a key that stands for the position of a row."""
    if order is None:
        return load_dataset(spark, _path(sf_dir, name))
    df = _table(spark, sf_dir, name)
    return Dataset(df.withColumn(POS, F.array(F.col(order).cast("long"))))


# ---- scans, projection, filter


@query("SELECT doc_id, lang FROM documents")
def project_columns(spark, sf_dir):
    return _data(spark, sf_dir, "documents").select_columns(["doc_id", "lang", "doc_id"]).frame


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS nope FROM documents")
def project_missing_as_null(spark, sf_dir):
    return _data(spark, sf_dir, "documents").select_columns(["doc_id", "nope"], missing="null").frame


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf_dir):
    return _data(spark, sf_dir, "orders").remove_columns(["o_orderdate", "o_orderpriority", "unknown"]).frame


@query("SELECT doc_id, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) AS n FROM documents WHERE length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) < 120")
def filter_short_text(spark, sf_dir):
    n = F.char_length(strip(or_empty(F.col("text")))).cast("long")
    return _data(spark, sf_dir, "documents").filter(n < 120).map({"doc_id": F.col("doc_id"), "n": n}).frame


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_callable(spark, sf_dir):
    ds = _data(spark, sf_dir, "orders").select_columns(["o_orderkey", "o_totalprice", "o_orderstatus"])
    return ds.filter(lambda r: r["o_totalprice"] > 100000 and r["o_orderstatus"] == "F").remove_columns(["o_orderstatus"]).frame


# ---- maps


@query("SELECT conv_id, turn, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS n_chars FROM conversations")
def map_lengths(spark, sf_dir):
    return _data(spark, sf_dir, "conversations").map({"conv_id": F.col("conv_id"), "turn": F.col("turn"), "n_chars": F.char_length(strip(F.col("text"))).cast("long")}).frame


@query("SELECT conv_id, turn, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text FROM conversations")
def map_normalize(spark, sf_dir):
    return _data(spark, sf_dir, "conversations").with_columns({"text": F.lower(strip(F.col("text")))}).select_columns(["conv_id", "turn", "text"]).frame


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE upper(c_mktsegment) END AS segment FROM customer")
def map_callable(spark, sf_dir):
    ds = _data(spark, sf_dir, "customer").select_columns(["c_custkey", "c_acctbal", "c_mktsegment"])
    return ds.map(lambda r: {"id": r["c_custkey"], "segment": None if r["c_acctbal"] < 0 else r["c_mktsegment"].upper()}).frame


@query("SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents")
def flatmap_lines(spark, sf_dir):
    return _data(spark, sf_dir, "documents").frame.select("doc_id", F.explode(F.split(or_empty(F.col("text")), "\n")).alias("line"))


@query("SELECT CAST((c_custkey - (SELECT min(c_custkey) FROM customer)) // 100 AS BIGINT) AS chunk, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def batched_map(spark, sf_dir):
    """Exact batches of 100 rows in the order of the key (dense, so a batch is a range of it), one row out for each."""
    ds = _data(spark, sf_dir, "customer", "c_custkey").select_columns(["c_custkey"])
    out = ds.map(lambda rows: [{"first": rows[0]["c_custkey"], "n": len(rows), "total": sum(r["c_custkey"] for r in rows)}], batched=True, batch_size=100)
    least = ds.frame.agg(F.min("c_custkey").alias("least"))
    return out.frame.crossJoin(least).select(F.floor((F.col("first") - F.col("least")) / 100).alias("chunk"), "n", "total")


# ---- order, positions, concatenation


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation UNION ALL SELECT * FROM nation")
def concat_files(spark, sf_dir):
    return load_dataset(spark, [_path(sf_dir, "nation")] * 3).frame


@query("SELECT v.ord AS ord, n.n_nationkey, n.n_name FROM (VALUES (0, 3), (1, 24), (2, 3), (3, 0)) AS v(ord, pos) JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) n ON v.pos = n.pos")
def select_positions(spark, sf_dir):
    ds = _data(spark, sf_dir, "nation", "n_nationkey").select([3, -1, 3, 0])
    return ds._frame.select(F.col(POS)[0].cast("int").alias("ord"), "n_nationkey", "n_name")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos BETWEEN 100 AND 1099")
def slice_range(spark, sf_dir):
    return _data(spark, sf_dir, "orders", "o_orderkey").select_columns(["o_orderkey"]).slice(100, 1100).frame


@query("SELECT * FROM customer")
def shuffle_rows(spark, sf_dir):
    return _data(spark, sf_dir, "customer").shuffle(42).frame


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def row_numbers(spark, sf_dir):
    return dense(_table(spark, sf_dir, "orders").select("o_orderkey"), "pos", "o_orderkey")


@query("SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk, o_orderkey FROM orders")
def row_chunks(spark, sf_dir):
    return row_numbers(spark, sf_dir).select(F.floor(F.col("pos") / 1000).alias("chunk"), "o_orderkey")


# ---- nulls, nested values, JSON


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS event_type, count(*) FILTER (WHERE value IS NULL) AS value, count(*) FILTER (WHERE props IS NULL) AS props FROM events")
def null_profile(spark, sf_dir):
    """Nulls of each column; the table has none, so one value is turned into null first."""
    ds = _data(spark, sf_dir, "events").with_columns({"event_type": F.nullif("event_type", F.lit("click"))})
    return ds.select_columns(["event_type", "value", "props"]).null_counts()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return _data(spark, sf_dir, "events").map({"event_id": F.col("event_id"), "k": F.from_json("props", "k bigint")["k"]}).frame


@query("SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"k\":' || json_extract(props, '$.k') || '}' AS row FROM events")
def json_encode(spark, sf_dir):
    rows = json_extract(spark, sf_dir)
    return rows.select("event_id", F.lit("k").alias("name"), "k", F.to_json(F.struct("event_id", "k")).alias("row"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(list_sum(list_transform(embedding[3:6], lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 6) AS part_sum FROM embeddings")
def nested_list_ops(spark, sf_dir):
    e = F.col("embedding")
    part = F.aggregate(F.slice(e, 3, 4), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("n"), F.round(e[0].cast("double"), 6).alias("first_value"), F.round(part, 6).alias("part_sum"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def struct_pack_unpack(spark, sf_dir):
    packed = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.char_length("text").alias("n")).alias("t"))
    return packed.select("conv_id", "t.turn", "t.role", F.col("t.n").cast("long").alias("n"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || text, '|' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def collect_conversation(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("|", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))).alias("body"))


@query("SELECT o_orderkey, CAST(octet_length(encode(o_orderpriority)) AS INTEGER) AS n_bytes, base64(encode(o_orderpriority)) AS b64 FROM orders")
def encode_text(spark, sf_dir):
    raw = F.encode("o_orderpriority", "UTF-8")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.octet_length(raw).alias("n_bytes"), F.base64(raw).alias("b64"))


# ---- aggregates


@query("""
    SELECT token, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS token FROM documents)
    GROUP BY token ORDER BY n DESC, token LIMIT 20""")
def token_topk(spark, sf_dir):
    """The 20 most frequent tokens: partial counts before the shuffle, and a top-k that keeps 20 rows a task."""
    words = _table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query("""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS token, unnest(range(len(regexp_extract_all(lower(text), '[a-zA-Z]+')))) AS i FROM documents)
    SELECT token, count(*) AS n, min(doc_id * 10000000 + i) AS first_seen FROM t GROUP BY token ORDER BY n DESC, first_seen LIMIT 20""")
def token_topk_first_seen(spark, sf_dir):
    """The same with ties by first appearance."""
    words = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    seen = F.min(F.col("doc_id") * 10000000 + F.col("at"))
    return words.groupBy("token").agg(F.count("*").alias("n"), seen.alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(20)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / greatest(1, sum(l_quantity)), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.round(numeric.weighted_mean(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


@query("SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def mean_reward(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("""
    SELECT round(max(abs(l_extendedprice - x)), 6) AS max_error, round(avg(abs(l_extendedprice - x)), 6) AS mean_error, round(avg(abs(l_extendedprice - x) / greatest(abs(x), 1e-6)), 6) AS mean_relative_error
    FROM (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS x FROM lineitem)""")
def error_stats(spark, sf_dir):
    out = _table(spark, sf_dir, "lineitem").agg(*att.gap_stats(F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 8) AS s, round(greatest(-1.0, least(1.0, c_acctbal / 5000)), 8) AS c FROM customer")
def sigmoid_clip(spark, sf_dir):
    x = F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(numeric.sigmoid(x / 1000), 8).alias("s"), F.round(numeric.clamp(x / 5000, -1.0, 1.0), 8).alias("c"))


@query("SELECT c_custkey, (1103515245 * ((1103515245 * c_custkey + 12345) & 2147483647) + 12345) & 2147483647 AS x FROM customer")
def lcg_steps(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", numeric.lcg(F.col("c_custkey"), 2).alias("x"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS as_long, CAST(p_size AS DOUBLE) AS as_double, CAST(p_size > 10 AS BIGINT) AS flag FROM part")
def coerce_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", numeric.to_int(F.col("p_size")).alias("as_long"), F.col("p_size").cast("double").alias("as_double"), numeric.to_int(F.col("p_size") > 10).alias("flag"))


# ---- attention


_ATTENTION = """
    WITH e AS (SELECT CAST(label AS BIGINT) AS head, vec_id AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    s AS (SELECT a.head, a.pos, list_dot_product(a.v, b.v) / 8.0 AS s, b.v FROM e a JOIN e b ON a.head = b.head {mask}),
    w AS (SELECT head, pos, v, exp(s - max(s) OVER (PARTITION BY head, pos)) AS w FROM s),
    d AS (SELECT head, pos, w, unnest(range(64)) AS dim, unnest(v) AS x FROM w)
    SELECT head, pos, dim, round(sum(w * x) / sum(w), 6) + 0.0 AS value FROM d GROUP BY head, pos, dim"""


def _attention(spark, sf_dir, causal):
    e = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("head"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    out = att.attention(e, e, e, causal)
    return out.select("head", "pos", F.posexplode("out").alias("dim", "value")).select("head", "pos", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query(_ATTENTION.format(mask="AND b.pos <= a.pos"))
def attention_causal(spark, sf_dir):
    return _attention(spark, sf_dir, True)


@query(_ATTENTION.format(mask=""))
def attention_full(spark, sf_dir):
    return _attention(spark, sf_dir, False)


@query("SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS dot FROM embeddings")
def dot_product(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(att.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"))


# ---- calls and placement


@query("SELECT n_nationkey, n_regionkey, CAST(n_nationkey * n_nationkey + n_regionkey AS BIGINT) AS result FROM nation")
def remote_call(spark, sf_dir):
    fn = calls.remote("bigint")(lambda n_nationkey, n_regionkey: n_nationkey * n_nationkey + n_regionkey)
    return fn.call(_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS result FROM events")
def actor_counter(spark, sf_dir):
    """A counter for each user: the state of an actor after each call."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id")
    return calls.fold(rows, "user_id", "event_id", lambda: 0, lambda s, r: (s + 1, s + 1), "bigint")


_OWNER = "['A', 'B', 'C'][CAST({at} % 3 AS INTEGER) + 1]"


@query(f"SELECT o_orderkey, {_OWNER.format(at='(row_number() OVER (ORDER BY o_orderkey) - 1)')} AS owner FROM orders")
def round_robin_owner(spark, sf_dir):
    return calls.round_robin(_table(spark, sf_dir, "orders").select("o_orderkey"), NODES, "o_orderkey")


@query("SELECT o_orderkey, 'A' AS owner FROM orders")
def fifo_owner(spark, sf_dir):
    return calls.fifo(_table(spark, sf_dir, "orders").select("o_orderkey"), NODES)


@query(f"""
    WITH g AS (SELECT o_custkey, {_OWNER.format(at='(row_number() OVER (ORDER BY min(o_orderkey)) - 1)')} AS owner FROM orders GROUP BY o_custkey)
    SELECT o_orderkey, o.o_custkey, owner FROM orders o JOIN g ON o.o_custkey = g.o_custkey""")
def pack_owner(spark, sf_dir):
    tasks = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return calls.pack(tasks, NODES, "o_custkey", "o_orderkey")


@query(f"""
    SELECT o_orderkey, o_custkey, {_OWNER.format(at='(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7) - 1)')} AS owner FROM orders""")
def spread_owner(spark, sf_dir):
    tasks = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).alias("bundle"))
    return calls.spread(tasks, NODES, "o_custkey", "bundle").select("o_orderkey", "o_custkey", "owner")


#: One row for each task placed so far, with the session's state: cursor, and the node of each of four bundles (-1: none).
#: {rule}: the candidates c among the nodes `fit` that a task's needs and pin leave.
_PLACED = """
    WITH RECURSIVE t AS (
        SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 1 + o_orderkey % 5 AS need,
            CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS pin, {bundle} AS bundle FROM orders
    ), r AS (
        SELECT DISTINCT o_custkey, CAST(NULL AS BIGINT) AS o_orderkey, 0::BIGINT AS n, 0 AS cur, [-1, -1, -1, -1] AS taken, CAST(NULL AS INTEGER) AS own FROM orders
        UNION ALL
        SELECT o_custkey, o_orderkey, n,
            CASE WHEN len(c) > 1 THEN (own + 1) % 3 ELSE cur END,
            CASE WHEN own IS NULL OR pin IS NOT NULL OR bundle IS NULL OR taken[bundle + 1] >= 0 THEN taken ELSE list_transform(range(4), lambda i: CASE WHEN i = bundle THEN own ELSE taken[i + 1] END) END,
            own
        FROM (
            SELECT *, CAST((cur + list_min(list_transform(c, lambda i: (i - cur + 3) % 3))) % 3 AS INTEGER) AS own FROM (
                SELECT *, {rule} AS c FROM (
                    SELECT t.*, r.cur, r.taken, list_filter(list_filter([0, 1, 2], lambda i: need <= 2 + i), lambda i: coalesce(i = pin, true)) AS fit
                    FROM r JOIN t ON t.o_custkey = r.o_custkey AND t.n = r.n + 1)))
    )
    SELECT o_custkey, o_orderkey, ['A', 'B', 'C'][own + 1] AS owner FROM r WHERE n > 0"""
_STUCK = "CASE WHEN pin IS NOT NULL THEN fit WHEN taken[bundle + 1] >= 0 THEN list_filter(fit, lambda i: i = taken[bundle + 1]) ELSE {new} END"
_UNUSED = "list_filter(fit, lambda i: NOT list_contains(taken, i))"


def _placed(spark, sf_dir, strategy=None):
    """Orders as tasks, a customer's orders as a session: nodes of 2, 3 and 4 units, needs of 1 to 5, some tasks pinned to B."""
    k = F.col("o_orderkey")
    tasks = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + k % 5).alias("need"), F.when(k % 11 == 0, F.lit("B")).alias("pin"), F.lit("g").alias("group"), (k % 4).alias("bundle"))
    nodes = tuple(scheduling.Node(name, {"unit": 2 + i}) for i, name in enumerate(NODES))
    cluster = scheduling.Cluster(nodes, "round_robin", {"g": strategy} if strategy else {})
    return scheduling.place(tasks, cluster, "o_custkey", "o_orderkey", {"unit": "need"}, "pin", "group" if strategy else None, "bundle")


@query(_PLACED.format(bundle="NULL::INTEGER", rule="fit"))
def placed_by_cursor(spark, sf_dir):
    return _placed(spark, sf_dir)


@query(_PLACED.format(bundle="0", rule=_STUCK.format(new="fit")))
def placed_packed(spark, sf_dir):
    return _placed(spark, sf_dir, scheduling.PACK)


@query(_PLACED.format(bundle="CAST(o_orderkey % 4 AS INTEGER)", rule=_STUCK.format(new=f"CASE WHEN len({_UNUSED}) > 0 THEN {_UNUSED} ELSE fit END")))
def placed_spread(spark, sf_dir):
    return _placed(spark, sf_dir, scheduling.SPREAD)


class _Account:
    """An actor with several methods: a balance that starts with the customer's number."""

    def __init__(self, start: int):
        self.balance = self.deposits = start

    def add(self, amount: int) -> int:
        self.balance += amount
        return self.balance

    def reset(self) -> int:
        self.balance = 0
        return self.balance

    def peek(self) -> int:
        return self.balance


@query("""
    WITH t AS (SELECT user_id, event_id, event_id % 9 AS m FROM events),
    s AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM t)
    SELECT user_id, event_id, CAST(CASE WHEN era = 0 THEN user_id ELSE 0 END + sum(CASE WHEN m BETWEEN 1 AND 6 THEN m ELSE 0 END) OVER (PARTITION BY user_id, era ORDER BY event_id) AS BIGINT) AS result FROM s""")
def actor_methods(spark, sf_dir):
    """A user's events as calls of one actor's methods: every ninth id resets, two of nine look, the others add."""
    m = F.col("event_id") % 9
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(m == 0, "reset").when(m >= 7, "peek").otherwise("add").alias("method"), F.when((m > 0) & (m < 7), m).alias("amount"))
    return scheduling.Actor(_Account, "bigint").call(rows, "user_id", "event_id", "method", ["amount"], ["user_id"])


@query(f"SELECT owner, count(*) AS n FROM (SELECT {_OWNER.format(at='(row_number() OVER (ORDER BY o_orderkey) - 1)')} AS owner FROM orders) GROUP BY owner")
def owner_histogram(spark, sf_dir):
    return calls.owner_histogram(round_robin_owner(spark, sf_dir))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON n_nationkey >= s_nationkey AND n_regionkey * 4000 - 2000 >= s_acctbal")
def eligible_nodes(spark, sf_dir):
    """Suppliers as tasks, nations as nodes; two capacities each."""
    nodes = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") * 4000 - 2000).alias("room"))
    tasks = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return calls.eligible(tasks, nodes, "s_suppkey", "n_nationkey", {"n_nationkey": "s_nationkey", "room": "s_acctbal"})


# ---- topology


_GROUPS = """
    SELECT r AS rank, 'data' AS mode, r % 8 AS group_id, r // 8 AS local_rank, 2 AS size FROM range(16) t(r)
    UNION ALL SELECT r, 'model', r // 8, r % 8, 8 FROM range(16) t(r)
    UNION ALL SELECT r, 'tensor', r // 2, r % 2, 2 FROM range(16) t(r)
    UNION ALL SELECT r, 'pipeline', (r // 8) * 2 + (r % 8) % 2, (r % 8) // 2, 4 FROM range(16) t(r)"""


@query(f"SELECT rank, mode, CAST(group_id AS BIGINT) AS group_id, CAST(local_rank AS BIGINT) AS local_rank, CAST(size AS BIGINT) AS size FROM ({_GROUPS})")
def topology_groups(spark, sf_dir):
    return topology.groups(spark, 16, 2, 4, 2)


@query(f"""
    SELECT rank, mode, first_value(rank) OVER w AS first_rank,
        coalesce(lead(rank) OVER w, first_value(rank) OVER w) AS next_rank,
        coalesce(lag(rank) OVER w, last_value(rank) OVER (PARTITION BY mode, group_id ORDER BY local_rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_rank,
        local_rank = 0 AS is_first, local_rank = size - 1 AS is_last
    FROM ({_GROUPS}) WINDOW w AS (PARTITION BY mode, group_id ORDER BY local_rank)""")
def topology_ring(spark, sf_dir):
    rows = topology.ring(topology.groups(spark, 16, 2, 4, 2))
    first = rows.where("is_first").select("mode", "group_id", F.col("rank").alias("first_rank"))
    return rows.join(first, ["mode", "group_id"]).select("rank", "mode", "first_rank", "next_rank", "prev_rank", "is_first", "is_last")


@query("SELECT r AS rank, CAST(7 AS BIGINT) AS data_seed, 7 + r % 2 + 1024 * ((r % 8) // 2) AS tensor_seed FROM range(16) t(r)")
def mode_seeds(spark, sf_dir):
    return topology.seeds(topology.groups(spark, 16, 2, 4, 2), 7)


@query("SELECT r AS rank, (r // 8) * 8 + 3 * 2 + r % 2 AS device FROM range(16) t(r)")
def ranks_to_device(spark, sf_dir):
    """The rank in the last pipeline stage that shares each rank's other places."""
    return topology.ranks_to_device(topology.groups(spark, 16, 2, 4, 2), pipeline=3)


@query(f"SELECT rank, CAST(max(CASE WHEN mode = 'data' THEN local_rank END) AS BIGINT) AS data, CAST(max(CASE WHEN mode = 'model' THEN local_rank END) AS BIGINT) AS model, CAST(max(CASE WHEN mode = 'tensor' THEN local_rank END) AS BIGINT) AS tensor, CAST(max(CASE WHEN mode = 'pipeline' THEN local_rank END) AS BIGINT) AS pipeline FROM ({_GROUPS}) GROUP BY rank")
def topology_places(spark, sf_dir):
    """Every rank's places, gathered."""
    return topology.local_ranks(topology.groups(spark, 16, 2, 4, 2))


# ---- sources and sinks: rows of a driver table are written to the scratch folder and read back


def _nested(spark, sf_dir) -> Dataset:
    """Suppliers with a struct, a list and nulls."""
    rows = _table(spark, sf_dir, "supplier").selectExpr(
        f"array(s_suppkey) AS `{POS}`", "struct(s_suppkey, s_name) AS who",
        "IF(s_nationkey % 3 = 0, NULL, array(bigint(s_nationkey), s_nationkey + 1L)) AS places", "IF(s_nationkey % 2 = 0, NULL, s_acctbal) AS balance",
    )
    return Dataset(rows)


_NESTED_SQL = """
    SELECT s_suppkey, s_name, CASE WHEN s_nationkey % 3 <> 0 THEN CAST(2 AS INTEGER) END AS n_places, CASE WHEN s_nationkey % 3 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS first_place,
        CASE WHEN s_nationkey % 3 <> 0 THEN CAST(s_nationkey + 1 AS BIGINT) END AS last_place, CASE WHEN s_nationkey % 2 <> 0 THEN s_acctbal END AS balance FROM supplier"""


def _flat(ds: Dataset) -> DataFrame:
    at = lambda i: F.get("places", F.lit(i))
    return ds.frame.select("who.s_suppkey", "who.s_name", F.when(F.col("places").isNotNull(), F.size("places")).alias("n_places"), at(0).alias("first_place"), at(1).alias("last_place"), "balance")


def _read_back(spark, ds: Dataset, suffix: str, **how) -> Dataset:
    path = scratch_path(spark, "round-trip") + suffix
    ds.to_json(path, **how) if how else ds.save_to_disk(path)
    return load_dataset(spark, path)


@query(_NESTED_SQL)
def json_lines_round_trip(spark, sf_dir):
    return _flat(_read_back(spark, _nested(spark, sf_dir), ".jsonl", lines=True))


@query(_NESTED_SQL)
def json_array_round_trip(spark, sf_dir):
    return _flat(_read_back(spark, _nested(spark, sf_dir), ".json", lines=False))


@query(_NESTED_SQL)
def container_round_trip(spark, sf_dir):
    return _flat(_read_back(spark, _nested(spark, sf_dir), ".nano"))


@query(_NESTED_SQL)
def parquet_round_trip(spark, sf_dir):
    return _flat(_read_back(spark, _nested(spark, sf_dir), ".parquet"))


@query(f"SELECT balance FROM ({_NESTED_SQL})")
def container_one_column(spark, sf_dir):
    return _read_back(spark, _nested(spark, sf_dir), ".nano").select_columns(["balance"]).frame


@query("SELECT n_name FROM nation")
def json_lines_one_field(spark, sf_dir):
    path = scratch_path(spark, "one-field") + ".jsonl"
    _data(spark, sf_dir, "nation", "n_nationkey").to_json(path)
    return readers.read_field(spark, path, "n_name")


@query("SELECT CASE WHEN r_regionkey <> 2 THEN CAST(r_regionkey AS BIGINT) END AS k, CASE WHEN r_regionkey > 2 THEN r_name END AS later, CAST(CASE WHEN r_regionkey <> 2 THEN CASE WHEN r_regionkey = 3 THEN 1.5 ELSE r_regionkey END END AS DOUBLE) AS x FROM region")
def json_lines_of_odd_rows(spark, sf_dir):
    """A null line, blank lines, a key that comes late, whole numbers among fractions."""
    k = F.col("r_regionkey")
    line = F.when(k == 2, "null").when(k < 2, F.format_string('{"k": %d, "x": %d}\n  ', k, k)).when(k == 3, F.format_string('{"k": 3, "x": 1.5, "later": "%s"}', "r_name")).otherwise(F.format_string('{"later": "%s", "k": %d, "x": %d}', "r_name", k, k))
    path = scratch_path(spark, "odd-rows") + ".jsonl"
    _table(spark, sf_dir, "region").orderBy("r_regionkey").select(line.alias("value")).coalesce(1).write.text(path)
    return load_dataset(spark, path).frame


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def rows_of_the_driver(spark, sf_dir):
    """All rows of a fixed table to the driver, in order, and back."""
    return Dataset.from_rows(spark, _data(spark, sf_dir, "nation", "n_nationkey").to_dict(), strict_keys=True).frame


@query("SELECT n_name, n_regionkey FROM nation")
def columns_of_the_driver(spark, sf_dir):
    table = _data(spark, sf_dir, "nation", "n_nationkey").select_columns(["n_name", "n_regionkey"]).to_arrow()
    return Dataset.from_columns(spark, table.to_pydict(), {"n_regionkey": T.IntegerType()}).frame


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def head_rows(spark, sf_dir):
    return Dataset.from_rows(spark, _data(spark, sf_dir, "documents", "doc_id").select_columns(["doc_id", "lang"]).head(20)).frame


@query("SELECT s_name, s_acctbal FROM supplier")
def columns_by_index_and_name(spark, sf_dir):
    ds = _data(spark, sf_dir, "supplier")
    return ds.frame.select(ds.column(1), ds.column("s_acctbal"))


@query("SELECT * FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double')) AS t(position, name, type), (SELECT count(*) AS n_rows FROM supplier)")
def described(spark, sf_dir):
    ds = _data(spark, sf_dir, "supplier")
    rows = [(ds.index(f.name), f.name, f.dataType.simpleString(), len(ds)) for f in ds.schema]
    return spark.createDataFrame(rows, "position int, name string, type string, n_rows long")


@query("SELECT * FROM (VALUES ('r_regionkey', true), ('r_name', true)) AS t(name, stored)")
def column_sizes(spark, sf_dir):
    return spark.createDataFrame([(name, size > 0) for name, size in writers.column_bytes(_path(sf_dir, "region")).items()], "name string, stored boolean")


@query("SELECT count(*) AS n, count(*) AS n_distinct, CAST(12 AS INTEGER) AS shortest, CAST(12 AS INTEGER) AS longest FROM orders")
def short_ids(spark, sf_dir):
    numbered = counted(_table(spark, sf_dir, "orders").select("o_orderkey"), "n")
    rows = numbered.select(numeric.short_id("obj-", F.col("n"), secrets.randbits(32)).alias("i"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("i").alias("n_distinct"), F.min(F.length("i")).alias("shortest"), F.max(F.length("i")).alias("longest"))
