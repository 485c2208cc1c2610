"""Calls of functions, ordered state and placement, as operations on tables of calls.

A call is a row: its arguments, and the number that orders it. Functions of one call run in Arrow batches wherever the row
lies. State is a fold over the ordered calls of its key. Placement assigns calls to nodes by expressions, with row numbers
made by a parallel sort (no single-partition window)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.inference import coerce
from millrace.operators.position import dense


class Remote:
    """A function of keyword arguments. call() runs it once for each row of a table of arguments."""

    def __init__(
        self, fn: Callable[..., Any], returns: T.DataType | str, partitions: int | None = None, env: dict[str, str] | None = None,
        cwd: str | None = None, python_path: list[str] | None = None, resources: Any = None,
    ):
        """env, cwd, python_path: variables, working directory and more places for imports while a task runs the function.
        resources: a pyspark.resource.ResourceProfile for the calls (Spark schedules by it on clusters, not on local masters)."""
        self.fn, self.returns = fn, returns
        self.settings = {"partitions": partitions, "env": env, "cwd": cwd, "python_path": python_path, "resources": resources}

    def options(self, **changes: Any) -> Remote:
        """A copy with these options; None keeps the old one."""
        unknown = set(changes) - set(self.settings)
        if unknown:
            raise TypeError(f"no options {sorted(unknown)}")
        return Remote(self.fn, self.returns, **{**self.settings, **{k: v for k, v in changes.items() if v is not None}})

    def call(self, arguments: DataFrame, name: str = "result") -> DataFrame:
        """arguments with one more column, the result. Lazy: nothing runs before an action."""
        kind = self.returns if isinstance(self.returns, T.DataType) else T._parse_datatype_string(self.returns)
        rows = arguments.repartition(self.settings["partitions"]) if self.settings["partitions"] else arguments
        schema = T.StructType([*arguments.schema.fields, T.StructField(name, kind)])
        arrow, fn, env = to_arrow_schema(schema), self.fn, self.settings["env"] or {}
        cwd, python_path = self.settings["cwd"], list(self.settings["python_path"] or [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import os
            import sys

            old = {k: os.environ.get(k) for k in env}
            here, paths = os.getcwd(), list(sys.path)
            os.environ.update(env)
            sys.path[:0] = python_path
            if cwd:
                os.chdir(cwd)
            try:
                for batch in batches:
                    out = [coerce(fn(**r), kind) for r in batch.to_pylist()]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow.field(name).type)], schema=arrow)
            finally:
                for k, v in old.items():
                    os.environ.pop(k, None) if v is None else os.environ.update({k: v})
                sys.path[:] = paths
                os.chdir(here)

        return rows.mapInArrow(run, schema, profile=self.settings["resources"])


def remote(returns: T.DataType | str, **options) -> Callable[[Callable], Remote]:
    """Decorator: a function whose calls are rows."""
    return lambda fn: Remote(fn, returns, **options)


def fold(calls: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, Any]], returns: str) -> DataFrame:
    """(key, order, result) of each call: step(state, call) gives the new state and the result; calls of a key run in order.

    Calls of one key run one after another by definition, so a key's calls are sorted to one task and stream through it in
    batches: only the state is held, whatever the number of calls. Where step is a sum or the like, use a window instead."""
    kind = T._parse_datatype_string(returns)
    fields = calls.schema
    schema = T.StructType([fields[key], fields[order], T.StructField("result", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    state, now, begun = start(), row[key], True
                state, result = step(state, row)
                out.append({key: row[key], order: row[order], "result": coerce(result, kind)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return calls.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def put(spark: SparkSession, value: Any, most: int = 64 << 20):
    """A value that every task can read (`.value`); its pickled size is checked."""
    import pickle

    size = len(pickle.dumps(value))
    if size > most:
        raise ValueError(f"a value of {size} bytes is too large to send to all tasks; write it as a table")
    return spark.sparkContext.broadcast(value)


def get(ref: Any) -> Any:
    """The value of a reference or the rows of a lazy result."""
    return ref.collect() if isinstance(ref, DataFrame) else ref.value


# ---- placement


def _pick(nodes: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, nodes)), at.cast("int") + 1)


def fifo(tasks: DataFrame, nodes: list[str]) -> DataFrame:
    """The first node that can take a task; each takes all."""
    return tasks.withColumn("owner", F.lit(nodes[0]))


def round_robin(tasks: DataFrame, nodes: list[str], order: str) -> DataFrame:
    """Nodes in turn, by the order of the tasks."""
    return dense(tasks, "__row", order).withColumn("owner", _pick(nodes, F.col("__row") % len(nodes))).drop("__row")


def pack(tasks: DataFrame, nodes: list[str], group: str, order: str) -> DataFrame:
    """All tasks of a placement group on one node: groups take nodes in turn, by their first task."""
    first = dense(tasks.groupBy(group).agg(F.min(order).alias("__first")), "__row", "__first")
    own = first.select(group, _pick(nodes, F.col("__row") % len(nodes)).alias("owner"))
    return tasks.join(own, group)


def spread(tasks: DataFrame, nodes: list[str], group: str, bundle: str) -> DataFrame:
    """Bundles of a placement group on different nodes while there are any: a group's bundles, in their order, on the nodes in turn.

    Where earlier tasks, pins or needs decide, use scheduling.place."""
    used = tasks.select(group, bundle).distinct()
    own = used.withColumn("owner", _pick(nodes, (F.expr(f"row_number() OVER (PARTITION BY `{group}` ORDER BY `{bundle}`)") - 1) % len(nodes)))
    return tasks.join(own, [group, bundle])


def eligible(tasks: DataFrame, nodes: DataFrame, task: str, node: str, needs: dict[str, str], pin: str | None = None) -> DataFrame:
    """(task, node) for each node that has what a task needs; needs: capacity column of nodes -> column of tasks.

    A pinned task only fits its node. A join on conditions: nodes are the small side, and Spark broadcasts it by its size."""
    on = F.lit(True)
    for have, want in needs.items():
        on = on & (nodes[have] >= tasks[want])
    if pin:
        on = on & (tasks[pin].isNull() | (tasks[pin] == nodes[node]))
    return tasks.join(nodes, on).select(tasks[task], nodes[node])


def owner_histogram(placed: DataFrame) -> DataFrame:
    return placed.groupBy("owner").agg(F.count("*").alias("n"))
