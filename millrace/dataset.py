"""An immutable, lazy dataset over a DataFrame.

Column expressions are the first choice for filter and map, since Catalyst then prunes and pushes down; Python callables run
in Arrow batches. Every operator gives a new dataset and starts no job, except where it says so."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.inference import Shape, coerce, infer, same_schema, strict
from millrace.operators import position
from millrace.operators.position import POS
from millrace.sources import columnar, readers, writers

#: Most rows whose exact CPython shuffle is computed on the driver.
EXACT_ROWS = 5_000_000


class Dataset:
    def __init__(self, frame: DataFrame):
        self._frame = frame if POS in frame.columns else readers.from_frame(frame)

    # ---- making

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[dict | None], strict_keys: bool = False, schema: T.StructType | None = None) -> Dataset:
        if strict_keys:
            strict(rows)
        return cls(readers.from_rows(spark, rows, schema))

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: dict[str, list], types: dict[str, T.DataType] | None = None) -> Dataset:
        return cls(readers.from_columns(spark, columns, types))

    @classmethod
    def concat(cls, parts: Sequence[Dataset]) -> Dataset:
        """All rows of the parts, in order. Names and types must agree."""
        if not parts:
            raise ValueError("nothing to concatenate")
        for p in parts[1:]:
            if not same_schema(parts[0].schema, p.schema):
                raise ValueError(f"schemas differ: {parts[0].schema.simpleString()} and {p.schema.simpleString()}")
        names = parts[0].columns
        frames = [p._frame.select(F.concat(F.array(F.lit(i).cast("long")), F.col(POS)).alias(POS), *names) for i, p in enumerate(parts)]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return cls(out)

    # ---- looking

    @property
    def frame(self) -> DataFrame:
        """The rows without their order."""
        return self._frame.drop(POS)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._frame.columns if c != POS]

    @property
    def schema(self) -> T.StructType:
        return self.frame.schema

    def __len__(self) -> int:
        return self._frame.count()

    def __repr__(self) -> str:
        return f"Dataset({self.schema.simpleString()})"

    def index(self, name: str) -> int:
        if name not in self.columns:
            raise ValueError(f"no column {name}")
        return self.columns.index(name)

    def column(self, which: int | str) -> Column:
        return self._frame[self.columns[which] if isinstance(which, int) else self.columns[self.index(which)]]

    def null_counts(self) -> DataFrame:
        """One row: the nulls of each column."""
        return self.frame.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in self.columns))

    def head(self, n: int) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._frame.orderBy(POS).limit(n).drop(POS).collect()]

    def to_dict(self) -> list[dict]:
        """All rows on the driver, in order."""
        return [r.asDict(recursive=True) for r in writers.ordered(self._frame).collect()]

    def to_arrow(self) -> pa.Table:
        return writers.ordered(self._frame).toArrow()

    # ---- writing

    def save_to_disk(self, path: str) -> None:
        """Parquet, or the binary container where the path ends with its suffix."""
        if path.lower().endswith(columnar.SUFFIX):
            columnar.write_columnar(self._frame, path)
        else:
            writers.write_parquet(self._frame, path)

    def to_json(self, path: str, lines: bool = True) -> None:
        (writers.write_jsonl if lines else writers.write_json)(self._frame, path)

    # ---- columns

    def select_columns(self, names: Sequence[str], missing: str = "error") -> Dataset:
        """Columns in this order, repeats once. missing="null": an unknown name is a string column of nulls."""
        names = list(dict.fromkeys(names))
        if not names:
            raise ValueError("no columns")
        unknown = [n for n in names if n not in self.columns]
        if unknown and missing != "null":
            raise ValueError(f"no columns {unknown}")
        return Dataset(self._frame.select(POS, *(F.lit(None).cast("string").alias(n) if n in unknown else F.col(f"`{n}`") for n in names)))

    def remove_columns(self, names: Sequence[str]) -> Dataset:
        """All columns but these; unknown names are ignored."""
        if not set(self.columns) - set(names):
            raise ValueError("no column would be left")
        return Dataset(self._frame.drop(*[n for n in names if n != POS]))

    def with_columns(self, columns: dict[str, Column]) -> Dataset:
        return Dataset(self._frame.withColumns(columns))

    # ---- rows

    def filter(self, predicate: Column | str | Callable[[dict], object]) -> Dataset:
        """Rows for which the predicate holds: a column, an SQL condition, or a function of a dict (any true value keeps a row)."""
        if isinstance(predicate, (Column, str)):
            return Dataset(self._frame.where(predicate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.drop_columns([POS]).to_pylist()
                yield batch.filter(pa.array([bool(predicate(r)) for r in rows], pa.bool_()))

        return Dataset(self._frame.mapInArrow(run, self._frame.schema))

    def select(self, indices: Sequence[int]) -> Dataset:
        """Rows by position. Sorts once; the given positions are the only thing held on the driver."""
        return Dataset(position.gather(self._frame, list(indices)))

    def slice(self, start: int, stop: int) -> Dataset:
        rows = position.dense(self._frame).where((F.col("__row") >= start) & (F.col("__row") < stop))
        return Dataset(rows.drop("__row"))

    def shuffle(self, seed: int | None = None, exact: bool = False) -> Dataset:
        """A permutation by hash. exact=True: that of random.Random(seed).shuffle, computed on the driver, for bounded sizes."""
        if seed is None:
            seed = random.randrange(1 << 62)
        if not exact:
            return Dataset(position.shuffled(self._frame, seed))
        n = len(self)
        if n > EXACT_ROWS:
            raise ValueError(f"an exact shuffle is for at most {EXACT_ROWS} rows")
        order = list(range(n))
        random.Random(seed).shuffle(order)
        return self.select(order)

    def map(self, fn: Callable | dict[str, Column], batched: bool = False, batch_size: int = 1000, schema: T.StructType | None = None) -> Dataset:
        """What fn makes of each row: columns (a dict of expressions replaces the row), or a function of a dict that returns a
        dict or None (a row of nulls). batched: fn takes a list of batch_size rows and returns a list of any length.

        Without a schema the function runs once more beforehand, to infer it from all results."""
        if isinstance(fn, dict):
            return Dataset(self._frame.select(POS, *(c.alias(k) for k, c in fn.items())))
        if batched:
            return self._map_batches(fn, batch_size, schema)
        if schema is None:
            schema = _shape_of_results(self._frame, lambda rows: [fn(r) for r in rows]).row_type()
        full = T.StructType([T.StructField(POS, T.ArrayType(T.LongType())), *schema.fields])
        arrow, kind = to_arrow_schema(full), schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.drop_columns([POS]).to_pylist()
                out = [{**(coerce(_row(fn(r)), kind) or {}), POS: p} for r, p in zip(rows, batch.column(POS).to_pylist())]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        return Dataset(self._frame.mapInArrow(run, full))

    def _map_batches(self, fn: Callable[[list[dict]], list], size: int, schema: T.StructType | None) -> Dataset:
        numbered = position.dense(self._frame).withColumn("__chunk", F.floor(F.col("__row") / size))

        def results(table: pa.Table) -> list:
            table = table.sort_by("__row")
            out = fn(table.drop_columns([POS, "__row", "__chunk"]).to_pylist())
            if not isinstance(out, list):
                raise TypeError("a batched function returns a list")
            return out

        if schema is None:
            import pickle

            def shape(table: pa.Table) -> pa.Table:
                chunk = table.column("__chunk")[0].as_py()
                place = [chunk // 1000, chunk]  # shapes of a thousand batches merge before any reaches the driver
                return pa.table({"first": pa.array([place], pa.list_(pa.int64())), "raw": pa.array([pickle.dumps(infer(results(table)))], pa.binary())})

            whole = readers.merged_shape(numbered.groupBy("__chunk").applyInArrow(shape, "first array<bigint>, raw binary"))
            schema = whole.row_type()
        full = T.StructType([T.StructField(POS, T.ArrayType(T.LongType())), *schema.fields])
        arrow, kind = to_arrow_schema(full), schema

        def run(table: pa.Table) -> pa.Table:
            chunk = table.column("__chunk")[0].as_py()
            out = [{**(coerce(_row(r), kind) or {}), POS: [chunk, k]} for k, r in enumerate(results(table))]
            return pa.Table.from_pylist(out, schema=arrow)

        return Dataset(numbered.groupBy("__chunk").applyInArrow(run, full))


def _row(x):
    if x is not None and not isinstance(x, dict):
        raise TypeError(f"a row is a dict or None, not {type(x).__name__}")
    return x


def _shape_of_results(frame: DataFrame, fn) -> Shape:
    """The shape of what fn makes of the rows, merged in their order."""
    names = [c for c in frame.columns if c != POS]
    packed = frame.select(POS, F.struct(*names).alias("value"))
    return readers.shape_of(packed, lambda row: fn([row]), "value")


def load_dataset(spark: SparkSession, data_files: str | list[str]) -> Dataset:
    """A dataset from .json (arrays), .jsonl or .ndjson, .parquet or .nano (binary container) files; a list is concatenated in its order."""
    if isinstance(data_files, list):
        if not data_files:
            raise IndexError("no files")
        return Dataset.concat([load_dataset(spark, p) for p in data_files])
    if not isinstance(data_files, str):
        raise TypeError("data_files is a path or a list of paths")
    kind = data_files.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    by_kind = {"json": readers.read_json, "jsonl": readers.read_jsonl, "ndjson": readers.read_jsonl, "parquet": readers.read_parquet, "nano": columnar.read_columnar}
    if kind not in by_kind:
        raise ValueError(f"no reader for {data_files}")
    return Dataset(by_kind[kind](spark, data_files))


load_from_disk = load_dataset
