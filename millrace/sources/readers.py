"""Readers: JSON arrays, JSON lines and Parquet, each with an explicit schema and an order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.inference import Shape, coerce, infer
from millrace.operators.position import POS, arrival, file_order

_BLANK = r"^\s*$"


def shape_of(rows: DataFrame, parse, column: str) -> Shape:
    """The merged shape of all rows: each task infers its own, parts merge in groups, and the driver merges the groups in order.

    parse: from the column's value to a list of rows (dicts or None)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        shape, first = Shape(), None
        for batch in batches:
            for value, pos in zip(batch.column(column).to_pylist(), batch.column(POS).to_pylist()):
                first = pos if first is None else first
                shape.merge(infer(parse(value)))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.list_(pa.int64())), pa.array([pickle.dumps(shape)], pa.binary())], ["first", "raw"])

    return merged_shape(rows.select(column, POS).mapInArrow(part, "first array<bigint>, raw binary"))


def merged_shape(parts: DataFrame) -> Shape:
    """The shape of parts (first: their place, raw: a pickled shape), merged in their order. Parts of neighbouring places, which
    agree in all of `first` but its last entry, meet in one task; the driver merges one shape of each such group."""
    import pickle

    def merged(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("first").to_pylist(), table.column("raw").to_pylist()))
        shape = Shape()
        for _, raw in own:
            shape.merge(pickle.loads(raw))
        return pa.table({"first": pa.array([own[0][0]], pa.list_(pa.int64())), "raw": pa.array([pickle.dumps(shape)], pa.binary())})

    grouped = parts.groupBy(F.slice("first", 1, F.greatest(F.size("first") - 1, F.lit(1)))).applyInArrow(merged, "first array<bigint>, raw binary")
    shape = Shape()
    for row in sorted(grouped.collect(), key=lambda r: r.first):
        shape.merge(pickle.loads(bytes(row.raw)))
    return shape


#: Rows from the start of a file that may tell the order of its fields.
HEAD_ROWS = 1000


def variant_shape(text: str) -> Shape | None:
    """The shape that schema_of_variant_agg's answer describes; None where it doesn't tell types apart as infer() does: mixed
    values, structs without fields, and decimals without a fraction (1.0, or integers beyond 64 bits)."""
    at = 0

    def word(stops: str) -> str:
        nonlocal at
        begin = at
        while at < len(text) and text[at] not in stops:
            at += 1
        return text[begin:at]

    def name() -> str:
        nonlocal at
        if text[at] != "`":
            return word(":")
        out, at = "", at + 1
        while True:
            out += word("`")
            at += 1
            if at < len(text) and text[at] == "`":
                out, at = out + "`", at + 1
            else:
                return out

    def kind() -> Shape | None:
        nonlocal at
        head = word("<>(,")
        if head == "OBJECT":
            out, at = Shape({"struct"}), at + 1
            while text[at] != ">":
                own = name()
                at += 2  # ": "
                value = kind()
                if value is None:
                    return None
                out.fields[own] = value
                if text[at : at + 2] == ", ":
                    at += 2
            at += 1
            return out if out.fields else None
        if head == "ARRAY":
            at += 1
            item = kind()
            at += 1
            return None if item is None else Shape({"list"}, item)
        if head == "DECIMAL":
            at += 1
            _, scale = word(")").split(",")
            at += 1
            return Shape({"float"}) if int(scale) else None
        known = {"VOID": set(), "BOOLEAN": {"bool"}, "BIGINT": {"int"}, "DOUBLE": {"float"}, "FLOAT": {"float"}, "STRING": {"str"}}
        return Shape(known[head]) if head in known else None

    return kind()


def ordered_as(shape: Shape, head: Shape) -> Shape | None:
    """shape with its fields in the order of head's; None where head lacks some."""
    if shape.item is not None:
        item = ordered_as(shape.item, head.item or Shape())
        return None if item is None else Shape(shape.kinds, item)
    if set(shape.fields) - set(head.fields):
        return None
    fields = {k: ordered_as(shape.fields[k], head.fields[k]) for k in head.fields if k in shape.fields}
    return None if None in fields.values() else Shape(shape.kinds, None, fields)


def native_shape(rows: DataFrame, head: Callable[[DataFrame], list], array: bool = False) -> Shape | None:
    """The shape of JSON texts (of one object, or of an array of them) by the JVM's own aggregate, with the order of fields from
    the first rows; None where either doesn't settle it, and shape_of() reads all rows in Python instead."""
    try:
        found = rows.agg(F.expr("schema_of_variant_agg(parse_json(value))").alias("t")).first().t or ""
    except Exception:  # a malformed text or a repeated key: shape_of() takes or refuses it
        return None
    if not found.startswith("ARRAY<OBJECT<" if array else "OBJECT<"):
        return None
    shape = variant_shape(found)
    if shape is not None and array:
        shape = shape.item
    return None if shape is None else ordered_as(shape, infer(head(rows)))


def head_lines(lines: DataFrame) -> list:
    return [json.loads(r.value) for r in lines.orderBy(POS).limit(HEAD_ROWS).select("value").collect()]


def head_elements(files: DataFrame) -> list:
    """The first elements of the first file's array, as far as they lie in its first megabyte."""
    first = files.orderBy(POS).select(F.substring("value", 1, 1 << 20).alias("t")).first()
    text, out, at = first.t if first else "", [], 0
    decoder, gap = json.JSONDecoder(), re.compile(r"[\s,\[]*")
    while len(out) < HEAD_ROWS:
        at = gap.match(text, at).end()
        try:
            row, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:  # the end of the array or of the megabyte
            break
        out.append(row)
    return out


def _loads(text: str):
    return json.loads(text)


def _python_rows(df: DataFrame, schema: T.StructType, parse) -> DataFrame:
    """Parse in Python: for columns whose values the JVM's reader doesn't convert."""
    full = T.StructType([T.StructField(POS, T.ArrayType(T.LongType())), *schema.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, pos in zip(batch.column("value").to_pylist(), batch.column(POS).to_pylist()):
                for k, row in parse(value):
                    out.append({**(coerce(row, schema) or {}), POS: pos if k is None else [*pos, k]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.select("value", POS).mapInArrow(run, full)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One object a line. Blank lines are skipped, the line null is a row of nulls, anything else raises."""
    lines = file_order(spark.read.text(path), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).where(~F.col("value").rlike(_BLANK))
    shape = None
    if schema is None:
        shape = native_shape(lines, head_lines) or shape_of(lines, lambda v: [_loads(v)], "value")
        schema = shape.row_type()
    if not schema.fields:
        return lines.select(POS)
    if shape is not None and shape.mixes_bool():
        return _python_rows(lines, schema, lambda v: [(None, _loads(v))])
    row = F.when(F.trim("value") != "null", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return lines.select(POS, row.alias("r")).select(POS, "r.*")


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """A file holds one array of objects or nulls. A file is one task, as its root can't be split."""
    files = file_order(spark.read.text(path, wholetext=True))
    bad = files.where(~F.col("value").rlike(r"^\s*\["))
    if bad.limit(1).count():
        raise TypeError("the root of a JSON file must be a list")
    shape = None
    if schema is None:
        shape = native_shape(files, head_elements, array=True) or shape_of(files, _loads, "value")
        schema = shape.row_type()
    if not schema.fields:
        return files.select(F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))), POS).select(F.concat(POS, F.array(F.col("pos").cast("long"))).alias(POS))
    if shape is not None and shape.mixes_bool():
        return _python_rows(files, schema, lambda v: enumerate(_loads(v)))
    rows = files.select(POS, F.posexplode(F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})).alias("k", "r"))
    return rows.select(F.concat(POS, F.array(F.col("k").cast("long"))).alias(POS), "r.*")


def read_field(spark: SparkSession, path: str, name: str, kind: str = "string") -> DataFrame:
    """One field of JSON lines; other fields are skipped by the parser."""
    return spark.read.schema(f"`{name}` {kind}").json(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return file_order(df, F.col("_metadata.row_index"))


def from_rows(spark: SparkSession, rows: list[dict | None], schema: T.StructType | None = None) -> DataFrame:
    """Rows of the driver."""
    kind = schema or infer(rows).row_type()
    full = T.StructType([T.StructField(POS, T.ArrayType(T.LongType())), *kind.fields])
    own = [{POS: [i], **(coerce(row, kind) or {f.name: None for f in kind})} for i, row in enumerate(rows)]
    return spark.createDataFrame(own, full)


def from_columns(spark: SparkSession, columns: dict[str, list], types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Columns of the driver, with explicit types where given."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    known = types or {}
    schema = T.StructType([T.StructField(k, known.get(k) or _column_type(k, v)) for k, v in columns.items()])
    return from_rows(spark, [dict(zip(columns, values)) for values in zip(*columns.values())], schema)


def _column_type(name: str, values: list) -> T.DataType:
    shape = Shape()
    for v in values:
        shape.see(v)
    return shape.type(name)


def from_frame(df: DataFrame) -> DataFrame:
    return df.withColumn(POS, arrival())
