"""A binary columnar container as a Spark data source.

Fixed values of the format: five bytes NANO0, the header's length as a little-endian unsigned 32-bit integer, a JSON header,
then the buffers one after another. The header has schema.fields (name, dtype.kind, nullable), batches (length, columns) and
buffers (offset, length). A column has dtype, length, kind (primitive, string, list, struct), the numbers of its buffers
(values, offsets, and validity if it has nulls) and its child or children (with names). Validity is a bit a value from the
lowest, 1 for valid; offsets are 32-bit; a bool is a byte. Kinds of dtype: bool, int32, int64, float32, float64, string,
list, struct.

These are Arrow's own buffers but for bools, so batches are built on them without a loop over values. A batch is a
partition, and only the buffers of the wanted columns (option `columns`) are read."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.operators.position import POS
from millrace.sources.files import commit_manifest, committed, file_system

MAGIC = b"NANO0"
SUFFIX = ".nano"
_PRIMITIVE = {"bool": pa.bool_(), "int32": pa.int32(), "int64": pa.int64(), "float32": pa.float32(), "float64": pa.float64()}
_BATCH_ROWS = 65_536


# ---- writing


class _Blobs:
    def __init__(self):
        self.parts: list[bytes] = []

    def add(self, data) -> int:
        self.parts.append(bytes(data))
        return len(self.parts) - 1


def _encode(a: pa.Array, blobs: _Blobs) -> dict:
    kind = a.type
    meta: dict = {"length": len(a)}
    if a.null_count:
        meta["validity"] = blobs.add(np.packbits(a.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        raw = a.cast(pa.binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(raw), 0).to_numpy(zero_copy_only=False)
        meta |= {"dtype": {"kind": "string"}, "kind": "string", "offsets": blobs.add(_offsets(sizes)), "values": blobs.add(b"".join(x for x in raw.to_pylist() if x))}
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        meta |= {"dtype": {"kind": "list"}, "kind": "list", "offsets": blobs.add(_offsets(sizes)), "child": _encode(a.flatten(), blobs)}
    elif pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        meta |= {"dtype": {"kind": "struct"}, "kind": "struct", "names": names, "children": [_encode(x, blobs) for x in a.flatten()]}
    else:
        name = next((n for n, t in _PRIMITIVE.items() if t == kind), None)
        if name is None:
            raise TypeError(f"the container has no type for {kind}")
        zero = False if name == "bool" else 0
        values = pa.compute.fill_null(a, pa.scalar(zero, kind)).to_numpy(zero_copy_only=False)
        meta |= {"dtype": {"kind": name}, "kind": "primitive", "values": blobs.add(np.ascontiguousarray(values).view(np.uint8) if len(values) else b"")}
    return meta


def _offsets(sizes: np.ndarray) -> bytes:
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    if out[-1] >= 1 << 31:
        raise OverflowError("a batch's column holds more than 2^31 - 1 bytes or elements")
    return out.astype("<i4").tobytes()


def to_bytes(batches: list[pa.RecordBatch], schema: pa.Schema) -> bytes:
    blobs = _Blobs()
    columns = [{"length": b.num_rows, "columns": [_encode(c, blobs) for c in b.columns]} for b in batches]
    kind = lambda t: "string" if pa.types.is_string(t) else "list" if pa.types.is_list(t) else "struct" if pa.types.is_struct(t) else next(n for n, x in _PRIMITIVE.items() if x == t)
    nulls = [any(b.column(i).null_count for b in batches) for i in range(len(schema))]
    fields = [{"name": f.name, "dtype": {"kind": kind(f.type)}, "nullable": n} for f, n in zip(schema, nulls)]
    places, at = [], 0
    for p in blobs.parts:
        places.append({"offset": at, "length": len(p)})
        at += len(p)
    header = json.dumps({"schema": {"fields": fields}, "batches": columns, "buffers": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *blobs.parts])


# ---- reading


def read_header(handle) -> tuple[dict, int]:
    """The header, and where the buffers begin."""
    head = handle.read(len(MAGIC) + 4)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a columnar container: the first bytes differ")
    (size,) = struct.unpack("<I", head[len(MAGIC) :])
    return json.loads(handle.read(size)), len(MAGIC) + 4 + size


def _type(meta: dict) -> pa.DataType:
    kind = meta["dtype"]["kind"]
    if kind == "string":
        return pa.string()
    if kind == "list":
        return pa.list_(_type(meta["child"]))
    if kind == "struct":
        return pa.struct([(n, _type(c)) for n, c in zip(meta["names"], meta["children"])])
    return _PRIMITIVE[kind]


def header_schema(header: dict) -> pa.Schema:
    """Names and types; nested types come from the first batch."""
    names = [f["name"] for f in header["schema"]["fields"]]
    if header["batches"]:
        return pa.schema([(n, _type(c)) for n, c in zip(names, header["batches"][0]["columns"])])
    return pa.schema([(n, _PRIMITIVE.get(f["dtype"]["kind"], pa.string())) for n, f in zip(names, header["schema"]["fields"])])


def _decode(meta: dict, buffer) -> pa.Array:
    n = meta["length"]
    valid = pa.py_buffer(buffer(meta["validity"])) if "validity" in meta else None
    kind = meta["kind"]
    if kind == "primitive":
        raw = buffer(meta["values"])
        if meta["dtype"]["kind"] == "bool":
            raw = np.packbits(np.frombuffer(raw, dtype=np.uint8) != 0, bitorder="little").tobytes()
        return pa.Array.from_buffers(_type(meta), n, [valid, pa.py_buffer(raw)])
    if kind == "string":
        return pa.Array.from_buffers(pa.string(), n, [valid, pa.py_buffer(buffer(meta["offsets"])), pa.py_buffer(buffer(meta["values"]))])
    if kind == "list":
        return pa.Array.from_buffers(_type(meta), n, [valid, pa.py_buffer(buffer(meta["offsets"]))], children=[_decode(meta["child"], buffer)])
    if kind == "struct":
        return pa.Array.from_buffers(_type(meta), n, [valid], children=[_decode(c, buffer) for c in meta["children"]])
    raise TypeError(f"no column kind {kind!r}")


def read_batch(handle, header: dict, start: int, number: int, names: list[str]) -> pa.RecordBatch:
    """One batch; only the buffers of the named columns are read."""
    every = [f["name"] for f in header["schema"]["fields"]]
    own = header["batches"][number]

    def buffer(i: int) -> bytes:
        place = header["buffers"][i]
        handle.seek(start + place["offset"])
        return handle.read(place["length"])

    return pa.RecordBatch.from_arrays([_decode(own["columns"][every.index(n)], buffer) for n in names], names)


class Piece(InputPartition):
    def __init__(self, path: str, file: int, batch: int):
        super().__init__((path, file, batch))
        self.path, self.file, self.batch = path, file, batch


class ColumnarReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.names, self.position = options["path"], [n for n in schema.names if n != POS], POS in schema.names

    def partitions(self) -> list[Piece]:
        fs, _ = file_system(self.path)
        out = []
        for i, path in enumerate(committed(self.path, (SUFFIX,))):
            with fs.open_input_file(path) as f:
                out += [Piece(path, i, b) for b in range(len(read_header(f)[0]["batches"]))]
        return out or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(piece.path) as f:
            header, start = read_header(f)
            batch = read_batch(f, header, start, piece.batch, self.names)
        if self.position:
            n = header["batches"][piece.batch]["length"]
            flat = np.stack([np.full(n, piece.file), np.full(n, piece.batch), np.arange(n)], axis=1).astype(np.int64).ravel()
            pos = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3), pa.int32()), pa.array(flat))
            batch = pa.RecordBatch.from_arrays([pos, *batch.columns], [POS, *self.names])
        yield batch


class Wrote(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class ColumnarWriter(DataSourceArrowWriter):
    """A task writes one file; its name begins with the number of the task, so the order of sorted rows is that of the names."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, held, rows = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            name = f"part-{TaskContext.get().partitionId():07d}-{len(files):05d}-{uuid.uuid4().hex}{SUFFIX}"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(table.combine_chunks().to_batches(max_chunksize=_BATCH_ROWS), table.schema))
            files.append(name)

        for batch in iterator:  # a file holds a bounded number of rows
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 4 * _BATCH_ROWS:
                flush()
                held, rows = [], 0
        if held:
            flush()
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        commit_manifest(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, root = file_system(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f}")


class ColumnarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "columnar"

    def schema(self) -> T.StructType:
        fs, _ = file_system(self.options["path"])
        files = committed(self.options["path"], (SUFFIX,))
        if not files:
            raise ValueError("the folder has no rows, so no schema; give one")
        with fs.open_input_file(next(iter(files))) as f:
            own = from_arrow_schema(header_schema(read_header(f)[0]))
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        fields = [own[c] for c in wanted] if wanted else own.fields
        if self.options.get("position") == "true":
            fields = [T.StructField(POS, T.ArrayType(T.LongType())), *fields]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> ColumnarReader:
        return ColumnarReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ColumnarWriter:
        if overwrite:
            raise ValueError("files are only added to: use mode append")
        return ColumnarWriter(self.options)


def read_columnar(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows with their order (the column POS)."""
    spark.dataSource.register(ColumnarSource)
    reader = spark.read.format("columnar").option("position", "true").option("columns", ",".join(columns or []))
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(POS, T.ArrayType(T.LongType())), *schema.fields]))
    return reader.load(path)


def write_columnar(df: DataFrame, path: str) -> None:
    """Rows in their order, into a new folder."""
    df.sparkSession.dataSource.register(ColumnarSource)
    fs, root = file_system(path)
    if fs.get_file_info(root).type.name != "NotFound":
        raise FileExistsError(path)
    df.orderBy(POS).drop(POS).write.format("columnar").mode("append").save(path)
