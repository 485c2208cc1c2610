import io
import json
import struct

import pyarrow as pa
import pytest

from millrace.dataset import Dataset, load_dataset
from millrace.sources import columnar
from tests.test_dataset import filled, parcels


def test_round_trip(spark, tmp_path):
    rows = parcels(200, gaps=True)
    path = str(tmp_path / "a.nano")
    Dataset.from_rows(spark, rows).save_to_disk(path)
    ds = load_dataset(spark, path)
    assert ds.to_dict() == filled(rows)
    assert columnar.read_columnar(spark, path, ["town"]).columns == ["__pos", "town"]
    assert [r.town for r in columnar.read_columnar(spark, path, ["town"]).orderBy("__pos").collect()] == [r["town"] for r in filled(rows)]
    with pytest.raises(FileExistsError):
        ds.save_to_disk(path)


def test_layout():
    """A file laid out by hand."""
    parts = [struct.pack("<2q", 1, 2), bytes([0b10]), struct.pack("<3i", 0, 0, 2), "é".encode(), bytes([1, 0])]
    at, places = 0, []
    for p in parts:
        places.append({"offset": at, "length": len(p)})
        at += len(p)
    header = {
        "schema": {"fields": [{"name": "i", "dtype": {"kind": "int64"}, "nullable": False}, {"name": "s", "dtype": {"kind": "string"}, "nullable": True}, {"name": "b", "dtype": {"kind": "bool"}, "nullable": False}]},
        "batches": [{"length": 2, "columns": [
            {"dtype": {"kind": "int64"}, "length": 2, "kind": "primitive", "values": 0},
            {"dtype": {"kind": "string"}, "length": 2, "validity": 1, "kind": "string", "offsets": 2, "values": 3},
            {"dtype": {"kind": "bool"}, "length": 2, "kind": "primitive", "values": 4},
        ]}],
        "buffers": places,
    }
    raw = json.dumps(header).encode()
    data = b"NANO0" + struct.pack("<I", len(raw)) + raw + b"".join(parts)
    f = io.BytesIO(data)
    own, start = columnar.read_header(f)
    batch = columnar.read_batch(f, own, start, 0, ["i", "s", "b"])
    assert batch.to_pylist() == [{"i": 1, "s": None, "b": True}, {"i": 2, "s": "é", "b": False}]
    again, _ = columnar.read_header(io.BytesIO(columnar.to_bytes([batch], batch.schema)))
    assert again["schema"] == header["schema"] and len(again["buffers"]) == 5
    with pytest.raises(ValueError):
        columnar.read_header(io.BytesIO(b"OTHER" + data[5:]))


def test_types():
    table = pa.table({
        "a": pa.array([1, None], pa.int32()), "f": pa.array([1.5, None], pa.float32()), "l": pa.array([[["x"], None, []], None]), "n": pa.array([None, {"k": [{"z": None}, {"z": True}]}]),
    })
    sliced = pa.concat_tables([table, table]).combine_chunks().slice(1, 2)
    f = io.BytesIO(columnar.to_bytes(sliced.to_batches(), sliced.schema))
    header, start = columnar.read_header(f)
    assert columnar.header_schema(header).types == sliced.schema.types
    assert columnar.read_batch(f, header, start, 0, sliced.column_names).to_pylist() == sliced.to_pylist()
