"""Sinks: JSON lines, a JSON array, Parquet. Rows are written in their order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.position import POS


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(POS).drop(POS)


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of JSON lines; nulls are written. single: one part file."""
    rows = ordered(df)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(df: DataFrame, path: str, indent: int = 2) -> None:
    """One JSON array in one file, on any file system that Spark writes: rows stream through the driver in pieces of a megabyte,
    never all at once."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    rows = df.orderBy(POS).select(F.to_json(F.struct(*[c for c in df.columns if c != POS]), {"ignoreNullFields": "false"}).alias("r"))
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        held, size, first = ["["], 1, True
        for row in rows.toLocalIterator(prefetchPartitions=True):
            text = json.dumps(json.loads(row.r), ensure_ascii=False, indent=indent)
            held.append(("\n" if first else ",\n") + "\n".join(" " * indent + x for x in text.split("\n")))
            size, first = size + len(held[-1]), False
            if size > 1 << 20:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        held.append("]" if first else "\n]")
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def write_parquet(df: DataFrame, path: str) -> None:
    ordered(df).write.mode("overwrite").parquet(path)


def column_bytes(path: str, fs=None) -> dict[str, int]:
    """Compressed bytes of each column of Parquet files, from their footers (nothing is decoded)."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    out: dict[str, int] = {}
    for piece in ds.dataset(path, format="parquet", filesystem=fs).get_fragments():
        meta = pq.read_metadata(piece.path, filesystem=piece.filesystem)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                name = chunk.path_in_schema.split(".")[0]
                out[name] = out.get(name, 0) + chunk.total_compressed_size
    return out
