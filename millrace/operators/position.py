"""Row order as data.

A frame's order is a column of arrays of longs, compared from the left. Loading sets it without a job; filters and maps keep
it, a concatenation puts the part's number in front, a flat map the row's number behind. Only operators that need dense
numbers (positions, exact batches) sort, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

POS = "__pos"


def arrival() -> Column:
    """Order of rows as the plan yields them."""
    return F.array(F.monotonically_increasing_id())


def file_order(df: DataFrame, *within: Column) -> DataFrame:
    """Order by file path, then by `within`. The files' table is joined by path; Spark broadcasts it by its size."""
    files = sorted(df.inputFiles())
    spark = df.sparkSession
    named = df.withColumn("__file", F.col("_metadata.file_path"))
    if len(files) <= 1:
        return named.withColumn(POS, F.array(F.lit(0).cast("long"), *within)).drop("__file")
    table = spark.createDataFrame(list(enumerate(files)), "__n long, __path string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return named.join(table, plain(F.col("__file")) == plain(F.col("__path"))).withColumn(POS, F.array(F.col("__n"), *within)).drop("__file", "__n", "__path")


def counted(df: DataFrame, name: str = "__row", label: str = "counted") -> DataFrame:
    """df with the number of each row as the plan yields them, from 0: a count for each part, and running sums of the counts."""
    part = F.shiftright("__mid", 33)
    kept = materialize(df.withColumn("__mid", F.monotonically_increasing_id()), label)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = kept.withColumn("__part", part).join(starts, "__part")
    return numbered.withColumn(name, F.col("__start") + F.col("__mid").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__mid")


def dense(df: DataFrame, name: str = "__row", by: str | Column = POS) -> DataFrame:
    """df with the number of each row in its order, from 0: one sort, then counted()."""
    return counted(df.orderBy(by), name, "sorted")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A pseudo-random order from a hash of the old one; narrow, the sort waits for a sink."""
    return df.withColumn(POS, F.concat(F.array(F.xxhash64(F.col(POS), F.lit(seed))), F.col(POS)))


def gather(df: DataFrame, indices: list[int]) -> DataFrame:
    """Rows at these positions, in this order, repeats included; negatives count from the end."""
    spark = df.sparkSession
    if not indices:
        return df.where("false")
    if indices == list(range(indices[0], indices[0] + len(indices))) and indices[0] >= 0:
        own = dense(df).where(F.col("__row").between(indices[0], indices[-1]))
        if own.count() < len(indices):
            raise IndexError("a position is out of range")
        return own.withColumn(POS, F.array("__row")).drop("__row")
    n = df.count()
    wanted = [i + n if i < 0 else i for i in indices]
    if any(not 0 <= i < n for i in wanted):
        raise IndexError("a position is out of range")
    table = spark.createDataFrame(list(enumerate(wanted)), "__ord long, __row long")
    return dense(df).join(table, "__row").withColumn(POS, F.array("__ord")).drop("__row", "__ord")
