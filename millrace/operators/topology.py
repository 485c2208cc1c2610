"""Ranks of data, tensor and pipeline parallel groups, as arithmetic over a range of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("data", "model", "tensor", "pipeline")


def check_world(world: int, data: int, pipeline: int, tensor: int) -> None:
    if min(world, data, pipeline, tensor) < 1 or world != data * pipeline * tensor:
        raise ValueError(f"a world of {world} isn't {data} x {pipeline} x {tensor}")


def groups(spark: SparkSession, world: int, data: int, pipeline: int, tensor: int) -> DataFrame:
    """(rank, mode, group_id, local_rank, size): one row for each rank and mode."""
    check_world(world, data, pipeline, tensor)
    r, block = F.col("rank"), world // data
    stride = block // pipeline
    div = lambda a, b: F.floor(a / F.lit(b))
    of = {
        "data": (r % block, div(r, block), data),
        "model": (div(r, tensor * pipeline), r % (tensor * pipeline), tensor * pipeline),
        "tensor": (div(r, tensor), r % tensor, tensor),
        "pipeline": (div(r, block) * stride + (r % block) % stride, div(r % block, stride), pipeline),
    }
    rows = F.array(*(F.struct(F.lit(m).alias("mode"), g.cast("long").alias("group_id"), n.cast("long").alias("local_rank"), F.lit(s).cast("long").alias("size")) for m, (g, n, s) in of.items()))
    return spark.range(world).withColumnRenamed("id", "rank").select("rank", F.explode(rows).alias("x")).select("rank", "x.*")


def ring(ranks: DataFrame) -> DataFrame:
    """groups() with the next and previous rank of each ring and whether a rank is first or last in its group."""
    at = lambda step: F.pmod(F.col("local_rank") + step, F.col("size"))
    other = ranks.select("mode", "group_id", F.col("local_rank").alias("l"), F.col("rank").alias("other"))
    out = ranks.withColumn("n", at(1)).withColumn("p", at(-1))
    out = out.join(other.select("mode", "group_id", F.col("l").alias("n"), F.col("other").alias("next_rank")), ["mode", "group_id", "n"])
    out = out.join(other.select("mode", "group_id", F.col("l").alias("p"), F.col("other").alias("prev_rank")), ["mode", "group_id", "p"])
    first, last = F.col("local_rank") == 0, F.col("local_rank") == F.col("size") - 1
    return out.select("rank", "mode", "group_id", "local_rank", "size", "next_rank", "prev_rank", first.alias("is_first"), last.alias("is_last"))


def local_ranks(ranks: DataFrame) -> DataFrame:
    """(rank, data, model, tensor, pipeline): each rank's place in its groups."""
    return ranks.groupBy("rank").pivot("mode", list(MODES)).agg(F.first("local_rank"))


def ranks_to_device(ranks: DataFrame, own: int | None = None, **places: int) -> DataFrame:
    """(rank, device): to each rank, or to `own` alone, the rank whose places are the same but for the given ones (pipeline=1)."""
    table = local_ranks(ranks)
    modes = [m for m in MODES if m != "model"]
    mine = table if own is None else table.where(F.col("rank") == own)
    wanted = mine.select("rank", *(F.lit(places[m]).cast("long").alias(m) if m in places else F.col(m) for m in modes))
    return wanted.join(table.select(F.col("rank").alias("device"), *modes), modes).select("rank", "device")


def seeds(ranks: DataFrame, seed: int) -> DataFrame:
    """(rank, data_seed, tensor_seed)."""
    own = local_ranks(ranks)
    return own.select("rank", F.lit(seed).cast("long").alias("data_seed"), (F.lit(seed) + F.col("tensor") + 1024 * F.col("pipeline")).alias("tensor_seed"))
