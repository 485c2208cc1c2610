"""Bounded samples of labelled rows for the models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 20


def labelled_sample(labels: DataFrame, label: str, allowed: Column, most: int, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """(id, y): the `most` labelled ids of smallest hash among those that `allowed` admits; one row an id, the larger label of
    repeats. The same labels give the same sample, however they are dealt to partitions."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & allowed).groupBy(F.col(id_col).cast("long").alias("id"))
    own = own.agg(F.max(F.col(label).cast("int")).alias("y"))
    n = own.count()
    if n <= most:
        return own
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_SCALE))
    few = own.where(place < int(_SCALE * min(1.0, 1.2 * most / n)) + 1)  # enough of the smallest hashes, so that few rows are sorted
    return few.orderBy(place, "id").limit(most)


def labelled_rows(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(t, y): the text of each sampled id, of several texts the smallest. The sample is bounded, so it is broadcast and only
    sampled texts are shuffled."""
    kept = F.broadcast(sample.select(F.col("id").alias("_id"), F.col("y").alias("_y")))
    own = docs.select(F.col(id_col).cast("long").alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    return own.join(kept, F.col("_d") == F.col("_id")).groupBy("_id").agg(F.min("_t").alias("t"), F.first("_y").alias("y")).select("t", "y")
