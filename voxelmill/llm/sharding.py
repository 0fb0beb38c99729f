"""Rendezvous hashing: every shard bids for a record, the lowest bid takes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise, text_of


def bid(key: Column, shard: int, weight: float) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from a hash of key and shard."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.ln((h + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (index into ``weights``) with the lowest bid; ties go to the lower index.

    A shard's chance is its share of the weights.  A further shard changes the
    result only for the keys that it wins itself.  A null key counts as a key.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    k = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    bids = F.array(*[F.struct(bid(k, i, w).alias("b"), F.lit(i).alias("s")) for i, w in enumerate(weights)])
    return F.array_min(bids)["s"]


def shard_records(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Place ``docs(doc_id, text)`` into weighted shards.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law (``key``), shard,
    slot (0.. without gaps in a shard) and grown_shard (under ``grown`` weights,
    or null).  Null text counts as empty, a null doc_id is a key of its own,
    repeated rows share a shard and get slots of their own, other columns are
    ignored, an empty table gives no rows.

    Slots come from row counts per (shard, input partition), so that no task
    ranks more than one input partition's rows, however many share a key.
    """
    t = text_of(docs)
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        (rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialise(rows).withColumn("_part", F.shiftright("_row", 33))
    sizes = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("shard", "_part").orderBy("_row")) - 1
    return (
        rows.withColumn("_rank", rank)
        .join(starts, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
    )
