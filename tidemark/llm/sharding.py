"""Weighted rendezvous sharding of records by a stable key.

Every (key, shard) pair has a hashed score; a record belongs to the shard with
the best one.  A new shard only adds a candidate, so records either stay or move
into the new shard, and a shard's expected share is its weight over the sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import durable, free_name, table

#: Sub-groups of a shard that get their slots independently; rows of one beyond which it is split further.
SLOT_BUCKETS, GROUP_ROWS = 1024, 500_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard with the least ``-ln(u) / weight``; u is a hash of key and shard in (0, 1).

    With equal weights the order of -ln(u) is the reverse of the order of the
    hash itself, which is then compared without a logarithm.  A null key hashes
    like any other value.  Ties go to the lowest index.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    known = F.coalesce(F.xxhash64(key), F.lit(0))
    hashed = [F.xxhash64(known, F.lit(i)) for i in range(len(weights))]
    if len(set(weights)) == 1:
        scores = [F.negative(F.shiftright(h, 1)) for h in hashed]
    else:
        unit = [(F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53) for h in hashed]
        scores = [-F.log(u) / F.lit(float(w)) for u, w in zip(unit, weights)]
    return (F.array_position(F.array(*scores), F.least(*scores)) - 1).cast("int") if len(weights) > 1 else F.lit(0)


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    slot_buckets: int = SLOT_BUCKETS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Shard, slot and size of every row.

    The text is scanned once, to its length and checksum; only these narrow rows
    are written and shuffled.  Slots: each shard falls into ``slot_buckets``
    hashed sub-groups, and a sub-group of more than ``group_rows`` rows, as of a
    key that is repeated again and again, into parts by the place of its rows.  A
    part's slots begin after those of the parts before it, so no task numbers a
    whole shard or key and slots have no gap.

    Nulls: a null text has size 8 and checksum 0; rows with a null key share a
    shard.  Repeated rows each get a slot.  An empty table gives no rows.  Other
    columns of the input, whatever their names, are not carried.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    k = F.col(key)
    narrow = durable(
        docs.select(
            k.alias(key),
            size.alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            rendezvous_shard(k, weights).alias("shard"),
            (rendezvous_shard(k, grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"),
            F.pmod(F.xxhash64(k), F.lit(slot_buckets)).cast("int").alias("sub"),
        )
    )
    # at most len(weights) * slot_buckets rows, and one more for each group_rows rows of a large one
    counts = durable(narrow.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("part", F.lit(0).cast("long")))
    group = ["shard", "sub"]
    large = counts.where(F.col("n") > group_rows).select("shard", "sub", F.ceil(F.col("n") / group_rows).alias("parts"))
    if not large.isEmpty():
        group = [*group, "part"]
        parted = narrow.join(F.broadcast(large), ["shard", "sub"], "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))))
        narrow = durable(parted.drop("parts"))
        counts = narrow.groupBy(*group).agg(F.count("*").alias("n"))
    first = counts.select(*group, (F.sum("n").over(W.partitionBy("shard").orderBy(*group[1:])) - F.col("n")).alias("first"))
    within = W.partitionBy(*group).orderBy(key, "size", "text_crc32")
    return (
        narrow.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(first), group)
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("first") + F.col("at")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """All columns of ``docs`` and the shard, under a free name; no shuffle."""
    return docs.withColumn(free_name(docs, name), rendezvous_shard(F.col(key), weights))


def op5_rendezvous_shards(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)
