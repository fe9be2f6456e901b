"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the hash that becomes a uniform number in (0, 1): 13 hex digits, 52 bits, exact in a double.
_HEX = 13
#: Sub-buckets per shard within which slots are counted in parallel (hex digits of the key's hash).
_SUB_HEX = 3


def key_text(key: str) -> Column:
    """Stable text of a key; a null key has one text of its own, which no other key shares."""
    return F.when(F.col(key).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))


def pick_shard(key: Column, weights: list[float]) -> Column:
    """The shard with the largest ``weight / -ln(u)``, u being uniform from a hash of key and shard number.

    A shard's score doesn't depend on the other shards: one more shard takes rows only into itself, and a shard's share
    is in proportion to its weight. Equal scores go to the smaller number.
    """
    if not weights or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("weights must be positive numbers, one per shard")

    def score(i: int) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f"#{i}")).cast("binary")), 1, _HEX)
        uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**_HEX))
        return F.lit(float(weights[i])) / -F.log(uniform)

    best = F.array_max(F.array(*[F.struct(score(i).alias("score"), F.lit(-i).alias("minus")) for i in range(len(weights))]))
    return (-best["minus"]).cast("int")


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Deal records over shards by key: ``key, size, text_crc32, shard, slot, grown_shard``.

    size is the text's UTF-8 bytes plus 1 (null text: 1, with the crc32 of no bytes); grown_shard is the shard if one
    more shard of ``grown_weight`` is added. slot counts each shard's rows from 0 without gaps, in the order of the
    key's hash bucket, key, checksum and size. Null keys make one key of their own; repeated keys share a shard; an empty
    table gives no rows; other columns are ignored.

    Rows that agree in everything returned are counted, not listed, before rows of a bucket are brought together, and a
    shard is numbered in 16**3 buckets side by side, so neither a hot key nor a large shard meets in one task. What is
    broadcast is the count per shard and bucket: at most 4,096 rows a shard, whatever the input.
    """
    weights = weights or [1.0] * 8
    name = key_text(key)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("__key"), name.alias("__name"), (F.octet_length(body) + 1).cast("long").alias("__size"), F.crc32(body.cast("binary")).alias("__crc"))
    counted = rows.groupBy("__key", "__name", "__size", "__crc").agg(F.count(F.lit(1)).alias("__n"))
    placed = counted.select(
        "__key", "__size", "__crc", "__n",
        pick_shard(F.col("__name"), weights).alias("__shard"),
        pick_shard(F.col("__name"), [*weights, grown_weight]).alias("__grown"),
        F.substring(F.md5(F.concat(F.col("__name"), F.lit("/"), F.col("__crc").cast("string")).cast("binary")), 1, _SUB_HEX).alias("__sub"),
    )
    bucket = placed.groupBy("__shard", "__sub").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy("__shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket.select(F.col("__shard").alias("__s"), F.col("__sub").alias("__b"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__shard", "__sub").orderBy("__key", "__crc", "__size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("__first", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    joined = numbered.join(F.broadcast(starts), (F.col("__shard") == F.col("__s")) & (F.col("__sub") == F.col("__b")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__copy")
    return joined.select("*", copies).select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"),
        (F.col("__start") + F.col("__first") + F.col("__copy")).alias("slot"), F.col("__grown").alias("grown_shard"),
    )
