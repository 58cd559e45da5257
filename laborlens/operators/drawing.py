"""Samples of scans, repeatable whatever the partitioning: a row's keyed hash decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(key: str, seed: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)), 256)


def share(rows: DataFrame, key: str, percent: float, seed: str) -> DataFrame:
    """About `percent` % of the rows: those whose hash is in the lowest part of its range. A filter: no shuffle."""
    return rows.where(F.conv(F.substring(_draw(key, seed), 1, 8), 16, 10).cast("bigint") < int(percent / 100 * (1 << 32)))


def each(rows: DataFrame, group: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group. Ranking by a limit known beforehand keeps n rows a group in each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(_draw(key, seed), key))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def capped(rows: DataFrame, shard: str, key: str, cap: int) -> DataFrame:
    """The first `cap` rows in order of shard and key: shards that fit whole, and part of the one that doesn't. Sizes of shards (one row each) are
    added up first, so that only one shard is ranked."""
    sizes = rows.groupBy(shard).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(shard)) - F.col("__n")
    room = sizes.select(F.col(shard).alias("__shard"), (F.lit(cap) - before).alias("__room"), "__n").where("__room > 0")
    both = rows.join(F.broadcast(room), F.col(shard) == F.col("__shard"))  # a row for each shard
    whole = both.where("__n <= __room").select(*rows.columns)
    part = both.where("__n > __room").orderBy(key).limit(cap).withColumn("__k", F.row_number().over(Window.orderBy(key))).where("__k <= __room")
    return whole.unionByName(part.select(*rows.columns))
