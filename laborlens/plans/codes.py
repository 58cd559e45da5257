"""Dense codes without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlens.sources.files import published, shared_folder


def dense_codes(keys: DataFrame, name: str) -> DataFrame:
    """(name, code): 0, 1, 2... over the sorted distinct keys. Ranges are sorted in parallel; only their sizes (one row for
    each partition) are summed up in one place. The ranges are published, as drawing them anew after a lost executor could move their
    borders and make codes clash."""
    ranged = keys.select(name).distinct().repartitionByRange(name).withColumn("part", F.spark_partition_id())
    ranged = published(ranged, shared_folder(keys.sparkSession), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", before.alias("start")))
    place = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return ranged.withColumn("place", place).join(starts, "part").select(name, (F.col("start") + F.col("place") - 1).alias("code"))
