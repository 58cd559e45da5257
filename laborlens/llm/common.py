"""What the corpus operators share: table access, lineage cuts, ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract that says [^\x20\x09-\x0D]+; bytes.split() uses the same set.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where Spark runs in this one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="laborlens-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared checkpoint folder and read back."""
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """rows with the columns of their group, where it has one; groups: a row for each, n: its rows in `rows`. Groups of over one row in `share` are
    broadcast (there are fewer than `share`), so none of them lands in one task; the others are joined by their keys. Both are read twice: store them."""
    most = rows.count() // share
    large = F.broadcast(groups.where(F.col("n") > most))
    rest = rows.join(large.select(keys), keys, "left_anti")
    return rows.join(large.drop("n"), keys).unionByName(rest.join(groups.where(F.col("n") <= most).drop("n"), keys))
