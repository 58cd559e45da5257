"""Files as sources and sinks: JSON lines, term files, dictionaries with checks, published tables, manifests, releases, resumed units.

Paths are opened through Hadoop's file systems only, so that any store that Spark reads will do. Renames publish: what is at the target path is whole.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: file that a finished release ends with
COMPLETE = "RELEASE_COMPLETE"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names for checkpoints; a temporary one only where Spark runs in this one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="laborlens-")
    return f"{root}/files-{uuid.uuid4().hex}"


class Store:
    """The few file operations that publishing takes."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        target = self._jvm.org.apache.hadoop.fs.Path(new)
        if target.getParent() is not None:
            fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"{old} could not be moved to {new}")

    def write(self, path: str, text: str) -> None:
        """text at path, whole or not at all."""
        fs, p = self._at(path + ".part")
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(path)
        self.move(path + ".part", path)

    def read(self, path: str) -> str:
        return self.tail(path, None).decode()

    def tail(self, path: str, most: int | None) -> bytes:
        """The last `most` bytes of a file (all of them: None)."""
        fs, p = self._at(path)
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            stream.seek(0 if most is None else max(0, size - most))
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


def json_lines(spark: SparkSession, path: str, schema: str, torn: bool = False) -> DataFrame:
    """Objects of a file or folder of JSON lines, with line feeds alone between lines. A line that is no object is an error; with `torn`, an unfinished
    last line of a file goes: that of a writer that was stopped."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    bad = lines.where(kind.isNull() | ~kind.startswith("OBJECT")).limit(10_000).collect()
    seen: dict[str, str] = {}
    for r in bad:  # more than one a file is an error, so this list is as long as there are files with torn ends
        if r.file in seen or not torn:
            raise ValueError(f"no object: {r.value[:80]!r} in {r.file}")
        seen[r.file] = r.value
    store = Store(spark)
    for file, value in seen.items():
        end = value.encode()
        if store.tail(file, len(end)) != end:
            raise ValueError(f"a line before the last is no object: {value[:80]!r} in {file}")
    good = lines.where(F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    return good.select(F.from_json("value", schema).alias("x")).select("x.*")


def published(df: DataFrame, path: str, stamp: str, by: list[str] | None = None) -> DataFrame:
    """df as zstd Parquet at path: written beside it, then moved there. A table of the same stamp that is there already is used as it is."""
    spark, store = df.sparkSession, Store(df.sparkSession)
    if store.exists(f"{path}/_STAMP") and store.read(f"{path}/_STAMP") == stamp:
        return spark.read.parquet(path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(part)
    store.write(f"{part}/_STAMP", stamp)
    store.delete(path)
    store.move(part, path)
    return spark.read.parquet(path)


def csv_dictionary(spark: SparkSession, path: str, schema: str, sha256: str, rows: int, active: str) -> DataFrame:
    """A CSV dictionary whose bytes must have the given digest, with that many rows and at least one that is active."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()
    if [r.h for r in found] != [sha256]:
        raise ValueError("the file is not the one that was agreed on")
    out = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    n = out.agg(F.count("*").alias("n"), F.count_if(F.expr(active)).alias("on")).first()
    if n.n != rows or not n.on:
        raise ValueError(f"{n.n} rows, {n.on} active: {rows} rows were agreed on")
    return out


def results(df: DataFrame, path: str, source: str, total: str, least: int, anchor: Column, anchor_rows: int) -> DataFrame:
    """Results without cells of under `least` in all, in place of what was at path, which must not be the source; so many rows must be the anchor's."""
    if path.rstrip("/") == source.rstrip("/"):
        raise ValueError("results would overwrite their source")
    kept = df.where(F.col(total) >= least)
    kept.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    got = out.where(anchor).count()
    if got != anchor_rows:
        raise ValueError(f"{got} anchor rows, {anchor_rows} expected")
    return out


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, digest) of tables: row counts and order-free hashes of all rows, each an aggregate combined before the shuffle."""
    out = None
    for name, df in tables.items():
        h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        own = df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)")).alias("d"))
        row = own.select(F.lit(name).alias("name"), "n", F.coalesce(F.col("d").cast("string"), F.lit("0")).alias("digest"))
        out = row if out is None else out.unionByName(row)
    return out


def gate(record: dict, expected: dict[str, str]) -> None:
    """A record that was handed over must be complete, and its digests the expected ones."""
    if record.get("status") not in ("formal_pass", "complete"):
        raise ValueError(f"status is {record.get('status')!r}")
    wrong = sorted(k for k, h in expected.items() if record.get("digests", {}).get(k) != h)
    if wrong:
        raise ValueError(f"other digests: {wrong}")


def release(tables: dict[str, DataFrame], path: str, config: dict) -> dict[str, DataFrame]:
    """Tables and their manifest at path, staged beside it; what was there comes back if publishing fails. The last file written says complete."""
    spark = next(iter(tables.values())).sparkSession
    store, staged, backup = Store(spark), f"{path}.staged-{uuid.uuid4().hex}", f"{path}.backup"
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{staged}/{name}")
    written = {name: spark.read.parquet(f"{staged}/{name}") for name in tables}
    rows = [r.asDict() for r in manifest(written).collect()]
    store.write(f"{staged}/manifest.json", json.dumps({"status": "complete", "config": config, "tables": rows, "digests": {r["name"]: r["digest"] for r in rows}}, sort_keys=True))
    had = store.exists(path)
    if had:
        store.delete(backup)
        store.move(path, backup)
    try:
        store.move(staged, path)
        store.write(f"{path}/{COMPLETE}", "ok")
    except Exception:
        store.delete(path)
        if had:
            store.move(backup, path)
        raise
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}


def resumed(spark: SparkSession, path: str, units: Iterable[str], stamp: str, compute: Callable[[str], DataFrame]) -> DataFrame:
    """All units' tables: those that an earlier run of the same stamp published are read, the others computed and published."""
    out = None
    for unit in units:
        at = f"{path}/{stamp}/{unit}"
        done = spark.read.parquet(at) if Store(spark).exists(f"{at}/_STAMP") else published(compute(unit), at, stamp)
        out = done if out is None else out.unionByName(done)
    return out
