"""Bounded samples of labelled rows for fitting classifiers, and the split that queries hold out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def held_out(doc_id: Column | str, folds: int, held: int = 0) -> Column:
    """Whether the row is in the fold that is held out; rows without doc_id are not."""
    return F.coalesce(fold(doc_id, folds) == held, F.lit(False))


def one_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with one row for each doc_id, that of the least hash of its text: repeated ids can't swell a sample."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.min_by(F.struct("text", *others), F.struct(F.xxhash64("text"), F.length("text")))
    return docs.groupBy("doc_id").agg(row.alias("row")).select("doc_id", "row.text", *[f"row.{c}" for c in others])


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` distinct doc_ids, those of least hash: the same at every run and partitioning."""
    return rows.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
