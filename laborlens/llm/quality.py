"""Document quality: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal).

A text is its words; each word also has a form (letters, capitals and digits collapsed, punctuation kept: `thnd***` is
`a*`, `THE!!` is `A!`) and, if the pair of it and the word before stood earlier in the text, a repeat mark. Features are hashed
word 1- and 2-grams (present or not, scaled to unit length) and hashed 1- and 2-grams of marked forms with the logarithm
of their share of the text. The model is fitted on the driver on at most `SAMPLE` labelled documents, in a fixed order, one
example at a time; scoring is a sparse dot product for each document, in Arrow batches, over whole texts.

Defined cases: null or empty text has only the bias and a length feature and gets a score; rows that repeat a doc_id get a
score each (one of their texts, that of the least hash, is learnt from); a null doc_id is scored and not held out; labels that are null or
of doc_ids that aren't there are ignored; with no labels every score is 0.5; texts are read whole, in memory linear in the
longest; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import first_by_hash, held_out, one_text

#: most labelled documents that the model is fitted on
SAMPLE = 4000
BITS = 20
_EPOCHS, _ALPHA, _BETA, _L1, _L2 = 4, 0.1, 1.0, 0.05, 0.5
_CACHED = 200_000
_MASK = np.uint64((1 << BITS) - 1)
_cache: dict[bytes, tuple[int, int]] = {}


def _form(word: bytes) -> bytes:
    upper = word.isupper()
    kept = re.sub(rb"[A-Za-z\x80-\xff]+", b"A" if upper and len(word) > 2 else b"a", word)
    kept = re.sub(rb"\d+", b"0", kept)
    return re.sub(rb"(.)\1+", rb"\1", kept, flags=re.S)


def _codes(words: list[bytes]) -> np.ndarray:
    """(n, 2): hashes of each word and of its form."""
    out = []
    for w in words:
        if (known := _cache.get(w)) is None:
            if len(_cache) >= _CACHED:
                _cache.clear()
            known = _cache[w] = (zlib.crc32(w.lower()), zlib.crc32(_form(w), 77))
        out.append(known)
    return np.array(out, dtype=np.uint64).reshape(-1, 2)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices below 2**BITS and their values."""
    words = (text or b"").split()
    n = len(words)
    length = np.array([_mix(np.array([n.bit_length()], dtype=np.uint64), 5)[0]]) & _MASK
    base, ones = np.concatenate([np.zeros(1, np.uint64), length]), np.ones(2)
    if not n:
        return base.astype(np.int64), ones
    codes = _codes(words)
    word, form = codes[:, 0], codes[:, 1]
    pair = word[:-1] * np.uint64(0x100000001B3) + word[1:]
    grams = np.unique(np.concatenate([_mix(word, 1), _mix(pair, 2)]) & _MASK)
    marked = form.copy()
    if n > 1:
        first = np.zeros(n - 1, dtype=bool)
        first[np.unique(pair, return_index=True)[1]] = True
        marked[1:] += (~first).astype(np.uint64) * np.uint64(0x5BD1E995)
    forms = np.concatenate([_mix(marked, 3), _mix(marked[:-1] * np.uint64(0x100000001B3) + marked[1:], 4)]) & _MASK
    shapes, times = np.unique(forms, return_counts=True)
    share = np.log1p(100 * times / n) / 2
    at = np.concatenate([base, grams, shapes]).astype(np.int64)
    return at, np.concatenate([ones, np.full(len(grams), len(grams) ** -0.5), share])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """FTRL-proximal over rows (indices, values, label), `_EPOCHS` times in the given order -> weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= _L1, 0.0, -(zz - np.sign(zz) * _L1) / ((_BETA + np.sqrt(n[at])) / _ALPHA + _L2))

    for _ in range(_EPOCHS):
        for at, x, y in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / _ALPHA
            np.add.at(z, at, g - s * w)
            np.add.at(n, at, g * g)
    return weights(np.arange(1 << BITS)).astype(np.float32)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "at", "x", "y"])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """docs (doc_id, text), labels (doc_id, label 0 or 1) -> weights, from at most `sample` labelled documents."""
    some = first_by_hash(labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("y")), sample)
    chosen = one_text(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).select(F.col("doc_id").cast("bigint"), "text", F.col("y").cast("int"))
    found = chosen.mapInArrow(_feature_batches, "doc_id bigint, at array<bigint>, x array<double>, y int").toArrow().to_pylist()
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], len(r["at"])))
    return fit([(np.array(r["at"]), np.array(r["x"]), r["y"]) for r in found])


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, score), a row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            dots = [float(w[at] @ x) for at, x in (features(t.as_py()) for t in batch.column(1).cast(pa.binary()))]
            score = 1 / (1 + np.exp(-np.clip(np.array(dots, dtype=np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def graded(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """labels (doc_id, label). Labels of the fold 0 are never read -> (doc_id, held_out, score, predicted)."""
    weights = trained(docs, labels.where(~held_out("doc_id", folds)), sample)
    out = scored(docs, weights)
    return out.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
