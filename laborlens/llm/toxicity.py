"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, at most `POSITIVES`; the unlabelled are all documents, whose labels are not looked at. A linear
classifier over the words and word beginnings that a text has (hashed, present or not; folded case, outer punctuation off) minimises

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with logistic loss by full-batch Adam in numpy; where the bracket is negative, its gradient is turned round (the
non-negative correction). The class prior is the share of toxic rows among all labelled training rows. Words that only a few
positives have, or no more of them than of all documents, can't be told from chance and get no weight.

The unlabelled risk is over all documents: one pass counts how many have each word that positives have, a second adds up
documents that have the same words with a weight. The table of these patterns has a row for each combination met; if it has over
`PATTERNS` rows, each step's sums are taken by executors, else on the driver. Both are the same sums.

Defined cases: null or empty text gets the score of the bias; repeated rows get a score each (one text of a doc_id, that of the least hash,
is learnt from); a null doc_id is scored and not held out; null labels are ignored; with no positive every score is the prior; texts are
read whole, in memory linear in the longest; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .labelled import first_by_hash, held_out, one_text

#: most labelled positives that the model is fitted on, and most patterns that go to the driver
POSITIVES, PATTERNS = 2000, 200_000
BITS = 20
_STEPS, _RATE, _DECAY = 80, 0.3, 1e-4
#: bytes of a word's beginning that are a feature of their own, so that other endings of a word are known
_STEM = 5
_PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|<>-_/\\"


def words_of(text: bytes | None) -> np.ndarray:
    """Hashes below 2**BITS of the distinct words, and of the distinct beginnings of longer ones."""
    words = {w.strip(_PUNCTUATION) for w in set((text or b"").lower().split())} - {b""}
    starts = {w[:_STEM] for w in words if len(w) > _STEM}
    found = {zlib.crc32(w) & ((1 << BITS) - 1) for w in words} | {zlib.crc32(w, 1) & ((1 << BITS) - 1) for w in starts}
    return np.fromiter(found, dtype=np.int64, count=len(found))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words of rows, and the row of each."""
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def risk(theta: np.ndarray, rows: list[np.ndarray], times: np.ndarray, sign: int) -> np.ndarray:
    """Sums over rows, each `times`: the logistic loss of calling them sign, and its gradient by weight and bias (the last of theta)."""
    words, row = _flat(rows)
    f = np.bincount(row, weights=theta[words], minlength=len(rows)) + theta[-1]
    pull = -sign * times / (1 + np.exp(np.clip(sign * f, -35, 35)))
    return np.concatenate([[(np.logaddexp(0, -sign * f) * times).sum()], np.bincount(words, weights=pull[row], minlength=len(theta) - 1), [pull.sum()]])


def fit(positive: list[np.ndarray], unlabelled, n: int, active: int, prior: float) -> np.ndarray:
    """Adam on the risk of positives (places below `active`) and of n unlabelled documents, whose sums unlabelled(theta) gives -> theta."""
    theta, m, v = np.zeros(active + 1), np.zeros(active + 1), np.zeros(active + 1)
    theta[-1] = np.log(prior / (1 - prior))
    ones = np.ones(len(positive))
    for step in range(1, _STEPS + 1):
        away = prior * risk(theta, positive, ones, -1) / len(positive)
        rest = unlabelled(theta) / n - away
        g = -rest[1:] if rest[0] < 0 else rest[1:] + prior * risk(theta, positive, ones, 1)[1:] / len(positive)
        g[:-1] += _DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words_of(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "words"])


def _frequencies(asked: np.ndarray):
    """Texts -> (place, n): how many have each of the asked words; place -1: how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, len(asked))
        place[asked] = np.arange(len(asked))
        seen, n = np.zeros(len(asked) + 1, np.int64), 0
        for batch in batches:
            rows = [words_of(t.as_py()) for t in batch.column(0).cast(pa.binary())]
            seen += np.bincount(place[_flat(rows)[0]], minlength=len(seen))
            n += len(rows)
        some = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["place", "n"])

    return run


def _patterns(active: np.ndarray):
    """Texts -> (pattern, n): the places of the active words that a text has, and how many texts of the task have just these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1)
        place[active] = np.arange(len(active))
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                own = place[words_of(t.as_py())]
                seen[np.sort(own[own >= 0]).astype(np.int32).tobytes()] += 1
            if len(seen) > PATTERNS:
                yield rows()
                seen.clear()
        yield rows()

    return run


def _risk_batches(theta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(theta) + 1)
        for batch in batches:
            sums += risk(theta, [np.frombuffer(p.as_py(), np.int32) for p in batch.column(0)], batch.column(1).to_numpy(), -1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return run


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, patterns: int = PATTERNS) -> tuple[np.ndarray, float]:
    """docs (doc_id, text), labels (doc_id, label) -> weights of all hashes and bias."""
    labels = labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("y"))
    prior = float(np.clip(labels.agg(F.avg("y")).first()[0] or 0.0, 1e-3, 0.9))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    some = first_by_hash(labels.where("y = 1").select("doc_id"), positives)
    found = one_text(docs.join(F.broadcast(some), "doc_id")).mapInArrow(_word_batches, "doc_id bigint, words array<bigint>").toArrow().to_pylist()
    rows = [np.array(r["words"], dtype=np.int64) for r in sorted(found, key=lambda r: r["doc_id"])]
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not rows:
        return weights, float(np.log(prior / (1 - prior)))
    seen = np.bincount(_flat(rows)[0], minlength=1 << BITS)
    asked = np.flatnonzero(seen >= 3)
    counts = docs.select("text").mapInArrow(_frequencies(asked), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in counts if r.place < 0)
    share_u = np.zeros(len(asked))
    for r in counts:
        if r.place >= 0:
            share_u[r.place] = r.n / n
    # a word can speak for toxicity only if positives have it more often than the whole; chance is four deviations
    gap = seen[asked] / len(rows) - share_u - 4 * np.sqrt(np.maximum(share_u, 1 / n) / len(rows))
    active = asked[gap > 0]
    place = np.full(1 << BITS, -1)
    place[active] = np.arange(len(active))
    rows = [place[r][place[r] >= 0] for r in rows]
    table = cut(docs.select("text").mapInArrow(_patterns(active), "pattern binary, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")))
    if table.limit(patterns + 1).count() <= patterns:
        own = table.toArrow()
        held = [np.frombuffer(p, np.int32) for p in own.column(0).to_pylist()], own.column(1).to_numpy()
        unlabelled = lambda theta: risk(theta, *held, -1)
    else:
        unlabelled = lambda theta: sum(np.frombuffer(r.sums) for r in table.mapInArrow(_risk_batches(theta), "sums binary").collect())
    theta = fit(rows, unlabelled, n, len(active), prior)
    weights[active] = theta[:-1]
    return weights, float(theta[-1])


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, text) -> (doc_id, score), a row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            dots = np.array([float(weights[words_of(t.as_py())].sum()) + bias for t in batch.column(1).cast(pa.binary())], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def graded(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """labels (doc_id, label). Labels of the fold 0 are never read -> (doc_id, held_out, score, predicted)."""
    model = trained(docs, labels.where(~held_out("doc_id", folds)))
    out = scored(docs, model)
    return out.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
