"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax, under a table of word pairs that grows
with the corpus.

    P(token | before) = u                                                  for a token that training texts do not have
                      = (1 - u) * (k + MU * P0) / (n + MU)                  for any other
    P0 = P(class | before) * c / m

u is the share of tokens that occur once in training (Good-Turing). c and m are the counts of the token and of its class. The class
softmax is the maximum-entropy model: a bias and three hashed features of what stands before, the previous word, the word before that (a
skip feature), and both as a 2-gram. k is how often the token follows its previous word in training, n how often anything does: the pair
table has a row for every distinct pair of the corpus. In exponential form a pair's weight is log(1 + k / (MU * P0)), normalised
by (n + MU) / MU. All tokens that a text can have, the unknown one included, add up to 1.

Head tokens are those that make up 1 in `HEAD` tokens or more, so there are at most `HEAD`, and their counts go to every task. They have
classes of about equal total root frequency, other tokens classes of their last two bytes. The previous word of a pair is itself if it
is a head token, else one of `CONTEXTS` hash buckets, so that n is known everywhere. Words are 64-bit hashes (`hashing`).

1. Counts of all tokens, aggregated in each task and summed by Spark. Pairs that are 1 in `HOT` (at most `HEAD`) of some block are noted.
2. Training: with zero weights the expected feature counts are known, so generalised iterative scaling moves each weight by
   log(observed / expected) / 3; `STEPS` gradient steps follow, each over all training texts, which add up expected counts in the executors.
   The sums have the model's size, whatever the corpus, and are dealt to 48 tasks.
3. Texts are read in blocks of about a million tokens. A block's tokens are dealt to buckets of about `BUCKET_TOKENS`: a head token by its
   pair, another by itself. A bucket counts the pairs (and non-head tokens) of its training blocks, settles every token of all its
   blocks, and returns sums by document to the block (class log-probabilities travel
   in steps of 1 / 2048). Tokens of the noted pairs, whose counts are taken in step 2 exactly, are
   settled in the block, so no pair of over 2 in HOT and no token of over 1 in HEAD meets in one bucket.

Rows sent are one for each block and bucket. Beyond about 10 TB these get short and their headers count.

Defined cases: null or empty text is the end token alone; rows that repeat a doc_id are scored by their own text; a null doc_id is
training text (its remainder is null) and not held out; without training text V and N are 0, base scores are those of add-one over nothing
and scores are 0; extra columns are not read; texts are read whole, in memory linear in the longest; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import before, hashed, mix
from .labelled import fold

HEAD, HOT = 1 << 16, 1 << 16
HEAD_CLASSES, TAIL_CLASSES = 8, 8
CLASSES = HEAD_CLASSES + TAIL_CLASSES
CONTEXTS = 1 << 19
#: hashed features of each of the three kinds
FEATURES = 1 << 13
KINDS = 3
STEPS, MU, _RATE, _PRIOR = 2, 60.0, 0.5, 100.0
BUCKET_TOKENS, BLOCK_TOKENS = 1 << 21, 1 << 20
_BLOCK_ROWS = 50_000
_PART = 64
#: class log-probabilities are sent to buckets in steps of one part in so many
_STEP = 2048


def _pairs(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words + contexts.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _tally(words: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and how often each occurs."""
    if times is None:
        return np.unique(words, return_counts=True)
    found, at = np.unique(words, return_inverse=True)
    return found, np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)


def _count_batches(hot: int):
    """Texts -> (token, c, pair): counts of tokens, and of pairs that are 1 in `hot` of the tokens of a block."""

    def rows(found: np.ndarray, times: np.ndarray, pair: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(np.full(len(found), pair))], names=["token", "c", "pair"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def settle() -> tuple[tuple, pa.RecordBatch]:
            words = np.concatenate([x[0] for x in held])
            pairs, times = _tally(np.concatenate([x[1] for x in held]))
            often = times * hot >= len(words)
            new = _tally(words)
            merged = _tally(np.concatenate([seen[0], new[0]]), np.concatenate([seen[1], new[1]]))
            return merged, rows(pairs[often], times[often], True)

        for batch in batches:
            for _, words, at in hashed(batch.column(0)):
                held.append((words, _pairs(words, before(words, at)[0])))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    seen, noted = settle()
                    yield noted
                    held, size = [], 0
                    if len(seen[0]) > 4 * BLOCK_TOKENS:
                        yield rows(*seen, False)
                        seen = seen[0][:0], seen[1][:0]
        if held:
            seen, noted = settle()
            yield noted
        yield rows(*seen, False)

    return run


def counted(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(text) -> (token, c, pair): exact counts of all tokens, and counts of often met pairs, at most their true ones."""
    return texts.mapInArrow(_count_batches(hot), "token bigint, c bigint, pair boolean").groupBy("pair", "token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    total: int  # N
    kinds: int  # V
    unknown: float  # u
    head: np.ndarray  # hashes of head tokens, sorted
    counts: np.ndarray  # of head tokens
    classes: np.ndarray  # of head tokens
    mass: np.ndarray  # tokens in each class
    follows: np.ndarray  # n of each context: head tokens, then hash buckets
    hot: np.ndarray  # pairs that are settled in the block, sorted
    hot_counts: np.ndarray
    bias: np.ndarray
    weights: np.ndarray  # (KINDS * FEATURES, CLASSES)

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the head tokens, and whether there is one."""
        if not len(self.head):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        return at, self.head[at] == words

    def classes_of(self, words: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        own = HEAD_CLASSES + (words & np.uint64(7)).astype(np.int64)
        return np.where(known, self.classes[at], own) if len(self.head) else own

    def contexts(self, words: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        bucket = (words >> np.uint64(3)).astype(np.int64) % (len(self.follows) - len(self.head))
        return np.where(known, at, len(self.head) + bucket)

    @staticmethod
    def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """(KINDS, n) feature numbers of the words before."""
        n = np.uint64(FEATURES)
        kinds = (one >> np.uint64(20)) % n, (two >> np.uint64(24)) % n, mix(one * np.uint64(3) + two) % n
        return np.stack([x.astype(np.int64) + k * FEATURES for k, x in enumerate(kinds)])

    def log_classes(self, feats: np.ndarray) -> np.ndarray:
        """(n, CLASSES) natural log probabilities."""
        z = self.bias + self.weights[feats[0]]
        z += self.weights[feats[1]]
        z += self.weights[feats[2]]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def log_known(self, k: np.ndarray, prior: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of known tokens."""
        return math.log10(max(1 - self.unknown, 1e-300)) + np.log10((k + MU * prior) / (n + MU))


def _sums(shared, first: bool):
    """Texts -> (part, vec): in the first pass observed class counts by feature, and the counts of the noted pairs (part -1); later the
    counts that the model expects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        sums = np.zeros((KINDS * FEATURES, CLASSES))
        pairs = np.zeros(len(model.hot), dtype=np.int64)
        for batch in batches:
            for _, words, rows in hashed(batch.column(0)):
                one, two = before(words, rows)
                feats = model.features(one, two)
                if first:
                    cls = model.classes_of(words, *model.places(words))
                    for f in feats:
                        sums += np.bincount(f * CLASSES + cls, minlength=sums.size).reshape(sums.shape)
                    at, there = _among(model.hot, _pairs(words, one))
                    pairs += np.bincount(at[there], minlength=len(pairs))
                else:
                    share = np.exp(model.log_classes(feats))
                    for k, f in enumerate(feats):
                        order = np.argsort((f - k * FEATURES).astype(np.uint16), kind="stable")
                        edge = np.flatnonzero(np.diff(f[order], prepend=-1))
                        sums[f[order[edge]]] += np.add.reduceat(share[order], edge, axis=0)
        parts = sums.astype(np.float32).reshape(-1, _PART * CLASSES)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array([*(parts[k].tobytes() for k in some), pairs.tobytes()], pa.binary())], names=["part", "vec"])

    return run


def _among(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = np.frombuffer(vec.as_buffer(), dtype=np.int64 if part < 0 else np.float32)
            sums[part] = sums[part] + v if part in sums else v.astype(np.int64 if part < 0 else np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "vec"])


def _gathered(texts: DataFrame, model: Model, first: bool) -> tuple[np.ndarray, np.ndarray]:
    shared = texts.sparkSession.sparkContext.broadcast(model)
    parts = texts.mapInArrow(_sums(shared, first), "part bigint, vec binary")
    summed = parts.repartition(48, "part").mapInArrow(_merge, "part bigint, vec binary").toArrow()
    out, pairs = np.zeros((KINDS * FEATURES // _PART, _PART * CLASSES)), np.zeros(len(model.hot), np.int64)
    for part, vec in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist(), strict=True):
        if part < 0:
            pairs = np.frombuffer(vec, dtype=np.int64)
        else:
            out[part] = np.frombuffer(vec, dtype=np.float64)
    return out.reshape(KINDS * FEATURES, CLASSES), pairs


def trained(texts: DataFrame, counts: DataFrame, head: int = HEAD, hot: int = HOT, steps: int = STEPS, contexts: int = CONTEXTS) -> Model:
    """texts (text) of the training documents and their counts (token, c, pair) -> the model."""
    words = counts.where("not pair")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    n = int(sums.n)
    top = words.where(F.col("c") * head >= n).select("token", "c").toArrow()  # at most `head` tokens
    own, c = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    order = np.argsort(own)
    own, c = own[order], c[order]
    down = np.lexsort((own, -c))
    roots = np.cumsum(np.sqrt(c[down]))
    classes = np.zeros(len(c), np.int64)
    if len(c):
        classes[down] = np.minimum(HEAD_CLASSES - 1, (roots * HEAD_CLASSES / roots[-1]).astype(np.int64))
    mass = np.bincount(classes, weights=c, minlength=CLASSES) if len(c) else np.zeros(CLASSES)
    bucket = F.shiftrightunsigned("token", 3) % contexts
    tails = words.groupBy(bucket.alias("bucket")).agg(*[F.sum(F.when(F.col("token").bitwiseAND(7) == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(TAIL_CLASSES)]).toArrow()  # at most `contexts` rows
    by_end = np.stack([tails.column(1 + k).to_numpy().astype(np.int64) for k in range(TAIL_CLASSES)]) if tails.num_rows else np.zeros((TAIL_CLASSES, 0), np.int64)
    follows = np.zeros(len(own) + contexts)
    follows[: len(own)] = c
    follows[len(own) + tails.column(0).to_numpy().astype(np.int64)] = by_end.sum(axis=0)
    np.subtract.at(follows, len(own) + (own >> np.uint64(3)).astype(np.int64) % contexts, c)
    mass[HEAD_CLASSES:] += by_end.sum(axis=1) - np.bincount((own & np.uint64(7)).astype(np.int64), weights=c, minlength=TAIL_CLASSES)
    noted = counts.where("pair").where(F.col("c") * hot >= n).select("token").toArrow()  # at most `hot` pairs
    noted = np.sort(noted.column(0).to_numpy().astype(np.int64).view(np.uint64))
    share = np.where(mass > 0, mass, 1e-12) / max(n, 1)
    unknown = (int(sums.once) + 1) / (n + 2) if n else 1.0
    model = Model(n, int(sums.v), unknown, own, c, classes, np.maximum(mass, 1), follows.astype(np.float32), noted, np.zeros(len(noted), np.int64), np.log(share).astype(np.float32), np.zeros((KINDS * FEATURES, CLASSES), np.float32))
    if not n:
        return model
    observed, model.hot_counts = _gathered(texts, model, True)
    times = observed.sum(axis=1, keepdims=True)
    model.weights = (np.log((observed + _PRIOR * share) / ((times + _PRIOR) * share)) / KINDS).astype(np.float32)
    for _ in range(steps):
        expected, _ = _gathered(texts, model, False)
        model.weights = (model.weights + _RATE * np.log((observed + _PRIOR * share) / (expected + _PRIOR * share))).astype(np.float32)
    return model


_SENT = "bucket bigint, block bigint, kind int, data binary"
_DOC = np.dtype([("id", "<i8"), ("none", "?"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
_BACK = np.dtype([("row", "<u2"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def _packed(places: np.ndarray, words: np.ndarray, contexts: np.ndarray, rows: np.ndarray, logs: np.ndarray) -> bytes:
    """Tokens of a block for a bucket, head tokens (known by their places) first, then the others by word: each distinct one once."""
    edge = np.flatnonzero(np.diff(words, prepend=~words[:1]))
    runs = np.diff(np.append(edge, len(words)))
    kinds = (places, np.uint16), (words[edge], np.uint64), (runs, np.uint32), (contexts & 0xFFFF, np.uint16), (contexts >> 16, np.uint8), (rows, np.uint16), (np.minimum(np.round(-logs * _STEP), 65535), np.uint16)
    return b"".join([np.array([len(places), len(edge), len(contexts)], np.uint32).tobytes(), *(x.astype(kind).tobytes() for x, kind in kinds)])


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """(places, words, runs, contexts, rows, logs)"""
    head, m, n = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    at, out = 12, []
    for kind, size in ((np.uint16, head), (np.uint64, m), (np.uint32, m), (np.uint16, n), (np.uint8, n), (np.uint16, n), (np.uint16, n)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    places, words, runs, low, high, rows, logs = out
    return places, words, runs, low.astype(np.int32) | high.astype(np.int32) << 16, rows, logs


def _deal_batches(shared, buckets: int):
    """(doc_id, text, held) -> rows of `_SENT`: kind 0 and 1: tokens of training and of held-out texts; 2: the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        task, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        docs: list[tuple] = []
        size = rows_in = 0

        def settle() -> pa.RecordBatch:
            words, context, rows, logs = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, none, out = (np.concatenate(x) for x in zip(*docs, strict=True))
            name = (task << 24) + block
            at, known = model.places(words)
            after, before_known = model.places(context)
            where = model.contexts(context, after, before_known)
            table = np.zeros(len(ids), _DOC)
            table["id"], table["none"], table["n"] = ids, none, np.bincount(rows, minlength=len(ids))
            table["known"] = np.bincount(rows[known], minlength=len(ids))
            if known.any():
                table["base"] = np.bincount(rows[known], weights=np.log10(model.counts + 1.0)[at[known]], minlength=len(ids))
            spot, often = _among(model.hot, _pairs(words, context))
            often &= known
            if often.any():
                c = model.counts[at[often]]
                prior = np.exp(logs[often]) * c / model.mass[model.classes[at[often]]]
                table["score"] = np.bincount(rows[often], weights=model.log_known(model.hot_counts[spot[often]], prior, model.follows[where[often]]), minlength=len(ids))
            sent = [(name % buckets, name, 2, table.tobytes())]
            dealt = (np.where(known, _pairs(words, where), words) >> np.uint64(32)) % np.uint64(buckets)
            for kind in (0, 1):
                mine = np.flatnonzero(~often & (out[rows] == bool(kind)))
                mine = mine[np.argsort((dealt[mine] << np.uint64(40)) | np.where(known[mine], np.uint64(0), (words[mine] >> np.uint64(25)) | np.uint64(1 << 39)))]
                edge = np.searchsorted(dealt[mine], np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edge)):
                    part = mine[edge[k] : edge[k + 1]]
                    head = part[known[part]]
                    sent.append((int(k), name, kind, _packed(at[head], words[part[len(head) :]], where[part], rows[part], logs[part])))
            cols = zip(*sent, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "block", "kind", "data"])

        for batch in batches:
            ids = batch.column(0)
            for low, words, rows in hashed(batch.column(1)):
                m = int(rows[-1]) + 1
                own = ids.slice(low, m)
                one, two = before(words, rows)
                logs = model.log_classes(model.features(one, two))
                logs = logs[np.arange(len(words)), model.classes_of(words, *model.places(words))]
                held.append((words, one, rows + rows_in, logs))
                docs.append((own.fill_null(0).to_numpy(), np.asarray(own.is_null()), np.asarray(batch.column(2).slice(low, m))))
                size, rows_in = size + len(words), rows_in + m
                if size >= BLOCK_TOKENS or rows_in >= _BLOCK_ROWS:
                    yield settle()
                    held, docs, size, rows_in, block = [], [], 0, 0, block + 1
        if docs:
            yield settle()

    return run


def _settle_batches(shared):
    """Rows of `_SENT` by bucket -> (block, kind, data): kind 2 as it came, kind 3: sums by document of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        out: list[tuple] = []

        def settle(rows: list[tuple]) -> None:
            parts = [_unpacked(data) for _, _, data in rows]
            training = [kind == 0 for _, kind, _ in rows]
            pairs = np.concatenate([_pairs(np.concatenate([model.head[p[0]], np.repeat(p[1], p[2])]), p[3]) for p in parts])
            sizes = [len(p[3]) for p in parts]
            order = np.argsort(pairs)
            edge = np.flatnonzero(np.diff(pairs[order], prepend=~pairs[order[0]]))
            k = np.empty(len(pairs), np.int32)
            k[order] = np.repeat(np.add.reduceat(np.repeat(training, sizes)[order], edge, dtype=np.int32), np.diff(np.append(edge, len(pairs))))
            del pairs, order
            distinct, spot = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            times = np.bincount(spot, weights=np.concatenate([p[2] * int(t) for p, t in zip(parts, training, strict=True)]), minlength=len(distinct))[spot]
            low = first = 0
            for (block, _, _), (places, words, runs, contexts, row, logs), n in zip(rows, parts, sizes, strict=True):
                c = np.concatenate([model.counts[places], np.repeat(times[first : first + len(words)], runs)])
                cls = np.concatenate([model.classes[places], np.repeat(HEAD_CLASSES + (words & np.uint64(7)).astype(np.int64), runs)])
                found = c > 0
                prior = np.exp(logs / -_STEP) * np.where(found, c, 1) / model.mass[cls]
                score = np.where(found, model.log_known(k[low : low + n], prior, model.follows[contexts]), math.log10(model.unknown))
                tail = found & (np.arange(n) >= len(places))
                row = row.astype(np.int64)
                there = np.flatnonzero(np.bincount(row))
                table = np.zeros(len(there), _BACK)
                table["row"] = there
                for name, weight in (("known", tail.astype(float)), ("base", np.where(tail, np.log10(c + 1), 0)), ("score", score)):
                    table[name] = np.bincount(row, weights=weight)[there]
                out.append((block, 3, table.tobytes()))
                low, first = low + n, first + len(words)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "kind", "data"])
            out.clear()
            return batch

        now, held = None, []
        for batch in batches:
            for bucket, block, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if bucket != now and held:
                    settle(held)
                    held = []
                now = bucket
                if kind == 2:
                    out.append((block, 2, data.as_py()))
                else:
                    held.append((block, kind, data.as_py()))
            if len(out) > 1000:
                yield flush()
        if held:
            settle(held)
        yield flush()

    return run


def _collect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, data), those of a block together, its documents first -> a row for each document."""

    def rows(table: np.ndarray) -> pa.RecordBatch:
        ids = pa.array(table["id"], mask=table["none"])
        return pa.RecordBatch.from_arrays([ids, *(pa.array(table[k].copy()) for k in ("n", "known", "base", "score"))], names=["doc_id", "n", "known", "base", "score"])

    now, table = None, None
    for batch in batches:
        for block, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if block != now:
                if table is not None:
                    yield rows(table)
                now = block
            if kind == 2:
                table = np.frombuffer(data.as_py(), _DOC).copy()
            else:
                back = np.frombuffer(data.as_py(), _BACK)
                for name in ("known", "base", "score"):
                    table[name][back["row"]] += back[name].astype(table[name].dtype)
    if table is not None:
        yield rows(table)


def scored(docs: DataFrame, folds: int = 7, held: int = 2, head: int = HEAD, hot: int = HOT, steps: int = STEPS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    texts = docs.where(~out).select("text")
    counts = cut(counted(texts, hot))
    model = trained(texts, counts, head, hot, steps)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets = max(12, model.total // bucket_tokens)
    sent = docs.select("doc_id", "text", out.alias("held")).mapInArrow(_deal_batches(shared, buckets), _SENT)
    back = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle_batches(shared), "block bigint, kind int, data binary")
    rows = back.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_collect_batches, "doc_id bigint, n bigint, known bigint, base double, score double")
    each = math.log10(model.total + model.kinds + 1)
    return rows.select(
        "doc_id", out.alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n") * each).alias("base_score"), "score",
    )
