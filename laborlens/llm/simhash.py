"""SimHash near-duplicates: fingerprints, and a binary-trie self-join within a Hamming distance.

Spark hashes every document to 64 bits, keeps each fingerprint once with its smallest doc_id, and deals fingerprints by
each of `distance + 1` bit blocks: two that differ in at most `distance` bits agree on one block at least. Inside a
dealt group the fingerprints, sorted, are a binary trie whose nodes are ranges. The join walks pairs of nodes together
from the root pair, one bit a level, adds up differing bits, and drops a pair once they exceed the budget. Two leaves
are settled at once by their remaining bits. A group sends on a spanning forest of what it linked (at most one link for
each fingerprint), never all pairs; links meet in `components.connected`.

Defined cases: null text counts as empty; an empty text has fingerprint zero, which links like any other; repeated rows
each get a row; a null doc_id never names a component unless all of it is null; extra columns are not read (`keep_one` keeps them); texts are
read whole, in memory linear in the longest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut
from .components import connected

_CHUNK = 1 << 16
#: byte -> eight counters of one byte each, for its eight bits
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes | None) -> int:
    """64 bits: bit k is 1 if it is set in over half of the hashes of the text's 3-word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - 2)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + 2]
        grams = zip(part, part[1:], part[2:]) if len(words) > 2 else [words]
        hashes = np.array([digest(b" ".join(g), 42) for g in grams], dtype="<u8")
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp bigint), a row for each row."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_hash_batches, "doc_id bigint, fp bigint")


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of 0..n-1 by the links i-j."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, again := label[label]):
            label = again
    return label


def trie_links(keys: np.ndarray, tops: list[tuple[int, int, int, int, int]], depth: int, budget: int, slice_: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Linked leaves of a trie (spanning links are enough; all links between different components are found).

    keys: uint64, sorted within each range. tops: node pairs (a_lo, a_hi, b_lo, b_hi, differing bits so far) at `depth`.
    Memory is bounded: a frontier over `slice_` pairs is cut and its parts are walked one after the other; parts whose
    two subtrees have become one component meanwhile are not walked.
    """
    n = len(keys)
    ones: dict[int, np.ndarray] = {}

    def split(at: int) -> np.ndarray:
        if at not in ones:
            bits = ((keys >> np.uint64(63 - at)) & np.uint64(1)).astype(np.int32)
            ones[at] = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])
        return ones[at]

    label = np.arange(n)
    found_i: list[np.ndarray] = []
    found_j: list[np.ndarray] = []
    stack = [(depth, *(np.array(x, dtype=np.int32) for x in (zip(*tops, strict=True) if tops else [[]] * 5)))]
    while stack:
        at, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > slice_:
            parts = range(0, len(alo), slice_)
            stack += [(at, *(x[p : p + slice_] for x in (alo, ahi, blo, bhi, err))) for p in parts]
            continue
        if found_i and len(alo) > 1000:
            label = roots_of(n, np.concatenate(found_i), np.concatenate(found_j))
            linked = np.flatnonzero(label != np.arange(n))
            found_i, found_j = [linked], [label[linked]]
            turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            one = (turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (label[alo] == label[blo])
            alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                found_i.append(i[near])
                found_j.append(j[near])
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or at == 64:
            continue
        set_ = split(at)
        amid, bmid = ahi - (set_[ahi] - set_[alo]), bhi - (set_[bhi] - set_[blo])
        cross = (alo != blo) & (err < budget)
        own = (alo == blo) & (err < budget)
        pairs = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            *([tuple(x[own | cross] for x in (alo, amid, bmid, bhi, err + 1))] if (own | cross).any() else []),
            *([tuple(x[cross] for x in (amid, ahi, blo, bmid, err + 1))] if cross.any() else []),
        ]
        nxt = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        full = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        stack.append((at + 1, *(x[full] for x in nxt)))
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def _join_group_batches(block_bits: int, distance: int, memory_rows: int):
    """mapInArrow over (block, node, side, err, key), sorted so that the rows of a node pair are neighbours."""

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        block, node, side, err, key = cols
        n = len(key)
        keys = key.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (node[1:] != node[:-1]), [True]]))
        tops = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo > 1:
                mid = lo + int((side[lo:hi] == 0).sum())
                if err[lo] == 0 and mid == hi:
                    tops.append((lo, hi, lo, hi, 0))
                elif lo < mid < hi:
                    tops.append((lo, mid, mid, hi, 0))
        i, j = trie_links(keys, tops, block_bits, distance)
        label = roots_of(n, i, j)
        leafs = np.flatnonzero(label != np.arange(n))
        turn = lambda x: np.bitwise_or(keys[x] >> (shift := (block[x] * block_bits).astype(np.uint64)), np.where(shift > 0, keys[x] << (np.uint64(64) - shift) % np.uint64(64), 0))
        return pa.RecordBatch.from_arrays([pa.array(turn(leafs).view(np.int64)), pa.array(turn(label[leafs]).view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            rows += batch.num_rows
            if rows >= memory_rows:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
                end = int(last[-1]) + 1 if len(last) else 0
                if end:
                    yield links([c[:end] for c in cols])
                held, rows = [[c[end:] for c in cols]], len(cols[0]) - end
        if rows:
            yield links([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def near_links(prints: DataFrame, distance: int = 3, group_rows: int = 100_000) -> DataFrame:
    """Distinct (fp bigint) -> (a, b) links that connect all within `distance` differing bits, through others or not.

    Groups of a block value with over `group_rows` fingerprints are dealt again by pairs of deeper trie nodes.
    """
    blocks = distance + 1
    bits = 64 // blocks
    turned = prints.select(F.explode(F.array(*[F.struct(F.lit(b).alias("block"), (F.shiftleft("fp", bits * b).bitwiseOR(F.shiftrightunsigned("fp", 64 - bits * b)) if b else F.col("fp")).alias("key")) for b in range(blocks)])).alias("x")).select("x.*")
    turned = turned.withColumn("top", F.shiftrightunsigned("key", 64 - bits))
    sizes = turned.groupBy("block", "top").count().where(F.col("count") > group_rows)
    most = sizes.agg(F.max("count")).first()[0]
    plain = lambda x: x.select("block", F.col("top").alias("node"), F.lit(0).alias("side"), F.lit(0).alias("err"), "key")
    if most is None:
        dealt = plain(turned)
    else:
        deeper = min(12, 1 + int(np.ceil(np.log2(most / group_rows))) + 2)
        hot = turned.join(sizes.select("block", "top"), ["block", "top"], "left_semi")
        cold = turned.join(sizes.select("block", "top"), ["block", "top"], "left_anti")
        masks = [m for m in range(1 << deeper) if m.bit_count() <= distance]
        u = F.shiftrightunsigned(F.shiftleft("key", bits), 64 - deeper)
        pairs = hot.withColumn("u", u).withColumn("m", F.explode(F.array(*map(F.lit, masks)))).withColumn("v", F.col("u").bitwiseXOR(F.col("m")))
        node = F.col("top") * (1 << 2 * deeper) + F.least("u", "v") * (1 << deeper) + F.greatest("u", "v")
        dealt = plain(cold).union(pairs.select("block", (-node - 1).alias("node"), F.when(F.col("u") <= F.col("v"), 0).otherwise(1), F.bit_count("m"), "key"))
    dealt = dealt.select(F.col("block").cast("bigint"), "node", F.col("side").cast("bigint"), F.col("err").cast("bigint"), "key")
    sorted_ = dealt.repartition("block", "node").sortWithinPartitions("block", "node", "side", "key")
    return sorted_.mapInArrow(_join_group_batches(bits, distance, 4 * group_rows), "a bigint, b bigint")


def _classified(docs: DataFrame, distance: int = 3, group_rows: int = 100_000) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, root, component_id), a row for each row; root is one for each group, which component_id need not be
    where rows repeat a doc_id."""
    signed = cut(fingerprints(docs))
    firsts = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    roots = connected(near_links(firsts.select("fp"), distance, group_rows))
    classed = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(classed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    classes = cut(beside(classed, least, ["root"]).select("fp", "root", "component_id", F.col("rows").alias("n")))
    return beside(signed, classes, ["fp"])


def near_duplicates(docs: DataFrame, distance: int = 3, group_rows: int = 100_000) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, fingerprint, component_id), a row for each row."""
    return _classified(docs, distance, group_rows).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 3) -> DataFrame:
    """docs without all but one document (the smallest doc_id, then the smallest fingerprint) of each near-duplicate group. Rows that repeat
    a doc_id are told apart by fingerprint: those with unlike texts are documents of their own. Rows without doc_id stay. Columns as in docs."""
    items = _classified(docs, distance).where("doc_id is not null").select("doc_id", "fp", "root")
    winners = cut(items.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select("x.*"))
    texts = items.groupBy("doc_id").agg((F.min("fp") < F.max("fp")).alias("__unlike"))
    ids = winners.select("doc_id").distinct().join(texts, "doc_id").withColumnRenamed("doc_id", "__id")
    there = docs.join(ids, F.col("doc_id").cast("bigint") == F.col("__id"))
    alike = there.where("not __unlike").dropDuplicates(["__id"]).select(docs.columns)
    mixed = there.where("__unlike").withColumn("__version", F.xxhash64("text"))
    signed = fingerprints(mixed.select(F.col("__version").alias("doc_id"), "text")).distinct().toDF("__version", "__fp")
    winning = winners.toDF("__id", "__fp")
    unlike = mixed.join(signed, "__version").join(winning, ["__id", "__fp"], "left_semi").dropDuplicates(["__id", "__fp"]).select(docs.columns)
    return alike.union(unlike).union(docs.where("doc_id is null"))
