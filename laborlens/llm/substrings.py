"""Exact removal of word windows that an earlier document has too: prefix-partitioned suffix trees.

A suffix is a document's word sequence from some word on. In the tree of all suffixes, a node at word depth `window` or deeper that holds
suffixes of several documents is a repeat of at least that length. Words are 64-bit hashes of their bytes.

1. A suffix matters only if another document shares its first `window` words. Of every window, the `gram`-word piece with the least hash
   is its anchor (equal windows have equal anchors, about one word in thirteen starts one). Anchors that one document text has
   alone can't lie under a repeat and are dropped.
2. Suffixes are split into groups by prefixes of two lengths: windows with the same anchor are a group as a rule; where an anchor's count
   shows that its group could exceed `group_rows` suffixes, the prefix is the whole window. Neighbouring suffixes of a document with the
   same anchor travel as one row with their words, so that a group has all it takes to sort its suffixes.
3. A group's suffix tree is built from its words: ranks of all word sequences of 1, 2, 4, 8... words (prefix doubling) sort the suffixes,
   and the same ranks give the words that neighbours share. Runs that share `window` words or more are the tree's deep
   internal nodes; their suffixes in documents after the node's smallest doc_id are repeats. A group whose prefix is the whole window is
   a single such node: its smallest doc_id is an aggregate, combined before the shuffle, and goes back to large nodes' suffixes by a broadcast, so a
   passage that a third of all documents share is no hot key.

Documents that are the same word for word (128 bits of their words' hashes) count as one text in step 1, and all words of those after the
smallest doc_id go if there is a window, so groups of copies alone make no suffixes.

Defined cases: null text has no words; texts under `window` words keep all; rows that repeat a doc_id with the same words
get the same result each; a null doc_id keeps all its words and takes none from others; extra columns are not read (`rewrite` keeps them);
texts are read whole, in memory linear in the longest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut
from .hashing import hashed, mix

WINDOW = 50
#: most shared anchors (8 bytes each) that are broadcast; beyond it they are joined to the documents
BROADCAST_ROWS = 2_000_000
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: rows whose trees are built together
_TOGETHER = 4000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Fingerprints of runs of words, from prefix sums of word hashes times powers modulo 2**64; two seeds give 128 bits."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        own = mix(words + np.uint64(seed)) if seed else words
        self.back = _powers(pow(_ODD[seed], -1, 1 << 64), len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _powers(_ODD[seed], len(words)), dtype=np.uint64)])

    def runs(self, n: int | np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.back[at] + np.asarray(n).astype(np.uint64))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` neighbours: two running minima over blocks give any of them."""
    n = len(values) - span + 1
    if n <= 0:
        return values[:0]
    blocks = np.concatenate([values, np.full(-len(values) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[span - 1 : span - 1 + n])


class Texts:
    """Neighbouring rows of a text column: their words, and the windows that lie in one row with their anchors."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, window: int, gram: int):
        self.words, self.rows, self.window = words, rows, window
        self.firsts = np.flatnonzero(np.diff(rows, prepend=-1))
        self.ends = np.append(self.firsts[1:], len(words)) - 1  # where END stands
        self.rolling = Rolling(words)
        places = np.arange(len(words))
        self.starts = places[places + window <= self.ends[rows]]
        grams = self.rolling.runs(gram, places[: max(0, len(words) - gram + 1)])
        self.anchors = least_of(grams, window - gram + 1)[self.starts].view(np.int64)

    def versions(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each row's words."""
        n = self.ends - self.firsts
        return tuple(r.runs(n, self.firsts).view(np.int64) for r in (self.rolling, Rolling(self.words, 1)))


def _pieces(starts: np.ndarray, anchors: np.ndarray, most: int) -> np.ndarray:
    """Where runs of neighbouring windows with one anchor begin; runs of over `most` windows are cut."""
    places = np.arange(len(starts))
    new = (np.diff(starts, prepend=-9) != 1) | (np.diff(anchors, prepend=~anchors[:1]) != 0)
    return np.flatnonzero((places - np.maximum.accumulate(np.where(new, places, 0))) % most == 0)


def _scan(window: int, gram: int):
    """(doc_id, text) -> (doc_id, version, twin, anchors: that of each row that step 2 would send): texts under `window` words have no anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words, rows in hashed(batch.column(1), lower=False):
                t = Texts(words, rows, window, gram)
                new = _pieces(t.starts, t.anchors, window - gram + 1)
                own = t.rows[t.starts]
                ends = np.searchsorted(own[new], np.arange(len(t.firsts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(t.anchors[new]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(t.firsts)), *map(pa.array, t.versions()), lists], names=["doc_id", "version", "twin", "anchors"])

    return run


_SUFFIXES = "key bigint, doc_id bigint, version bigint, start int, words binary"
_WINDOWS = "key bigint, twin bigint, doc_id bigint, version bigint, start int"


def _marked(batch: pa.RecordBatch, low: int, t: Texts, shared) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have shared anchors, and which of them are dealt by the whole window. shared: sorted anchors and their marks, for all
    documents; else the batch has those of each row."""
    if shared is not None:
        hot, full = shared.value
        asked = t.anchors
    else:
        part = batch.slice(low, len(t.firsts))
        lists, marks = part.column(2), part.column(3)
        owner = np.repeat(np.arange(len(t.firsts)), [len(x) for x in lists]).astype(np.uint64)
        salted = lambda x, r: mix(x.view(np.uint64) + r.astype(np.uint64) * np.uint64(_ODD[1])).view(np.int64)
        hot = salted(lists.flatten().to_numpy(), owner)
        order = np.argsort(hot)
        hot, full = hot[order], marks.flatten().to_numpy(zero_copy_only=False)[order]
        asked = salted(t.anchors, t.rows[t.starts])
    if not len(hot):
        return np.zeros(len(asked), bool), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(hot, asked), len(hot) - 1)
    there = hot[at] == asked
    return there, there & full[at].astype(bool)


def _suffixes(window: int, gram: int, whole: bool, shared=None):
    """(doc_id, text[, hot array<bigint>, full array<boolean>]) -> the suffixes that are dealt by anchors (rows of `_SUFFIXES`), or those
    that are dealt by whole windows (rows of `_WINDOWS`)."""
    span = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words, rows in hashed(batch.column(1), lower=False):
                t = Texts(words, rows, window, gram)
                there, full = _marked(batch, low, t, shared)
                chosen = np.flatnonzero(full if whole else there & ~full)
                starts = t.starts[chosen]
                key = t.anchors[chosen]
                if whole:
                    key, twin = t.rolling.runs(window, starts).view(np.int64), Rolling(words, 1).runs(window, starts).view(np.int64)
                elif len(starts):
                    new = _pieces(starts, key, span)
                    sizes = np.diff(np.append(new, len(starts))) + window - 1
                    starts, key = starts[new], key[new]
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                    flat = words[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
                row = rows[starts]
                docs = batch.column(0).slice(low, len(t.firsts)).to_numpy(zero_copy_only=False)[row]
                cols = {"key": pa.array(key)} | ({"twin": pa.array(twin)} if whole else {})
                cols |= {"doc_id": pa.array(docs), "version": pa.array(t.versions()[0][row]), "start": pa.array((starts - t.firsts[row]).astype(np.int32))}
                if not whole:
                    cols["words"] = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((offsets * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]) if len(starts) else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def subtrees(key: np.ndarray, doc: np.ndarray, sizes: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of groups. key, doc and sizes: of pieces of text whose words follow each other in `words`; every suffix of at
    least `window` words is a leaf in the tree of its piece's key. -> (pieces, places in them) of the suffixes that lie under a node of `window`
    words or more together with one of a smaller doc."""
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(words))
    left = ends[piece] - places
    ranks, step = [np.append(np.unique(words, return_inverse=True)[1] + 1, 0)], 1
    while step < sizes.max():
        now = ranks[-1]
        further = np.where(left > step, now[np.minimum(places + step, len(words))], 0)
        ranks.append(np.append(np.unique(now[:-1] * (len(words) + 2) + further, return_inverse=True)[1] + 1, 0))
        step *= 2
    leaf = np.flatnonzero(left >= window)
    leaf = leaf[np.lexsort((ranks[-1][leaf], key[piece[leaf]]))]
    a, b = leaf[:-1].copy(), leaf[1:].copy()
    most = np.minimum(left[a], left[b])
    shared = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (shared < most) & (ranks[k][a] == ranks[k][b])
        shared += same * (1 << k)
        a, b = np.minimum(a + same * (1 << k), len(words)), np.minimum(b + same * (1 << k), len(words))
    deep = (np.minimum(shared, most) >= window) & (key[piece[leaf[1:]]] == key[piece[leaf[:-1]]])
    node = np.flatnonzero(np.concatenate([[True], ~deep]))
    own = doc[piece[leaf]]
    first = np.repeat(np.minimum.reduceat(own, node), np.diff(np.append(node, len(leaf))))
    late = leaf[own > first]
    return piece[late], late - (ends - sizes)[piece[late]]


def _subtree_batches(window: int):
    """Rows of `_SUFFIXES`, sorted by key -> (doc_id, version, start) of late windows. Groups are small; some are taken together."""

    def settle(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, doc, version, start, sizes, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        piece, place = subtrees(key, doc, sizes, words, window)
        return pa.RecordBatch.from_arrays([pa.array(doc[piece]), pa.array(version[piece]), pa.array((start[piece] + place).astype(np.int32))], names=["doc_id", "version", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            for low in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(low, _TOGETHER)
                texts = part.column(4)
                ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] // 8
                words = np.frombuffer(texts.buffers()[2], np.uint64, ends[-1])[ends[0] :]
                own = [part.column(k).to_numpy() for k in range(4)]
                key = own[0]
                # the last key may go on in what follows
                cut_at = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
                if cut_at or (held and held[-1][0][-1] != key[0]):
                    if cut_at:
                        held.append([*(x[:cut_at] for x in own), np.diff(ends[: cut_at + 1]), words[: ends[cut_at] - ends[0]]])
                    rows += cut_at
                    if held and (rows >= _TOGETHER or not cut_at):
                        yield settle(held)
                        held, rows = [], 0
                held.append([*(x[cut_at:] for x in own), np.diff(ends[cut_at:]), words[ends[cut_at] - ends[0] :]])
                rows += len(key) - cut_at
        if held:
            yield settle(held)

    return run


def _late_windows(own: DataFrame, scanned: DataFrame, window: int, gram: int, group_rows: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, version, starts): windows that start in a smaller doc_id too."""
    seen = scanned.select("version", F.explode("anchors").alias("anchor"))
    counts = seen.groupBy("anchor").agg(F.min("version").alias("lo"), F.max("version").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    shared = cut(counts.select("anchor", (F.col("n") * (window - gram) > group_rows).alias("full")))
    if shared.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = shared.toArrow()
        anchor, full = hot.column(0).to_numpy(), hot.column(1).to_numpy()
        order = np.argsort(anchor)
        value = own.sparkSession.sparkContext.broadcast((anchor[order].copy(), full[order].copy()))
        rows = own
    else:
        each = scanned.select("doc_id", F.explode("anchors").alias("anchor")).distinct().join(shared, "anchor")
        lists = each.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "full")).alias("x")).select("doc_id", F.col("x.anchor").alias("hot"), F.col("x.full").alias("full"))
        rows, value = own.join(lists, "doc_id").select("doc_id", "text", "hot", "full"), None
    found = rows.mapInArrow(_suffixes(window, gram, False, value), _SUFFIXES)
    late = found.repartition("key").sortWithinPartitions("key").mapInArrow(_subtree_batches(window), "doc_id bigint, version bigint, start int")
    if not shared.where("full").isEmpty():
        windows = cut(rows.mapInArrow(_suffixes(window, gram, True, value), _WINDOWS))
        nodes = windows.groupBy("key", "twin").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
        late = late.unionByName(beside(windows, cut(nodes), ["key", "twin"]).where("doc_id > first").select("doc_id", "version", "start"))
    return late.groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"))


def _marks(own: DataFrame, window: int, group_rows: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, marks array of (version, copy, starts)): what goes from the rows of doc_id whose text has that version."""
    gram = max(1, window // 2)
    own = own.where("doc_id is not null")
    scanned = cut(own.mapInArrow(_scan(window, gram), "doc_id bigint, version bigint, twin bigint, anchors array<bigint>"))
    ids = scanned.where("size(anchors) > 0").select("doc_id", "version", "twin")
    least = cut(ids.groupBy("version", "twin").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    copies = beside(ids, least, ["version", "twin"]).where("doc_id > least").select("doc_id", "version", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("starts"))
    late = _late_windows(own, scanned, window, gram, group_rows, broadcast_rows).select("doc_id", "version", F.lit(False).alias("copy"), "starts")
    both = copies.dropDuplicates(["doc_id", "version"]).unionByName(late)
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("version", "copy", "starts")).alias("marks"))


def _kept(texts: pa.Array, marks: pa.Array, window: int) -> Iterator[tuple[bytes | None, list[bytes], int]]:
    """Each text, its words that stay, and how many it has."""
    versions = np.concatenate([np.zeros(0, np.int64), *(Texts(words, rows, window, 1).versions()[0] for _, words, rows in hashed(texts, lower=False))])
    for text, own, version in zip(texts.cast(pa.binary()), marks, versions, strict=True):
        text = text.as_py()
        words = words_of(text)
        kept = words
        for mark in sorted(own.as_py() or (), key=lambda m: not m["copy"]):
            if mark["version"] == version:
                if mark["copy"]:
                    kept = []
                else:
                    steps = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.array(mark["starts"])
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                break
        yield text, kept, len(words)


def deduplicated(docs: DataFrame, window: int = WINDOW, group_rows: int = 100_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept), a row for each row; kept: the kept words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, n - len(kept), b" ".join(kept)) for _, kept, n in _kept(batch.column(1), batch.column(2), window)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = own.join(_marks(own, window, group_rows, broadcast_rows), "doc_id", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def rewrite(docs: DataFrame, window: int = WINDOW, group_rows: int = 100_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with repeats taken out of text (n_chars, if there, follows); texts without any stay as they are. Columns as in docs."""
    schema, names = docs.schema, docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns[:-1]
            texts = [text if len(kept) == n else b" ".join(kept) for text, kept, n in _kept(cols[at], batch.columns[-1], window)]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t.decode()) for t in texts]).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marks = _marks(own, window, group_rows, broadcast_rows).select(F.col("doc_id").alias("__doc"), F.col("marks").alias("__marks"))
    joined = docs.join(marks, docs["doc_id"].cast("bigint") == F.col("__doc"), "left").select(*[docs[c] for c in names], "__marks")
    return joined.mapInArrow(run, schema)


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM g JOIN f USING (k) WHERE doc_id > first),
u AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s FROM u ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""
