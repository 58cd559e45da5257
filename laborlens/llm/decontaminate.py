"""Benchmark decontamination by winnowing, with Spark expressions only.

Of the `K`-word grams of every window of `SPAN` words the least hash is kept as the window's fingerprint; equal windows
have equal fingerprints, so a shared window can't be missed. Fingerprints of documents and of benchmark items meet in an
equi-join; in the documents that it finds, the windows of the fingerprints that met are compared word for word, and hits
are extended to all words that such windows cover. Items of under `SPAN` words are one window each and are looked up among
the documents' grams of just that length (lengths that occur only).

The benchmark side is broadcast only after a count shows that it is small, else both sides are shuffled by fingerprint
(a hot fingerprint is split by adaptive execution). Texts of documents with hits are shuffled once, to count repeated rows once.

Defined cases: null text has no words; an item without words is no window; rows that repeat a doc_id are judged by
their own text; a null doc_id gets its row; item_ids that repeat count once; extra columns are not read (`clean` keeps them); texts are
read whole, in memory linear in the longest; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut

SPAN, K = 10, 5
BROADCAST_ROWS = 300_000
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), _GAP), "")


def _grams(words: str, k: int) -> Column:
    some = F.size(words) >= k
    return F.when(some, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def _least(grams: str, span: int, k: int) -> Column:
    n = span - k + 1
    some = F.size(grams) >= n
    return F.when(some, F.transform(F.sequence(F.lit(0), F.size(grams) - n), lambda i: F.least(*[F.get(grams, i + j) for j in range(n)])))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, w) -> (keys, w, m): m[i] is the fingerprint of the window that starts at word i."""
    return rows.select(*keys, "w", _grams("w", K).alias("g")).select(*keys, "w", _least("g", SPAN, K).alias("m"))


def _gram(i: Column, n: int | Column) -> Column:
    return F.array_join(F.slice("w", i + 1, n), " ")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, version, start, size, item_id): windows of items in documents.
    version: a hash of the text, which tells rows apart that repeat a doc_id."""
    items = cut(benchmark.select("item_id", lowered_words(F.col("text")).alias("w")).where("size(w) > 0").distinct())
    long = cut(_windows(items.where(F.size("w") >= SPAN), "item_id").select("item_id", F.posexplode("m").alias("i", "fp"), "w").select("item_id", "fp", _gram(F.col("i"), SPAN).alias("gram")).distinct())
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("version"), "text")

    words = keyed.select("doc_id", "version", lowered_words(F.col("text")).alias("w")).where(F.size("w") >= SPAN)
    prints = _windows(words, "doc_id", "version").select("doc_id", "version", F.explode(F.array_distinct("m")).alias("fp"))
    met = prints.join(_maybe_broadcast(cut(long.select("fp").distinct())), "fp")
    found = cut(met.groupBy("doc_id", "version").agg(F.collect_set("fp").alias("hot")))
    again = found.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "hot")
    size = again.agg(F.count("*").alias("n"), F.sum(F.size("hot")).alias("m")).first()
    if size.n + (size.m or 0) <= BROADCAST_ROWS:
        again = F.broadcast(again)
    texts = keyed.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).dropDuplicates(["doc_id", "version"])
    texts = texts.select("doc_id", "version", "hot", lowered_words(F.col("text")).alias("w"))
    spots = _windows(texts, "doc_id", "version", "hot").select("doc_id", "version", "w", F.explode(F.filter(F.transform("m", lambda x, i: F.when(F.array_contains("hot", x), i)), lambda i: i.isNotNull())).alias("i"))
    spots = spots.select("doc_id", "version", F.col("i").alias("start"), _gram(F.col("i"), SPAN).alias("gram"))
    out = spots.join(_maybe_broadcast(long.select("item_id", "gram").distinct()), "gram").select("doc_id", "version", "start", F.lit(SPAN).alias("size"), "item_id")

    short = items.where(F.size("w") < SPAN).select("item_id", F.size("w").alias("n"), _gram(F.lit(0), F.size("w")).alias("gram"))
    for (n,) in short.select("n").distinct().collect():  # at most SPAN - 1 lengths
        own = keyed.select("doc_id", "version", lowered_words(F.col("text")).alias("w")).where(F.size("w") >= n)
        grams = own.select("doc_id", "version", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: _gram(i, n))).alias("start", "gram"))  # noqa: B023
        one = grams.join(_maybe_broadcast(short.where(F.col("n") == n).select("item_id", "gram")), "gram")
        out = out.unionByName(one.select("doc_id", "version", "start", F.lit(n).alias("size"), "item_id"))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row."""
    docs = docs.select("doc_id", "text")
    windows = cut(hits(docs, benchmark)).groupBy("doc_id", "version")
    spans = windows.agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        stop = F.greatest(acc.end, s.start + s["size"])
        return F.struct((acc.n + stop - F.greatest(acc.end, s.start)).alias("n"), stop.alias("end"))

    per = cut(spans.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.aggregate("spans", none, add, lambda acc: acc.n).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items")))
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    base = docs.select("doc_id", F.xxhash64("text").alias("version"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(word)).cast("bigint").alias("n_words"))
    both = base.join(_maybe_broadcast(per), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return both.select("doc_id", "n_words", *[F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("n_hit", "n_items")], F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns as in docs."""
    found = cut(hits(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__d"), F.col("version").alias("__v")).distinct())
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__v"))
    return docs.join(_maybe_broadcast(found), same, "left_anti")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, n - least(n, 10) + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM bw),
dg AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM t, sizes WHERE len(w) >= size)),
h AS (SELECT r, i, dg.size, item_id FROM dg JOIN bw ON dg.size = bw.size AND dg.gram = bw.gram),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""
