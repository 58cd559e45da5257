"""Quality rules for documents and for their hosts (`source`), with Spark expressions only.

Rules of a document: too few words; too many words inside repeated 3-word windows (these two reject on their own);
too many symbols for its words; too many repeated lines. Failures are added up by host. A host's failure rate is shrunk
towards all hosts' by a beta prior whose two parameters are fitted to the hosts' rates by moments, so that a host
with a few documents gets no extreme rate. A document that breaks the symbol rule is rejected where the host's shrunk rate
is over `SYMBOLS_FROM`, one with repeated lines where it is over `LINES_FROM`; documents that break no rule stay whatever
their host is.

Host sums are aggregated before the shuffle, and the verdict table (a row for each host) is broadcast only up to
`HOSTS_BROADCAST` hosts, else joined by shuffle.

Defined cases: null text has no words; null source is a host of its own; a null doc_id is a document like any other; repeated rows count
each; extra columns are not read (`keep_good` keeps them); texts are read whole, in memory linear in the longest; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, stored

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT = 50, 50, 10, 30
SYMBOLS_FROM, LINES_FROM = 0.01, 0.5
SYMBOLS = "#*$%&|<>"
HOSTS_BROADCAST = 100_000
_GAP = "[\\x20\\x09-\\x0D]+"


def _without(c: Column, chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column `__m`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    a = docs.select(*names, text.alias("__t"), F.btrim(text, F.lit(SPACE)).alias("__trim"))
    words = F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", _GAP))
    lines = F.filter(F.split("__t", "\n"), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    b = a.select(*names, "__t", words.alias("__w"), lines.alias("__l"))
    hashes = F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    c = b.select(
        *names, hashes.alias("__h"), F.size("__w").alias("__n"), F.length(_without(F.col("__t"), SPACE)).alias("__wc"),
        (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).alias("__ns"), F.size("__l").alias("__nl"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).alias("__dl"),
    )
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    d = c.select("*", F.when(some, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    again = F.filter("__s", lambda x, k: (F.get("__s", k + 1).h == x.h) | ((k > 0) & (F.get("__s", F.greatest(k - 1, F.lit(0))).h == x.h)))
    at = F.sort_array(F.transform(again, lambda x: x.i))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(at, none, lambda acc, i: F.struct((acc.n + 3 - F.greatest(acc.end - i, F.lit(0))).alias("n"), (i + 3).alias("end")), lambda acc: acc.n)
    m = {"n_words": F.col("__n"), "word_chars": F.col("__wc"), "n_symbols": F.col("__ns"), "n_lines": F.col("__nl"), "n_dup_lines": F.col("__dl"), "n_repeat_words": F.coalesce(covered, F.lit(0))}
    return d.select(*names, F.struct(*[v.cast("bigint").alias(k) for k, v in m.items()]).alias("__m"))


def _flags(m: str) -> dict[str, Column]:
    g = lambda k: F.col(f"{m}.{k}")
    return {
        "base_failed": (g("n_words") < MIN_WORDS) | (100 * g("n_repeat_words") > MAX_REPEAT_PERCENT * g("n_words")),
        "symbols_failed": 100 * g("n_symbols") > MAX_SYMBOL_PERCENT * g("n_words"),
        "lines_failed": 100 * g("n_dup_lines") > MAX_LINE_PERCENT * g("n_lines"),
    }


def host_rates(rows: DataFrame) -> DataFrame:
    """rows (host, __m) -> (host, rate): failures by host, shrunk by the beta prior of all hosts."""
    f = _flags("__m")
    failed = (f["base_failed"] | f["symbols_failed"] | f["lines_failed"]).cast("bigint")
    hosts = cut(rows.groupBy("host").agg(F.sum(failed).alias("bad"), F.count("*").alias("n")))
    rate = F.col("bad") / F.col("n")
    spread = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v")).first()
    mean, var = spread.m or 0.0, max(spread.v or 0.0, 1e-6)
    weight = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6)
    return hosts.select("host", ((F.col("bad") + mean * weight) / (F.col("n") + weight)).alias("rate"))


def _verdict(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (host, __m, ...) with base_failed and kept."""
    if rates.limit(HOSTS_BROADCAST + 1).count() <= HOSTS_BROADCAST:
        rates = F.broadcast(rates)
    rates = rates.select(F.col("host").alias("__host"), F.col("rate").alias("__rate"))
    f = _flags("__m")
    both = rows.join(rates, rows["host"].eqNullSafe(F.col("__host")))
    host = (f["symbols_failed"] & (F.col("__rate") > SYMBOLS_FROM)) | (f["lines_failed"] & (F.col("__rate") > LINES_FROM))
    # one comparison of a sum: a filter on it can't be split and pushed below the join, where the measures' expressions would be
    # put into it many times over
    kept = f["base_failed"].cast("int") + host.cast("int") == 0
    return both.withColumns({"base_failed": f["base_failed"], "kept": kept}).drop("__host", "__rate")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    rows = cut(measured(docs.select("doc_id", "text", "source")).select("doc_id", F.col("source").alias("host"), "__m"))
    out = _verdict(rows, host_rates(rows.select("host", "__m")))
    return out.select("doc_id", *[f"__m.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep; columns as in docs. Documents are stored beside their measures, so that texts are measured once
    and none is shuffled."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("text"), docs["source"].alias("host"))
    rows = stored(measured(packed).select("__row", "host", "__m"))
    return _verdict(rows, host_rates(rows)).where("kept").select("__row.*")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT r, doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gr AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS c FROM g),
cov AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS k FROM gr WHERE c > 1) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM
  (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS sf,
  100 * n_dup_lines > 30 * n_lines AS lf FROM m),
h AS (SELECT source, sum((base_failed OR sf OR lf)::INT)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, greatest(var_pop(bad / n), 1e-6) AS var FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / var - 1, 1.0), 1e6) AS weight FROM p),
s AS (SELECT source, (bad + mean * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((sf AND rate > 0.01) OR (lf AND rate > 0.5)) AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""
