import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import substrings
from laborlens.llm.common import beside


def plain(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), kept))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()], 50)
    assert got(substrings.deduplicated(docs)) == want and sum(x[2] for x in want) > 1000


@pytest.mark.parametrize(("group_rows", "broadcast"), [(3, 0), (3, 10**6), (1000, 0), (1000, 10**6)])
def test_random_texts(spark, group_rows, broadcast):
    rng = np.random.default_rng(4)
    pool = [" ".join(rng.choice(list("abc"), 30)) for _ in range(4)]
    rows = []
    for d in range(60):
        parts = [pool[k] if k < 4 else " ".join(rng.choice(list("abcdefgh"), 15)) for k in rng.integers(0, 7, 5)]
        rows.append((int(d * 3 % 60), "  ".join(parts)))
    rows += [(100, None), (101, ""), (102, "a b"), (7, rows[3][1]), (103, rows[5][1]), (103, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(substrings.deduplicated(df, 8, group_rows, broadcast)) == plain(rows, 8)
    same = "x " * 3000
    more = spark.createDataFrame([(1, same), (2, "y " + same)], "doc_id bigint, text string")
    assert got(substrings.deduplicated(more, 8, group_rows, broadcast)) == plain([(1, same), (2, "y " + same)], 8)


def test_rewrite_keeps_columns(spark):
    long = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, long, "a", 5, 0), (2, "top\n" + long + "  end", "b", 6, 0), (None, long, None, None, 0), (3, None, None, None, 0)], "doc_id bigint, text string, kept string, n_chars bigint, marks int")
    out = substrings.rewrite(df)
    assert out.schema == df.schema
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, long, len(long)), (2, "top end", 7), (None, long, len(long)), (3, None, None)}
    assert substrings.rewrite(df.limit(0)).count() == 0


def test_least_of_neighbours():
    rng = np.random.default_rng(0)
    for n in (3, 10, 57):
        g = rng.integers(0, 6, n).astype(np.uint64)
        for span in (1, 2, 5):
            assert list(substrings.least_of(g, span)) == [min(g[i : i + span]) for i in range(n - span + 1)]


def test_subtrees():
    rng = np.random.default_rng(6)
    for _ in range(30):
        pieces = [rng.integers(0, 3, int(rng.integers(4, 30))) for _ in range(12)]
        key, doc = rng.integers(0, 3, 12), rng.integers(0, 6, 12)
        got = set(zip(*substrings.subtrees(key, doc, np.array([len(p) for p in pieces]), np.concatenate(pieces).astype(np.uint64), 4), strict=True))
        spots = [(k, i) for k, p in enumerate(pieces) for i in range(len(p) - 3)]
        path = lambda k, i: (key[k], *pieces[k][i : i + 4])  # noqa: B023, E731
        first = {}
        for k, i in spots:
            first[path(k, i)] = min(doc[k], first.get(path(k, i), 99))
        assert got == {(k, i) for k, i in spots if doc[k] > first[path(k, i)]}


def test_large_groups_are_broadcast(spark):
    rows = spark.createDataFrame([(k if k < 40 else 99, k) for k in range(100)], "g int, x int")
    groups = rows.where("g <> 7").groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("least"))
    want = sorted((r.g, r.x, 40 if r.g == 99 else r.x) for r in rows.where("g <> 7").collect())
    for share in (1, 10, 100, 1000):
        assert sorted((r.g, r.x, r.least) for r in beside(rows, groups, ["g"], share).collect()) == want
