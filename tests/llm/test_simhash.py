import re

import numpy as np
import pytest
import xxhash

from laborlens.llm import simhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(rows, distance=3):
    prints = {d: plain_print(t) for d, t in rows}
    parent = {p: p for p in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ps = np.array(sorted(parent), dtype=np.uint64)
    for p in ps:
        for q in ps[np.bitwise_count(ps ^ p) <= distance]:
            parent[find(int(p))] = find(int(q))
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(d, least.get(find(p), d))
    return {(d, f"{p:016x}", least[find(p)]) for d, p in prints.items()}


def got(df):
    return {(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()}


def test_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert got(simhash.near_duplicates(docs)) == plain_components([tuple(r) for r in docs.collect()])


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (7, "One two"), (8, "one TWO"), (2, "É x y z"), (2, "É x y z"), (11, "w " * 70000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as fp", "2 as fingerprint", "3 as component_id")
    out = simhash.near_duplicates(df)
    assert out.count() == 8 and got(out) == plain_components(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 11]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_unlike_texts_of_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (4, b.upper()), (4, c), (6, "x y z"), (6, "p q r"), (6, "P Q R"), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=str) == sorted([(0, a), (1, b), (4, c), (6, "x y z"), (6, "p q r"), (None, a)], key=str)


@pytest.mark.parametrize("group_rows", [40, 100_000])
def test_trie_join_against_all_pairs(spark, group_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 30, 3), dtype=np.uint64)).astype(np.uint64)
    ps = np.unique(np.concatenate([base, (base[:, None] ^ np.bitwise_xor.reduce(flips * rng.integers(0, 2, (40, 30, 3), dtype=np.uint64), axis=2)).ravel()]))
    links = simhash.near_links(spark.createDataFrame([(int(p),) for p in ps.view(np.int64)], "fp bigint"), group_rows=group_rows)
    pairs = np.array([tuple(r) for r in links.collect()], dtype=np.int64).view(np.uint64)
    at = {int(p): k for k, p in enumerate(ps)}
    i, j = ([at[int(x)] for x in pairs[:, c]] for c in (0, 1))
    near = np.argwhere(np.bitwise_count(ps[:, None] ^ ps[None]) <= 3)
    want = simhash.roots_of(len(ps), near[:, 0], near[:, 1])
    assert np.array_equal(simhash.roots_of(len(ps), np.array(i), np.array(j)), want)


def test_slices_do_not_change_links():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**18, 3000, dtype=np.uint64) << np.uint64(7))
    want = np.argwhere(np.bitwise_count(keys[:, None] ^ keys[None]) <= 2)
    n = len(keys)
    for cut in (50, 1 << 20):
        i, j = simhash.trie_links(keys, [(0, n, 0, n, 0)], 0, 2, cut)
        assert np.array_equal(simhash.roots_of(n, i, j), simhash.roots_of(n, want[:, 0], want[:, 1]))
