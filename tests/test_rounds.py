"""Model replies, chunks and discovery rounds on small fixtures."""

import random
import uuid

from pyspark.sql import functions as F

from laborlens.functions import text as tx
from laborlens.operators import replies, sampling


def test_unwrapped(spark):
    cases = {
        "<think>a</think> {}": "{}", "</think>\n[1]": "[1]", "{} </thinking> ": "{}", "```json\n{}\n```": "{}", "```\n{}": "```\n{}",
        '{"a": "<think>x</think> ```"}': '{"a": "<think>x</think> ```"}', "": "", "```": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.u for r in rows.select("t", replies.unwrapped(F.col("t")).alias("u")).collect()}
    assert got == cases | {None: ""}


def test_json_recovery(spark):
    cases = [('x {"a": "}"} }', '{"a":"}"}', ['{"a": "}']), ("[1, 2] {bad}", "[1,2]", []), ('{"a": {"b": 1}}{"c": 2}', '{"a":{"b":1}}', ['{"a": {"b": 1}}', '{"c": 2}']), ("none", None, []), (None, None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, t string")
    got = rows.select("i", replies.first_json("t").alias("f"), replies.json_objects(F.col("t")).alias("o")).orderBy("i").collect()
    assert [r.f for r in got] == [c[1] for c in cases]
    # a brace inside a string ends the object for the scan by pattern; what it cuts does not parse
    assert [r.o for r in got] == [[], *[c[2] for c in cases[1:]]]


def test_located(spark):
    rows = [("ab x ab y ab", "ab", "x ab"), ("ab", "ab", None), ("abab", "ab", "zz"), ("a", "", ""), ("a", "b", "a"), (None, "b", "a")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, e string").select("i", replies.located(F.col("t"), F.col("s"), F.col("e")).alias("x")).orderBy("i").collect()
    assert [tuple(r.x) if r.x else None for r in got] == [(5, 7, 1), (0, 2, 0), (0, 2, 1), None, None, None]


def test_chunks(spark):
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("ab .;\n") for _ in range(rng.randint(0, 300)))
        cut = replies.spans(text, len, 40, 10)
        assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(e - s <= 40 for s, e in cut)
        for (s, e), (t, _) in zip(cut, cut[1:]):
            assert t == max(s + 1, e - 10)
            late = [i + 1 for i in range(s + 26, s + 40) if text[i] in replies.SENTENCE_ENDS]
            assert e == (late[-1] if late else s + 40)
    rows = spark.createDataFrame([(1, "a. b"), (2, None), (3, "")], "id bigint, text string")
    assert sorted(tuple(r) for r in replies.chunked(rows, "id", len, 3, 1).collect()) == [(1, 0, 0, 3, "a. "), (1, 1, 2, 4, " b"), (2, 0, 0, 0, ""), (3, 0, 0, 0, "")]


def test_batches(spark):
    rows = spark.createDataFrame([("a", i, "x" * 60) for i in range(5)] + [("b", 0, None), ("b", 1, "y" * 900), ("b", 2, "z")], "k string, i int, text string")
    got = {(r.k, r.i): r.batch for r in replies.batched(rows, "k", "i", 200).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 1, 2] and [got["b", i] for i in range(3)] == [0, 1, 2]
    most = {(r.k, r.i): r.batch for r in replies.batched(rows, "k", "i", 10_000, 2).collect()}
    assert [most["a", i] for i in range(5)] == [0, 0, 1, 1, 2]


def test_industry_quota(spark):
    def quotas(sizes, n):
        rows = spark.createDataFrame([(1, k, c) for k, c in sizes.items()], "y int, k string, n bigint")
        return {r.k: r.quota for r in sampling.industry_quota(rows, "y", "k", n).collect()}

    def plain(sizes, n):
        order = sorted(sizes, key=lambda k: (-sizes[k], k))
        floor = {k: min(50, sizes[k]) for k in order}
        if sum(floor.values()) >= n:
            out, left = {}, n
            for k in order:
                out[k] = min(floor[k], left)
                left -= out[k]
            return out
        rest = {k: sizes[k] - floor[k] for k in order}
        spare = min(n - sum(floor.values()), sum(rest.values()))
        share = {k: spare * rest[k] // sum(rest.values()) if spare else 0 for k in order}
        short = spare - sum(share.values())
        return {k: floor[k] + share[k] + (k in order[:short] and rest[k] > 0) for k in order}

    rng = random.Random(8)
    for n in (70, 333, 2000):
        for _ in range(4):
            sizes = {c: rng.choice([7, 49, 50, 51, 260, 901, 4000]) for c in "pqrstu"[: rng.randint(1, 6)]}
            assert quotas(sizes, n) == plain(sizes, n), (sizes, n)


def test_saturation(spark):
    rows = [(1, 2, 0.02, 9.0), (2, 3, 0.09, 8.93), (3, 2, None, 8.93), (4, 0, 0.01, 8.93), (5, 0, 0.01, 6.5), (7, 0, 0.01, 6.5), (8, 0, float("nan"), 6.5)]
    got = sampling.saturated(spark.createDataFrame(rows, "round int, new_concepts int, coverage_gain double, uncovered double")).collect()
    assert {r.round: r.saturated for r in got} == {1: False, 2: True, 3: False, 4: False, 5: False, 7: False, 8: False}


def test_round_sample(spark):
    pool = spark.createDataFrame([(i, 0 if i < 5 else 2, int(5 <= i < 8)) for i in range(40)], "job_id bigint, matched int, main int")
    got = sampling.round_sample(pool, 30, "s").collect()
    parts = [r.component for r in got]
    assert len({r.job_id for r in got}) == 30
    assert [parts.count(p) for p in ("low_coverage", "main_anchor", "general", "quota_shortfall_fill")] == [5, 3, 9, 13]


def test_concept_ids(spark):
    rows = spark.createDataFrame([(f" Térm {i} 深度", 1990 + i) for i in range(40)], "t string, y int")
    got = rows.select("t", "y", tx.concept_id(str(uuid.NAMESPACE_URL), F.col("t"), F.col("y")).alias("id")).collect()
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.t.strip().lower()}|{r.y}")) for r in got)
