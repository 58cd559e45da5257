"""Every registered query that has SQL against DuckDB on the smallest tables; the others against small fixtures."""

import math
import re

import duckdb
import pytest

from laborlens.operators import matching, postings
from laborlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        return float(f"{x:.9g}") if isinstance(x, float) else x

    return sorted(repr([str(one(x)) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    answer = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in answer.fetchall()]
    norm = lambda rows: plain([[bool(x) if isinstance(x, bool) else x for x in r] for r in rows])
    assert norm(got) == norm(want)


def test_longest_matches(spark):
    posts = spark.createDataFrame([(1, "Apache License and the license. Of the data"), (2, None), (3, "relicense"), (4, "")], "id bigint, text string")
    terms = spark.createDataFrame([("license", 1), ("apache license", 2), ("of the", 4), ("the", 3), ("data", 5)], "term string, skill_id bigint")
    got = sorted(tuple(r) for r in matching.longest_matches(posts, terms).collect())
    assert got == [(1, 1, "license", 23, 1), (1, 2, "apache license", 0, 1), (1, 3, "the", 19, 1), (1, 4, "of the", 32, 1), (1, 5, "data", 39, 1)]


def test_beta_prior():
    cells = [(20, k % 8, 5) for k in range(30)]
    a, b, status = matching.beta_prior(cells)
    assert status == "fitted" and 0.1 < a / (a + b) < 0.25
    lg = math.lgamma
    loss = lambda a, b: -sum(k * (lg(c + a) + lg(n - c + b) - lg(n + a + b) - lg(a) - lg(b) + lg(a + b)) for n, c, k in cells)
    assert all(loss(a, b) <= loss(a * x, b * y) + 1e-6 for x in (0.95, 1, 1.05) for y in (0.95, 1, 1.05))
    assert matching.beta_prior([(10, 1, 3)]) == (0.5, 0.5, "jeffreys:few_skills")


def test_bigram_retrieval(spark):
    terms = spark.createDataFrame([(1, "python"), (1, "py"), (2, "pylon"), (3, "java")], "concept bigint, alias string")
    asked = spark.createDataFrame([("pythons",)], "query string")
    got = [tuple(r) for r in matching.bigram_retrieval(asked, terms).orderBy("place").collect()]
    assert [g[1] for g in got] == [1, 2] and abs(got[0][2] - 5 / 6) < 1e-12


def test_quotas(spark):
    strata = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "stratum string, n bigint")
    assert {r.stratum: r.quota for r in postings.largest_remainder(strata, 4).collect()} == {"a": 2, "b": 2, "c": 0}
    assert {r.stratum: r.quota for r in postings.largest_remainder(strata, 99).collect()} == {"a": 5, "b": 5, "c": 1}


def test_names_are_ids():
    assert all(re.match(r"[A-Z]{1,2}\d+_", n) for n in registry.QUERIES)
