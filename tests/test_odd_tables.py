"""Queries on small tables made for one odd case each."""

from datetime import datetime

import duckdb

from laborlens.plans import registry, rounds


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_means_on_the_edge(spark, tmp_path):
    # (jobs with an anchor, jobs) of four skills whose omegas, to six places, average 0.1999995: in 18 of 24 orders their sum as doubles falls short
    skills, shared = [(27, 592), (31, 455), (273, 489), (43, 336)], 200
    jobs, lines = [(i, 0) for i in range(shared)], [(i, k) for i in range(shared) for k in range(4)]
    for k, (c, n) in enumerate(skills):
        for i in range(n - shared):
            lines.append((len(jobs), k))
            jobs.append((len(jobs), int(i < c)))
    day = datetime(1997, 5, 1)
    d = written(
        spark, tmp_path,
        orders=([(i, 1, "F", day, "1-URGENT" if a else "5-LOW") for i, a in jobs], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        customer=([(1, 1, "X")], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        nation=([(1, "N")], "n_nationkey int, n_name string"),
        lineitem=([(i, k, 0.06) for i, k in lines], "l_orderkey bigint, l_partkey bigint, l_discount double"),
    )
    # all shared jobs, and those with the third skill alone
    got = registry.QUERIES["A7_anchor_penetration"](spark, d).collect()
    assert [r.asDict() for r in got] == [{"city": "N", "year": 1997, "total": len(jobs), "ai_jobs": shared + skills[2][1] - shared}]


def test_business_words_in_texts(spark, tmp_path):
    words = rounds.BUSINESS.split("|")
    texts = ["A!! THBLE!! THE!! ANEAHA.BDOA!", *words, "BBDD", "销市场售", "x" * 29 + "BD", "x" * 29 + "销售", "", None, *(f"the {w} of" for w in words)]
    # every text with every remainder, and an id that is null
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)] + [(-3, "BD"), (-2, "BD"), (None, "BD")]
    d = written(spark, tmp_path, documents=([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    name = "X28_business_titles"
    got = [(r.recruit_id, r.business) for r in registry.QUERIES[name](spark, d).collect()]
    assert sorted(got, key=repr) == sorted(c.execute(registry.ORACLES[name]).fetchall(), key=repr)
