"""Golden cases of cleaning and of longest matching."""

from laborlens.functions import text as tx
from laborlens.operators import matching


def test_cleaning(spark):
    cases = {
        "精通C++/C#.NET，R与Go；负责LLM（大模型）微调！！！！": "精通C++/C#.NET，R与Go；负责LLM（大模型）微调！",
        "职位介绍\n\n岗位：算法\n\n----------\n任职要求：本科": "岗位：算法\n\n任职要求：本科",
        "a\n岗位职责 ：\nb。 ！？c; ;d": "a\n\nb。c;d",
        "a\n=·=·=\nb　　c\u00a0": "a\n\nb c",
        "a\nfooter of x\nb" + "!" * 50_000: "a\n\nb!",
        "a,, b:: c\n~~~~": "a,, b:: c\n~~~~",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.c for r in rows.select("raw", tx.cleaned(rows.raw, ("footer of x",)).alias("c")).collect()}
    assert got == cases


def test_matches_with_evidence(spark):
    texts = ["熟悉c++17与C#8", "abc++tool c#er 1c++", "r and react", "深度学习能力强", "深度学习能力, 深度学习", "会机器学习ml", "machine learning, deep machine learning"]
    posts = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    terms = [("c++", 1, 0), ("C#", 2, 0), ("r", 3, 1), ("深度学习", 4, 0), ("机器学习", 5, 0), ("machine learning", 5, 0), ("deep machine learning", 6, 0), ("学习ml", 7, 0)]
    out = matching.matches_with_evidence(posts, spark.createDataFrame(terms, "term string, skill_id bigint, ambiguous int")).collect()
    got = sorted((r.id, r.skill_id, r.surface, r.start, r.mention_count, r.ambiguous, [tuple(c) for c in r.covered]) for r in out)
    assert got == [
        (0, 1, "c++", 2, 1, False, []),
        (0, 2, "c#", 8, 1, False, []),
        (2, 3, "r", 0, 1, True, []),
        (4, 4, "深度学习", 0, 2, False, []),
        (5, 5, "机器学习", 1, 1, False, [(7, "学习ml", 3, 7)]),
        (6, 5, "machine learning", 0, 1, False, []),
        (6, 6, "deep machine learning", 18, 1, False, [(5, "machine learning", 23, 39)]),
    ]
