"""Dictionaries and their checks, files and releases: cases that SQL over the test tables has not, and errors."""

import pytest
from pyspark.sql import functions as F

from laborlens.functions import fold, industry
from laborlens.functions import text as tx
from laborlens.operators import counts, skills
from laborlens.sources import files


def test_alias_resolution(spark):
    schema = "alias string, skill_id string, primary_id string, ambiguous int"
    good = [("Go", "s2", "s2", 0), ("go", "s1", "s2", 1), ("R", "s3", "", 0)]
    assert {tuple(r) for r in skills.resolved(spark.createDataFrame(good, schema)).collect()} == {("go", "Go", "s2", 1), ("r", "R", "s3", 0)}
    for bad in ([("x", "s1", "", 0), ("X", "s2", "", 0)], [("x", "s1", "s9", 0), ("X", "s2", "s9", 0)], [("x", "s1", "s1", 0), ("X", "s2", "s2", 0)]):
        with pytest.raises(Exception, match="no only primary"):
            skills.resolved(spark.createDataFrame(bad, schema)).collect()


def test_governed_errors(spark):
    schema = "term string, grade string, skill_id string"
    assert {tuple(r) for r in skills.governed(spark.createDataFrame([("A ", "A", "1"), ("b", "D", None)], schema)).collect()} == {("a", "1")}
    for bad in ([("a", "B", None)], [("a", "B", "")], [("a", "B", "1"), ("A", "C", "2")]):
        with pytest.raises(Exception, match="no id or several"):
            skills.governed(spark.createDataFrame(bad, schema)).collect()


def test_contexts_and_brackets(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    score = lambda t: one(t, lambda c: skills.scored(c, {"AI设计": 3, "深度学习": 2, "R": 1}, skills.EXCLUDED, {"深度学习": "深度学习(?!能力)"}))
    assert [score(t) for t in ("AI设计软件", "AI设计", "深度学习能力", "深度学习", "React R", "React", None)] == [0, 3, 0, 2, 1, 0, 0]
    title = lambda t: one(t, lambda c: skills.in_title(c, ["AI", "机器人"]))
    assert [title(t) for t in ("工程师(机器人科技有限公司)", "客服（ai中文语料）", "air", "机器人", None)] == [False, True, False, True, False]
    assert one("c++ [x] a.b", lambda c: skills.listed(c, ["c++", "[x]", "a.b", "axb", ""])) == ["c++", "[x]", "a.b"]
    assert one("ＡＩ①", lambda c: fold.nfkc(c)) == "AI1"
    assert [one(t, lambda c: industry.classified(c)) for t in ("C221", " c22 ", "C", "C99", "9", None)] == ["C22造纸和纸制品业", "C22造纸和纸制品业", "C制造业", "C制造业", "未知", "未知"]
    assert [len(tx.VERSIONS[k]) for k in ("main", "cn_paper", "babina")] == [21, 11, 11]


def test_broken_counts(spark):
    schema = "skill_code int, year int, span string, anchor string, n_skill bigint, n_anchor bigint"
    good = [(1, 2000, "annual", "main", 3, 1), (1, 2001, "annual", "main", 2, 2), (1, -1, "pooled", "main", 5, 3)]
    broken = lambda rows: {r.rule: r.n for r in counts.broken(spark.createDataFrame(rows, schema)).collect()}
    assert broken(good) == {"unique": 0, "bounds": 0, "pooled": 0}
    assert broken([*good, (2, 2000, "annual", "main", 1, 2), (3, 2000, "annual", "main", 0, 0)]) == {"unique": 0, "bounds": 2, "pooled": 1}
    assert broken([*good[:2], good[0], (1, -1, "pooled", "main", 5, 3)]) == {"unique": 1, "bounds": 0, "pooled": 1}


def test_dedup_invariants_break(spark):
    stage = spark.createDataFrame([("a", 1), ("a", 50), ("b", 2)], "rid string, day int")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "rid string, day int")
    groups = spark.createDataFrame([("a", 2, 1, 50, 7), ("b", 2, 2, 2, 7)], "rid string, records bigint, earliest_day int, latest_day int, canonical bigint")
    assert {r.rule: r.broken for r in skills.dedup_invariants(stage, first, groups).collect()} == {"buckets_hold_all_rows": 1, "rule_one_within_share": 1, "spans_within_days": 1, "canonical_rows_unique": 1}


def test_json_lines(spark, tmp_path):
    store = files.Store(spark)
    read = lambda name, text, torn: (store.write(f"{tmp_path}/{name}", text), [r.a for r in files.json_lines(spark, f"{tmp_path}/{name}", "a int", torn).collect()])[1]
    assert read("a", '{"a": 1}\n\n{"a": 2}\n{"a', True) == [1, 2] and read("b", '{"a": 1}\n', False) == [1] and read("c", '{"a": 1, "t": "x\u2028y"}', True) == [1]
    for name, text, torn in (("d", '{"a": 1}\n{"a', False), ("e", '{"a\n{"a": 1}\n', True), ("f", '[1]\n{"a": 1}', True), ("g", '{"a\n{"a', True)):
        with pytest.raises(ValueError):
            read(name, text, torn)


def test_publishing(spark, tmp_path):
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    path = f"{tmp_path}/t"
    assert [files.published(df, path, stamp).count() for df, stamp in ((one, "1"), (two, "1"), (two, "2"))] == [3, 3, 5]
    with pytest.raises(ValueError):
        files.results(one, "s", "s/", "x", 0, F.lit(True), 3)
    with pytest.raises(ValueError, match="anchor"):
        files.results(one, f"{tmp_path}/r", "s", "x", 1, F.lit(True), 3)
    for record in ({"status": "draft", "digests": {"a": "1"}}, {"status": "complete", "digests": {"a": "2"}}, {"status": "complete"}):
        with pytest.raises(ValueError):
            files.gate(record, {"a": "1"})
    out = files.release({"t": one}, f"{tmp_path}/rel", {})
    assert out["t"].count() == 3 and files.Store(spark).exists(f"{tmp_path}/rel/{files.COMPLETE}")
    with pytest.raises(Exception):
        files.release({"t": two.select((F.col("x") / F.raise_error(F.lit("no"))).alias("x"))}, f"{tmp_path}/rel", {})
    assert spark.read.parquet(f"{tmp_path}/rel/t").count() == 3
    digest = lambda df: files.manifest({"t": df}).first().digest
    assert digest(two) == digest(two.repartition(4)) != digest(two.withColumn("x", F.col("x") + 1))


def test_csv_dictionary_checks(spark, tmp_path):
    files.Store(spark).write(f"{tmp_path}/d.csv", "a,n\nx,1\n")
    digest = "0" * 64
    with pytest.raises(ValueError, match="agreed"):
        files.csv_dictionary(spark, f"{tmp_path}/d.csv", "a string, n int", digest, 1, "n = 1")
    digest = spark.read.format("binaryFile").load(f"{tmp_path}/d.csv").select(F.sha2("content", 256)).first()[0]
    assert files.csv_dictionary(spark, f"{tmp_path}/d.csv", "a string, n int", digest, 1, "n = 1").count() == 1
    for rows, active in ((2, "n = 1"), (1, "n = 2")):
        with pytest.raises(ValueError, match="agreed"):
            files.csv_dictionary(spark, f"{tmp_path}/d.csv", "a string, n int", digest, rows, active)
