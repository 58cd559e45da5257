"""Judged replies: cases that the queries' SQL has not, and errors."""

import pytest
from pyspark.sql import functions as F

from laborlens.functions import text as tx
from laborlens.operators import judging


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_validated(spark):
    skill = '{"surface": "b", "canonical_suggestion": "c", "skill_type": "t", "evidence": "ab", "start": "x", "end": 2, "existing_skill_id": %s}'
    check = lambda said: one(spark, "ab b", lambda c: judging.validated(F.lit(said), c, ["t"]))
    x = check('{"skills": [%s]}' % (skill % '"s"'))
    assert (x.state, [tuple(k) for k in x.kept], x.direct, x.evidence) == ("success", [("b", 1, 2, "deterministic_fallback", 1)], 0, 1)
    assert [check(t).state for t in ('{"skills": []}', '{"skills": 3}', "[1]", "no", '{"skills": [1]}', '{"skills": [%s]}' % (skill % "5"))] == ["empty"] + ["schema_failed"] * 5
    assert check('{"skills": [%s, {}]}' % (skill % "null")).kept == []


def test_parsed(spark):
    standard = lambda t: tuple(one(spark, t, judging.standardised))
    assert [standard(t) for t in (None, "", "[]", '{"occupation_name": null}', 'x {"a": 1} {"occupation_name": "y"}')] == [("", "")] * 5
    labels = lambda t: [tuple(x) for x in one(spark, t, judging.labels_of)]
    assert labels('[{"id": 1, "label": "1"}, {"id": 2}, {"id": 1, "label": 3, "reason": "n"}]') == [(2, None, ""), (1, None, "n")] and labels("x") == labels(None) == []
    assert [one(spark, t, judging.qc_passed) for t in ('{"ok": true}', '{"ok": true, "valid": false}', '[{"status": "OK"}]', "{}", None, "x")] == [True, False, True, False, False, False]
    field = judging.found_field("b", "a")
    assert [one(spark, t, field) for t in ('{"a": 1, "b": 2}', '{"x": [{"a": ""}, {"a": "q "}]}', '{"z": {"a": 1}, "y": {"b": 2}}', "[]", None)] == ["2", "q", "2", "", ""]


def test_anchor_hits(spark):
    assert tuple(one(spark, "AI and ai; large-language models", tx.anchor_hits)) == (1, ["AI", "LLM"], ["ai", "large-language models"])
    assert tuple(one(spark, "", tx.anchor_hits)) == (0, [], [])


def test_backfilled_errors(spark):
    schema = "batch int, line int, id string, name string"
    asked = spark.createDataFrame([(1, k, f"s{k}", f"n{k}") for k in range(100)], schema)
    fill = lambda rows: [tuple(r) for r in judging.backfilled(asked, spark.createDataFrame(rows, schema)).collect()]
    assert fill([(1, k, "", f"N{k}" if k > 1 else "other") for k in range(100)]) == [(1, 100, 100, 0.98)]
    assert fill([(1, k, f"s{k}", "other") for k in range(100)]) == [(1, 100, 0, 1.0)]
    for rows, fault in (
        ([(1, k, "", f"n{k}" if k > 2 else "other") for k in range(100)], "order"), ([(1, k, None, "") for k in range(100)], "order"),
        ([(1, k, "s1", f"n{k}") for k in range(100)], "ids"), ([(1, k, "", f"n{k}") for k in range(99)], "lines"), ([(1, k, "", f"n{k}") for k in range(101)], "lines"),
    ):
        with pytest.raises(Exception, match=f"batch 1: {fault}"):
            fill(rows)


def test_choice_and_sets(spark):
    schema = "signature string, passed boolean, selected boolean, reason string"
    broken = lambda rows: {r.rule: r.broken for r in judging.model_choice(spark.createDataFrame(rows, schema)).collect()}
    assert set(broken([("a", True, True, None), ("b", False, False, "slow")]).values()) == {0}
    assert broken([("a", False, True, None)]) == {"two_signatures": 1, "one_selected": 0, "selected_passed": 1, "exclusions_have_reasons": 0}
    assert broken([("a", True, False, None), ("b", True, False, " ")])["one_selected"] == 1
    sets = judging.precision_by_set(spark.createDataFrame([(1, True, False)], "id int, in_old boolean, in_new boolean"), spark.createDataFrame([], "id int, label int"))
    assert {r.judged: (r.n, r.n_none, r.precision) for r in sets.collect()} == {"old": (1, 1, None), "new": (0, 0, None), "common": (0, 0, None), "increment": (0, 0, None), "dropped": (1, 1, None)}
