"""Judging model replies: parsed labels, validated extractions, checks at any depth, precision by set, a model's metrics and the choice of one,
batches whose ids are filled back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from laborlens.operators import replies, skills

# The fields of an extracted skill, flags and status words of a check, the share of names that must agree in order.
FIELDS = "surface canonical_suggestion skill_type evidence start end existing_skill_id".split()
FLAGS = "passed valid ok".split()
PASSED = "pass passed success valid completed complete ok".split()
FAILED = "fail failed invalid error blocked".split()
IN_ORDER = 0.98


def _at(e: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(e, f"$.{key}", kind)


def standardised(reply: Column) -> Column:
    """(occupation_name, occupation_category) of a reply: all of it as JSON without fences, else its first flat object; of an array the first
    element. What is missing is an empty text."""
    bare = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), "```json|```", ""))
    whole = F.try_parse_json(bare)
    v = F.coalesce(whole, F.try_parse_json(F.regexp_extract(bare, "\\{[^{}]*\\}", 0)))
    one = lambda k: F.coalesce(F.trim(F.coalesce(_at(v, k), F.try_variant_get(v, f"$[0].{k}", "string"))), F.lit("")).alias(k)
    return F.struct(one("occupation_name"), one("occupation_category"))


def labels_of(reply: Column) -> Column:
    """An array of objects -> array of (id, label, reason): label is 0, 1 or null. What has no whole number as id is left out; the last object of an id holds."""
    rows = F.coalesce(F.try_variant_get(F.try_parse_json(reply), "$", "array<variant>"), F.array().cast("array<variant>"))
    label = lambda e: F.when(_at(e, "label").isin("0", "1"), _at(e, "label").cast("int"))
    found = F.transform(rows, lambda e: F.struct(_at(e, "id", "bigint").alias("id"), label(e).alias("label"), F.coalesce(_at(e, "reason"), F.lit("")).alias("reason")))
    known = F.filter(found, lambda x: x["id"].isNotNull())
    return F.filter(known, lambda x, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda later: later["id"] == x["id"]))


def validated(reply: Column, chunk: Column, types: list[str]) -> Column:
    """(state, kept, dropped, direct, hallucinated, evidence) of the skills that a reply takes from chunk.

    A skill that lacks a field, has an empty one or an unknown type makes the reply schema_failed, which keeps nothing. Spans that don't fit are looked for
    (`replies.located`); skills that can't be found are dropped alone. direct, hallucinated and evidence count skills whose span fits, whose surface
    the chunk lacks, and whose evidence it has."""
    listed = F.try_variant_get(F.try_parse_json(reply), "$.skills", "array<variant>")

    def read(e: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(F.to_json(e)), F.array().cast("array<string>"))
        texts = {k: F.coalesce(_at(e, k), F.lit("")) for k in FIELDS[:4]}
        whole = (F.size(F.array_except(F.array(*map(F.lit, FIELDS)), keys)) == 0) & reduce(lambda a, b: a & b, [t != "" for t in texts.values()])
        kind = F.coalesce(F.schema_of_variant(_at(e, "existing_skill_id", "variant")), F.lit("VOID")).isin("VOID", "STRING")
        place = {k: F.coalesce(_at(e, k, "int"), F.lit(-1)).alias(k) for k in ("start", "end")}
        return F.struct(texts["surface"].alias("surface"), texts["evidence"].alias("evidence"), *place.values(), (whole & kind & texts["skill_type"].isin(types)).alias("good"))

    def placed(x: Column) -> Column:
        fits = (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(chunk)) & (chunk.substr(x["start"] + 1, x["end"] - x["start"]) == x["surface"])
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(0).alias("multiple"))
        return F.struct(x["surface"].alias("surface"), x["evidence"].alias("evidence"), x["good"].alias("good"), fits.alias("direct"), F.when(fits, own).otherwise(replies.located(chunk, x["surface"], x["evidence"])).alias("at"))

    found = F.transform(F.transform(listed, read), placed)
    failed = F.coalesce(F.exists(found, lambda x: ~x["good"]), F.lit(True))
    rows = F.when(failed, F.slice(found, 1, 0)).otherwise(found)
    source = lambda x: F.when(x["direct"], "model").otherwise("deterministic_fallback")
    kept = F.transform(F.filter(rows, lambda x: x["at"].isNotNull()), lambda x: F.struct(x["surface"].alias("surface"), x["at"]["start"].alias("start"), x["at"]["end"].alias("end"), source(x).alias("span_source"), x["at"]["multiple"].alias("multiple")))
    count = lambda rule: F.coalesce(F.size(F.filter(rows, rule)), F.lit(0)).cast("bigint")
    return F.struct(
        F.when(failed, "schema_failed").when(F.size(kept) == 0, "empty").otherwise("success").alias("state"), kept.alias("kept"),
        F.transform(F.filter(rows, lambda x: x["at"].isNull()), lambda x: x["surface"]).alias("dropped"), count(lambda x: x["direct"]).alias("direct"),
        count(lambda x: ~chunk.contains(x["surface"])).alias("hallucinated"), count(lambda x: chunk.contains(x["evidence"])).alias("evidence"),
    )


def _nodes(value: object) -> Iterator[dict]:
    """All objects in a JSON value, at any depth."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(BooleanType())
def qc_passed(texts: pd.Series) -> pd.Series:
    """Whether a JSON value says somewhere that it passed, and nowhere that it failed. What is no JSON has not passed."""

    def one(text: str | None) -> bool:
        votes = set()
        for x in _nodes(_loaded(text)):
            votes |= {x[k] for k in FLAGS if isinstance(x.get(k), bool)}
            word = str(x.get("status", "")).strip().lower()
            votes |= {True} if word in PASSED else {False} if word in FAILED else set()
        return votes == {True}

    return texts.map(one)


def found_field(*names: str) -> Callable[[Column], Column]:
    """The first non-empty field of one of the names in a JSON value: an object's own fields in the order of names, then its members by key, arrays in order."""

    def look(x: object) -> object:
        below: list = x if isinstance(x, list) else []
        if isinstance(x, dict):
            for n in names:
                if x.get(n) not in (None, ""):
                    return x[n]
            below = [x[k] for k in sorted(x)]
        return next((y for y in map(look, below) if y is not None), None)

    @F.pandas_udf(StringType())
    def field(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "" if (x := look(_loaded(t))) is None else str(x).strip())

    return field


def precision_by_set(items: DataFrame, labels: DataFrame) -> DataFrame:
    """items (id, in_old, in_new), labels (id, label) -> (judged, n, n_labeled, n_none, precision), a row for each set, empty ones too."""
    old, new = F.col("in_old"), F.col("in_new")
    sets = {"old": old, "new": new, "common": old & new, "increment": new & ~old, "dropped": old & ~new}
    in_set = lambda c, x: F.when(c, x)
    rows = [
        F.struct(F.lit(name).alias("judged"), F.count_if(c).alias("n"), F.count(in_set(c, F.col("label"))).alias("n_labeled"), F.count_if(c & F.col("label").isNull()).alias("n_none"), F.round(F.avg(in_set(c, F.col("label"))), 4).alias("precision"))
        for name, c in sets.items()
    ]
    return items.join(labels, "id", "left").agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def agreement_rates(rows: DataFrame, flag: str, value: str, threshold: float) -> DataFrame:
    """One row: the four cells of flag against value >= threshold, agreement, kappa, the correlation of flag and value, and both rates."""
    a, b = F.col(flag) == 1, F.coalesce(F.col(value) >= threshold, F.lit(False))
    t = rows.agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both_ai"), F.count_if(a & ~b).alias("keyword_only"), F.count_if(~a & b).alias("skill_only"), F.count_if(~a & ~b).alias("both_not"),
        F.round(F.corr(flag, value), 4).alias("corr"),
    )
    n = F.col("n")
    p, q, same = (F.col("both_ai") + F.col("keyword_only")) / n, (F.col("both_ai") + F.col("skill_only")) / n, (F.col("both_ai") + F.col("both_not")) / n
    by_chance = p * q + (1 - p) * (1 - q)
    return t.withColumns({"agreement": F.round(same, 4), "kappa": F.round(F.try_divide(same - by_chance, 1 - by_chance), 4), "keyword_rate": F.round(p, 4), "skill_rate": F.round(q, 4)})


def model_metrics(calls: DataFrame, repeats: int, limits: dict[str, float]) -> DataFrame:
    """calls (sample, valid, spans, effective, hallucinated, failed, answer), a row for each call -> one row of rates and whether they are within limits
    (least valid, effective and repeat_exact, most hallucinated and failed). A sample is repeated exactly if all its calls have one answer."""
    n = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    own = calls.groupBy("sample").agg(F.count("*").alias("calls"), *[n(c) for c in ("valid", "spans", "effective", "hallucinated", "failed")], F.min("answer").alias("lo"), F.max("answer").alias("hi"), F.count("answer").alias("answers"))
    exact = (F.col("answers") == repeats) & (F.col("lo") == F.col("hi"))
    t = own.agg(n("calls"), n("valid"), n("spans"), n("effective"), n("hallucinated"), n("failed"), F.count_if(exact).alias("exact"), F.count("*").alias("samples"))
    spans = F.greatest("spans", F.lit(1))
    rates = {"valid": F.col("valid") / F.col("calls"), "effective": F.col("effective") / spans, "hallucinated": F.col("hallucinated") / spans, "failed": F.col("failed") / F.col("calls"), "repeat_exact": F.col("exact") / F.col("samples")}
    out = t.select(*[c.alias(k) for k, c in rates.items()])
    least = [F.col(k) >= limits[k] for k in ("valid", "effective", "repeat_exact")]
    most = [F.col(k) <= limits[k] for k in ("hallucinated", "failed")]
    return out.withColumn("passed", reduce(lambda x, y: x & y, least + most))


def model_choice(models: DataFrame) -> DataFrame:
    """models (signature, passed, selected, reason) -> (rule, broken): two signatures at least, one is selected, it passed, and all others have a reason."""
    chosen = models.where("selected")
    return skills.checked([
        ("two_signatures", models, (F.countDistinct("signature") < 2).cast("int")),
        ("one_selected", chosen, (F.countDistinct("signature") != 1).cast("int")),
        ("selected_passed", chosen, F.count_if(~F.col("passed"))),
        ("exclusions_have_reasons", models.where("not selected"), F.count_if(F.trim(F.coalesce("reason", F.lit(""))) == "")),
    ])


def backfilled(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """inputs (batch, line, id, name), results (batch, line, id, name; ids may be empty) -> (batch, rows, filled, ratio): how many ids of a batch are filled from
    the input by order. Other lines than the input's, an id that isn't the input's, or names that agree in under `IN_ORDER` of a batch with ids to fill are errors."""
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    theirs = results.select("batch", "line", F.nullif(F.trim("id"), F.lit("")).alias("rid"), name("name").alias("rname"), F.lit(1).alias("there"))
    both = inputs.select("batch", "line", F.col("id"), name("name").alias("iname"), F.lit(1).alias("asked")).join(theirs, ["batch", "line"], "full")
    t = both.groupBy("batch").agg(
        F.count("*").alias("rows"), F.count_if(F.col("asked").isNull() | F.col("there").isNull()).alias("lost"), F.count_if(F.col("rid") != F.col("id")).alias("wrong"),
        F.count_if(F.col("rid").isNull()).alias("filled"), F.count(F.col("iname") == F.col("rname")).alias("comparable"), F.count_if(F.col("iname") == F.col("rname")).alias("matched"),
    )
    ratio = F.when(F.col("filled") == 0, 1.0).otherwise(F.coalesce(F.try_divide("matched", "comparable"), F.lit(0.0)))
    fault = F.when(F.col("lost") > 0, "lines").when(F.col("wrong") > 0, "ids").when(ratio < IN_ORDER, "order")
    said = F.raise_error(F.concat(F.lit("batch "), F.col("batch").cast("string"), F.lit(": "), fault)).cast("double")
    return t.select("batch", "rows", "filled", F.when(fault.isNotNull(), said).otherwise(ratio).alias("ratio"))
