"""More named queries: judged model replies, agreement, the choice of a model, filled batches, folded texts. Registered beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.functions import fold
from laborlens.functions import text as tx
from laborlens.operators import judging
from laborlens.plans.registry import query
from laborlens.sources import views as v


def _by(k, n, *values):
    """values[k % n] as an expression."""
    return F.element_at(F.array(*values), (k % n + 1).cast("int"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '' WHEN 4 THEN '7' ELSE 'N' || doc_id END AS occupation_name, CASE WHEN doc_id % 5 IN (0, 2) THEN 'C' ELSE '' END AS occupation_category FROM documents""")
def G4_standardised_replies(s, d):
    n = F.col("doc_id").cast("string")
    said = _by(
        F.col("doc_id"), 5,
        F.concat(F.lit('```json\n{"occupation_name": " N'), n, F.lit(' ", "occupation_category": "C"}\n```')), F.concat(F.lit('Result: {"occupation_name": "N'), n, F.lit('"} done')),
        F.concat(F.lit('[{"occupation_name": "N'), n, F.lit('", "occupation_category": "C"}]')), F.lit("nothing {"), F.lit('{"occupation_name": 7}'),
    )
    return v.table(s, d, "documents").select("doc_id", judging.standardised(said).alias("x")).select("doc_id", "x.*")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'empty' ELSE 'schema_failed' END AS state, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS kept, (doc_id % 4 < 2)::BIGINT AS dropped,
 (doc_id % 4 = 0)::BIGINT AS direct, (doc_id % 4 < 2)::BIGINT AS hallucinated, CASE WHEN doc_id % 4 = 0 THEN position(substr(text, 11, 6) IN text) - 1 END AS second_start FROM documents WHERE length(text) >= 40""")
def G5_G6_validated_skills(s, d):
    """Of three skills the first has its span, the second a wrong one, and the chunk lacks the third; then the third alone, a field less, an unknown type."""
    text = F.col("text")

    def skill(surface, start, end, kind="tool", lacks=""):
        values = {"surface": surface, "canonical_suggestion": F.lit("c"), "skill_type": F.lit(kind), "evidence": F.substring(text, 1, 20), "start": F.lit(start), "end": F.lit(end), "existing_skill_id": F.lit(None).cast("string")}
        return F.to_json(F.struct(*[c.alias(k) for k, c in values.items() if k != lacks]), {"ignoreNullFields": "false"})

    first, second, third = skill(F.substring(text, 3, 6), 2, 8), skill(F.substring(text, 11, 6), 0, 3), skill(F.lit("qqxzq"), 0, 5)
    lists = F.concat_ws(",", first, second, third), third, F.concat_ws(",", first, skill(F.substring(text, 3, 6), 2, 8, lacks="evidence")), skill(F.substring(text, 3, 6), 2, 8, kind="other")
    said = F.concat(F.lit('{"job_id": "j", "skills": ['), _by(F.col("doc_id"), 4, *lists), F.lit("]}"))
    docs = v.table(s, d, "documents").where(F.length("text") >= 40)
    found = docs.select("doc_id", judging.validated(said, text, ["tool", "method"]).alias("x"))
    size = lambda c: F.size(c).cast("bigint")
    return found.select("doc_id", "x.state", size("x.kept").alias("kept"), size("x.dropped").alias("dropped"), "x.direct", "x.hallucinated", F.get("x.kept", 1)["start"].cast("bigint").alias("second_start"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS passed, 'K' || doc_id AS source_id FROM documents""")
def G7_nested_checks(s, d):
    k = F.col("doc_id")
    checks = _by(k, 3, F.lit('{"a": [{"status": " Passed "}], "b": {"ok": true}}'), F.lit('{"ok": true, "x": [{"y": {"status": "error"}}]}'), F.lit('{"x": 1, "ok": "yes"}'))
    record = F.concat(F.lit('{"z": {"skill_id": "S"}, "b": [{"source_id": ""}, {"source_id": " K'), k.cast("string"), F.lit(' "}]}'))
    return v.table(s, d, "documents").select("doc_id", judging.qc_passed(checks).alias("passed"), judging.found_field("source_skill_id", "skill_id", "source_id")(record).alias("source_id"))


@query("SELECT doc_id, doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label, 'r' AS reason FROM documents")
def R18_parsed_labels(s, d):
    k = F.col("doc_id")
    said = F.concat(F.lit('[{"id": '), k.cast("string"), F.lit(', "label": 1}, 5, {"label": 1}, {"id": "x", "label": 1}, {"id": "'), k.cast("string"), F.lit('", "reason": "r", "label": '), _by(k, 3, F.lit("1"), F.lit('"0"'), F.lit("2")), F.lit("}]"))
    return v.table(s, d, "documents").select("doc_id", F.explode(judging.labels_of(said)).alias("x")).select("doc_id", "x.*")


@query("""WITH i AS (SELECT doc_id % 3 < 2 AS o, doc_id % 2 = 0 AS n, CASE WHEN doc_id % 7 > 0 THEN a END AS l FROM v_gold), s AS (SELECT unnest(['old', 'new', 'common', 'increment', 'dropped']) AS judged)
SELECT judged, count(*) AS n, count(l) AS n_labeled, count(*) - count(l) AS n_none, round(avg(l), 4) AS precision FROM i JOIN s ON CASE judged WHEN 'old' THEN o WHEN 'new' THEN n WHEN 'common' THEN o AND n WHEN 'increment' THEN n AND NOT o ELSE o AND NOT n END GROUP BY judged""")
def A32_precision_by_set(s, d):
    gold, k = v.gold(s, d), F.col("doc_id")
    items = gold.select(k.alias("id"), (k % 3 < 2).alias("in_old"), (k % 2 == 0).alias("in_new"))
    return judging.precision_by_set(items, gold.where("doc_id % 7 > 0").select(k.alias("id"), F.col("a").alias("label")))


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (a = 1 AND n_chars >= 1475) AS both_ai, count(*) FILTER (a = 1 AND n_chars < 1475) AS keyword_only, count(*) FILTER (a = 0 AND n_chars >= 1475) AS skill_only,
 count(*) FILTER (a = 0 AND n_chars < 1475) AS both_not, round(corr(a, n_chars), 4) AS corr FROM v_gold), r AS (SELECT *, (both_ai + keyword_only) / n AS p, (both_ai + skill_only) / n AS q, (both_ai + both_not) / n AS o, p * q + (1 - p) * (1 - q) AS e FROM t)
SELECT n, both_ai, keyword_only, skill_only, both_not, corr, round(o, 4) AS agreement, round((o - e) / (1 - e), 4) AS kappa, round(p, 4) AS keyword_rate, round(q, 4) AS skill_rate FROM r""")
def A30_agreement_rates(s, d):
    return judging.agreement_rates(v.gold(s, d), "a", "n_chars", 1475)


@query("""WITH c AS (SELECT doc_id // 2 AS sample, (doc_id % 50 > 0)::INT AS valid, 3 AS spans, 3 - (doc_id % 40 = 0)::INT AS effective, (doc_id % 40 = 0)::INT AS hallucinated, (doc_id % 60 = 7)::INT AS failed,
  CASE WHEN doc_id % 30 = 0 THEN 'x' ELSE 'y' END AS answer FROM documents), p AS (SELECT sample, count(*) = 2 AND min(answer) = max(answer) AS exact FROM c GROUP BY 1)
SELECT *, valid >= 0.97 AND effective >= 0.98 AND repeat_exact >= 0.9 AND hallucinated <= 0.02 AND failed <= 0.02 AS passed FROM (SELECT sum(valid) / count(*) AS valid, sum(effective) / sum(spans) AS effective,
 sum(hallucinated) / sum(spans) AS hallucinated, sum(failed) / count(*) AS failed, (SELECT count(*) FILTER (exact) / count(*) FROM p) AS repeat_exact FROM c)""")
def A41_model_metrics(s, d):
    k = F.col("doc_id")
    lost = (k % 40 == 0).cast("int")
    calls = v.table(s, d, "documents").select(
        F.floor(k / 2).alias("sample"), (k % 50 > 0).cast("int").alias("valid"), F.lit(3).alias("spans"), (3 - lost).alias("effective"), lost.alias("hallucinated"),
        (k % 60 == 7).cast("int").alias("failed"), F.when(k % 30 == 0, "x").otherwise("y").alias("answer"),
    )
    return judging.model_metrics(calls, 2, {"valid": 0.97, "effective": 0.98, "repeat_exact": 0.9, "hallucinated": 0.02, "failed": 0.02})


@query("""SELECT 'two_signatures' AS rule, 0::BIGINT AS broken UNION ALL SELECT 'one_selected', (count(*) FILTER (n_nationkey % 10 = 3) <> 1)::BIGINT FROM nation
UNION ALL SELECT 'selected_passed', count(*) FILTER (n_nationkey % 10 = 3 AND n_nationkey >= 10) FROM nation UNION ALL SELECT 'exclusions_have_reasons', count(*) FILTER (n_nationkey % 10 <> 3 AND n_nationkey % 4 = 0) FROM nation""")
def C15_model_choice(s, d):
    k = F.col("n_nationkey")
    models = v.table(s, d, "nation").select(F.col("n_name").alias("signature"), (k < 10).alias("passed"), (k % 10 == 3).alias("selected"), F.when(k % 4 > 0, "slow").otherwise(" ").alias("reason"))
    return judging.model_choice(models)


@query("SELECT p_partkey % 20 AS batch, count(*) AS rows, count(*) FILTER (p_partkey % 20 >= 10 AND p_size > 20) AS filled, 1.0::DOUBLE AS ratio FROM part GROUP BY 1")
def C10_filled_batches(s, d):
    k = F.col("p_partkey")
    own = F.concat(F.lit("S"), k.cast("string"))
    parts = v.table(s, d, "part").select((k % 20).alias("batch"), k.alias("line"), own.alias("id"), F.when((k % 20 >= 10) & (F.col("p_size") > 20), "").otherwise(own).alias("said"), F.col("p_name").alias("name"))
    return judging.backfilled(parts.select("batch", "line", "id", "name"), parts.select("batch", "line", F.col("said").alias("id"), F.concat(F.upper("name"), F.lit(" ")).alias("name")))


_SAID_SQL = "(VALUES (0, 1, 'AI|ML|LLM', '人工智能|machine--learning|llms|llm'), (1, 1, 'TRANS', 'transformer 架构'), (2, 0, '', ''), (3, 1, 'AI', 'ai'))"


@query(f"SELECT recruit_id, flag, groups, surfaces FROM v_posts JOIN {_SAID_SQL} AS t(k, flag, groups, surfaces) ON k = recruit_id % 4")
def X7_anchor_hits(s, d):
    """All anchor terms, over texts in full width and other cases."""
    said = _by(F.col("recruit_id"), 4, F.lit("人工智能, Machine--Learning; ＬＬＭｓ LLM llm"), F.lit("Transformer 架构"), F.lit("email mlx 自然语言"), F.lit("ＡＩ工程师 ai"))
    folded = v.posts(s, d).select("recruit_id", fold.nfkc(said).alias("text"))
    return folded.select("recruit_id", tx.anchor_hits(F.col("text")).alias("x")).select("recruit_id", "x.flag", F.array_join("x.groups", "|").alias("groups"), F.array_join("x.surfaces", "|").alias("surfaces"))


@query("SELECT p_partkey, 'ai 1 ' || lower(p_name) AS state, 'ai工程师' || replace(lower(p_name), ' ', '') AS position, CASE WHEN p_partkey % 3 = 0 THEN 'CITY_MISSING' ELSE 'A' || p_name END AS city FROM part")
def X2_X4_P5_folded_texts(s, d):
    """Match states, position keys and labels of texts in full width."""
    name = F.col("p_name")
    state = tx.match_text(fold.nfkc(F.concat(F.lit("ＡＩ　①　"), name)))
    place = tx.position_key(fold.nfkc(F.concat(F.lit("（ＡＩ）工程师１２３＃"), name)))
    city = F.trim(fold.nfkc(F.when(F.col("p_partkey") % 3 == 0, "　").otherwise(F.concat(F.lit("Ａ"), name))))
    return v.table(s, d, "part").select("p_partkey", state.alias("state"), place.alias("position"), F.coalesce(F.nullif(city, F.lit("")), F.lit("CITY_MISSING")).alias("city"))
