"""More named queries: governance, review samples, comparisons and gates. Registered beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.functions import text as tx
from laborlens.operators import review
from laborlens.plans.registry import _ANNUAL, _FUSED, _HASH, _SCORES, _counts, _fused, _scores, query
from laborlens.sources import views as v

_SCORED = _SCORES.replace("j.year, count(skill_code)", "j.year AS year, count(skill_code)")


def _n(c):
    return F.sum(c.cast("bigint"))


@query("""SELECT term, count(DISTINCT regexp_replace(description, '\\s+', '', 'g')) AS df, min(substr(publish_time, 1, 4)::INT) AS first_year FROM v_posts, (VALUES ('data'), ('license'), ('the')) AS t(term)
 WHERE regexp_matches(lower(description), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY term""")
def A22_document_frequency(s, d):
    terms = [("data", "data", "phrase"), ("license", "license", "phrase"), ("the", "the", "phrase")]
    rows = v.posts(s, d).select(F.explode(tx.anchor_groups(F.col("description"), terms)).alias("term"), tx.hash63(tx.squeezed(F.col("description"))).alias("h"), tx.year_of(F.col("publish_time")).alias("y"))
    return rows.groupBy("term").agg(F.countDistinct("h").alias("df"), F.min("y").alias("first_year"))


@query("SELECT lower(p_brand) AS alias, count(DISTINCT p_type) AS skills, count(DISTINCT p_type) > 1 OR bool_or(length(p_brand) <= 2) AS ambiguous FROM part GROUP BY 1")
def A23_ambiguity(s, d):
    return review.ambiguity(v.table(s, d, "part").select(F.col("p_brand").alias("alias"), F.col("p_type").alias("skill")))


@query(_ANNUAL + """SELECT skill_code, n_skill, CASE WHEN skill_code % 10 = 0 THEN 'removed_tautology' WHEN n_skill < 100 THEN 'removed_lowfreq' ELSE 'kept' END AS disposition
 FROM c WHERE span = 'pooled' AND anchor = 'main'""")
def A27_dispositions(s, d):
    pooled = _counts(s, d).where("span = 'pooled' and anchor = 'main'").select("skill_code", "n_skill")
    return pooled.select("skill_code", "n_skill", review.disposition(F.col("skill_code") % 10 == 0, F.col("n_skill")).alias("disposition"))


@query("SELECT company_id, sum(main)::BIGINT AS ai_posts FROM v_jobs GROUP BY 1 HAVING sum(CASE WHEN year < 1998 THEN main ELSE 0 END) = 0 AND sum(main) >= 2")
def A28_new_occupations(s, d):
    return review.newcomers(v.jobs(s, d), "company_id", 1998, 2)


@query("""SELECT year, (month + 2) // 3 AS quarter, industry, count(DISTINCT company_id) AS occupations, count(DISTINCT CASE WHEN main = 1 THEN company_id END) AS ai_occupations FROM v_jobs GROUP BY ALL""")
def A29_penetration_by_category(s, d):
    quarter = F.floor((F.col("month") + 2) / 3).cast("bigint").alias("quarter")
    ai = F.countDistinct(F.when(F.col("main") == 1, F.col("company_id"))).alias("ai_occupations")
    return v.jobs(s, d).groupBy("year", quarter, "industry").agg(F.countDistinct("company_id").alias("occupations"), ai)


@query("""WITH m AS (SELECT avg(main) AS m FROM v_jobs) SELECT skill_code, count(*) AS n, round(avg(main) / min(m), 8) AS lift FROM v_pairs JOIN v_jobs USING (job_id), m GROUP BY 1 HAVING count(*) >= 50 ORDER BY lift DESC, skill_code""")
def A31_lift(s, d):
    return review.lift(v.jobs(s, d), v.pairs(s, d), 50)


@query("""WITH k AS (SELECT DISTINCT sha256(regexp_replace(lower(text), '\\s+', '', 'g')) AS h FROM documents)
SELECT item_id, CASE WHEN h IN (SELECT h FROM k) THEN 'MAPPED' ELSE 'NEW_CONCEPT' END AS bucket FROM (SELECT item_id, sha256(regexp_replace(lower(text), '\\s+', '', 'g')) AS h FROM benchmark)""")
def A33_gap_terms(s, d):
    key = F.sha2(tx.squeezed(F.lower("text")), 256).alias("h")
    known = v.table(s, d, "documents").select(key).distinct().withColumn("known", F.lit(True))
    both = v.table(s, d, "benchmark").select("item_id", key).join(known, "h", "left")
    return both.select("item_id", F.when(F.col("known"), "MAPPED").otherwise("NEW_CONCEPT").alias("bucket"))


@query(_SCORED + """SELECT year, count(*) AS n, round(sum(zero_skill::INT) / count(*), 8) AS zero, round(sum((coalesce(round(score, 8), 0) > 0.2)::INT) / count(*), 8) AS hi_all,
 round(sum((round(score, 8) > 0.2)::INT) / nullif(count(score), 0), 8) AS hi_matched FROM sc WHERE year >= 1996 GROUP BY year""")
def A34_subsample_curve(s, d):
    return review.curve(_scores(s, d).withColumn("score", F.round("score", 8)).where("year >= 1996"), 0.2)


@query(_SCORED + """, z AS (SELECT year, sum(zero_skill::INT)::BIGINT AS zero_skill, count(*) AS jobs FROM sc GROUP BY year),
t AS (SELECT year, sum((tier = 'C')::INT)::BIGINT AS tier_c, count(*) AS pairs FROM v_pairs JOIN v_jobs USING (job_id) GROUP BY year)
SELECT year, zero_skill, jobs, tier_c, pairs FROM z JOIN t USING (year)""")
def A36_quality_statistics(s, d):
    z = _scores(s, d).groupBy("year").agg(_n(F.col("zero_skill")).alias("zero_skill"), F.count("*").alias("jobs"))
    rows = v.pairs(s, d).join(v.jobs(s, d).select("job_id", "year"), "job_id")
    return z.join(rows.groupBy("year").agg(_n(F.col("tier") == "C").alias("tier_c"), F.count("*").alias("pairs")), "year")


@query("""SELECT year, count(*) AS jobs, sum(main)::BIGINT AS main, sum(cn_paper)::BIGINT AS cn_paper, sum(babina)::BIGINT AS babina, sum(greatest(main, cn_paper, babina))::BIGINT AS any_measure,
 round(sum(babina) / nullif(sum(main), 0), 8) AS babina_effect FROM v_jobs GROUP BY year""")
def A39_measure_matrix(s, d):
    m = {k: _n(F.col(k)) for k in ("main", "cn_paper", "babina")} | {"any_measure": _n(F.greatest("main", "cn_paper", "babina"))}
    out = v.jobs(s, d).groupBy("year").agg(F.count("*").alias("jobs"), *[c.alias(k) for k, c in m.items()])
    return out.withColumn("babina_effect", F.round(F.col("babina") / F.nullif("main", F.lit(0)), 8))


@query(_FUSED + "SELECT city, sum((a = 0 AND b = 1)::INT)::BIGINT AS added, sum((a = 1 AND b = 0)::INT)::BIGINT AS dropped, sum((a = 1 AND b = 1)::INT)::BIGINT AS both_jobs FROM fu GROUP BY city")
def A40_dual_comparison(s, d):
    a, b = F.col("a") == 1, F.col("b") == 1
    return _fused(s, d).groupBy("city").agg(_n(~a & b).alias("added"), _n(a & ~b).alias("dropped"), _n(a & b).alias("both_jobs"))


@query("SELECT platform, count(*) AS rows, count(DISTINCT city) AS cities, round(avg(main), 8) AS hit_rate, count(DISTINCT city) = 1 AND avg(main) BETWEEN 0 AND 0.03 AS healthy FROM v_jobs GROUP BY platform")
def A42_shard_health(s, d):
    out = v.jobs(s, d).groupBy("platform").agg(F.count("*").alias("rows"), F.countDistinct("city").alias("cities"), F.avg("main").alias("r"))
    return out.select("platform", "rows", "cities", F.round("r", 8).alias("hit_rate"), ((F.col("cities") == 1) & F.col("r").between(0, 0.03)).alias("healthy"))


@query("SELECT lang, a AS is_active, count(*) AS n FROM v_gold GROUP BY ALL")
def A43_activation_by_language(s, d):
    return v.gold(s, d).groupBy("lang", F.col("a").alias("is_active")).agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT unnest(range(0, 50)) AS skill_code), h AS (SELECT DISTINCT skill_code FROM v_pairs WHERE tier <> 'C') SELECT count(*) AS known, count(h.skill_code) AS covered, count(h.skill_code) / count(*) AS coverage FROM k LEFT JOIN h ON h.skill_code = k.skill_code")
def A44_known_term_coverage(s, d):
    return review.coverage(s.range(50).select(F.col("id").cast("int").alias("skill_code")), v.pairs(s, d).where("tier <> 'C'"), "skill_code")


_DRAW = "(SELECT *, sha256({0}::VARCHAR || '|{1}') AS h FROM {2})"
_BAND = "CASE WHEN n_chars < 500 THEN 'b1' WHEN n_chars < 1000 THEN 'b2' WHEN n_chars < 2000 THEN 'b3' WHEN n_chars < 4000 THEN 'b4' ELSE 'b5' END"


@query(f"""SELECT doc_id, band, least(20, n) / n AS inclusion FROM (SELECT doc_id, band, row_number() OVER (PARTITION BY band ORDER BY {_HASH}, doc_id) AS place, count(*) OVER (PARTITION BY band) AS n
 FROM (SELECT *, {_BAND} AS band FROM {_DRAW.format('doc_id', '11', 'v_gold')})) WHERE place <= 20""")
def W11_band_sample(s, d):
    band = tx.binned(F.col("n_chars"), [0, 500, 1000, 2000, 4000], ["b1", "b2", "b3", "b4", "b5"])
    return review.drawn(v.gold(s, d).select("doc_id", band.alias("band")), "band", "doc_id", 20, "11")


_STRATUM = "CASE WHEN a = 1 AND b = 0 THEN 'S1' WHEN a = 0 AND b = 1 THEN 'S2' WHEN a = 1 THEN 'S3' WHEN n_chars < 500 THEN 'S4' ELSE 'S5' END"


@query(f"""SELECT doc_id, stratum, least(10, n) / n AS inclusion FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH}, doc_id) AS place, count(*) OVER (PARTITION BY stratum) AS n
 FROM (SELECT *, {_STRATUM} AS stratum FROM {_DRAW.format('doc_id', '12', 'v_gold')})) WHERE place <= 10""")
def W12_priority_strata(s, d):
    a, b = F.col("a") == 1, F.col("b") == 1
    stratum = F.when(a & ~b, "S1").when(~a & b, "S2").when(a, "S3").when(F.col("n_chars") < 500, "S4").otherwise("S5")
    return review.drawn(v.gold(s, d).select("doc_id", stratum.alias("stratum")), "stratum", "doc_id", 10, "12")


@query(f"""SELECT doc_id, kind, least(15, n) / n AS inclusion FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {_HASH}, doc_id) AS place, count(*) OVER (PARTITION BY kind) AS n
 FROM (SELECT *, CASE WHEN a = 1 THEN 'only_a' ELSE 'only_b' END AS kind FROM {_DRAW.format('doc_id', '13', 'v_gold')} WHERE a <> b)) WHERE place <= 15""")
def W13_disagreements(s, d):
    kind = F.when(F.col("a") == 1, "only_a").otherwise("only_b").alias("kind")
    return review.drawn(v.gold(s, d).where("a <> b").select("doc_id", kind), "kind", "doc_id", 15, "13")


@query("""SELECT CASE WHEN a = 1 AND b = 1 THEN 'BOTH' WHEN a = 1 THEN 'KW' WHEN b = 1 THEN 'SK' WHEN n_chars >= 1000 THEN 'WEAK' ELSE 'NON' END AS bucket, count(*) AS n FROM v_gold GROUP BY 1""")
def W15_five_buckets(s, d):
    a, b = F.col("a") == 1, F.col("b") == 1
    bucket = F.when(a & b, "BOTH").when(a, "KW").when(b, "SK").when(F.col("n_chars") >= 1000, "WEAK").otherwise("NON")
    return v.gold(s, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT skill_code, count(*) AS n FROM v_pairs WHERE tier <> 'C' AND skill_code % 10 <> 0 GROUP BY 1")
def C11_exclusions(s, d):
    p = v.pairs(s, d)
    gone = p.where("tier = 'C' or skill_code % 10 = 0").select("skill_code").distinct()  # a row for each code, of 40
    return p.join(gone, "skill_code", "left_anti").groupBy("skill_code").agg(F.count("*").alias("n"))


@query("""SELECT 'jobs_unique' AS rule, count(*) - count(DISTINCT job_id) AS broken FROM v_jobs UNION ALL SELECT 'pairs_unique', count(*) - count(DISTINCT (job_id, skill_code)) FROM v_pairs
 UNION ALL SELECT 'pairs_have_jobs', count(*) FROM v_pairs p WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.job_id = p.job_id) UNION ALL SELECT 'anchors_binary', count(*) FROM v_jobs WHERE main NOT IN (0, 1) OR babina < main""")
def C12_gate(s, d):
    return review.gate(v.jobs(s, d), v.pairs(s, d))


@query("""SELECT recruit_id, coalesce(nullif(trim(platform), ''), 'PLATFORM_MISSING') AS platform, ((trim(platform) NOT IN ('', '-'))::INT + (trim(city) NOT IN ('', '-'))::INT + (trim(position) NOT IN ('', '-'))::INT)::BIGINT AS completeness FROM v_posts""")
def P8_completeness(s, d):
    cols = ("platform", "city", "position")
    return v.posts(s, d).select("recruit_id", review.present("platform", "PLATFORM_MISSING").alias("platform"), review.completeness(*cols).cast("bigint").alias("completeness"))


@query("SELECT skill_code, 'gov-' || substr(sha256(skill_code::VARCHAR || '\\0' || lower(tier)), 1, 24) AS alias_id FROM (SELECT DISTINCT skill_code, tier FROM v_pairs)")
def P11_alias_ids(s, d):
    key = F.concat(F.col("skill_code").cast("string"), F.lit("\\0"), F.lower("tier"))
    return v.pairs(s, d).select("skill_code", "tier").distinct().select("skill_code", F.concat(F.lit("gov-"), F.substring(F.sha2(key, 256), 1, 24)).alias("alias_id"))
