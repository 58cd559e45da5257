"""Named queries over the test tables and, where SQL can express them, the same in ANSI SQL. Names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.functions import text as tx
from laborlens.operators import counts as ct
from laborlens.operators import matching, postings
from laborlens.sources import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = v.with_views(sql)
        return f

    return add


def _counts(s, d):
    return ct.counts(v.jobs(s, d), v.pairs(s, d))


_ANNUAL = """WITH f AS (SELECT job_id, year, unnest(['main','cn_paper','babina']) AS anchor, unnest([main, cn_paper, babina]) AS hit FROM v_jobs),
an AS (SELECT skill_code, year, anchor, count(*) AS n_skill, sum(hit)::BIGINT AS n_anchor FROM v_pairs JOIN f USING (job_id) GROUP BY ALL),
ends AS (SELECT min(year) AS lo, max(year) AS hi FROM v_jobs),
c AS (SELECT skill_code, year, 'annual' AS span, year AS window_start, year AS window_end, n_skill, anchor, n_anchor FROM an
 UNION ALL SELECT skill_code, -1, 'pooled', lo, hi, sum(n_skill)::BIGINT, anchor, sum(n_anchor)::BIGINT FROM an, ends GROUP BY skill_code, anchor, lo, hi
 UNION ALL SELECT skill_code, y, 'roll3', greatest(y - 1, lo), least(y + 1, hi), sum(n_skill)::BIGINT, anchor, sum(n_anchor)::BIGINT
  FROM an, ends, (SELECT DISTINCT year AS y FROM v_jobs) WHERE an.year BETWEEN y - 1 AND y + 1 GROUP BY skill_code, anchor, y, lo, hi)
"""


@query(_ANNUAL + "SELECT * FROM c")
def A13_cooccurrence_counts(s, d):
    return _counts(s, d)


@query("SELECT 'unique' AS rule, 0::BIGINT AS n UNION ALL SELECT 'bounds', 0 UNION ALL SELECT 'pooled', 0")
def A14_count_invariants(s, d):
    return ct.broken(_counts(s, d))


@query(_ANNUAL + """SELECT c.*, n_anchor / n_skill AS rate_raw, (n_anchor + 0.5) / (n_skill + 1.0) AS rate_smoothed, n_skill < 10 AS rare_lt10, n_skill < 20 AS rare_lt20,
 n_skill < 50 AS rare_lt50 FROM c""")
def A15_rates_fixed_prior(s, d):
    return ct.rates(_counts(s, d))


@query()
def A16_beta_binomial_priors(s, d):
    out = matching.fitted_priors(_counts(s, d))
    return out.select("span", "anchor", "year", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), "status")


@query(_ANNUAL + "SELECT skill_code, year, n_skill, n_anchor FROM c WHERE span = 'roll3' AND anchor = 'main'")
def W5_roll3_centered(s, d):
    return _counts(s, d).where("span = 'roll3' and anchor = 'main'").select("skill_code", "year", "n_skill", "n_anchor")


_SCORES = _ANNUAL + """, sc AS (SELECT job_id, j.year, count(skill_code) AS matched, count(n_skill) AS weighted, avg((n_anchor + 0.5) / (n_skill + 1.0)) AS score,
 count(skill_code) = 0 AS zero_skill FROM v_jobs j LEFT JOIN v_pairs USING (job_id) LEFT JOIN (SELECT * FROM c WHERE span = 'annual' AND anchor = 'main') w USING (skill_code, year) GROUP BY job_id, j.year)
"""


def _scores(s, d, anchor="main", span="annual"):
    jobs, pairs = v.jobs(s, d), v.pairs(s, d)
    return ct.scores(jobs, pairs, ct.counts(jobs, pairs), anchor, span)


@query(_SCORES.replace("j.year, count(skill_code)", "j.year AS year, count(skill_code)") + "SELECT job_id, year, matched, weighted, round(score, 8) AS score, zero_skill FROM sc")
def A18_job_scores(s, d):
    return _scores(s, d).withColumn("score", F.round("score", 8))


@query(_SCORES.replace("j.year, count(skill_code)", "j.year AS year, count(skill_code)") + """SELECT year, count(*) AS jobs, sum(zero_skill::INT)::BIGINT AS zero_skill, sum((coalesce(round(score, 8), 0) > 0.05)::INT)::BIGINT AS f005,
 sum((coalesce(round(score, 8), 0) > 0.15)::INT)::BIGINT AS f015, sum((coalesce(round(score, 8), 0) > 0.2)::INT)::BIGINT AS f020 FROM sc GROUP BY year""")
def A19_threshold_flags(s, d):
    f = ct.flagged(_scores(s, d).withColumn("score", F.round("score", 8)))
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return f.groupBy("year").agg(F.count("*").alias("jobs"), n("zero_skill").alias("zero_skill"), n("flag_005").alias("f005"), n("flag_015").alias("f015"), n("flag_020").alias("f020"))


@query("""WITH r AS (SELECT job_id, skill_code, company_id, main FROM v_pairs JOIN v_jobs USING (job_id)),
w AS (SELECT skill_code, count(*) AS n, sum(main) AS c FROM r GROUP BY 1), f AS (SELECT skill_code, company_id, count(*) AS fn, sum(main) AS fc FROM r GROUP BY 1, 2)
SELECT job_id, round(avg((c - fc) / nullif(n - fn, 0)), 8) AS loo_score, count(nullif(n - fn, 0)) AS loo_skills FROM r JOIN w USING (skill_code) JOIN f USING (skill_code, company_id) GROUP BY job_id""")
def A20_leave_one_firm_out(s, d):
    return ct.leave_one_firm_out(v.jobs(s, d), v.pairs(s, d)).withColumn("loo_score", F.round("loo_score", 8))


@query(_ANNUAL + """, r AS (SELECT job_id, avg((n_anchor + 0.5) / (n_skill + 1.0)) AS s, avg((n_anchor + 0.5) / (n_skill + 1.0)) FILTER (tier <> 'C') AS t
 FROM v_pairs JOIN v_jobs USING (job_id) JOIN (SELECT * FROM c WHERE span = 'pooled' AND anchor = 'main') w USING (skill_code) GROUP BY job_id)
SELECT count(*) AS jobs, count(t) AS scored_without_c, sum((coalesce(round(s, 8) > 0.2, false) <> coalesce(round(t, 8) > 0.2, false))::INT)::BIGINT AS flips FROM r""")
def A21_robust_without_tier(s, d):
    jobs, pairs = v.jobs(s, d), v.pairs(s, d)
    w = ct.weights(ct.counts(jobs, pairs), "pooled", "main").drop("year")
    rows = pairs.join(w, "skill_code").join(jobs.select("job_id"), "job_id").groupBy("job_id").agg(F.round(F.avg("w"), 8).alias("s"), F.round(F.avg(F.when(F.col("tier") != "C", F.col("w"))), 8).alias("t"))
    flip = F.coalesce(F.col("s") > 0.2, F.lit(False)) != F.coalesce(F.col("t") > 0.2, F.lit(False))
    return rows.agg(F.count("*").alias("jobs"), F.count("t").alias("scored_without_c"), F.sum(flip.cast("bigint")).alias("flips"))


_OMEGA = """WITH t AS (SELECT sum(main) AS ta, count(*) AS t FROM v_jobs), g AS (SELECT skill_code, count(*) AS n, sum(main)::BIGINT AS c FROM v_pairs JOIN v_jobs USING (job_id) GROUP BY 1 HAVING count(*) >= 20),
o AS (SELECT skill_code, n, c, c / n AS omega, (c / ta) / ((n - c + 1) / (t - ta + 1)) AS ratio, ((c + 1) / (ta + 2)) / ((n - c + 1) / (t - ta + 2)) AS l FROM g, t)
"""


@query(_OMEGA + "SELECT skill_code, n, c, round(omega, 8) AS omega, round(ratio, 8) AS ratio, round(l / (1 + l), 8) AS laplace FROM o")
def A9_A11_omega(s, d):
    o = ct.omega(v.jobs(s, d), v.pairs(s, d))
    return o.withColumns({k: F.round(k, 8) for k in ("omega", "ratio", "laplace")})


@query(_OMEGA + "SELECT job_id, round(coalesce(avg(omega), 0), 8) AS relevance FROM v_jobs LEFT JOIN v_pairs USING (job_id) LEFT JOIN o USING (skill_code) GROUP BY job_id")
def A12_job_relevance(s, d):
    jobs, pairs = v.jobs(s, d), v.pairs(s, d)
    own = pairs.join(ct.omega(jobs, pairs), "skill_code").groupBy("job_id").agg(F.avg("omega").alias("r"))
    return jobs.select("job_id").join(own, "job_id", "left").select("job_id", F.round(F.coalesce("r", F.lit(0.0)), 8).alias("relevance"))


_FUSED = _OMEGA + """, b AS (SELECT job_id, (round(avg(round(omega, 6)), 6) >= 0.19 AND max(round(omega, 6)) >= 0.21)::INT AS b FROM v_pairs JOIN o USING (skill_code) GROUP BY 1),
fu AS (SELECT job_id, city, industry, year, month, company_id, main AS a, coalesce(b, 0) AS b, greatest(main, coalesce(b, 0)) AS fused FROM v_jobs LEFT JOIN b USING (job_id))
"""


def _fused(s, d):
    jobs, pairs = v.jobs(s, d), v.pairs(s, d)
    known = ct.omega(jobs, pairs).withColumn("omega", F.round("omega", 6))
    own = pairs.join(known.select("skill_code", "omega"), "skill_code").groupBy("job_id").agg(((F.round(F.avg("omega"), 6) >= 0.19) & (F.max("omega") >= 0.21)).cast("int").alias("b"))
    b = F.coalesce("b", F.lit(0))
    return jobs.join(own, "job_id", "left").select("job_id", "city", "industry", "year", "month", "company_id", F.col("main").alias("a"), b.alias("b"), F.greatest("main", b).alias("fused"))


@query(_FUSED + "SELECT job_id, a, b, fused FROM fu")
def C1_fused_judgement(s, d):
    return _fused(s, d).select("job_id", "a", "b", "fused")


_CELLS = "count(*) AS total, sum(a)::BIGINT AS a_jobs, sum(b)::BIGINT AS b_jobs, sum(fused)::BIGINT AS fused_jobs"


def _panel(rows, *keys):
    n = lambda c: F.sum(c).cast("bigint")
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), n("a").alias("a_jobs"), n("b").alias("b_jobs"), n("fused").alias("fused_jobs"))


@query(_FUSED + f"SELECT city, year, {_CELLS} FROM fu GROUP BY city, year")
def A5_fused_panel(s, d):
    return _panel(_fused(s, d), "city", "year")


@query(_FUSED + f"SELECT industry, year, {_CELLS} FROM fu GROUP BY industry, year HAVING count(*) >= 500")
def A6_fused_by_industry(s, d):
    return _panel(_fused(s, d), "industry", "year").where("total >= 500")


@query(_FUSED + f"""SELECT year, total, a_jobs + b_jobs - fused_jobs AS both_jobs, fused_jobs - b_jobs AS a_only, fused_jobs - a_jobs AS b_only, fused_jobs / total AS fused_rate
 FROM (SELECT year, {_CELLS} FROM fu GROUP BY year)""")
def P15_decomposition(s, d):
    p = _panel(_fused(s, d), "year")
    a, b, f = F.col("a_jobs"), F.col("b_jobs"), F.col("fused_jobs")
    return p.select("year", "total", (a + b - f).alias("both_jobs"), (f - b).alias("a_only"), (f - a).alias("b_only"), (f / F.col("total")).alias("fused_rate"))


@query(_FUSED + f"""SELECT grain, period, city, {_CELLS} FROM (SELECT *, unnest(['year', 'half', 'quarter']) AS grain,
 unnest([year::VARCHAR, year || 'H' || (CASE WHEN month <= 6 THEN 1 ELSE 2 END), year || 'Q' || ((month + 2) // 3)]) AS period FROM fu) GROUP BY grain, period, city HAVING count(*) >= 20""")
def A4_grain_rollup(s, d):
    y = F.col("year").cast("string")
    cells = [("year", y), ("half", F.concat(y, F.lit("H"), F.when(F.col("month") <= 6, "1").otherwise("2"))), ("quarter", F.concat(y, F.lit("Q"), F.floor((F.col("month") + 2) / 3).cast("string")))]
    # months are counted once; the small table of months is rolled up
    rows = _panel(_fused(s, d), "city", "year", "month").withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("grain"), p.alias("period")) for k, p in cells])))
    sums = [F.sum(c).alias(c) for c in ("total", "a_jobs", "b_jobs", "fused_jobs")]
    return rows.select("*", "x.grain", "x.period").groupBy("grain", "period", "city").agg(*sums).where("total >= 20")


@query(f"WITH fu AS (SELECT *, main AS a, babina AS b, greatest(main, babina) AS fused FROM v_jobs) SELECT coalesce(city, 'ALL') AS city, year, {_CELLS} FROM fu GROUP BY GROUPING SETS ((city, year), (year))")
def A3_city_rollup(s, d):
    rows = v.jobs(s, d).withColumns({"a": F.col("main"), "b": F.col("babina"), "fused": F.greatest("main", "babina")})
    by_city = _panel(rows, "city", "year")
    return by_city.union(by_city.groupBy(F.lit("ALL").alias("city"), "year").agg(*[F.sum(c).alias(c) for c in ("total", "a_jobs", "b_jobs", "fused_jobs")]))


@query("""WITH f AS (SELECT year, company_id, count(*) AS n, sum(main) AS ai FROM v_jobs GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT year, count(*) AS firms, round(avg(ai / n), 8) AS mean_ratio, sum((ai > 0)::INT)::BIGINT AS with_ai, sum((ai / n >= 0.05)::INT)::BIGINT AS over_5 FROM f GROUP BY year""")
def A8_company_ratio(s, d):
    f = v.jobs(s, d).groupBy("year", "company_id").agg(F.count("*").alias("n"), F.sum("main").alias("ai")).where("n >= 2")
    r = F.col("ai") / F.col("n")
    return f.groupBy("year").agg(F.count("*").alias("firms"), F.round(F.avg(r), 8).alias("mean_ratio"), F.sum((F.col("ai") > 0).cast("bigint")).alias("with_ai"), F.sum((r >= 0.05).cast("bigint")).alias("over_5"))


@query("SELECT platform, year, (month + 2) // 3 AS quarter, count(*) AS n FROM v_jobs GROUP BY ALL")
def A1_position_counts(s, d):
    return v.jobs(s, d).groupBy("platform", "year", F.floor((F.col("month") + 2) / 3).cast("bigint").alias("quarter")).count().withColumnRenamed("count", "n")


@query("""SELECT year, count(*) AS posts, sum(main)::BIGINT AS ai_posts, count(DISTINCT company_id) AS positions, count(DISTINCT CASE WHEN main = 1 THEN company_id END) AS ai_positions FROM v_jobs GROUP BY year""")
def A2_keyword_penetration(s, d):
    return v.jobs(s, d).groupBy("year").agg(F.count("*").alias("posts"), F.sum("main").cast("bigint").alias("ai_posts"), F.countDistinct("company_id").alias("positions"), F.countDistinct(F.when(F.col("main") == 1, F.col("company_id"))).alias("ai_positions"))


@query(_OMEGA + """, r AS (SELECT job_id, round(avg(round(omega, 6)), 6) AS r FROM v_pairs JOIN o USING (skill_code) GROUP BY 1)
SELECT city, year, count(*) AS total, sum((coalesce(r, 0) >= 0.2)::INT)::BIGINT AS ai_jobs FROM v_jobs LEFT JOIN r USING (job_id) GROUP BY city, year""")
def A7_anchor_penetration(s, d):
    jobs, pairs = v.jobs(s, d), v.pairs(s, d)
    # in whole millionths: means of four or more doubles fall to either side of the threshold by the order of their sum
    known = ct.omega(jobs, pairs).select("skill_code", ct.half_up(F.col("c") * 1_000_000, F.col("n")).alias("omega"))
    r = pairs.join(known, "skill_code").groupBy("job_id").agg(ct.half_up(F.sum("omega"), F.count("*")).alias("r"))
    return jobs.join(r, "job_id", "left").groupBy("city", "year").agg(F.count("*").alias("total"), F.sum((F.coalesce("r", F.lit(0)) >= 200_000).cast("bigint")).alias("ai_jobs"))


@query("SELECT city, year, count(*) AS n FROM v_jobs WHERE year = 1997 GROUP BY ALL")
def S3_year_scan(s, d):
    return v.jobs(s, d).where("year = 1997").groupBy("city", "year").count().withColumnRenamed("count", "n")


@query("SELECT recruit_id, length(description) AS n FROM v_posts WHERE recruit_id IS NOT NULL AND description IS NOT NULL AND position <> '' AND length(trim(description)) >= 10")
def S1_admitted_posts(s, d):
    return postings.admitted(v.posts(s, d)).select("recruit_id", F.length("description").cast("bigint").alias("n"))


@query("SELECT recruit_id FROM v_posts WHERE description IS NOT NULL AND position IS NOT NULL AND description <> '' AND position <> ''")
def S2_admitted_v1(s, d):
    return v.posts(s, d).where("description <> '' and position <> ''").select("recruit_id")


@query("SELECT city, count(*) AS n FROM v_jobs GROUP BY city ORDER BY n DESC")
def S7_shard_sizes(s, d):
    return v.jobs(s, d).groupBy("city").count().withColumnRenamed("count", "n").orderBy(F.desc("n"))


@query("""SELECT year, platform, count(*) AS n FROM v_jobs GROUP BY ALL""".replace("SELECT year, platform, count(*) AS n FROM v_jobs GROUP BY ALL", "SELECT industry, " + ", ".join(f"sum((year = {y})::INT)::BIGINT AS y{y}" for y in range(1995, 2002)) + " FROM v_jobs GROUP BY industry"))
def S20_matrix(s, d):
    years = list(range(1995, 2002))
    wide = v.jobs(s, d).groupBy("industry").pivot("year", years).count()
    return wide.select("industry", *[F.coalesce(str(y), F.lit(0).cast("bigint")).alias(f"y{y}") for y in years])


@query("SELECT recruit_id, year(publish_time::DATE) AS year, CASE WHEN month(publish_time::DATE) <= 6 THEN 1 ELSE 2 END AS half, (month(publish_time::DATE) + 2) // 3 AS quarter FROM v_posts")
def P2_periods(s, d):
    return v.posts(s, d).select("recruit_id", tx.period_of(F.col("publish_time")).alias("p")).select("recruit_id", *[F.col(f"p.{k}").cast("bigint").alias(k) for k in ("year", "half", "quarter")])


@query("SELECT recruit_id, CASE WHEN length(description) < 200 THEN 'short' WHEN length(description) < 1000 THEN 'medium' WHEN length(description) < 3000 THEN 'long' ELSE 'very long' END AS bin FROM v_posts")
def P6_length_bins(s, d):
    return v.posts(s, d).select("recruit_id", tx.binned(F.length("description"), [0, 200, 1000, 3000], ["short", "medium", "long", "very long"]).alias("bin"))


@query("SELECT recruit_id, regexp_matches(position, '(?i)data|the') AS tech FROM v_posts")
def P7_tech_flag(s, d):
    return v.posts(s, d).select("recruit_id", F.col("position").rlike("(?i)data|the").alias("tech"))


_HASH = "cast('0x' || printf('%x', (instr('0123456789abcdef', substr(h, 1, 1)) - 1) & 7) || substr(h, 2, 15) AS BIGINT)"


@query(f"SELECT recruit_id, {_HASH} AS id FROM (SELECT recruit_id, sha256(trim(platform) || chr(31) || recruit_id::VARCHAR) AS h FROM v_posts)")
def P9_stable_ids(s, d):
    return v.posts(s, d).select("recruit_id", tx.hash63(F.concat(F.trim("platform"), F.lit("\x1f"), F.col("recruit_id").cast("string"))).alias("id"))


@query("SELECT company_id, row_number() OVER (ORDER BY company_id) - 1 AS code FROM (SELECT DISTINCT company_id FROM v_jobs)")
def P12_dense_codes(s, d):
    from laborlens.plans.codes import dense_codes

    return dense_codes(v.jobs(s, d).select("company_id"), "company_id")


@query(f"SELECT recruit_id, {_HASH} AS text_hash FROM (SELECT recruit_id, sha256(regexp_replace(description, '\\s+', '', 'g')) AS h FROM v_posts)")
def X3_text_hash(s, d):
    return v.posts(s, d).select("recruit_id", tx.hash63(tx.squeezed(F.col("description"))).alias("text_hash"))


@query("SELECT recruit_id, regexp_replace(lower(position), '[\\s()\\[\\]{}<>0-9#_\\-]+', '', 'g') AS key FROM v_posts")
def X4_position_key(s, d):
    return v.posts(s, d).select("recruit_id", tx.position_key(F.col("position")).alias("key"))


@query("SELECT page_id, sha256(trim(regexp_replace(lower(html), '\\s+', ' ', 'g'))) AS digest FROM pages")
def X2_match_state(s, d):
    return v.table(s, d, "pages").select("page_id", F.sha2(tx.match_text(F.col("html")), 256).alias("digest"))


@query()
def X1_cleaned_pages(s, d):
    return v.table(s, d, "pages").select("page_id", F.sha2(tx.cleaned(F.col("html")), 256).alias("digest"), F.length(tx.cleaned(F.col("html"))).alias("n"))


#: stand-ins for anchor terms that occur in the test texts
_TERMS = [("AI", "the", "phrase"), ("ML", "of", "phrase"), ("NLP", "license", "plural"), ("LLM", "data", "phrase"), ("CIMAGE", "and the", "phrase")]


@query("""SELECT recruit_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(^|[^a-z0-9])the($|[^a-z0-9])') THEN 'AI' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])of($|[^a-z0-9])') THEN 'ML' END,
 CASE WHEN regexp_matches(t, '(^|[^a-z0-9])licenses?($|[^a-z0-9])') THEN 'NLP' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])data($|[^a-z0-9])') THEN 'LLM' END,
 CASE WHEN regexp_matches(t, '(^|[^a-z0-9])and[\\s\\-]+the($|[^a-z0-9])') THEN 'CIMAGE' END], lambda x: x IS NOT NULL), '|') AS groups FROM (SELECT recruit_id, lower(description) AS t FROM v_posts)""")
def X7_anchor_groups(s, d):
    return v.posts(s, d).select("recruit_id", F.array_join(tx.anchor_groups(F.col("description"), _TERMS), "|").alias("groups"))


@query("""SELECT recruit_id, (contains(lower(description), 'the')::INT * 3 + contains(lower(description), 'license')::INT * 2 + contains(lower(description), 'data')::INT)::INT AS score FROM v_posts""")
def X10_weighted_keywords(s, d):
    low = F.lower("description")
    terms = {"the": 3, "license": 2, "data": 1}
    return v.posts(s, d).select("recruit_id", sum((low.contains(t).cast("int") * w for t, w in terms.items()), F.lit(0)).alias("score"))


@query()
def X17_longest_matches(s, d):
    terms = s.createDataFrame([("license", 1), ("apache license", 2), ("the", 3), ("of the", 4), ("data", 5)], "term string, skill_id bigint")
    return matching.matches_with_evidence(v.posts(s, d).select(F.col("recruit_id").alias("id"), F.col("description").alias("text")), terms)


@query()
def X24_bigram_retrieval(s, d):
    parts = v.table(s, d, "part").select(F.col("p_partkey").alias("concept"), F.col("p_name").alias("alias"))
    asked = v.table(s, d, "part").where("p_partkey % 20 = 0").select(F.col("p_name").alias("query")).distinct()
    return matching.bigram_retrieval(asked, parts).select("query", "concept", F.round("jaccard", 8).alias("jaccard"), "place")


@query("SELECT job_id, min(company_id) AS company_id FROM v_jobs j LEFT JOIN v_firms f ON f.recruit_id = j.job_id GROUP BY job_id".replace("min(company_id)", "min(f.company_id)"))
def J1_first_row_join(s, d):
    return v.jobs(s, d).select("job_id").join(ct.firm_first(v.firms(s, d)).withColumnRenamed("recruit_id", "job_id"), "job_id", "left")


@query("""SELECT job_id, coalesce(CASE WHEN min(f.company_id) = max(f.company_id) THEN min(f.company_id)::VARCHAR END, 'UNK:' || job_id) AS company, min(f.company_id) IS NULL OR min(f.company_id) <> max(f.company_id) AS unmatched
 FROM v_jobs j LEFT JOIN v_firms f ON f.recruit_id = j.job_id GROUP BY job_id""")
def J2_unique_or_null_join(s, d):
    own = ct.firm_unique(v.firms(s, d)).withColumnRenamed("recruit_id", "job_id").withColumnRenamed("company_id", "c")
    both = v.jobs(s, d).select("job_id").join(own, "job_id", "left")
    return both.select("job_id", F.coalesce(F.col("c").cast("string"), F.concat(F.lit("UNK:"), F.col("job_id").cast("string"))).alias("company"), F.col("c").isNull().alias("unmatched"))


@query("SELECT skill_code, count(*) AS n FROM v_pairs p WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.job_id = p.job_id AND main = 1) GROUP BY skill_code")
def J6_anti_join(s, d):
    hit = v.jobs(s, d).where("main = 1").select("job_id")
    return v.pairs(s, d).join(hit, "job_id", "left_anti").groupBy("skill_code").count().withColumnRenamed("count", "n")


@query("SELECT skill_code, count(*) AS n FROM v_pairs p WHERE EXISTS (SELECT 1 FROM v_jobs j WHERE j.job_id = p.job_id AND main = 1) GROUP BY skill_code")
def J7_semi_join(s, d):
    hit = v.jobs(s, d).where("main = 1").select("job_id")
    return v.pairs(s, d).join(hit, "job_id", "left_semi").groupBy("skill_code").count().withColumnRenamed("count", "n")


@query("""WITH a AS (SELECT platform, count(*) AS n FROM v_jobs WHERE year < 1998 GROUP BY 1), b AS (SELECT platform, count(*) AS m FROM v_jobs WHERE year >= 1998 AND platform <> '5-LOW' GROUP BY 1)
SELECT coalesce(a.platform, b.platform) AS platform, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b ON a.platform = b.platform""")
def J9_full_reconcile(s, d):
    j = v.jobs(s, d)
    a = j.where("year < 1998").groupBy("platform").agg(F.count("*").alias("n"))
    b = j.where("year >= 1998 and platform <> '5-LOW'").groupBy("platform").agg(F.count("*").alias("m"))
    return a.join(b, "platform", "full_outer").select("platform", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in "nm"])


@query("SELECT rid, day, event_id, n - 1 AS rule1_dups FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY day, event_id) AS rn, count(*) OVER (PARTITION BY rid) AS n FROM v_visits) WHERE rn = 1")
def W1_rule_one(s, d):
    return postings.rule_one(v.visits(s, d)).withColumn("day", F.col("day").cast("bigint"))


@query("""WITH b AS (SELECT *, (day - min(day) OVER (PARTITION BY rid)) // 7 AS bucket FROM v_visits)
SELECT rid, bucket, count(*) AS records, min(day) AS earliest_day, max(day) AS latest_day, arg_min(event_id, day * 1000000000 + event_id) AS canonical FROM b GROUP BY rid, bucket""")
def W2_W3_buckets(s, d):
    out = postings.bucketed(v.visits(s, d), 7)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("bucket", "earliest_day", "latest_day")})


@query(f"""SELECT text_hash, min(recruit_id) AS canonical_id, count(*) AS records, count(DISTINCT platform) AS platforms FROM
 (SELECT recruit_id, platform, {_HASH} AS text_hash FROM (SELECT *, sha256(regexp_replace(description, '\\s+', '', 'g')) AS h FROM v_posts)) GROUP BY text_hash""")
def W4_canonical_texts(s, d):
    return postings.canonical(v.posts(s, d))


_QUOTA = """WITH st AS (SELECT city AS stratum, count(*) AS n FROM v_jobs GROUP BY 1), al AS (SELECT sum(n)::BIGINT AS al FROM st),
q AS (SELECT stratum, n, (least(777, al) * n) // al AS base, (least(777, al) * n) % al AS rest, least(777, al) AS got FROM st, al),
qq AS (SELECT stratum, n, (base + (row_number() OVER (ORDER BY rest DESC, stratum) <= got - sum(base) OVER ())::INT)::BIGINT AS quota FROM q)
"""


def _quota(s, d):
    return postings.largest_remainder(v.jobs(s, d).groupBy(F.col("city").alias("stratum")).agg(F.count("*").alias("n")), 777)


@query(_QUOTA + "SELECT * FROM qq")
def W6_largest_remainder(s, d):
    return _quota(s, d)


@query(_QUOTA + f"""SELECT job_id, city FROM (SELECT job_id, city, row_number() OVER (PARTITION BY city ORDER BY {_HASH}, job_id) AS place
 FROM (SELECT job_id, city, sha256(job_id::VARCHAR || '|42') AS h FROM v_jobs)) JOIN qq ON city = stratum WHERE place <= quota""")
def T6_hash_sample(s, d):
    return postings.sampled(v.jobs(s, d).select("job_id", "city"), "city", "job_id", _quota(s, d))


@query(f"""SELECT year, job_id FROM (SELECT year, job_id, row_number() OVER (PARTITION BY year ORDER BY {_HASH}, job_id) AS place FROM (SELECT year, job_id, sha256(job_id::VARCHAR || '|7') AS h FROM v_jobs)) WHERE place <= 100""")
def W8_baseline_per_year(s, d):
    draw = tx.hash63(F.concat(F.col("job_id").cast("string"), F.lit("|7")))
    return ct.ranked(v.jobs(s, d).select("year", "job_id", draw.alias("h")), ["year"], F.col("h"), F.col("job_id")).where("rn <= 100").select("year", "job_id")


_AGREE = """SELECT {0} n00, n01, n10, n11, round((n00 + n11) / n, 8) AS agreement, round(((n00 + n11) / n - e) / (1 - e), 8) AS kappa FROM (SELECT *, ((n10 + n11) * (n01 + n11) + (n00 + n01) * (n00 + n10)) / (n * n) AS e FROM
 (SELECT {0} sum((a = 0 AND b = 0)::INT)::BIGINT AS n00, sum((a = 0 AND b = 1)::INT)::BIGINT AS n01, sum((a = 1 AND b = 0)::INT)::BIGINT AS n10, sum((a = 1 AND b = 1)::INT)::BIGINT AS n11, count(*) AS n FROM v_gold {1}))"""


@query(_AGREE.format("", ""))
def A30_agreement(s, d):
    return postings.agreement(v.gold(s, d))


@query(_AGREE.format("lang,", "GROUP BY lang"))
def A32_agreement_by_set(s, d):
    return postings.agreement(v.gold(s, d), "lang")


@query("""WITH t AS (SELECT skill_code, count(DISTINCT job_id) AS df, sum(main) / count(*) AS cooc, min(year) AS first_year FROM v_pairs JOIN v_jobs USING (job_id) GROUP BY 1)
SELECT skill_code, df, round(cooc, 8) AS cooc, first_year, CASE WHEN df >= 100 THEN 'B' WHEN df >= 10 THEN 'C' WHEN df >= 5 AND (cooc >= .5 OR first_year >= 2019) THEN 'C' ELSE 'D' END AS grade FROM t""")
def A26_grades(s, d):
    t = v.pairs(s, d).join(v.jobs(s, d), "job_id").groupBy("skill_code").agg(F.countDistinct("job_id").alias("df"), (F.sum("main") / F.count("*")).alias("cooc"), F.min("year").alias("first_year"))
    return postings.graded(t).withColumn("cooc", F.round("cooc", 8))


@query("""SELECT CASE WHEN n < 5 THEN '1-4' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' WHEN n < 100 THEN '20-99' WHEN n < 1000 THEN '100-999' ELSE '>=1000' END AS band, count(*) AS firms
 FROM (SELECT company_id, count(*) AS n FROM v_jobs GROUP BY 1) GROUP BY 1""")
def A24_frequency_histogram(s, d):
    n = v.jobs(s, d).groupBy("company_id").agg(F.count("*").alias("n"))
    return n.groupBy(postings.frequency_band(F.col("n")).alias("band")).agg(F.count("*").alias("firms"))


@query("""SELECT platform, count(*) AS rows, count(description) AS texts, sum((length(trim(description)) < 10)::INT)::BIGINT AS short, min(publish_time) AS first_day, max(publish_time) AS last_day,
 count(DISTINCT regexp_replace(description, '\\s+', '', 'g')) AS distinct_texts FROM v_posts GROUP BY platform""")
def A38_source_audit(s, d):
    return v.posts(s, d).groupBy("platform").agg(
        F.count("*").alias("rows"), F.count("description").alias("texts"), F.sum((F.length(F.trim("description")) < 10).cast("bigint")).alias("short"),
        F.min("publish_time").alias("first_day"), F.max("publish_time").alias("last_day"), F.countDistinct(tx.hash63(tx.squeezed(F.col("description")))).alias("distinct_texts"),
    )


@query("SELECT main, babina, count(*) AS n FROM v_jobs GROUP BY ALL")
def A35_transition_matrix(s, d):
    return v.jobs(s, d).groupBy("main", "babina").count().withColumnRenamed("count", "n")


@query("SELECT company_id, n FROM (SELECT company_id, count(*) AS n FROM v_jobs GROUP BY 1) ORDER BY n DESC, company_id LIMIT 20")
def T2_top_firms(s, d):
    return v.jobs(s, d).groupBy("company_id").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "company_id").limit(20)


@query("""SELECT job_id, skill_code, w FROM (SELECT job_id, skill_code, c / n AS w, row_number() OVER (PARTITION BY job_id ORDER BY c / n DESC, skill_code) AS rn
 FROM v_pairs JOIN (SELECT skill_code, count(*) AS n, sum(main) AS c FROM v_pairs JOIN v_jobs USING (job_id) GROUP BY 1) g USING (skill_code)) WHERE rn <= 3""")
def T2_top_concepts(s, d):
    p, j = v.pairs(s, d), v.jobs(s, d)
    w = p.join(j, "job_id").groupBy("skill_code").agg((F.sum("main") / F.count("*")).alias("w"))
    return ct.ranked(p.select("job_id", "skill_code").join(w, "skill_code"), ["job_id"], F.desc("w"), F.col("skill_code")).where("rn <= 3").select("job_id", "skill_code", "w")


@query("SELECT company_id FROM v_jobs WHERE year = 1996 EXCEPT SELECT company_id FROM v_jobs WHERE year = 1997")
def T4_set_difference(s, d):
    j = v.jobs(s, d)
    return j.where("year = 1996").select("company_id").subtract(j.where("year = 1997").select("company_id"))


@query("SELECT company_id, min(job_id) AS job_id FROM v_jobs GROUP BY company_id")
def T5_distinct_by_key(s, d):
    return v.jobs(s, d).groupBy("company_id").agg(F.min("job_id").alias("job_id"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def A37_ordered_checksum(s, d):
    t = v.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return t.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x.text), "\n"), 256).alias("digest"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def G5_json_fields(s, d):
    return v.table(s, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint").k).alias("k"))


@query("SELECT doc_id, sha256(lang || chr(31) || sha256(text)) AS key FROM documents")
def G12_cache_keys(s, d):
    return v.table(s, d, "documents").select("doc_id", F.sha2(F.concat("lang", F.lit("\x1f"), F.sha2("text", 256)), 256).alias("key"))
