"""More named queries: industries, skills in texts by small dictionaries, dictionaries and their governance. Registered beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.functions import fold, industry
from laborlens.functions import text as tx
from laborlens.operators import matching, postings, skills
from laborlens.operators import counts as ct
from laborlens.plans.registry import _ANNUAL, _FUSED, _OMEGA, _counts, _fused, query
from laborlens.sources import views as v

#: stand-ins for skill terms that occur in the test texts, with weights
WEIGHTS = {"the": 1.0, "of": 0.5, "license": 3.0, "data": 2.0, "and the": 1.5, "que": 0.25, "Der": 2.0}
EXCLUDED, REQUIRED = {"of": "of the"}, {"data": "data\\s+[a-z]"}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_occurs(column: str, term: str) -> str:
    if skills.needs_boundary(term):
        return f"regexp_matches({column}, '(^|[^A-Za-z]){term}($|[^A-Za-z])')"
    return f"contains({column}, {_text(term)})"


# codes that are whole, of a section only, padded, in small letters, of an unknown class, of no letter, empty and missing
_CODE_SQL = """CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '9' || p_size WHEN 3 THEN 'c' || lpad((p_size + 12)::VARCHAR, 2, '0') || '1' WHEN 4 THEN ' I65 ' WHEN 5 THEN 'C'
 WHEN 6 THEN 'Z' || lpad(p_size::VARCHAR, 2, '0') WHEN 7 THEN 'A' || lpad(p_size::VARCHAR, 2, '0') ELSE chr(65 + (p_partkey % 20)::INT) || lpad((p_size + 30)::VARCHAR, 2, '0') END"""
_LABELS_SQL = "(VALUES " + ", ".join(f"({_text(k)}, {_text(x)})" for k, x in industry.LABELS.items()) + ")"


def _codes(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = (
        F.when(k % 9 == 0, "").when(k % 9 == 1, F.lit(None).cast("string")).when(k % 9 == 2, F.concat(F.lit("9"), size.cast("string"))).when(k % 9 == 3, F.concat(F.lit("c"), two(size + 12), F.lit("1")))
        .when(k % 9 == 4, " I65 ").when(k % 9 == 5, "C").when(k % 9 == 6, F.concat(F.lit("Z"), two(size))).when(k % 9 == 7, F.concat(F.lit("A"), two(size)))
        .otherwise(F.concat(F.char((k % 20 + 65).cast("bigint")), two(size + 30)))
    )
    return v.table(s, d, "part").select("p_partkey", code.alias("code"))


@query(f"""WITH c AS (SELECT p_partkey, upper(trim(coalesce({_CODE_SQL}, ''))) AS code FROM part), l AS (SELECT col0 AS k, col1 AS label FROM {_LABELS_SQL})
SELECT p_partkey, coalesce(m.label, x.label, '{industry.UNKNOWN}') AS industry FROM c LEFT JOIN l m ON m.k = substr(code, 1, 3) AND length(m.k) = 3 LEFT JOIN l x ON x.k = substr(code, 1, 1) AND length(x.k) = 1""")
def P4_industries(s, d):
    return _codes(s, d).select("p_partkey", industry.classified(F.col("code")).alias("industry"))


@query("SELECT p_partkey, 'ＡＢ' || p_name AS raw, 'ab' || lower(p_name) AS folded FROM part")
def X5_folded_terms(s, d):
    raw = F.concat(F.lit("ＡＢ"), "p_name")
    return v.table(s, d, "part").select("p_partkey", raw.alias("raw"), F.lower(F.trim(fold.nfkc(raw))).alias("folded"))


@query("""WITH g AS (SELECT * FROM (VALUES ('AI', 3), ('ML', 3), ('NLP', 3), ('CVISION', 2), ('CIMAGE', 2), ('LLM', 4), ('TRANS', 4)) AS t(anchor_group, terms))
SELECT 'main' AS version, anchor_group, terms::BIGINT AS terms FROM g UNION ALL SELECT 'cn_paper', anchor_group, terms FROM g WHERE anchor_group IN ('AI', 'ML', 'NLP', 'CIMAGE')
UNION ALL SELECT 'babina', anchor_group, terms FROM g WHERE anchor_group IN ('AI', 'ML', 'NLP', 'CVISION')""")
def X8_anchor_dictionary(s, d):
    rows = s.createDataFrame([(ver, *a) for ver, terms in tx.VERSIONS.items() for a in terms], "version string, anchor_group string, term string, rule string")
    return rows.groupBy("version", "anchor_group").agg(F.count("*").alias("terms"))


_TITLE = "CASE WHEN recruit_id % 4 = 0 THEN position || '（the机器人科技有限公司）' WHEN recruit_id % 4 = 1 THEN position || '(ai中文语料)' ELSE position END"


@query(f"""SELECT recruit_id, regexp_matches(t, '(^|[^A-Za-z])THE($|[^A-Za-z])') OR regexp_matches(t, '(^|[^A-Za-z])AI($|[^A-Za-z])') OR contains(t, '机器人') AS hit
 FROM (SELECT recruit_id, upper(regexp_replace({_TITLE}, '[（(][^）)]*(科技|公司)[^）)]*[）)]', '', 'g')) AS t FROM v_posts)""")
def X9_keyword_titles(s, d):
    k = F.col("recruit_id") % 4
    title = F.when(k == 0, F.concat("position", F.lit("（the机器人科技有限公司）"))).when(k == 1, F.concat("position", F.lit("(ai中文语料)"))).otherwise(F.col("position"))
    return v.posts(s, d).select("recruit_id", skills.in_title(title, ["THE", "AI", "机器人"]).alias("hit"))


def _sql_score(column: str) -> str:
    parts = []
    for term, w in WEIGHTS.items():
        more = f" AND NOT regexp_matches({column}, '{EXCLUDED[term]}')" if term in EXCLUDED else f" AND regexp_matches({column}, '{REQUIRED[term]}')" if term in REQUIRED else ""
        parts.append(f"CASE WHEN {_sql_occurs(column, term)}{more} THEN {w}::DOUBLE ELSE 0 END")
    return " + ".join(parts)


def _score(column="description"):
    return skills.scored(F.col(column), WEIGHTS, EXCLUDED, REQUIRED)


@query(f"SELECT recruit_id, {_sql_score('description')} AS score FROM v_posts")
def X11_weighted_skills(s, d):
    return v.posts(s, d).select("recruit_id", _score().alias("score"))


@query(f"SELECT recruit_id, {_sql_score('position')} + {_sql_score('description')} >= {skills.THRESHOLD} AS is_ai FROM v_posts")
def X12_ai_jobs(s, d):
    return v.posts(s, d).select("recruit_id", (_score("position") + _score() >= skills.THRESHOLD).alias("is_ai"))


@query(f"SELECT recruit_id, {_sql_score('description')} AS score FROM v_posts WHERE {_sql_score('description')} > 0")
def X13_prefiltered(s, d):
    return v.posts(s, d).where(skills.prefilter(F.col("description"), list(WEIGHTS))).select("recruit_id", _score().alias("score")).where("score > 0")


_FOUND = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_sql_occurs('description', t)} THEN {_text(t)} END" for t in WEIGHTS) + "], lambda x: x IS NOT NULL), '|')"


@query(f"SELECT recruit_id, {_FOUND} AS skills FROM v_posts")
def X14_X15_listed_skills(s, d):
    return v.posts(s, d).select("recruit_id", F.array_join(skills.listed(F.col("description"), list(WEIGHTS)), "|").alias("skills"))


@query("""SELECT recruit_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(substr(description, 1, 4000), 'and the|license|data|the|of')), lambda x: x <> 'data' OR regexp_matches(substr(description, 1, 4000), 'data[a-z]'))), '|') AS skills FROM v_posts""")
def X16_longest_first(s, d):
    found = skills.longest_first(F.col("description"), ["the", "and the", "of", "data", "license"], contexts={"data": "data[a-z]"})
    return v.posts(s, d).select("recruit_id", F.array_join(F.array_sort(found), "|").alias("skills"))


@query("""SELECT recruit_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(^|[^a-z0-9])the($|[^a-z0-9])') OR regexp_matches(t, '(^|[^a-z0-9])of the($|[^a-z0-9])') THEN 1 END,
 CASE WHEN contains(t, 'ö') THEN 2 END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])data($|[^a-z0-9])') AND contains(t, 'license') THEN 3 END], lambda x: x IS NOT NULL), ',') AS concepts FROM (SELECT recruit_id, lower(description) AS t FROM v_posts)""")
def X18_concepts(s, d):
    found = skills.concepts(F.col("description"), [("the", 1), ("of the", 1), ("ö", 2), ("Data", 3)], {3: "license"})
    return v.posts(s, d).select("recruit_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("concepts"))


# aliases: names of parts; those of one name share a skill, but for every eighth name, which has two of which one is primary
_ALIAS_SQL = """SELECT p_name AS alias, CASE WHEN length(p_name) % 8 = 0 AND p_partkey % 2 = 0 THEN 'K' || md5(p_name)[1:6] ELSE 'S' || md5(p_name)[1:6] END AS skill_id,
 CASE WHEN length(p_name) % 8 = 0 THEN 'S' || md5(p_name)[1:6] ELSE '' END AS primary_id, (p_size > 45)::INT AS ambiguous, (p_partkey % 7 > 0)::INT AS is_active FROM part"""


def _aliases(s, d):
    h = F.substring(F.md5("p_name"), 1, 6)
    several = F.length("p_name") % 8 == 0
    return v.table(s, d, "part").select(
        F.col("p_name").alias("alias"), F.concat(F.when(several & (F.col("p_partkey") % 2 == 0), "K").otherwise("S"), h).alias("skill_id"),
        F.when(several, F.concat(F.lit("S"), h)).otherwise("").alias("primary_id"), (F.col("p_size") > 45).cast("int").alias("ambiguous"), (F.col("p_partkey") % 7 > 0).cast("int").alias("is_active"),
    )


_RESOLVED = f"al AS ({_ALIAS_SQL}), re AS (SELECT lower(alias) AS key, min(alias) AS alias, CASE WHEN min(skill_id) = max(skill_id) THEN min(skill_id) ELSE max(primary_id) END AS skill_id, max(ambiguous) AS ambiguous FROM al WHERE is_active = 1 GROUP BY 1)"


@query(f"WITH {_RESOLVED} SELECT * FROM re")
def X19_resolved_aliases(s, d):
    return skills.resolved(skills.active_aliases(_aliases(s, d)))


@query(f"WITH {_RESOLVED}, t AS (SELECT DISTINCT lower(p_type) AS key FROM part UNION SELECT lower(p_name) FROM part) SELECT key, skill_id FROM re UNION ALL SELECT key, 'legacy:' || key FROM t WHERE length(key) >= 2 AND key NOT IN (SELECT key FROM re)")
def X20_union_lexicon(s, d):
    parts = v.table(s, d, "part")
    terms = parts.select(F.col("p_type").alias("term")).union(parts.select("p_name"))
    return skills.union_lexicon(skills.resolved(skills.active_aliases(_aliases(s, d))), terms)


_TERM = "CASE WHEN p_partkey % 5 = 0 THEN 'x' WHEN p_partkey % 5 = 1 THEN p_type ELSE p_name END"


@query(f"""WITH {_RESOLVED}, t AS (SELECT p_partkey AS place, {_TERM} AS term, lower({_TERM}) AS key FROM part),
k AS (SELECT place, term, t.key, re.skill_id AS a, CASE WHEN length(t.key) < 2 THEN 'skipped_short' WHEN re.skill_id IS NOT NULL THEN 'covered_by_atier' WHEN row_number() OVER (PARTITION BY t.key ORDER BY place) = 1 THEN 'legacy_concept' ELSE 'duplicate_term' END AS disposition FROM t LEFT JOIN re ON re.key = t.key)
SELECT place, term, key, CASE WHEN disposition = 'skipped_short' THEN '' ELSE coalesce(a, 'legacy:' || key) END AS skill_id, disposition FROM k""")
def X20_term_dispositions(s, d):
    k = F.col("p_partkey")
    term = F.when(k % 5 == 0, "x").when(k % 5 == 1, F.col("p_type")).otherwise(F.col("p_name"))
    terms = v.table(s, d, "part").select(k.alias("place"), term.alias("term"))
    return skills.dispositions(terms, skills.resolved(skills.active_aliases(_aliases(s, d))))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(t, '人工智能|(^|[^a-z0-9])ai($|[^a-z0-9])') THEN 'AI' END, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])llms?($|[^a-z0-9])') THEN 'LLM' END], lambda x: x IS NOT NULL), '|') AS groups
 FROM (SELECT p_partkey, lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' AI' WHEN 1 THEN '人工智能' WHEN 2 THEN '-LLMs' ELSE 'ai' END AS t0, lower(t0) AS t FROM part) WHERE groups <> ''""")
def X21_tautologies(s, d):
    k = F.col("p_partkey") % 4
    key = F.concat(F.lower("p_name"), F.when(k == 0, " AI").when(k == 1, "人工智能").when(k == 2, "-LLMs").otherwise("ai"))
    return v.table(s, d, "part").select("p_partkey", F.array_join(tx.anchor_groups(key), "|").alias("groups")).where("groups <> ''")


@query("""WITH t AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, substr(a, i::INT, 2) AS g FROM (SELECT a, unnest(range(1, greatest(length(a), 2))) AS i FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT p_type AS q FROM part), h AS (SELECT q, substr(lower(q), i::INT, 2) AS g FROM (SELECT q, unnest(range(1, greatest(length(q), 2))) AS i FROM q) GROUP BY ALL)
SELECT query, alias, overlap, place FROM (SELECT q AS query, a AS alias, count(*) AS overlap, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, a) AS place FROM g JOIN h USING (g) GROUP BY q, a) WHERE place <= 10""")
def X25_overlap_retrieval(s, d):
    parts = v.table(s, d, "part")
    return matching.overlap_retrieval(parts.select(F.col("p_type").alias("query")).distinct(), parts.select(F.col("p_name").alias("alias")).distinct())


@query("SELECT term, count(*) AS posts FROM v_posts, (VALUES ('the'), ('license'), ('data'), ('absent')) AS t(term) WHERE contains(lower(description), term) GROUP BY term")
def J14_text_dictionary(s, d):
    found = F.filter(F.array(*map(F.lit, ("the", "license", "data", "absent"))), lambda t: F.contains(F.lower("description"), t))
    return v.posts(s, d).select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("posts"))


@query(f"SELECT alias, skill_id FROM ({_ALIAS_SQL}) WHERE is_active = 1 AND (length(trim(alias)) >= 2 OR lower(trim(alias)) = 'r') AND ambiguous = 0")
def R2_active_aliases(s, d):
    return skills.active_aliases(_aliases(s, d)).where("ambiguous = 0").select("alias", "skill_id")


@query("SELECT p_name AS alias, min(p_partkey) AS alias_id FROM part WHERE p_partkey % 7 = 0 GROUP BY 1")
def R3_inactive_candidates(s, d):
    return v.table(s, d, "part").where("p_partkey % 7 = 0").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("alias_id"))


@query("""SELECT count(*) AS n, sha256(count(*)::VARCHAR || '|' || sum(('0x' || h[1:12])::HUGEINT)::VARCHAR || '|' || sum(('0x' || h[13:24])::HUGEINT)::VARCHAR) AS registry_hash
 FROM (SELECT sha256(p_partkey::VARCHAR || chr(31) || p_name || chr(31) || p_type) AS h FROM part)""")
def R10_registry_hash(s, d):
    return skills.registry_hash(v.table(s, d, "part"), "p_partkey", "p_name", "p_type")


@query("SELECT lower(p_name) AS term FROM part UNION SELECT unnest(['large language model', 'prompt engineering', 'small ring'])")
def R11_candidate_terms(s, d):
    more = s.createDataFrame([("large language model",), ("prompt engineering",), ("small ring",)], "term string")
    return v.table(s, d, "part").select(F.lower("p_name").alias("term")).union(more).distinct()


@query(_ANNUAL + """SELECT p.skill_code, p.n_skill AS pooled_n, p.n_anchor / p.n_skill AS cooc, a.first_year FROM (SELECT * FROM c WHERE span = 'pooled' AND anchor = 'main') p
 JOIN (SELECT skill_code, min(year) AS first_year FROM c WHERE span = 'annual' AND anchor = 'main' GROUP BY 1) a USING (skill_code)""")
def R12_grade_inputs(s, d):
    main = _counts(s, d).where("anchor = 'main'")
    # both spans come from one aggregation
    pooled, annual = F.col("span") == "pooled", F.col("span") == "annual"
    out = main.groupBy("skill_code").agg(F.max(F.when(pooled, F.col("n_skill"))).alias("pooled_n"), F.max(F.when(pooled, F.col("n_anchor"))).alias("c"), F.min(F.when(annual, F.col("year"))).alias("first_year"))
    return out.select("skill_code", "pooled_n", (F.col("c") / F.col("pooled_n")).alias("cooc"), "first_year")


@query("SELECT word FROM (VALUES ('small ring'), ('quantum anchor'), ('red widget'), ('深度学习')) AS t(word) WHERE word NOT IN (SELECT lower(p_name) FROM part)")
def R19_missing_anchor_words(s, d):
    words = s.createDataFrame([("small ring",), ("quantum anchor",), ("red widget",), ("深度学习",)], "word string")
    return words.join(v.table(s, d, "part").select(F.lower("p_name").alias("word")).distinct(), "word", "left_anti")


@query("SELECT j.job_id, coalesce(m.occupation, j.platform) AS occupation, coalesce(m.category, '其他') AS category FROM v_jobs j LEFT JOIN (VALUES ('1-URGENT', 'urgent work', 'fast'), ('5-LOW', 'slow work', NULL)) AS m(platform, occupation, category) USING (platform)")
def R20_occupations(s, d):
    known = s.createDataFrame([("1-URGENT", "urgent work", "fast"), ("5-LOW", "slow work", None)], "platform string, occupation string, category string")
    both = v.jobs(s, d).select("job_id", "platform").join(F.broadcast(known), "platform", "left")  # a handful of fixed rows
    return both.select("job_id", F.coalesce("occupation", "platform").alias("occupation"), F.coalesce("category", F.lit("其他")).alias("category"))


@query(f"""WITH b AS (SELECT rid, (day - min(day) OVER (PARTITION BY rid)) // 7 AS bucket, day, event_id FROM v_visits), g AS (SELECT rid, bucket, count(*) AS records, max(day) - min(day) AS span FROM b GROUP BY ALL)
SELECT count(*) AS groups, sum(records)::BIGINT AS collapsed, max(records) AS largest, sum((span > 5)::INT)::BIGINT AS over_span FROM g""")
def R6_master_statistics(s, d):
    g = postings.bucketed(v.visits(s, d), 7)
    span = F.col("latest_day") - F.col("earliest_day")
    return g.agg(F.count("*").alias("groups"), F.sum("records").alias("collapsed"), F.max("records").alias("largest"), F.count_if(span > 5).alias("over_span"))


@query("""SELECT rule, broken FROM (SELECT 'buckets_hold_all_rows' AS rule, 0::BIGINT AS broken UNION ALL SELECT 'rule_one_within_share', (count(*) - count(DISTINCT rid) > 0.02 * count(*))::BIGINT FROM v_visits
 UNION ALL SELECT 'spans_within_days', (SELECT count(*) FROM (SELECT max(day) - min(day) AS span FROM (SELECT rid, day, (day - min(day) OVER (PARTITION BY rid)) // 7 AS b FROM v_visits) GROUP BY rid, b HAVING count(*) > 1) WHERE span > 4) UNION ALL SELECT 'canonical_rows_unique', 0)""")
def C13_dedup_invariants(s, d):
    rows = v.visits(s, d)
    return skills.dedup_invariants(rows, postings.rule_one(rows), postings.bucketed(rows, 7), span=4)


@query(_OMEGA + """, k AS (SELECT job_id, avg(round(omega, 6)) AS m, sum((round(omega, 6) >= 0.21)::INT) AS strong FROM v_pairs JOIN o USING (skill_code) GROUP BY 1)
SELECT j.job_id, coalesce(round(m, 6) >= 0.19 AND (strong >= 2 OR (strong >= 1 AND j.platform <> '5-LOW')), false) AS dual FROM v_jobs j LEFT JOIN k USING (job_id)""")
def C2_dual_rule(s, d):
    jobs, pairs = v.jobs(s, d), v.pairs(s, d)
    omega = ct.omega(jobs, pairs).select("skill_code", F.round("omega", 6).alias("omega"))
    own = pairs.join(omega, "skill_code").groupBy("job_id").agg(F.round(F.avg("omega"), 6).alias("m"), F.count_if(F.col("omega") >= 0.21).alias("strong"))
    business = F.col("platform") == "5-LOW"  # stands for business titles
    rule = (F.col("m") >= 0.19) & ((F.col("strong") >= 2) | ((F.col("strong") >= 1) & ~business))
    return jobs.select("job_id", "platform").join(own, "job_id", "left").select("job_id", F.coalesce(rule, F.lit(False)).alias("dual"))


@query("""WITH f AS (SELECT p_brand || ' ' || p_type AS alias, count(*) AS freq, count(DISTINCT p_size) > 12 AS several FROM part GROUP BY 1)
SELECT alias, freq, NOT several AND freq >= 5 AS is_active, CASE WHEN several THEN 'ambiguous' WHEN freq < 5 THEN 'below_frequency' ELSE 'activated' END AS reason FROM f""")
def C3_activation(s, d):
    f = v.table(s, d, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("alias")).agg(F.count("*").alias("freq"), F.countDistinct("p_size").alias("k"))
    return skills.activated(f.select("alias", "freq"), f.where("k > 12").select("alias"), 5)


@query(f"""WITH al AS ({_ALIAS_SQL}), am AS (SELECT alias FROM al GROUP BY 1 HAVING count(DISTINCT skill_id) > 1)
SELECT 'ids_present' AS rule, count(*) FILTER (skill_id IS NULL OR skill_id = '') AS broken FROM al UNION ALL SELECT 'ambiguous_not_active', count(*) FROM al JOIN am USING (alias) WHERE is_active = 1
UNION ALL SELECT 'short_not_active', count(*) FROM al WHERE is_active = 1 AND length(trim(alias)) <= 8 UNION ALL SELECT 'primary_known', count(*) FROM al WHERE primary_id <> '' AND primary_id NOT IN (SELECT skill_id FROM al)
UNION ALL SELECT 'active_not_fewer', greatest(0, 1000000 - count(*)) FROM al WHERE is_active = 1""")
def C4_freeze_checks(s, d):
    al = _aliases(s, d)
    several = al.groupBy("alias").agg((F.min("skill_id") < F.max("skill_id")).alias("several")).where("several").select("alias")
    active = al.where("is_active = 1")
    known = al.select(F.col("skill_id").alias("primary_id")).distinct()
    return skills.checked([
        ("ids_present", al, F.count_if(F.col("skill_id").isNull() | (F.col("skill_id") == ""))),
        ("ambiguous_not_active", active.join(several, "alias", "left_semi"), F.count("*")),
        ("short_not_active", active.where(F.length(F.trim("alias")) <= 8), F.count("*")),
        ("primary_known", al.where("primary_id <> ''").join(known, "primary_id", "left_anti"), F.count("*")),
        ("active_not_fewer", active, F.greatest(F.lit(0), 1_000_000 - F.count("*"))),
    ])


# grades of part names: by the number of parts of the name
_GRADES_SQL = "SELECT p_name AS term, CASE WHEN count(*) >= 34 THEN 'B' WHEN count(*) >= 30 THEN 'C' ELSE 'D' END AS grade, 'G' || md5(lower(p_name))[1:8] AS skill_id, count(*) AS df FROM part GROUP BY p_name"


def _grades(s, d):
    n = v.table(s, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("df"))
    grade = F.when(F.col("df") >= 34, "B").when(F.col("df") >= 30, "C").otherwise("D")
    return n.select("term", grade.alias("grade"), F.concat(F.lit("G"), F.substring(F.md5(F.lower("term")), 1, 8)).alias("skill_id"), "df")


@query(f"SELECT lower(trim(term)) AS key, skill_id FROM ({_GRADES_SQL}) WHERE grade <> 'D'")
def C5_governed_skills(s, d):
    return skills.governed(_grades(s, d))


@query(f"""WITH g AS ({_GRADES_SQL}), b AS (SELECT 'G' || md5(lower(p_name))[1:8] AS skill_id, min(p_name) AS name FROM part WHERE p_size < 3 GROUP BY 1)
SELECT skill_id, name, 'en' AS language, 'ascii_boundary' AS boundary, origin FROM (SELECT skill_id, name, 'base' AS origin FROM b UNION ALL SELECT skill_id, term, 'appended' FROM g WHERE grade <> 'D' AND skill_id NOT IN (SELECT skill_id FROM b))""")
def C6_formal_dictionary(s, d):
    base = v.table(s, d, "part").where("p_size < 3").groupBy(F.concat(F.lit("G"), F.substring(F.md5(F.lower("p_name")), 1, 8)).alias("skill_id")).agg(F.min("p_name").alias("name"))
    return skills.formal_dictionary(base, _grades(s, d))


@query("""WITH c AS (SELECT p_partkey AS skill_id, CASE p_partkey % 3 WHEN 0 THEN 'ESCO' WHEN 1 THEN 'ONET' ELSE '' END AS source, CASE WHEN p_size > 25 THEN 'v' || p_size ELSE '' END AS version, p_name AS source_id,
  CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS esco, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS onet FROM part),
r AS (SELECT skill_id, source AS source_name, coalesce(nullif(version, ''), 'UNKNOWN_LOCAL_SNAPSHOT') AS source_version, source_id AS source_skill_id, 'primary_source_record' AS mapping_type, 0 AS k FROM c
 UNION ALL SELECT skill_id, 'ESCO', CASE WHEN source = 'ESCO' THEN coalesce(nullif(version, ''), 'UNKNOWN_LOCAL_SNAPSHOT') ELSE 'UNKNOWN_LOCAL_SNAPSHOT' END, esco, 'source_crosswalk', 1 FROM c
 UNION ALL SELECT skill_id, 'O*NET', CASE WHEN source = 'ONET' THEN coalesce(nullif(version, ''), 'UNKNOWN_LOCAL_SNAPSHOT') ELSE 'UNKNOWN_LOCAL_SNAPSHOT' END, onet, 'source_crosswalk', 2 FROM c)
SELECT skill_id, source_name, source_skill_id, arg_min(source_version, k) AS source_version, arg_min(mapping_type, k) AS mapping_type FROM r WHERE source_name <> '' AND source_skill_id <> '' GROUP BY ALL""")
def C7_crosswalk(s, d):
    k = F.col("p_partkey")
    rows = v.table(s, d, "part").select(
        k.alias("skill_id"), F.when(k % 3 == 0, "ESCO").when(k % 3 == 1, "ONET").otherwise("").alias("source"), F.when(F.col("p_size") > 25, F.concat(F.lit("v"), F.col("p_size").cast("string"))).otherwise("").alias("version"),
        F.col("p_name").alias("source_id"), F.when(k % 3 == 0, F.col("p_name")).when(k % 4 == 0, "").otherwise(F.col("p_type")).alias("esco"), F.when(k % 5 > 0, F.col("p_brand")).alias("onet"),
    )
    return skills.crosswalk(rows)


@query(f"SELECT term, skill_id, grade, CASE WHEN grade IN ('A', 'B', 'C') THEN 'formal' ELSE 'candidate_d' END AS dictionary_status, df, 'v1' AS dictionary_version FROM ({_GRADES_SQL}) ORDER BY dictionary_status, grade, term")
def C8_changelog(s, d):
    status = F.when(F.col("grade").isin("A", "B", "C"), "formal").otherwise("candidate_d")
    return _grades(s, d).select("term", "skill_id", "grade", status.alias("dictionary_status"), "df", F.lit("v1").alias("dictionary_version")).orderBy("dictionary_status", "grade", "term")


@query(f"""WITH g AS ({_GRADES_SQL}), f AS (SELECT lower(p_name) AS key, sum(p_size)::BIGINT AS freq FROM part GROUP BY 1)
SELECT term, grade, freq FROM g JOIN f ON key = lower(term)""")
def R9_candidate_frequencies(s, d):
    f = v.table(s, d, "part").groupBy(F.lower("p_name").alias("key")).agg(F.sum("p_size").cast("bigint").alias("freq"))
    both = _grades(s, d).withColumn("key", F.lower("term")).join(f, "key", "left")
    lost = F.raise_error(F.concat(F.lit("a candidate without frequency: "), F.col("key"))).cast("bigint")
    return both.select("term", "grade", F.coalesce("freq", lost).alias("freq"))


@query(_FUSED + "SELECT city, year, count(*) AS total, sum(fused)::BIGINT AS fused_jobs, city < 'F' AS reused FROM fu GROUP BY city, year")
def R15_reused_panel(s, d):
    panel = lambda rows: rows.groupBy("city", "year").agg(F.count("*").alias("total"), F.sum("fused").cast("bigint").alias("fused_jobs"))
    rows = _fused(s, d)
    done = panel(rows.where("city < 'F'")).withColumn("reused", F.lit(True))
    rest = rows.join(F.broadcast(done.select("city").distinct()), "city", "left_anti")  # cities: a small fixed set
    return done.unionByName(panel(rest).withColumn("reused", F.lit(False)))


@query("""WITH m AS (SELECT (doc_id % 6)::INT AS round, count(*) FILTER (doc_id % 11 < 3) AS new_standard_concepts FROM documents GROUP BY 1) SELECT round, new_standard_concepts, CASE WHEN round > 0 THEN (round * 0.5)::DOUBLE END AS coverage_gain_pp FROM m""")
def R7_round_metrics(s, d):
    found = v.table(s, d, "documents").groupBy((F.col("doc_id") % 6).cast("int").alias("round")).agg(F.count_if(F.col("doc_id") % 11 < 3).alias("new_standard_concepts"))
    covered = s.createDataFrame([(k, k * 0.5) for k in range(1, 6)], "round int, coverage_gain_pp double")
    ends = found.agg(F.min("round").alias("lo"), F.max("round").alias("hi"), F.count("*").alias("k"))
    gap = (F.col("lo") != 0) | (F.col("hi") + 1 != F.col("k"))
    both = found.join(covered, "round", "left").join(F.broadcast(ends))  # one row
    return both.select(F.when(gap, F.raise_error(F.lit("rounds have gaps"))).otherwise(F.col("round")).cast("int").alias("round"), "new_standard_concepts", "coverage_gain_pp")
