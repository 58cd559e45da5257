"""More named queries: samples of scans, files as sources and sinks, releases and resumed units. Registered beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.operators import counts as ct
from laborlens.operators import drawing, skills
from laborlens.plans.registry import _ANNUAL, _FUSED, _OMEGA, _counts, _fused, query
from laborlens.sources import files
from laborlens.sources import views as v

_H = "sha256({0}::VARCHAR || '|{1}')"


@query(f"SELECT job_id, city FROM v_jobs WHERE ('0x' || {_H.format('job_id', 's8')}[1:8])::BIGINT < 429496729")
def S8_share_of_rows(s, d):
    return drawing.share(v.jobs(s, d).select("job_id", "city"), "job_id", 10, "s8")


@query(f"SELECT year, job_id FROM (SELECT year, job_id, row_number() OVER (PARTITION BY year ORDER BY {_H.format('job_id', 's9')}, job_id) AS k FROM v_jobs) WHERE k <= 50")
def S9_rows_per_year(s, d):
    return drawing.each(v.jobs(s, d).select("year", "job_id"), ["year"], "job_id", 50, "s9")


@query(f"""SELECT recruit_id, platform, y FROM (SELECT recruit_id, platform, y, row_number() OVER (PARTITION BY platform, y ORDER BY {_H.format('recruit_id', 's10')}, recruit_id) AS k
 FROM (SELECT recruit_id, platform, substr(publish_time, 1, 4)::INT AS y FROM v_posts WHERE regexp_matches(lower(description), 'license|data'))) WHERE k <= 2""")
def S10_prefiltered_sample(s, d):
    rows = v.posts(s, d).where(F.lower("description").rlike("license|data"))
    return drawing.each(rows.select("recruit_id", "platform", F.substring("publish_time", 1, 4).cast("int").alias("y")), ["platform", "y"], "recruit_id", 2, "s10")


@query("SELECT job_id, city FROM (SELECT job_id, city, row_number() OVER (ORDER BY city, job_id) AS k FROM v_jobs) WHERE k <= 2500")
def S11_capped_load(s, d):
    return drawing.capped(v.jobs(s, d).select("job_id", "city"), "city", "job_id", 2500)


@query("SELECT p_partkey AS alias_id, p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '\"x\", y' ELSE '' END AS alias, p_size AS n FROM part")
def S12_csv_dictionary(s, d):
    """The dictionary is written as one CSV file with quotes and line feeds in values, and read back after its digest, rows and active rows are checked."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, '\n"x", y').otherwise(""))
    rows = v.table(s, d, "part").select(F.col("p_partkey").alias("alias_id"), name.alias("alias"), F.col("p_size").alias("n"))
    path = files.shared_folder(s)
    rows.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    digest = s.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return files.csv_dictionary(s, path, "alias_id bigint, alias string, n int", digest, rows.count(), "n > 10")


@query("SELECT DISTINCT lower(p_type) AS term, CASE p_type[1:1] WHEN 'E' THEN 1.5 ELSE 3.0 END::DOUBLE AS weight FROM part")
def S13_term_file(s, d):
    kinds = v.table(s, d, "part").select(F.lower("p_type").alias("t")).distinct()
    lines = kinds.select(F.when(F.col("t").startswith("e"), F.concat("t", F.lit(" | 1.5"))).otherwise(F.concat("t", F.lit("|"))).alias("value"))
    path = files.shared_folder(s)
    lines.union(s.createDataFrame([("# a remark",), ("",), ("   ",)], "value string")).write.text(path)
    return skills.weighted_terms(s.read.text(path))


@query("SELECT lower(p_type) AS term FROM part UNION SELECT lower(p_name) FROM part WHERE p_size > 20 UNION SELECT unnest(['ai', 'llm'])")
def S14_merged_terms(s, d):
    parts = v.table(s, d, "part")
    own = parts.select(F.lower("p_type").alias("term")).union(parts.where("p_size > 20").select(F.lower("p_name")))
    return own.union(s.createDataFrame([("ai",), ("llm",)], "term string")).distinct()


@query("SELECT conv_id, turn, role FROM conversations")
def S15_json_lines(s, d):
    """Turns as JSON lines, the texts' line separators other than line feeds kept; each file ends in a line that its writer did not finish."""
    path = files.shared_folder(s)
    turns = v.table(s, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("  "), F.coalesce("text", F.lit(""))).alias("text"))
    turns.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    files.Store(s).write(f"{path}/part-torn.txt", '{"conv_id": -1, "tu')
    return files.json_lines(s, path, "conv_id bigint, turn bigint, role string, text string", torn=True).select("conv_id", "turn", "role")


@query(_ANNUAL + "SELECT * FROM c")
def S16_published_counts(s, d):
    path = files.shared_folder(s)
    files.published(_counts(s, d), path, "v1", ["span"])
    # the second call finds the stamp and reads what is there
    return files.published(_counts(s, d), path, "v1").select("skill_code", "year", "span", "window_start", "window_end", "n_skill", "anchor", "n_anchor")


@query(_FUSED + "SELECT industry, year, count(*) AS total, sum(fused)::BIGINT AS fused_jobs FROM fu GROUP BY industry, year HAVING count(*) >= 400")
def S18_results_table(s, d):
    cells = _fused(s, d).groupBy("industry", "year").agg(F.count("*").alias("total"), F.sum("fused").cast("bigint").alias("fused_jobs"))
    path = files.shared_folder(s)
    again = lambda: files.results(cells, path, d, "total", 400, F.col("year") == 0, 0)
    again()
    return again()


@query("SELECT city, year, count(*) AS jobs FROM v_jobs GROUP BY ALL")
def S19_report(s, d):
    """A report as CSV in UTF-8 with its mark, read back."""
    path = files.shared_folder(s)
    own = v.jobs(s, d).groupBy("city", "year").agg(F.count("*").alias("jobs"))
    files.Store(s).write(f"{path}/report.csv", "﻿" + own.toPandas().to_csv(index=False))  # one row a city and year
    return s.read.option("header", True).schema("city string, year int, jobs bigint").csv(f"{path}/report.csv")


_MERGED = _ANNUAL + """, sc AS (SELECT job_id, anchor, span, avg((n_anchor + 0.5) / (n_skill + 1.0)) AS score FROM v_pairs JOIN v_jobs j USING (job_id) JOIN c USING (skill_code) WHERE (span = 'annual' AND c.year = j.year) OR span = 'pooled' GROUP BY ALL)
"""


@query(_MERGED + "SELECT anchor, span, count(*) AS jobs, round(sum(round(score, 6)), 4) AS total FROM sc GROUP BY ALL")
def S21_merged_scores(s, d):
    """Scores of every anchor and span, each a partition of one table, read as one."""
    jobs, pairs, path = v.jobs(s, d), v.pairs(s, d), files.shared_folder(s)
    found = files.published(ct.counts(jobs, pairs), f"{path}/counts", "v1")
    for anchor in ct.ANCHORS:
        for span in ("annual", "pooled"):
            ct.scores(jobs, pairs, found, anchor, span).where("matched > 0").select("job_id", "score").write.parquet(f"{path}/scores/anchor={anchor}/span={span}")
    return s.read.parquet(f"{path}/scores").groupBy("anchor", "span").agg(F.count("*").alias("jobs"), F.round(F.sum(F.round("score", 6)), 4).alias("total"))


@query("SELECT 'nations' AS name, count(*) AS n FROM nation UNION ALL SELECT 'parts', count(*) FROM part")
def S22_S23_S24_manifest(s, d):
    """Two tables, their manifest, and the gate that compares its digests with those taken again."""
    tables = {"nations": v.table(s, d, "nation"), "parts": v.table(s, d, "part")}
    rows = {r.name: r for r in files.manifest(tables).collect()}
    again = {r.name: r.digest for r in files.manifest({k: t.repartition(3) for k, t in tables.items()}).collect()}
    files.gate({"status": "complete", "digests": {k: r.digest for k, r in rows.items()}}, again)
    return s.createDataFrame([(k, r.n) for k, r in rows.items()], "name string, n bigint")


@query(_OMEGA + "SELECT skill_code, n, c FROM o")
def S25_release(s, d):
    path = files.shared_folder(s)
    own = ct.omega(v.jobs(s, d), v.pairs(s, d)).select("skill_code", "n", "c")
    files.release({"omega": own.where("n < 0"), "nations": v.table(s, d, "nation")}, path, {"run": 1})
    return files.release({"omega": own, "nations": v.table(s, d, "nation")}, path, {"run": 2})["omega"]


@query("SELECT platform, year, count(*) AS jobs, sum(main)::BIGINT AS hits FROM v_jobs GROUP BY ALL")
def ST2_resumed_units(s, d):
    """One table for each platform; the second run finds those of the first and computes the rest."""
    jobs, path, asked = v.jobs(s, d), files.shared_folder(s), []
    units = [r.platform for r in jobs.select("platform").distinct().collect()]  # a handful

    def one(unit):
        asked.append(unit)
        return jobs.where(F.col("platform") == unit).groupBy("platform", "year").agg(F.count("*").alias("jobs"), F.sum("main").cast("bigint").alias("hits"))

    files.resumed(s, path, units[:2], "v1", one)
    out = files.resumed(s, path, units, "v1", one)
    if len(asked) != len(units):
        raise ValueError("a unit was computed twice")
    return out
