"""Integer skill x anchor counts, rates, scores and their variants. Ratios come last; counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHORS = ("main", "cn_paper", "babina")


def annual(jobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(skill_code, year, n_skill, c_main, c_cn_paper, c_babina): one pass and one partial aggregation for all anchors."""
    flags = jobs.select("job_id", "year", *ANCHORS)
    both = pairs.select("job_id", "skill_code").join(flags, "job_id")
    return both.groupBy("skill_code", "year").agg(F.count("*").alias("n_skill"), *[F.sum(a).cast("bigint").alias(f"c_{a}") for a in ANCHORS])


def _long(wide: DataFrame, window: str, *ends: Column) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("anchor"), F.col(f"c_{a}").alias("n_anchor")) for a in ANCHORS])).alias("x")
    low, high = ends or (F.col("year"), F.col("year"))
    return wide.select("skill_code", "year", F.lit(window).alias("span"), low.alias("window_start"), high.alias("window_end"), "n_skill", cells).select("skill_code", "year", "span", "window_start", "window_end", "n_skill", "x.anchor", "x.n_anchor")


def counts(jobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """All spans: annual; pooled (year -1); roll3, years y-1..y+1 cut at the ends, for every year in which that window has the skill.

    Pooled and rolled counts are sums of the small annual table, not further passes over jobs.
    """
    base = annual(jobs, pairs)
    sums = [F.sum(c).alias(c) for c in ("n_skill", *(f"c_{a}" for a in ANCHORS))]
    ends = jobs.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    pooled = base.groupBy("skill_code").agg(*sums).withColumn("year", F.lit(-1)).join(F.broadcast(ends))  # one row
    moved = base.withColumn("year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    rolled = moved.groupBy("skill_code", "year").agg(*sums).join(F.broadcast(ends)).where("year between lo and hi")
    roll_ends = F.greatest(F.col("year") - 1, F.col("lo")), F.least(F.col("year") + 1, F.col("hi"))
    return _long(base, "annual").union(_long(pooled, "pooled", F.col("lo"), F.col("hi"))).union(_long(rolled, "roll3", *roll_ends))


def broken(found: DataFrame) -> DataFrame:
    """Invariants of counts and how many cells break each: (rule, n)."""
    cells = found.groupBy("skill_code", "year", "span", "anchor").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
    over = found.where("n_anchor > n_skill or n_skill <= 0").agg(F.count("*").alias("n")).select(F.lit("bounds").alias("rule"), "n")
    summed = found.where("span = 'annual'").groupBy("skill_code", "anchor").agg(F.sum("n_skill").alias("s"), F.sum("n_anchor").alias("c"))
    off = found.where("span = 'pooled'").join(summed, ["skill_code", "anchor"], "full_outer")
    off = off.where("not (coalesce(s, 0) <=> coalesce(n_skill, 0) and coalesce(c, 0) <=> coalesce(n_anchor, 0))")
    return cells.union(over).union(off.agg(F.count("*").alias("n")).select(F.lit("pooled").alias("rule"), "n"))


def rates(found: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    n, c = F.col("n_skill"), F.col("n_anchor")
    return found.withColumns({"rate_raw": c / n, "rate_smoothed": (c + alpha) / (n + alpha + beta), "rare_lt10": n < 10, "rare_lt20": n < 20, "rare_lt50": n < 50})


def weights(found: DataFrame, span: str, anchor: str) -> DataFrame:
    return rates(found.where((F.col("span") == span) & (F.col("anchor") == anchor))).select("skill_code", "year", F.col("rate_smoothed").alias("w"))


def scores(jobs: DataFrame, pairs: DataFrame, found: DataFrame, anchor: str = "main", span: str = "annual") -> DataFrame:
    """(job_id, year, matched, weighted, score, zero_skill): mean weight of distinct skills; null without skills."""
    w = weights(found, span, anchor)
    if span == "pooled":
        w = w.drop("year")
    rows = pairs.select("job_id", "skill_code").join(jobs.select("job_id", "year"), "job_id").join(w, ["skill_code"] + ["year"] * (span != "pooled"), "left")
    own = rows.groupBy("job_id").agg(F.count("*").alias("matched"), F.count("w").alias("weighted"), F.avg("w").alias("score"))
    return jobs.select("job_id", "year").join(own, "job_id", "left").select("job_id", "year", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("weighted", F.lit(0)).alias("weighted"), "score", F.col("matched").isNull().alias("zero_skill"))


def flagged(scored: DataFrame, thresholds: tuple[float, ...] = (0.05, 0.15, 0.2)) -> DataFrame:
    """Strictly over the threshold; a missing score is false."""
    return scored.withColumns({f"flag_{round(t * 100):03d}": F.coalesce(F.col("score") > t, F.lit(False)) for t in thresholds})


def leave_one_firm_out(jobs: DataFrame, pairs: DataFrame, anchor: str = "main") -> DataFrame:
    """(job_id, loo_score, loo_skills): each job's pooled rates without its own firm's jobs; firms that are all of a skill have none."""
    rows = pairs.select("job_id", "skill_code").join(jobs.select("job_id", "company_id", F.col(anchor).alias("hit")), "job_id")
    firm = rows.groupBy("skill_code", "company_id").agg(F.count("*").alias("fn"), F.sum("hit").alias("fc"))
    whole = firm.groupBy("skill_code").agg(F.sum("fn").alias("n"), F.sum("fc").alias("c"))
    rest = firm.join(whole, "skill_code").select("skill_code", "company_id", F.when(F.col("n") > F.col("fn"), (F.col("c") - F.col("fc")) / (F.col("n") - F.col("fn"))).alias("w"))
    return rows.join(rest, ["skill_code", "company_id"]).groupBy("job_id").agg(F.avg("w").alias("loo_score"), F.count("w").alias("loo_skills"))


def omega(jobs: DataFrame, pairs: DataFrame, anchor: str = "main", min_count: int = 20) -> DataFrame:
    """(skill_code, n, c, omega, ratio, laplace): share of the skill's jobs with an anchor, its likelihood ratio, Laplace ratio."""
    rows = pairs.select("job_id", "skill_code").join(jobs.select("job_id", F.col(anchor).alias("hit")), "job_id")
    total = jobs.agg(F.sum(anchor).alias("ta"), F.count("*").alias("t"))
    own = rows.groupBy("skill_code").agg(F.count("*").alias("n"), F.sum("hit").alias("c")).where(F.col("n") >= min_count).join(F.broadcast(total))  # one row
    off = F.col("n") - F.col("c")
    ratio = (F.col("c") / F.col("ta")) / ((off + 1) / (F.col("t") - F.col("ta") + 1))
    laplace = ((F.col("c") + 1) / (F.col("ta") + 2)) / ((off + 1) / (F.col("t") - F.col("ta") + 2))
    return own.select("skill_code", "n", "c", (F.col("c") / F.col("n")).alias("omega"), ratio.alias("ratio"), (laplace / (1 + laplace)).alias("laplace"))


def half_up(a: Column, b: Column) -> Column:
    """a / b to the nearest integer, halves up, for integers not below zero: exact, whatever the order in which a was summed."""
    return F.call_function("div", 2 * a + b, 2 * b)


def fused(jobs: DataFrame, pairs: DataFrame, known: DataFrame, mean: float = 0.19, most: float = 0.21) -> DataFrame:
    """(job_id, a, b, fused): a is the anchor itself, b holds if known skills' omegas average `mean` and one reaches `most`."""
    own = pairs.join(known.select("skill_code", "omega"), "skill_code").groupBy("job_id").agg(((F.avg("omega") >= mean) & (F.max("omega") >= most)).cast("int").alias("b"))
    b = F.coalesce("b", F.lit(0))
    return jobs.join(own, "job_id", "left").select("job_id", "city", "industry", "year", "month", "company_id", F.col("main").alias("a"), b.alias("b"), F.greatest("main", b).alias("fused"))


def firm_first(firms: DataFrame) -> DataFrame:
    """(recruit_id, company_id): the first row of each recruit_id under a total order."""
    return firms.groupBy("recruit_id").agg(F.min("company_id").alias("company_id"))


def firm_unique(firms: DataFrame) -> DataFrame:
    """(recruit_id, company_id): the only company of each recruit_id, else null."""
    own = firms.groupBy("recruit_id").agg(F.min("company_id").alias("lo"), F.max("company_id").alias("hi"))
    return own.select("recruit_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("company_id"))


def ranked(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """rows with rn, their place within keys."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
