"""Review and governance: dispositions, lift, coverage, samples with inclusion probabilities, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.functions import text as tx

# What counts as no answer in a covariate.
BLANKS = ["", "-", "不限", "面议"]


def ambiguity(aliases: DataFrame) -> DataFrame:
    """(alias, skill) -> (alias, skills, ambiguous): several skills, or a spelling of two characters or fewer."""
    out = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.countDistinct("skill").alias("skills"), F.bool_or(F.length("alias") <= 2).alias("short"))
    return out.select("alias", "skills", ((F.col("skills") > 1) | F.col("short")).alias("ambiguous"))


def disposition(tautology: Column, freq: Column, least: int = 100) -> Column:
    """Tautologies go first, then what is too rare."""
    return F.when(tautology, "removed_tautology").when(freq < least, "removed_lowfreq").otherwise("kept")


def newcomers(jobs: DataFrame, unit: str, year: int, least: int = 5) -> DataFrame:
    """Units without anchor postings before `year` and with `least` or more in all."""
    before = F.sum(F.when(F.col("year") < year, F.col("main")).otherwise(0))
    out = jobs.groupBy(unit).agg(F.sum("main").cast("bigint").alias("ai_posts"), before.alias("before"))
    return out.where((F.col("before") == 0) & (F.col("ai_posts") >= least)).select(unit, "ai_posts")


def lift(jobs: DataFrame, pairs: DataFrame, least: int = 100) -> DataFrame:
    """(skill_code, n, lift): the anchor rate of a skill's jobs over that of all jobs. The overall mean is one row."""
    own = pairs.join(jobs.select("job_id", "main"), "job_id").groupBy("skill_code").agg(F.count("*").alias("n"), F.avg("main").alias("r")).where(F.col("n") >= least)
    return own.join(F.broadcast(jobs.agg(F.avg("main").alias("m")))).select("skill_code", "n", F.round(F.col("r") / F.col("m"), 8).alias("lift")).orderBy(F.desc("lift"), "skill_code")


def curve(scores: DataFrame, threshold: float) -> DataFrame:
    """(year, n, zero, hi_all, hi_matched): shares over all jobs, and over those that have a score."""
    high = F.sum((F.coalesce("score", F.lit(0.0)) > threshold).cast("bigint"))
    out = scores.groupBy("year").agg(F.count("*").alias("n"), F.sum(F.col("zero_skill").cast("bigint")).alias("z"), high.alias("hi"), F.count("score").alias("m"))
    n = F.col("n")
    return out.select("year", "n", F.round(F.col("z") / n, 8).alias("zero"), F.round(F.col("hi") / n, 8).alias("hi_all"), F.round(F.col("hi") / F.nullif("m", F.lit(0)), 8).alias("hi_matched"))


def coverage(known: DataFrame, active: DataFrame, key: str) -> DataFrame:
    found = active.select(key).distinct().withColumn("found", F.lit(1))
    return known.join(found, key, "left").agg(F.count("*").alias("known"), F.count("found").alias("covered")).withColumn("coverage", F.col("covered") / F.col("known"))


def drawn(rows: DataFrame, stratum: str, key: str, quota: int, seed: str) -> DataFrame:
    """The `quota` rows of each stratum with the least keyed hash, and the probability that a row of it is drawn.

    Sizes come from an aggregation; ranking keeps the first `quota` of each partition before the shuffle."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(tx.hash63(F.concat(F.col(key).cast("string"), F.lit("|" + seed))), key))
    best = rows.withColumn("place", place).where(F.col("place") <= quota)
    return best.join(sizes, stratum).select(key, stratum, (F.least(F.lit(quota), F.col("n")) / F.col("n")).alias("inclusion"))


def gate(jobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule, broken): one row for each check that blocks a release; all must be 0."""

    def row(rule: str, df: DataFrame, broken: Column) -> DataFrame:
        return df.agg(broken.alias("broken")).select(F.lit(rule).alias("rule"), "broken")

    bad = ~F.col("main").isin(0, 1) | (F.col("babina") < F.col("main"))
    checks = [
        row("jobs_unique", jobs, F.count("*") - F.countDistinct("job_id")),
        row("pairs_unique", pairs, F.count("*") - F.countDistinct("job_id", "skill_code")),
        row("pairs_have_jobs", pairs.join(jobs.select("job_id"), "job_id", "left_anti"), F.count("*")),
        row("anchors_binary", jobs.where(bad), F.count("*")),
    ]
    return reduce(DataFrame.unionByName, checks)


def present(col: str, sentinel: str) -> Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(sentinel))


def completeness(*cols: str) -> Column:
    """How many of the columns have an answer."""
    return reduce(lambda a, b: a + b, [F.coalesce(~F.trim(c).isin(BLANKS), F.lit(False)).cast("int") for c in cols])
