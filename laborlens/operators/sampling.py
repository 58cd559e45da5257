"""Samples for discovery rounds: quotas by stratum, rounds without repetition, saturation, blind pools.

Ranks come from hashes of the id, so that a sample does not depend on how rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least quota of an industry, stopping points of the rounds, shares of a round's parts.
INDUSTRY_FLOOR = 50
NEW_CONCEPTS_STOP, COVERAGE_STOP, UNCOVERED_STOP = 5, 0.1, 0.1
ROUND_PARTS = [("low_coverage", 0.4), ("main_anchor", 0.3), ("general", 0.3)]


def place(key: Column, seed: str) -> Column:
    """A repeatable random order of keys."""
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(seed)), 256)


def industry_quota(sizes: DataFrame, period: str, stratum: str, n: int) -> DataFrame:
    """(period, stratum, n) -> with quota: each stratum gets up to INDUSTRY_FLOOR; what is left goes in proportion to the
    remaining rows, rounding losses to the largest. Floors over n in all are cut, the smallest strata first."""
    by_size = Window.partitionBy(period).orderBy(F.desc("n"), stratum)
    whole = Window.partitionBy(period)
    s = sizes.withColumn("__floor", F.least("n", F.lit(INDUSTRY_FLOOR)))
    s = s.withColumn("__before", F.sum("__floor").over(by_size) - F.col("__floor")).withColumn("__floors", F.sum("__floor").over(whole))
    s = s.withColumn("__rest", F.col("n") - F.col("__floor"))
    s = s.withColumn("__rests", F.sum("__rest").over(whole)).withColumn("__spare", F.least(F.lit(n) - F.col("__floors"), F.col("__rests")))
    s = s.withColumn("__share", F.when(F.col("__spare") > 0, F.expr("__spare * __rest div __rests")).otherwise(0))
    s = s.withColumn("__short", F.col("__spare") - F.sum("__share").over(whole)).withColumn("__k", F.row_number().over(by_size))
    more = ((F.col("__spare") > 0) & (F.col("__rest") > 0) & (F.col("__k") <= F.col("__short"))).cast("bigint")
    cut = F.greatest(F.lit(0), F.least("__floor", F.lit(n) - F.col("__before")))
    return s.select(period, stratum, "n", F.when(F.col("__floors") >= n, cut).otherwise(F.col("__floor") + F.col("__share") + more).cast("bigint").alias("quota"))


def round_sample(pool: DataFrame, n: int, seed: str) -> DataFrame:
    """(job_id, matched, main) -> (job_id, component): 40 % without a match, 30 % with the anchor, 30 % of any kind, none twice;
    what the parts lack is filled from the rest. Each pick is a top-k of n rows or fewer, so only those are ever joined."""
    pool = pool.withColumn("place", place(F.col("job_id"), seed))
    wanted = {"low_coverage": F.col("matched") <= 0, "main_anchor": F.col("main") == 1, "general": F.lit(True)}
    taken = None
    for name, share in [*ROUND_PARTS, ("quota_shortfall_fill", None)]:
        free = pool.where(wanted.get(name, F.lit(True)))
        if taken is not None:
            free = free.join(F.broadcast(taken.select("job_id")), "job_id", "left_anti")  # n ids at most
        take = round(n * share) if share else n - taken.count()
        part = free.orderBy("place", "job_id").limit(take).select("job_id", F.lit(name).alias("component"))
        taken = part if taken is None else taken.union(part)
    return taken


def saturated(rounds: DataFrame) -> DataFrame:
    """(round, new_concepts, coverage_gain, uncovered) -> (round, saturated): this round and the one before, of consecutive
    numbers over 0, have few new concepts and little gain, and the uncovered share stops falling. Unknown figures say no."""
    before = Window.orderBy("round")  # one row a round: a handful of rows
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    r = rounds.where("round > 0").select("round", "new_concepts", known("coverage_gain").alias("gain"), known("uncovered").alias("open"))
    quiet = (F.col("new_concepts") < NEW_CONCEPTS_STOP) & (F.col("gain") < COVERAGE_STOP)
    r = r.withColumn("quiet", quiet)
    was = lambda c: F.lag(c).over(before)
    good = F.col("quiet") & was("quiet") & (was("round") == F.col("round") - 1) & (was("open") - F.col("open") < UNCOVERED_STOP)
    return r.select("round", F.coalesce(good, F.lit(False)).alias("saturated"))


def blind_pools(rows: DataFrame, key: str, old: Column, new: Column, per: int) -> DataFrame:
    """(key, in_old, in_new): `per` rows drawn from each pool, merged."""
    draw = lambda pool, name: rows.where(pool).orderBy(place(F.col(key), name), key).limit(per).select(key, F.lit(True).alias(f"in_{name}"))
    both = draw(old, "old").join(draw(new, "new"), key, "full_outer")
    return both.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_old", "in_new")])
