"""Postings: deduplication, sampling, governance, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.functions import text as tx


def bad_day(rows: DataFrame) -> Column:
    """Whether a row's day is before the first day or missing."""
    return F.coalesce(F.col("day") < 0, F.lit(True))


def preferred(rows: DataFrame) -> Column:
    """A struct that is least for the row to keep: the most complete (`comp`), of the longest text (`dlen`), of a good day, the earliest, of the
    least event_id. Tables without comp or dlen are judged by the rest; a row whose comp or dlen is null comes last."""
    sizes = [x for c in ("comp", "dlen") if c in rows.columns for x in (F.col(c).isNull().alias(f"no_{c}"), (-F.col(c)).alias(c))]
    return F.struct(*sizes, bad_day(rows).alias("bad"), "day", "event_id")


def rule_one(visits: DataFrame) -> DataFrame:
    """(rid, day, event_id, rule1_dups): the preferred row of each rid, and how many it stands for beyond itself.
    A minimum of a struct, so that a hot rid is aggregated before the shuffle."""
    return visits.groupBy("rid").agg(F.min(preferred(visits)).alias("x"), (F.count("*") - 1).alias("rule1_dups")).select("rid", "x.day", "x.event_id", "rule1_dups")


def bucketed(visits: DataFrame, width: int) -> DataFrame:
    """(rid, bucket, records, earliest_day, latest_day, canonical): buckets of `width` days counted from the first day of each rid, bad
    days included; each row of a bad day has the bucket 999999 + its place among the rid's rows by event_id. Only rids with such rows are sorted."""
    first = visits.groupBy("rid").agg(F.min("day").alias("first"), F.max(bad_day(visits)).alias("some_bad"))
    rows = visits.join(first, "rid")
    counted = F.floor((F.col("day") - F.col("first")) / width).cast("int")
    place = F.row_number().over(Window.partitionBy("rid").orderBy("event_id"))
    good = rows.where(~F.col("some_bad")).withColumn("bucket", counted)
    mixed = rows.where("some_bad").withColumn("place", place).withColumn("bucket", F.when(bad_day(rows), 999_999 + F.col("place")).otherwise(counted)).drop("place")
    both = good.unionByName(mixed)
    best = F.min(preferred(both))
    return both.groupBy("rid", "bucket").agg(F.count("*").alias("records"), F.min("day").alias("earliest_day"), F.max("day").alias("latest_day"), best.alias("best")).select("rid", "bucket", "records", "earliest_day", "latest_day", F.col("best.event_id").alias("canonical"))


def admitted(posts: DataFrame) -> DataFrame:
    return posts.where("recruit_id is not null and description is not null and position is not null and position <> '' and length(trim(description)) >= 10")


def canonical(posts: DataFrame) -> DataFrame:
    """(text_hash, canonical_id, records, platforms): one posting for each text without white space."""
    keyed = posts.select("recruit_id", "platform", tx.hash63(tx.squeezed(F.col("description"))).alias("text_hash"))
    return keyed.groupBy("text_hash").agg(F.min("recruit_id").alias("canonical_id"), F.count("*").alias("records"), F.countDistinct("platform").alias("platforms"))


def largest_remainder(strata: DataFrame, total: int) -> DataFrame:
    """(stratum, n) -> (stratum, n, quota): proportional shares that add up to min(total, sum of n); leftovers go to the largest remainders."""
    whole = strata.agg(F.sum("n").alias("all"))
    got = F.least(F.lit(total), F.col("all"))
    exact = strata.join(F.broadcast(whole)).select("stratum", "n", F.floor(got * F.col("n") / F.col("all")).cast("bigint").alias("base"), ((got * F.col("n")) % F.col("all")).alias("rest"), got.alias("got"))
    left = F.col("got") - F.sum("base").over(Window.partitionBy(F.lit(1)))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "stratum"))
    return exact.select("stratum", "n", (F.col("base") + (order <= left).cast("int")).alias("quota"))


def sampled(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: str = "42") -> DataFrame:
    """The `quota` rows of each stratum whose keyed hash is least: the same rows at every run."""
    draw = tx.hash63(F.concat(F.col(key).cast("string"), F.lit("|" + seed)))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))
    return rows.withColumn("place", place).join(quotas.select(F.col("stratum").alias(stratum), "quota"), stratum).where("place <= quota").drop("place", "quota")


def agreement(gold: DataFrame, *by: str) -> DataFrame:
    """Confusion cells, agreement and Cohen's kappa of raters a and b."""
    cells = gold.groupBy(*by).agg(*[F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("bigint")).alias(f"n{x}{y}") for x in (0, 1) for y in (0, 1)])
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    chance = ((F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11")) + (F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10"))) / (n * n)
    seen = (F.col("n00") + F.col("n11")) / n
    return cells.withColumns({"agreement": F.round(seen, 8), "kappa": F.round(F.when(chance < 1, (seen - chance) / (1 - chance)), 8)})


def graded(terms: DataFrame) -> DataFrame:
    """(df, cooc, first_year) -> grade by document frequency, co-occurrence and age."""
    df = F.col("df")
    grade: Column = F.when(df >= 100, "B").when(df >= 10, "C").when((df >= 5) & ((F.col("cooc") >= 0.5) | (F.col("first_year") >= 2019)), "C").otherwise("D")
    return terms.withColumn("grade", grade)


def frequency_band(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 5, "1-4").when(n < 10, "5-9").when(n < 20, "10-19").when(n < 100, "20-99").when(n < 1000, "100-999").otherwise(">=1000")
