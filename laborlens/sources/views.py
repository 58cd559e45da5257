"""Adapter views: the test tables seen as postings, skills, firms, texts and judgements; the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, year, month, company_id, city, industry, platform, anchor_main, anchor_cn_paper, anchor_babina)"""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations, a fixed table
        .select(
            F.col("o_orderkey").alias("job_id"),
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
            F.col("o_custkey").alias("company_id"),
            F.col("n_name").alias("city"),
            F.col("c_mktsegment").alias("industry"),
            F.col("o_orderpriority").alias("platform"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("main"),
            (F.col("o_orderstatus") == "F").cast("int").alias("cn_paper"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("babina"),
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (job_id, skill_code, tier)"""
    code = (F.col("l_partkey") % 40).cast("int")
    found = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("job_id"), code.alias("skill_code")).distinct()
    return found.withColumn("tier", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("skill_code") % 3 + 1))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recruit_id, platform, city, description, publish_time, company_id, position)"""
    day = F.date_add(F.lit("2014-01-01").cast("date"), (F.col("doc_id") * 37 % 4000).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("recruit_id"), F.col("source").alias("platform"), F.col("lang").alias("city"), F.col("text").alias("description"),
        F.date_format(day, "yyyy-MM-dd").alias("publish_time"), (F.col("doc_id") % 50).alias("company_id"), F.substring("text", 1, 30).alias("position"),
    )


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recruit_id, company_id): not unique by recruit_id"""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recruit_id"), F.col("l_suppkey").alias("company_id"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, day, event_id, value): the event stream as repeated postings"""
    day = F.datediff("ts", F.lit("2024-01-01"))
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("rid"), day.alias("day"), "event_id", "value")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a, b, n_chars): two binary raters"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("a"), (F.col("n_chars") > 1475).cast("int").alias("b"), "n_chars", "lang")


SQL = {
    "v_jobs": """SELECT o_orderkey AS job_id, year(o_orderdate) AS year, month(o_orderdate) AS month, o_custkey AS company_id, n_name AS city,
  c_mktsegment AS industry, o_orderpriority AS platform, (o_orderpriority = '1-URGENT')::INT AS main, (o_orderstatus = 'F')::INT AS cn_paper,
  (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS babina
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_pairs": """SELECT DISTINCT l_orderkey AS job_id, (l_partkey % 40)::INT AS skill_code, ['A','B','C'][(l_partkey % 40 % 3 + 1)::INT] AS tier
  FROM lineitem WHERE l_discount > 0.05""",
    "v_posts": """SELECT doc_id AS recruit_id, source AS platform, lang AS city, text AS description,
  strftime(DATE '2014-01-01' + (doc_id * 37 % 4000)::INT, '%Y-%m-%d') AS publish_time, doc_id % 50 AS company_id, substring(text, 1, 30) AS position FROM documents""",
    "v_firms": "SELECT l_orderkey AS recruit_id, l_suppkey AS company_id FROM lineitem",
    "v_visits": "SELECT event_type || user_id::VARCHAR AS rid, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, event_id, value FROM events",
    "v_gold": "SELECT doc_id, quality AS a, (n_chars > 1475)::INT AS b, n_chars, lang FROM labels JOIN documents USING (doc_id)",
}


def with_views(sql: str) -> str:
    """sql with the views that it names as common table expressions before its own."""
    used = [f"{k} AS ({v})" for k, v in SQL.items() if k in sql]
    sql = sql.strip()
    if not used:
        return sql
    own = sql.removeprefix("WITH ")
    return "WITH " + ",\n".join(used) + (",\n" if own != sql else "\n") + own
