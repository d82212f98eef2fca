"""Memories, entities, relations, questions and vectors derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1999-06-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER_COLUMNS = (
    "o_orderkey AS id", "o_orderkey AS seq", "array(replace(c_name, '#', '')) AS who",
    "concat(CASE o_orderstatus WHEN 'F' THEN 'order finished' WHEN 'O' THEN 'order still open' ELSE 'order not finished' END, ' priority ', lower(o_orderpriority)) AS what",
    "CASE WHEN o_totalprice > 300000 THEN 'large value' ELSE '' END AS why", "o_orderdate AS when_ts", "n_name AS place", "'' AS how",
    "least(1.0D, o_totalprice / 500000.0D) AS importance", "CAST(o_orderkey % 7 AS int) AS access_count",
    "CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + make_dt_interval(CAST(o_orderkey % 50 AS int)) END AS last_accessed", "o_orderdate AS created_at",
    "o_orderkey % 11 = 0 AS is_summary", "CASE WHEN o_orderkey % 13 = 0 THEN array(CAST(o_orderkey AS string)) ELSE CAST(array() AS array<string>) END AS consolidated_from",
    "CAST(NULL AS bigint) AS consolidated_into", "CAST(NULL AS string) AS lang",
)


def mem_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each order: who is its customer, where the customer's nation."""
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(read(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    return joined.selectExpr(*ORDER_COLUMNS)


def mem_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each document, with its whole text."""
    labels = read(spark, sf_dir, "labels")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id", "doc_id AS seq", "array(lang) AS who", "text AS what", "'docs' AS place",
        "CASE quality WHEN 1 THEN 0.8D WHEN 0 THEN 0.2D ELSE 0.5D END AS importance")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' taste for parts: returned lines speak against."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    return lines.selectExpr("o_custkey AS from_id", "'prefers' AS relation_type", "l_partkey AS to_id", "CASE l_returnflag WHEN 'R' THEN -1.0D WHEN 'A' THEN 0.0D ELSE 1.0D END AS polarity", "l_orderkey AS order_id", "l_linenumber AS line")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "'part' AS type", "p_name AS name", "array(p_brand, p_type) AS identifiers")


TEMPLATES = (
    ("en", "what is {}"), ("pt", "Quem é {}?"), ("es", "¿Quién es {}?"), ("en", "where does {} live?"), ("pt", "O que {} pediu?"),
    ("es", "¿Qué sabes sobre {}?"), ("auto", "why did {} order?"), ("pt", "o que você sabe sobre {}"), ("en", "when was order finished priority"),
    ("auto", "order not finished for {}"), ("pt", "quando foi order still open"), ("en", "where is the order"),
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each customer, by templates in turn."""
    n = F.col("c_custkey") % len(TEMPLATES)
    name = F.expr("replace(c_name, '#', '')")
    lang = F.element_at(F.array(*[F.lit(code) for code, _ in TEMPLATES]), (n + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(t) for _, t in TEMPLATES]), (n + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.replace(text, F.lit("{}"), name).alias("question"), lang.alias("lang"))
