"""Engine tables from Parquet: plain reads, and adapters that name columns as the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(id, file_path, content, language, source, n_chars)."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"),
        F.col("lang").alias("language"), "source", "n_chars",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding, label)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """(log_id, created_at, session_id, provider, status, duration, tokens): calls, executions or retrievals."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("session_id"), F.col("event_type").alias("provider"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("duration"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """(tenant_id, resource, used, cost, used_at): quota usage, from order lines and their orders."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return rows.select(
        F.col("o_custkey").alias("tenant_id"), F.col("l_returnflag").alias("resource"), F.col("l_quantity").alias("used"), F.col("l_extendedprice").alias("cost"),
        F.col("o_orderdate").cast("timestamp").alias("used_at"),
    )


def tenants(spark: SparkSession, folder: str) -> DataFrame:
    """(tenant_id, name, plan, nation)."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("plan"), F.col("c_nationkey").alias("nation")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, role, content)."""
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query): the benchmark items, whole."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
