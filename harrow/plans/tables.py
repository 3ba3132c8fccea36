"""The recruitment tables as projections of the Parquet tables, for Spark and as SQL common table expressions.

Organisation: nation. Staff: customer. Job: orders. Application: lineitem. Candidate: part. Events: events. Files: documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The present of all time-relative queries: results don't depend on the day they run.
NOW = "2024-01-31 00:00:00"
SQL_NOW = f"TIMESTAMP '{NOW}'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staff(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("staff_id"), F.col("c_nationkey").alias("org_id"), F.col("c_name").alias("staff_name"), F.col("c_mktsegment").alias("role"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with the organisation of who posted them."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("posted_by"), F.col("o_orderdate").alias("posted_on"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))
    return orders.join(staff(spark, d).select(F.col("staff_id").alias("posted_by"), "org_id"), "posted_by")


def applications(spark: SparkSession, d: str) -> DataFrame:
    """Applications; (job_id, line, candidate_id, source_id) is their key."""
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("candidate_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("applied_at"),
        (F.col("l_quantity") * 2).cast("int").alias("score"), (F.col("l_returnflag") == "A").alias("shortlisted"), F.col("l_returnflag").alias("outcome"), F.col("l_linestatus").alias("stage"),
    )


CTE = """staff AS (SELECT c_custkey AS staff_id, c_nationkey AS org_id, c_name AS staff_name, c_mktsegment AS role FROM customer),
jobs AS (SELECT o_orderkey AS job_id, o_custkey AS posted_by, o_orderdate AS posted_on, o_orderstatus AS status, o_orderpriority AS title, org_id FROM orders JOIN staff ON o_custkey = staff_id),
applications AS (SELECT l_orderkey AS job_id, l_linenumber AS line, l_partkey AS candidate_id, l_suppkey AS source_id, l_shipdate AS applied_at,
  CAST(l_quantity * 2 AS INTEGER) AS score, l_returnflag = 'A' AS shortlisted, l_returnflag AS outcome, l_linestatus AS stage FROM lineitem)"""


def sql(body: str) -> str:
    """A query over the projections."""
    return f"WITH {CTE}{body}" if body.lstrip().startswith(",") else f"WITH {CTE}\n{body}"
