"""Inputs derived from the given tables. One SQL text each, run by Spark here and by the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probatum.functions.rules import FieldRule, RuleSet

NBSP = " "


def _dirty(text: str, shift: int, mod: int) -> str:
    """CASE that dirties a text cell by the order key."""
    return f"""CASE (o_orderkey + {shift}) % {mod}
      WHEN 1 THEN concat('“', {text}, '”') WHEN 2 THEN concat('  ', {text}, ' ')
      WHEN 3 THEN concat('"', {text}, '"') WHEN 4 THEN 'Null' WHEN 5 THEN '' WHEN 6 THEN 'abc'
      WHEN 7 THEN '-1' WHEN 8 THEN '1e3' WHEN 9 THEN 'inf' WHEN 10 THEN '1_000'
      WHEN 11 THEN concat('{NBSP}', {text}) WHEN 12 THEN CAST(NULL AS STRING) WHEN 13 THEN concat({text}, '.5')
      WHEN 14 THEN ' nan ' WHEN 15 THEN '1d' ELSE {text} END"""


_PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_PRIO = "substr(o_orderpriority, 1, 1)"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END"

DIRTY_ORDERS = f"""
SELECT o_orderkey AS row_id,
  {_dirty(_PRICE, 0, 23)} AS price,
  {_dirty(_PRIO, 7, 41)} AS priority,
  {_dirty(f"({_STATUS})", 11, 67)} AS status
FROM {{orders}}"""
DIRTY_COLUMNS = ["price", "priority", "status"]

ORDER_FEATURES = """
SELECT o.o_orderkey AS row_id, o.o_custkey AS cust,
  CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
  CASE WHEN l.qty IS NULL OR l.qty < 70 THEN 0 WHEN l.qty < 130 THEN 1 ELSE 2 END AS size_label,
  l.n_lines, l.qty, l.disc, l.tax, c.c_acctbal AS balance,
  CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS priority
FROM {orders} o
LEFT JOIN (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines,
    CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS qty,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax
  FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey"""
FEATURES = ["n_lines", "qty", "disc", "tax", "balance", "priority"]
MODEL_FEATURES = ["n_lines", "disc", "tax", "balance", "priority"]

# Copies of every 7th order under shifted keys, every 14th of them with a rotated label.
DUP_ORDERS = """
SELECT row_id, CAST(label AS DOUBLE) AS label, n_lines, disc, priority FROM ({order_features}) f
UNION ALL
SELECT row_id + 100000000 AS row_id,
  CAST(CASE WHEN row_id % 14 = 0 THEN (label + 1) % 3 WHEN row_id % 21 = 0 THEN NULL ELSE label END AS DOUBLE) AS label,
  n_lines, disc, priority FROM ({order_features}) g WHERE row_id % 7 = 0"""

PART_DUMP = """
SELECT CAST(p_partkey AS BIGINT) AS row_index, CAST(p_partkey AS STRING) AS id, p_name AS name,
  p_brand AS brand, p_type AS type, CAST(p_size AS STRING) AS size
FROM {part}"""
# The same rows, last first.
PART_REVERSED = """
SELECT (SELECT max(p_partkey) + min(p_partkey) FROM {part}) - row_index AS row_index, id, name, brand, type, size
FROM (""" + PART_DUMP + ") r"
PART_CANDIDATE = f"""
SELECT CAST(p_partkey AS BIGINT) AS row_index, CAST(p_partkey AS STRING) AS id,
  CASE p_partkey % 31 WHEN 3 THEN concat(' ', p_name) WHEN 4 THEN '' WHEN 5 THEN 'N/A' WHEN 6 THEN upper(p_name)
    ELSE p_name END AS name,
  CASE p_partkey % 37 WHEN 1 THEN '17' ELSE p_brand END AS brand, p_type AS type,
  CASE p_partkey % 29 WHEN 1 THEN concat(CAST(p_size AS STRING), '.0') WHEN 2 THEN CAST(p_size + 1 AS STRING)
    WHEN 3 THEN 'null' WHEN 4 THEN concat('{NBSP}', CAST(p_size AS STRING)) WHEN 5 THEN 'big'
    ELSE CAST(p_size AS STRING) END AS size
FROM {{part}}"""
DUMP_COLUMNS = ["id", "name", "brand", "type", "size"]

ORDER_RULES = RuleSet(
    {
        "price": FieldRule("price", 0.0, 400000.0, True, source="order bounds"),
        "priority": FieldRule("priority", 1.0, 5.0, True, (1.0, 2.0, 3.0, 4.0, 5.0), "order bounds"),
        "status": FieldRule("status", 0.0, 2.0, True, (0.0, 1.0, 2.0), "order bounds"),
    },
    {"price": 300000.0, "priority": 4.0, "status": 2.0},
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, DIRTY_ORDERS, "orders")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ORDER_FEATURES, "orders", "lineitem", "customer")


def dup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = DUP_ORDERS.replace("{order_features}", ORDER_FEATURES)
    return _run(spark, sf_dir, sql, "orders", "lineitem", "customer")


def part_dumps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidate, reference)"""
    return _run(spark, sf_dir, PART_CANDIDATE, "part"), _run(spark, sf_dir, PART_DUMP, "part")


def reversed_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PART_REVERSED, "part")


def for_duckdb(sql: str) -> str:
    """The same text over the check tool's views."""
    for t in ("orders", "lineitem", "customer", "part"):
        sql = sql.replace("{" + t + "}", t)
    return sql
