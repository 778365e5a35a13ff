"""The driver's tables in the roles of the library's inputs, in both engines.

Parts are material records, line items their purchases (the company is the supplier's region, the vendor the supplier), events a decision log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up, half_up_sql


#: Suppliers that are sent to every task; more of them are shuffled, as the line items are then.
MOST_SENT = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = supplier.select("s_suppkey", F.col("r_name").alias("cpse"))
    few = table(spark, sf_dir, "supplier").count() <= MOST_SENT
    return (
        table(spark, sf_dir, "lineitem")
        .join(F.broadcast(supplier) if few else supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "cpse", F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("vendor"), half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
            F.col("l_quantity").cast("long").alias("qty"), F.col("l_linestatus").alias("plant"), F.col("l_shipdate").alias("po_date"),
        )
    )


PURCHASES = f"""purchases AS (
  SELECT r_name AS cpse, l_partkey AS part, l_orderkey AS basket, l_suppkey AS vendor, {half_up_sql('l_extendedprice / l_quantity', 2)} AS unit_price,
         l_quantity::BIGINT AS qty, l_linestatus AS plant, l_shipdate AS po_date
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, cpse, source_code, description, category, adjective, type, size, price, uom, plant."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record_id"), F.concat(F.lit("C"), (F.col("p_partkey") % 5).cast("string")).alias("cpse"), F.col("p_partkey").cast("string").alias("source_code"),
        F.concat_ws(" ", "p_brand", "p_name", "p_type", F.lit("SIZE"), F.col("p_size").cast("string")).alias("description"),
        F.element_at(F.split("p_name", " "), -1).alias("category"), F.element_at(F.split("p_name", " "), 1).alias("adjective"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"),
        F.element_at(F.array(*map(F.lit, ("EA", "No.", "NOS", "MTR", "MTS", "each", "PKT", " kg "))), (F.col("p_partkey") % 8 + 1).cast("int")).alias("uom"),
        F.concat(F.lit("P"), (F.col("p_size") % 3).cast("string")).alias("plant"),
    )


PARTS = """parts AS (
  SELECT p_partkey AS record_id, 'C' || (p_partkey % 5) AS cpse, p_partkey::VARCHAR AS source_code, concat_ws(' ', p_brand, p_name, p_type, 'SIZE', p_size::VARCHAR) AS description,
         string_split(p_name, ' ')[-1] AS category, string_split(p_name, ' ')[1] AS adjective, p_type AS type, p_size::DOUBLE AS size, p_retailprice AS price, p_brand AS brand,
         ['EA', 'No.', 'NOS', 'MTR', 'MTS', 'each', 'PKT', ' kg '][p_partkey % 8 + 1] AS uom, 'P' || (p_size % 3) AS plant
  FROM part)"""


def item_key() -> list[str]:
    """What makes two parts the same item: all but the brand."""
    return ["category", "adjective", "type", "size"]
