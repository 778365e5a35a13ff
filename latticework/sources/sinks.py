"""Results to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """With a header; of ``columns`` only those, in their order."""
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def spreadsheet_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The same with a byte-order mark on the first name, for spreadsheets; one file, as people open it (label sheets: some thousand rows)."""
    df.select(F.col(columns[0]).alias("﻿" + columns[0]), *columns[1:]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def erp_csv(df: DataFrame, path: str, files: int = 1) -> None:
    """A load file: every cell quoted, lines ending in CR LF. One task writes each file, row after row; systems that load several take more ``files``."""
    cells = F.concat_ws(",", *[F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', '""'), F.lit('"')) for c in df.columns])
    df.select(cells.alias("value")).coalesce(files).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def documents(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """An intermediate result."""
    (df.write.partitionBy(*by) if by else df.write).mode(mode).parquet(path)


def resume(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of ``df`` that a table written earlier lacks."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return df
    return df.join(spark.read.parquet(path).select(key), key, "left_anti")


def capped_bundle(tables: dict[str, tuple[DataFrame, list[Column], int]], folder: str) -> dict[str, int]:
    """Each table's first rows in its order; totals are counted over the whole, before the cap, and returned."""
    totals = {}
    for name, (df, order, cap) in tables.items():
        totals[name] = df.count()
        df.orderBy(*order).limit(cap).write.mode("overwrite").parquet(f"{folder}/{name}")
    return totals
