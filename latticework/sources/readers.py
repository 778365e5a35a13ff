"""Tables from files: CSV with byte-order marks and old codecs, JSON documents and lines, vectors, packed cells, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATERIALS = "record_id string, cpse string, source_code string, description string, uom string, material_group string, plant string"
PURCHASES = "cpse string, source_code string, vendor string, unit_price double, qty long, po_date date, plant string"
GROUND_TRUTH = "record_id string, true_item_id string"
AUDIT = "id string, ts string, actor string, role string, org string, verb string, object string, pair string, note string, code string, source string, prev string, hash string"
BOM = "﻿"


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and quoted commas. Cells are read as text, by the names of the header (without a byte-order mark), then cast; unknown columns are dropped, missing ones are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("inferSchema", False).csv(path)
    named = raw.toDF(*[c.removeprefix(BOM).strip('"') for c in raw.columns])
    wanted = T.StructType.fromDDL(schema)
    has = set(named.columns)
    return named.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def csv_any_codec(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """UTF-8, unless that leaves replacement characters: then Windows-1252 (read as Latin-1, with its signs in place of control characters).

    The choice looks at all rows, and brings one number to the driver.
    """
    first = csv(spark, path, schema)
    bad = F.lit(False)
    for f in T.StructType.fromDDL(schema):
        if isinstance(f.dataType, T.StringType):
            bad = bad | F.coalesce(F.col(f.name).contains("�"), F.lit(False))
    if not first.where(bad).limit(1).count():
        return first
    control = "".join(map(chr, range(0x80, 0xA0)))
    signs = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
    texts = {f.name: F.translate(f.name, control, signs) for f in T.StructType.fromDDL(schema) if isinstance(f.dataType, T.StringType)}
    return csv(spark, path, schema, "iso-8859-1").withColumns(texts)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_by_key(spark: SparkSession, path: str, value_schema: str, key: str = "record_id") -> DataFrame:
    """Files that are one object of objects: a row for each entry."""
    text = spark.read.option("wholetext", True).text(path)
    value = T.StructType.fromDDL(value_schema)
    entries = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias(key, "v"))
    return entries.select(key, *[F.col(f"v.{f.name}").alias(f.name) for f in value if f.name != key])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """An audit log, an event a line, with its place."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("seq"))
    return lines.select("seq", F.from_json("value", AUDIT).alias("e")).select("seq", "e.*")


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).json(folder)


def vectors(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame | None:
    """(key, vector) from Parquet, or None where there are none: similarities then fall back to words."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).select(key, F.col("vector").cast("array<float>"))


def vectors_from_npz(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame:
    """(key, vector) of NPZ archives with ``ids`` and ``vectors``, read on the executors."""
    import io

    import numpy as np
    import pandas as pd

    def unpack(frames):
        for frame in frames:
            for content in frame["content"]:
                blob = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({key: [str(x) for x in blob["ids"]], "vector": list(blob["vectors"].astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, f"{key} string, vector array<float>")


def split_cell(column: str) -> Column:
    """Values between bars, without blanks and empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"[\|]"), lambda x: F.trim(x)), lambda x: x != "")


def seed_list(spark: SparkSession, path: str, schema: str, packed: list[str]) -> DataFrame:
    """CSV of which some columns pack several values."""
    rows = csv(spark, path, schema)
    return rows.select(*[split_cell(c).alias(c) if c in packed else F.col(c) for c in rows.columns])


def run_path(root: str, name: str, run: str | None = None) -> str:
    """A table of a named run, or of the default one."""
    return f"{root}/runs/{run}/{name}" if run else f"{root}/{name}"


def bundle(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a written bundle."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def catalogue_index(spark: SparkSession, path: str) -> DataFrame:
    """Golden records as the gate compares with: code, category, attributes, description."""
    return spark.read.parquet(path).select(F.col("national_code").alias("code"), "category", "attributes", F.col("std_description").alias("description"))
