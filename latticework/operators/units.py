"""Units of measure: spellings, families, conflicts inside one code, pack sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up

# The spellings of each unit, and those that mean different units in different companies.
FAMILIES = {
    "EA": ("Each", ("EA", "EACH", "NO", "NOS", "NUMBER", "PC", "PCS", "PIECE", "PIECES", "UNIT", "U")),
    "M": ("Metre", ("M", "MTR", "MTRS", "METER", "METERS", "METRE", "METRES")),
    "KG": ("Kilogram", ("KG", "KGS", "KILOGRAM", "KILOGRAMS")),
    "L": ("Litre", ("L", "LTR", "LTRS", "LITRE", "LITER", "LITRES", "LITERS")),
    "SET": ("Set", ("SET", "SETS")),
    "BOX": ("Box", ("BOX", "BOXES", "BX")),
    "ROLL": ("Roll", ("ROLL", "ROLLS", "RL")),
}
AMBIGUOUS = {"MT": ("M", "MT", "metre or metric tonne"), "MTS": ("M", "MT", "metres or metric tonnes"), "T": ("MT", "M", "tonne or metre")}
PACK_RATIO = 10


def _literal(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def spelled(raw: Column) -> Column:
    return F.upper(F.trim(F.coalesce(raw, F.lit(""))))


def fold(raw: Column) -> Column:
    """Struct (canon, ambiguous): the unit of a spelling; null if it isn't known. An ambiguous one has its first reading."""
    key = F.regexp_replace(spelled(raw), r"\.", "")
    known = _literal({s: unit for unit, (_, spellings) in FAMILIES.items() for s in spellings})
    unclear = _literal({s: readings[0] for s, readings in AMBIGUOUS.items()})
    return F.struct(F.coalesce(unclear[key], known[key]).alias("canon"), unclear[key].isNotNull().alias("ambiguous"))


def label(canon: Column) -> Column:
    return _literal({unit: name for unit, (name, _) in FAMILIES.items()})[canon]


def spellings(materials: DataFrame, uom: str = "uom") -> DataFrame:
    """(raw, records, canon, status): every spelling in use; status is folded, ambiguous or unrecognised."""
    counted = materials.select(spelled(F.col(uom)).alias("raw")).where("raw != ''").groupBy("raw").agg(F.count(F.lit(1)).alias("records")).withColumn("_f", fold(F.col("raw")))
    status = F.when(F.col("_f.ambiguous"), "ambiguous").when(F.col("_f.canon").isNull(), "unrecognised").otherwise("folded")
    return counted.select("raw", "records", F.when(status == "folded", F.col("_f.canon")).alias("canon"), status.alias("status"))


def families(materials: DataFrame, uom: str = "uom") -> DataFrame:
    """(canonical, label, records, variants): spellings of each unit, the most frequent first."""
    rows = spellings(materials, uom).where("status = 'folded'")
    packed = F.array_sort(F.collect_list(F.struct((-F.col("records")).alias("n"), "raw")))
    return rows.groupBy(F.col("canon").alias("canonical")).agg(F.sum("records").alias("records"), F.transform(packed, lambda x: F.concat(x.raw, F.lit(":"), (-x.n).cast("string"))).alias("variants")).withColumn("label", label(F.col("canonical")))


def conflicts(members: DataFrame, code: str = "national_code", company: str = "cpse", uom: str = "uom") -> DataFrame:
    """Codes whose members write their unit in two or more ways. ``members``: a row for each member.

    Units of different families are an error (cross_family) and aren't resolved; companies that use several spellings themselves are listed.
    """
    rows = members.select(code, company, spelled(F.col(uom)).alias("raw")).where("raw != ''")
    by_raw = rows.groupBy(code, "raw").agg(F.count(F.lit(1)).alias("count")).withColumn("canon", fold(F.col("raw")).canon)
    within = rows.groupBy(code, company).agg(F.count_distinct("raw").alias("n")).groupBy(code).agg(F.sort_array(F.collect_set(F.when(F.col("n") > 1, F.col(company)))).alias("intra_cpse"))
    out = by_raw.groupBy(code).agg(F.count(F.lit(1)).alias("variant_count"), F.count_distinct("canon").alias("_units"), F.min("canon").alias("_unit"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "raw"))).alias("_v"))
    cross = F.col("_units") > 1
    resolved = F.when(~cross, F.col("_unit"))
    return out.where("variant_count >= 2").join(within, code).select(code, "variant_count", cross.alias("cross_family"), resolved.alias("resolved_to"), label(resolved).alias("resolved_label"), F.transform("_v", lambda x: F.concat(x.raw, F.lit(":"), (-x.n).cast("string"))).alias("variants"), "intra_cpse")


def pack_size_flags(prices: DataFrame, code: str = "national_code", company: str = "cpse", source: str = "source_code", price: str = "median_price", ratio: float = PACK_RATIO) -> DataFrame:
    """Codes in which a member's price is ``ratio`` times another's or more: one side prices a box and calls it a piece."""
    ends = prices.where(F.col(price) > 0).groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(price, company, source)).alias("lo"), F.max(F.struct(price, company, source)).alias("hi"))
    return ends.where((F.col("n") >= 2) & (F.col(f"hi.{price}") / F.col(f"lo.{price}") >= ratio)).select(
        code, half_up(F.col(f"hi.{price}") / F.col(f"lo.{price}"), 1).alias("ratio"), F.col(f"lo.{company}").alias("low_cpse"), F.col(f"lo.{source}").alias("low_code"), half_up(f"lo.{price}", 2).alias("low_price"),
        F.col(f"hi.{company}").alias("high_cpse"), F.col(f"hi.{source}").alias("high_code"), half_up(f"hi.{price}", 2).alias("high_price"),
    )
