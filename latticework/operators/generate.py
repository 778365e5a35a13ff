"""Made-up catalogues: all items that a category allows, samples, traps, records in several notations, corruptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import plain_number

Choices = dict[str, list]
#: Extra copies of an item (none to three) and how often; share of records sold in packs, and their size.
COPIES = (0.60, 0.25, 0.10, 0.05)
PACK_SHARE, PACK_SIZE = 0.02, 100
STYLES = ("commas", "blanks", "short", "long", "reordered", "lower")


def universe(spark: SparkSession, choices: Choices, valid: Column | None = None) -> DataFrame:
    """Every combination of the fields' values that is valid: chained products of literal tables, whose sizes the choices state."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in choices.items()]
    whole = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), frames)
    return whole if valid is None else whole.where(valid)


def chance(seed: int, *columns: Column | str) -> Column:
    """A number in (0, 1) from values, the same in each run and partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_003)) + 0.5) / 1_000_003.0


def sample(items: DataFrame, n: int, weight: Column, key: list[str], seed: int = 1) -> DataFrame:
    """``n`` items without replacement, by weight: those with the largest u^(1/w)."""
    return items.withColumn("_k", F.pow(chance(seed, *key), 1.0 / weight)).orderBy(F.desc("_k"), *key).limit(n).drop("_k")


def family(fields: list[str], left_out: tuple[str, ...] = ()) -> Column:
    """Items that agree on all but the variant fields are a family."""
    return F.concat_ws("|", *[F.concat(F.lit(f + "="), F.col(f).cast("string")) for f in sorted(fields) if f not in left_out])


def split(family_id: Column) -> Column:
    """dev or test by the first byte of the family's SHA-1: a family is never divided."""
    return F.when(F.conv(F.substring(F.sha1(family_id.cast("binary")), 1, 2), 16, 10).cast("int") < 192, "dev").otherwise("test")


def traps(items: DataFrame, key: str, hard: list[str], fields: list[str]) -> DataFrame:
    """(a, b, field): items that agree on all fields but exactly one hard one. Items meet by their signature without that field."""
    out = None
    for f in hard:
        rest = [c for c in fields if c != f]
        sig = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rest])
        rows = items.select(F.col(key).alias("a"), sig.alias("s"), F.col(f).cast("string").alias("x"))
        met = rows.join(rows.select(F.col("a").alias("b"), "s", F.col("x").alias("y")), "s").where((F.col("a") < F.col("b")) & ~F.col("x").eqNullSafe(F.col("y"))).select("a", "b", F.lit(f).alias("field"))
        out = met if out is None else out.union(met)
    return out


def copies(items: DataFrame, key: str, seed: int = 2) -> DataFrame:
    """One to four records of each item, with ``copy``."""
    u = chance(seed, key)
    extra = F.when(u < COPIES[0], 0).when(u < COPIES[0] + COPIES[1], 1).when(u < sum(COPIES[:3]), 2).otherwise(3)
    return items.withColumn("copy", F.explode(F.sequence(F.lit(0), extra)))


def style(key: str, seed: int = 3) -> Column:
    return F.element_at(F.array(*map(F.lit, STYLES)), (F.floor(chance(seed, key, "copy") * len(STYLES)) + 1).cast("int"))


def describe(noun: Column, parts: list[Column], style_: Column) -> Column:
    """A record's text in a notation."""
    joined = F.concat_ws(", ", noun, *parts)
    return (
        F.when(style_ == "blanks", F.concat_ws(" ", noun, *parts))
        .when(style_ == "short", F.concat_ws(" ", F.substring(noun, 1, 4), *parts))
        .when(style_ == "long", F.concat(joined, F.lit(", AS PER STANDARD")))
        .when(style_ == "reordered", F.concat_ws(", ", noun, *parts[::-1]))
        .when(style_ == "lower", F.lower(joined))
        .otherwise(joined)
    )


def number_text(c: Column, unit: str) -> Column:
    return F.concat(plain_number(c), F.lit(unit))


def with_typo(text: Column, u: Column) -> Column:
    """Two neighbouring characters swapped at a place that ``u`` in (0, 1) gives; short texts stay."""
    at = (F.floor(u * (F.length(text) - 2)) + 1).cast("int")
    swapped = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1, F.lit(1)), F.substr(text, at, F.lit(1)), F.substr(text, at + 2))
    return F.when(F.length(text) < 6, text).otherwise(swapped)


def without_part(text: Column, u: Column) -> Column:
    """One comma field dropped, never the first."""
    fields = F.split(text, ", ")
    drop = (F.floor(u * (F.size(fields) - 1)) + 1).cast("int")
    return F.when(F.size(fields) < 3, text).otherwise(F.array_join(F.filter(fields, lambda _, i: i != drop), ", "))


def base_price(weight: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1.0), weight * factor)


def packed(u: Column, price: Column) -> Column:
    """Struct (uom, unit_price): a few records are priced by the box."""
    box = u < PACK_SHARE
    return F.struct(F.when(box, f"BOX OF {PACK_SIZE}").otherwise("EA").alias("uom"), F.when(box, price * PACK_SIZE).otherwise(price).alias("unit_price"))


def purchases(records: DataFrame, key: str, price: str, seed: int = 5) -> DataFrame:
    """One to four orders of each record, with vendor, quantity and price within five percent."""
    rows = records.withColumn("order", F.explode(F.sequence(F.lit(1), (F.floor(chance(seed, key) * 4) + 1).cast("int"))))
    u = chance(seed + 1, key, "order")
    return rows.select(key, "order", F.concat(F.lit("V"), F.floor(u * 20).cast("string")).alias("vendor"), (F.floor(u * 90) + 10).cast("long").alias("qty"), (F.col(price) * (u * 0.1 + 0.95)).alias("unit_price"))
