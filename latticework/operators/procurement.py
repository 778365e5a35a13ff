"""Purchases: profiles, similarity of two profiles, spend and savings with suppression of small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up

#: Fewer companies than this, and a best price would be one company's own.
K_ANONYMITY = 3
#: Part of the theoretical saving that is counted as realistic.
CAPTURE_RATE = 0.40
PRICE_ANOMALY_RATIO = 10.0


def price_band(price: Column) -> Column:
    """Half-decades, 0 to 9; 0 for prices up to 0."""
    return F.when(price <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(9), (F.log10(price) * 2).cast("int"))))


def middle(numbers: Column) -> Column:
    """Median of a sorted list; null of an empty one."""
    n = F.size(numbers)
    at = lambda i: F.get(numbers, F.floor(i).cast("int")).cast("double")
    return F.when(n % 2 == 1, at((n - 1) / 2)).when(n > 0, at(n / 2 - 1) * 0.5 + at(n / 2) * 0.5)


def purchase_profiles(purchases: DataFrame, keys: list[str], vendor: str = "vendor", plant: str = "plant", price: str = "unit_price", qty: str = "qty", also: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each of ``keys``: vendors, plants, median price, its band, median quantity. Exact medians; sets are sorted. ``also``: further aggregates of these columns.

    Dealt by key first: purchases of one item lie far apart, so that sets and medians begun before the shuffle would be about as many as the rows, and larger.
    """
    lists = purchases.select(*keys, vendor, plant, price, qty).repartition(*keys).groupBy(*keys).agg(*[F.collect_list(c).alias(f"_l{i}") for i, c in enumerate((vendor, plant, price, qty))], *also)
    # exploded, so that a list is sorted once
    rows = lists.select(*lists.columns[: len(keys)], *lists.columns[len(keys) + 4 :], "_l0", "_l1", F.explode(F.array(F.struct(F.sort_array("_l2").alias("p"), F.sort_array("_l3").alias("q")))).alias("_s"))
    made = {"vendors": F.sort_array(F.array_distinct("_l0")), "plants": F.sort_array(F.array_distinct("_l1")), "median_price": middle(F.col("_s.p")), "median_qty": middle(F.col("_s.q"))}
    return rows.select(*keys, *[c.alias(n) for n, c in made.items()], *lists.columns[len(keys) + 4 :]).withColumn("band", price_band(F.col("median_price")))


def procurement_similarity(x: str, y: str, same_company: Column) -> Column:
    """Struct (score, blocked_by) of two profile structs ``x`` and ``y``; both null where either profile is missing.

    A price gap of ten times or more blocks. Else the mean of common vendor, distance of price bands, ratio of quantities and, inside one company only,
    common plant.
    """
    a, b = F.col(x), F.col(y)
    low, high = F.least(a.median_price, b.median_price), F.greatest(a.median_price, b.median_price)
    gap = (low > 0) & (high >= low * PRICE_ANOMALY_RATIO)
    last = lambda v: F.get(v, F.size(v) - 1)
    apart = (last(a.vendors) < F.get(b.vendors, 0)) | (last(b.vendors) < F.get(a.vendors, 0))  # sorted lists, whose ranges are cheaper to compare
    vendor = F.when(apart, 0.2).when(F.arrays_overlap(a.vendors, b.vendors), 1.0).otherwise(0.2)
    band = F.greatest(F.lit(0.0), 1.0 - F.abs(a.band - b.band) / 3.0)
    amount = F.least(a.median_qty, b.median_qty) / F.greatest(a.median_qty, b.median_qty, F.lit(1.0))
    plant = F.when(F.arrays_overlap(a.plants, b.plants), 1.0).otherwise(0.4)
    mean = F.when(same_company, (vendor + band + amount + plant) / 4.0).otherwise((vendor + band + amount) / 3.0)
    missing = a.isNull() | b.isNull()
    return F.struct(F.when(missing, None).when(gap, 0.0).otherwise(mean).alias("score"), F.when(~missing & gap, "price_anomaly").alias("blocked_by"))


def company_spend(purchases: DataFrame, item: list[str], company: str = "cpse", vendor: str = "vendor", price: str = "unit_price", qty: str = "qty") -> DataFrame:
    """A row for each item and company. Values are summed as decimals, so that no order of rows changes a result."""
    money = F.col(price).cast("decimal(18,2)") * F.col(qty).cast("decimal(18,0)")
    out = purchases.groupBy(*item, company).agg(
        F.sum(qty).alias("qty"), F.sum(money).cast("double").alias("_value"), F.count(F.lit(1)).alias("orders"), F.count_distinct(vendor).alias("vendor_count"), half_up(F.median(price), 2).alias("median_price")
    )
    return out.withColumn("avg_price", F.when(F.col("qty") != 0, half_up(F.col("_value") / F.col("qty"), 2)).otherwise(0.0)).withColumn("value", half_up("_value", 2)).drop("_value")


def savings(spend: DataFrame, item: list[str], company: str = "cpse", k: int = K_ANONYMITY, capture: float = CAPTURE_RATE) -> DataFrame:
    """A row for each item from its companies' spend. Best and worst are taken from the rounded averages; below ``k`` companies there is no benchmark and no saving."""
    total = spend.groupBy(*item).agg(
        F.count(company).alias("cpse_count"), F.sum("qty").alias("total_qty"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"), F.sum("orders").alias("orders"),
        F.min("avg_price").alias("_best"), F.max("avg_price").alias("_worst"),
    )
    few = F.col("cpse_count") < k
    upper = F.col("total_value") - F.col("_best") * F.col("total_qty")
    return total.select(
        *item, "cpse_count", "total_qty", "total_value", "orders", few.alias("benchmark_suppressed"),
        F.when(few, F.concat(F.lit("only "), F.col("cpse_count").cast("string"), F.lit(" CPSE(s) - a benchmark here would reveal an individual company's price"))).alias("suppression_reason"),
        F.when(~few, F.col("_best")).alias("best_price"), F.when(~few, F.col("_worst")).alias("worst_price"),
        F.when(~few, F.when(F.col("_best") != 0, half_up((F.col("_worst") - F.col("_best")) / F.col("_best") * 100, 1)).otherwise(0.0)).alias("price_spread_pct"),
        F.when(few, 0.0).otherwise(half_up(upper, 2)).alias("saving_upper"), F.when(few, 0.0).otherwise(half_up(upper * capture, 2)).alias("saving_realistic"),
    )


def savings_summary(items: DataFrame, k: int = K_ANONYMITY, capture: float = CAPTURE_RATE) -> DataFrame:
    """One row: items, how many are shared, eligible or suppressed, and their sums."""
    shared, open_ = F.col("cpse_count") > 1, ~F.col("benchmark_suppressed")
    money = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c).cast("decimal(18,2)")) if when is not None else F.col(c).cast("decimal(18,2)")).cast("double"), F.lit(0.0))
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(shared).alias("multi_cpse_items"), F.count_if(open_).alias("benchmark_eligible"), F.count_if(shared & ~open_).alias("benchmark_suppressed"),
        money("total_value").alias("total_spend"), money("total_value", shared).alias("shared_spend"), money("saving_upper", open_).alias("saving_upper"), money("saving_realistic", open_).alias("saving_realistic"),
        F.lit(capture).alias("capture_rate"), F.lit(k).alias("k_anonymity"),
    )


def code_purchases(codes: DataFrame, purchases: DataFrame) -> DataFrame:
    """Members of national codes joined with their purchases by company and source code."""
    members = codes.select("national_code", F.explode("members").alias("m")).select("national_code", F.col("m.cpse").alias("cpse"), F.col("m.source_code").alias("source_code"))
    return members.join(purchases, ["cpse", "source_code"])


def rupees(amount: Column) -> Column:
    """Amounts in crores, lakhs or whole rupees."""
    return (
        F.when(amount >= 1e7, F.concat(F.lit("Rs "), F.format_number(amount / 1e7, 2), F.lit(" cr")))
        .when(amount >= 1e5, F.concat(F.lit("Rs "), F.format_number(amount / 1e5, 1), F.lit(" L")))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(amount, 0)))
    )
