"""Spend, savings, profiles and units over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.numbers import half_up_sql as R

from ..operators import procurement, units
from .standins import PARTS, PURCHASES, item_key, parts, purchases


def savings_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.savings(procurement.company_spend(purchases(spark, sf_dir), ["part"]), ["part"]).orderBy(F.desc("saving_upper"), "part")


def savings_by_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: most have fewer than three companies, so that suppression shows."""
    return procurement.savings(procurement.company_spend(purchases(spark, sf_dir), ["basket"]), ["basket"])


def savings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.savings_summary(savings_by_basket(spark, sf_dir))


def company_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.company_spend(purchases(spark, sf_dir), ["part"])


def purchase_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.purchase_profiles(purchases(spark, sf_dir), ["part"])


def twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are the same item under two numbers, a < b."""
    p = parts(spark, sf_dir).select(*item_key(), "record_id", "cpse", "plant")
    q = p.select(*item_key(), F.col("record_id").alias("b"), F.col("cpse").alias("cpse_b"), F.col("plant").alias("plant_b"))
    return p.withColumnsRenamed({"record_id": "a", "cpse": "cpse_a", "plant": "plant_a"}).join(q, item_key()).where("a < b")


def procurement_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = procurement.purchase_profiles(purchases(spark, sf_dir), ["part"]).select("part", F.struct("vendors", "plants", "median_price", "median_qty", "band").alias("profile"))
    one, two = (profiles.select(F.col("part").alias(x), F.col("profile").alias(f"profile_{x}")) for x in "ab")
    pairs = twin_pairs(spark, sf_dir).join(one, "a", "left").join(two, "b", "left")
    scored = pairs.withColumn("s", procurement.procurement_similarity("profile_a", "profile_b", F.col("cpse_a") == F.col("cpse_b")))
    return scored.select("a", "b", half_up("s.score", 4).alias("proc_sim"), F.col("s.blocked_by").alias("blocked_by"))


def uom_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.spellings(parts(spark, sf_dir))


def uom_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.families(parts(spark, sf_dir))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).withColumn("national_code", F.concat_ws("|", "category", "adjective", "type"))


def uom_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.conflicts(_coded(spark, sf_dir))


def pack_size_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a member of its order; prices far apart in one order are flagged."""
    prices = purchases(spark, sf_dir).select(F.col("basket").alias("national_code"), "cpse", F.col("part").alias("source_code"), F.col("unit_price").alias("median_price"))
    return units.pack_size_flags(prices, ratio=1.7)


QUERIES = {f.__name__: f for f in (savings_by_item, savings_by_basket, savings_summary, company_spend, purchase_profiles, procurement_similarity, uom_spellings, uom_families, uom_conflicts, pack_size_flags)}


def _spend(item: str) -> str:
    return f"""WITH {PURCHASES},
spend AS (
  SELECT {item}, cpse, sum(qty)::BIGINT AS qty, sum(unit_price::DECIMAL(18,2) * qty::DECIMAL(18,0))::DOUBLE AS v, count(*) AS orders, count(DISTINCT vendor) AS vendor_count, {R('median(unit_price)', 2)} AS median_price
  FROM purchases GROUP BY ALL),
averaged AS (SELECT {item}, cpse, qty, orders, vendor_count, median_price, CASE WHEN qty <> 0 THEN {R('v / qty', 2)} ELSE 0.0 END AS avg_price, {R('v', 2)} AS value FROM spend)"""


def _savings(item: str) -> str:
    return f"""{_spend(item)},
total AS (
  SELECT {item}, count(cpse) AS cpse_count, sum(qty)::BIGINT AS total_qty, sum(value::DECIMAL(18,2))::DOUBLE AS total_value, sum(orders)::BIGINT AS orders, min(avg_price) AS best, max(avg_price) AS worst
  FROM averaged GROUP BY ALL),
items AS (
  SELECT {item}, cpse_count, total_qty, total_value, orders, cpse_count < 3 AS benchmark_suppressed,
       CASE WHEN cpse_count < 3 THEN 'only ' || cpse_count || ' CPSE(s) - a benchmark here would reveal an individual company''s price' END AS suppression_reason,
       CASE WHEN cpse_count >= 3 THEN best END AS best_price, CASE WHEN cpse_count >= 3 THEN worst END AS worst_price,
       CASE WHEN cpse_count >= 3 THEN CASE WHEN best <> 0 THEN {R('(worst - best) / best * 100', 1)} ELSE 0.0 END END AS price_spread_pct,
       CASE WHEN cpse_count < 3 THEN 0.0 ELSE {R('total_value - best * total_qty', 2)} END AS saving_upper,
       CASE WHEN cpse_count < 3 THEN 0.0 ELSE {R('(total_value - best * total_qty) * 0.4', 2)} END AS saving_realistic
  FROM total)"""


_FOLD = """folded AS (
  SELECT *, replace(raw, '.', '') AS k FROM (SELECT *, upper(trim(coalesce(uom, ''), ' ')) AS raw FROM {0}) WHERE raw <> ''),
known AS (
  SELECT *, CASE WHEN k IN ('MT', 'MTS') THEN 'M' WHEN k = 'T' THEN 'MT'
                 WHEN k IN ('EA', 'EACH', 'NO', 'NOS', 'NUMBER', 'PC', 'PCS', 'PIECE', 'PIECES', 'UNIT', 'U') THEN 'EA' WHEN k IN ('M', 'MTR', 'MTRS', 'METER', 'METERS', 'METRE', 'METRES') THEN 'M'
                 WHEN k IN ('KG', 'KGS', 'KILOGRAM', 'KILOGRAMS') THEN 'KG' WHEN k IN ('L', 'LTR', 'LTRS', 'LITRE', 'LITER', 'LITRES', 'LITERS') THEN 'L'
                 WHEN k IN ('SET', 'SETS') THEN 'SET' WHEN k IN ('BOX', 'BOXES', 'BX') THEN 'BOX' WHEN k IN ('ROLL', 'ROLLS', 'RL') THEN 'ROLL' END AS canon,
         k IN ('MT', 'MTS', 'T') AS ambiguous
  FROM folded)"""
_LABEL = "CASE {0} WHEN 'EA' THEN 'Each' WHEN 'M' THEN 'Metre' WHEN 'KG' THEN 'Kilogram' WHEN 'L' THEN 'Litre' WHEN 'SET' THEN 'Set' WHEN 'BOX' THEN 'Box' WHEN 'ROLL' THEN 'Roll' END"

PROFILES = """profiles AS (
  SELECT part, list_sort(list(DISTINCT vendor)) AS vendors, list_sort(list(DISTINCT plant)) AS plants, median(unit_price) AS median_price, median(qty)::DOUBLE AS median_qty,
         CASE WHEN median(unit_price) <= 0 THEN 0 ELSE greatest(0, least(9, trunc(log10(median(unit_price)) * 2)::INT)) END AS band
  FROM purchases GROUP BY part)"""

PROCUREMENT = """CASE WHEN pa.part IS NULL OR pb.part IS NULL THEN NULL
            WHEN least(pa.median_price, pb.median_price) > 0 AND greatest(pa.median_price, pb.median_price) >= least(pa.median_price, pb.median_price) * 10 THEN 0.0
            WHEN {same} THEN ({vendor} + {band} + {amount} + CASE WHEN list_has_any(pa.plants, pb.plants) THEN 1.0::DOUBLE ELSE 0.4 END) / 4.0
            ELSE ({vendor} + {band} + {amount}) / 3.0 END""".replace("{vendor}", "CASE WHEN list_has_any(pa.vendors, pb.vendors) THEN 1.0::DOUBLE ELSE 0.2 END").replace(
    "{band}", "greatest(0.0::DOUBLE, 1.0 - abs(pa.band - pb.band)::DOUBLE / 3.0)"
).replace("{amount}", "least(pa.median_qty, pb.median_qty) / greatest(pa.median_qty, pb.median_qty, 1.0)")

ORACLE_SQL = {
    "savings_by_item": _savings("part") + " SELECT * FROM items",
    "savings_by_basket": _savings("basket") + " SELECT * FROM items",
    "savings_summary": _savings("basket")
    + """ SELECT count(*) AS items, count(*) FILTER (cpse_count > 1) AS multi_cpse_items, count(*) FILTER (NOT benchmark_suppressed) AS benchmark_eligible,
       count(*) FILTER (cpse_count > 1 AND benchmark_suppressed) AS benchmark_suppressed, sum(total_value::DECIMAL(18,2))::DOUBLE AS total_spend,
       coalesce(sum(total_value::DECIMAL(18,2)) FILTER (cpse_count > 1)::DOUBLE, 0) AS shared_spend, coalesce(sum(saving_upper::DECIMAL(18,2)) FILTER (NOT benchmark_suppressed)::DOUBLE, 0) AS saving_upper,
       coalesce(sum(saving_realistic::DECIMAL(18,2)) FILTER (NOT benchmark_suppressed)::DOUBLE, 0) AS saving_realistic, 0.4::DOUBLE AS capture_rate, 3 AS k_anonymity FROM items""",
    "company_spend": _spend("part") + " SELECT * FROM averaged",
    "purchase_profiles": f"WITH {PURCHASES}, {PROFILES} SELECT * FROM profiles",
    "procurement_similarity": f"""WITH {PURCHASES}, {PARTS}, {PROFILES},
twins AS (SELECT x.record_id AS a, y.record_id AS b, x.cpse AS ca, y.cpse AS cb FROM parts x JOIN parts y USING (category, adjective, type, size) WHERE x.record_id < y.record_id)
SELECT a, b, {R(PROCUREMENT.replace("{same}", "ca = cb"), 4)} AS proc_sim,
       CASE WHEN least(pa.median_price, pb.median_price) > 0 AND greatest(pa.median_price, pb.median_price) >= least(pa.median_price, pb.median_price) * 10 THEN 'price_anomaly' END AS blocked_by
FROM twins LEFT JOIN profiles pa ON pa.part = a LEFT JOIN profiles pb ON pb.part = b""",
    "uom_spellings": f"""WITH {PARTS}, {_FOLD.format("parts")}
SELECT raw, count(*) AS records, any_value(CASE WHEN NOT ambiguous THEN canon END) AS canon, CASE WHEN any_value(ambiguous) THEN 'ambiguous' WHEN any_value(canon) IS NULL THEN 'unrecognised' ELSE 'folded' END AS status
FROM known GROUP BY raw""",
    "uom_families": f"""WITH {PARTS}, {_FOLD.format("parts")}, raws AS (SELECT canon, raw, count(*) AS n FROM known WHERE NOT ambiguous AND canon IS NOT NULL GROUP BY ALL)
SELECT canon AS canonical, {_LABEL.format("canon")} AS label, sum(n)::BIGINT AS records, list(raw || ':' || n ORDER BY n DESC, raw) AS variants FROM raws GROUP BY canon""",
    "uom_conflicts": f"""WITH {PARTS}, coded AS (SELECT *, category || '|' || adjective || '|' || type AS national_code FROM parts), {_FOLD.format("coded")},
raws AS (SELECT national_code, raw, any_value(canon) AS canon, count(*) AS n FROM known GROUP BY national_code, raw),
intra AS (SELECT national_code, list_sort(list(cpse) FILTER (k > 1)) AS intra_cpse FROM (SELECT national_code, cpse, count(DISTINCT raw) AS k FROM known GROUP BY ALL) GROUP BY national_code)
SELECT national_code, count(*) AS variant_count, count(DISTINCT canon) > 1 AS cross_family, CASE WHEN count(DISTINCT canon) <= 1 THEN min(canon) END AS resolved_to,
       {_LABEL.format("CASE WHEN count(DISTINCT canon) <= 1 THEN min(canon) END")} AS resolved_label, list(raw || ':' || n ORDER BY n DESC, raw) AS variants, coalesce(any_value(intra_cpse), []) AS intra_cpse
FROM raws JOIN intra USING (national_code) GROUP BY national_code HAVING count(*) >= 2""",
    "pack_size_flags": f"""WITH {PURCHASES},
ends AS (SELECT basket, count(*) AS n, min({{'p': unit_price, 'c': cpse, 's': part}}) AS lo, max({{'p': unit_price, 'c': cpse, 's': part}}) AS hi FROM purchases WHERE unit_price > 0 GROUP BY basket)
SELECT basket AS national_code, {R('hi.p / lo.p', 1)} AS ratio, lo.c AS low_cpse, lo.s AS low_code, {R('lo.p', 2)} AS low_price, hi.c AS high_cpse, hi.s AS high_code, {R('hi.p', 2)} AS high_price
FROM ends WHERE n >= 2 AND hi.p / lo.p >= 1.7""",
}
