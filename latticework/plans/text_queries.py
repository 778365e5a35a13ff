"""Extraction, standards and generation; windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, grades, standards
from ..functions.numbers import half_up
from ..functions.numbers import half_up_sql as R
from ..operators import canonical, evaluation, generate
from ..streaming import streams
from .standins import parts, table


def extract_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and facts read from the parts' descriptions."""
    return extract.extract(parts(spark, sf_dir).select("record_id", "description")).select("record_id", "category", F.size("attributes").alias("facts"), F.size("contradictions").alias("contradictions"))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.extraction_summary(extract.extract(parts(spark, sf_dir).select("record_id", "description")).withColumn("method", F.lit("rules")))


def standard_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract.extract(parts(spark, sf_dir).select("record_id", "description"))
    return made.select("record_id", canonical.standard_description(F.col("category"), F.col("attributes")).alias("std_description"))


def nearest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item's quantity times ten as a diameter in mm: the pipe size within one percent."""
    od = F.col("l_quantity") * 10.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", od.alias("od")).withColumn("nps", standards.nps_for_od(F.col("od")))


def pipe_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard walls that a weight gives on a four inch pipe."""
    w = F.col("p_size") / 2.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), w.alias("weight"), standards.wall_from_weight(F.lit(114.3), w).alias("wall_mm"))


def bearing_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("62"), F.lpad((F.col("p_size") % 25).cast("string"), 2, "0"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), name.alias("designation"), standards.bearing_dims(name).alias("d")).select("record_id", "designation", "d.bore", "d.od", "d.width")


def standards_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names that the closed table relates."""
    rows = [(*k.split("~"), rel) for k, (rel, _) in sorted(grades.equivalence_closure().items())]
    return spark.createDataFrame(rows, "x string, y string, relation string")


def generate_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flanges of some sizes, classes and grades; forged grades are not made in the highest class."""
    made = generate.universe(spark, {"size": [0.5, 1.0, 2.0, 4.0, 6.0, 8.0], "class": [150, 300, 600, 900, 1500], "grade": ["A105", "SS304", "SS316", "LF2"], "face": ["RF", "FF", "RTJ"]}, (F.col("class") < 1500) | (F.col("grade") != "LF2"))
    return made.select(F.concat_ws("-", F.col("size").cast("string"), F.col("class").cast("string"), "grade", "face").alias("item_id"), "size", F.col("class"), "grade", "face", generate.split(generate.family(["size", "class", "grade", "face"], ("face",))).alias("split"))


def generated_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.traps(generate_universe(spark, sf_dir), "item_id", ["class", "grade"], ["size", "class", "grade", "face"])


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return streams.tumbling(rows, "ts", ["event_type"], "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", half_up(F.col("value").cast("double"), 2).alias("value"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


QUERIES = {f.__name__: f for f in (extract_specs, extraction_summary, standard_descriptions, nearest_sizes, pipe_weights, bearing_dimensions, standards_equivalence, generate_universe, generated_traps, event_windows, event_sessions)}

_OD = ", ".join(f"({n}::DOUBLE, {o}::DOUBLE)" for n, o in standards.NPS_OD.items())
_UNIVERSE = """u AS (SELECT s::DOUBLE AS size, c AS class, g AS grade, f AS face FROM unnest([0.5, 1.0, 2.0, 4.0, 6.0, 8.0]) a(s), unnest([150, 300, 600, 900, 1500]) b(c), unnest(['A105', 'SS304', 'SS316', 'LF2']) d(g), unnest(['RF', 'FF', 'RTJ']) e(f) WHERE c < 1500 OR g <> 'LF2'),
named AS (SELECT concat_ws('-', size::VARCHAR, class::VARCHAR, grade, face) AS item_id, * FROM u)"""
ORACLE_SQL = {
    "nearest_sizes": f"""WITH t(nps, od) AS (VALUES {_OD}), l AS (SELECT l_orderkey, l_linenumber, l_quantity * 10.0::DOUBLE AS od FROM lineitem), d AS (SELECT DISTINCT od FROM l),
b AS (SELECT d.od, arg_min(nps, abs(t.od - d.od)) AS nps FROM d JOIN t ON abs(t.od - d.od) <= 0.01::DOUBLE * t.od GROUP BY d.od) SELECT l.*, b.nps FROM l LEFT JOIN b ON b.od = l.od""",
    "pipe_weights": f"""WITH t AS (SELECT unnest([{", ".join(f"{w}::DOUBLE" for w in standards.WALLS_IN)}]) AS t), p AS (SELECT p_partkey AS record_id, p_size / 2.0::DOUBLE AS weight FROM part), d AS (SELECT 114.3::DOUBLE / 25.4::DOUBLE AS d),
b AS (SELECT weight, arg_min(t, abs((d - t) * t * 10.69::DOUBLE - weight) / weight) AS t FROM (SELECT DISTINCT weight FROM p), t, d WHERE t < d / 2 AND abs((d - t) * t * 10.69::DOUBLE - weight) / weight <= 0.006::DOUBLE GROUP BY weight)
SELECT record_id, p.weight, {R("t * 25.4::DOUBLE", 2)} AS wall_mm FROM p LEFT JOIN b ON b.weight = p.weight""",
    "bearing_dimensions": f"""WITH t(d, bore, od, width) AS (VALUES {", ".join(f"('{k}', {b}::DOUBLE, {o}::DOUBLE, {w}::DOUBLE)" for k, (b, o, w) in standards.ISO15.items())}),
p AS (SELECT p_partkey AS record_id, '62' || lpad((p_size % 25)::VARCHAR, 2, '0') AS designation FROM part) SELECT record_id, designation, bore, od, width FROM p LEFT JOIN t ON d = designation""",
    "generated_traps": f"""WITH {_UNIVERSE} SELECT x.item_id AS a, y.item_id AS b, CASE WHEN x.class <> y.class THEN 'class' ELSE 'grade' END AS field FROM named x JOIN named y ON x.size = y.size AND x.face = y.face AND x.item_id < y.item_id
WHERE (x.class <> y.class)::INT + (x.grade <> y.grade)::INT = 1""",
    "event_windows": f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, {R("sum(value::DECIMAL(18,4))::DOUBLE", 2)} AS value FROM events GROUP BY ALL""",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""",
}
ORACLE_SQL["generate_universe"] = f"""WITH {_UNIVERSE} SELECT item_id, size, class, grade, face, CASE WHEN substr(sha1('class=' || class || '|grade=' || grade || '|size=' || size), 1, 2) < 'c0' THEN 'dev' ELSE 'test' END AS split FROM named"""
_EQUAL = ", ".join(f"('{grades.standard_key(a)}', '{rel}', '{grades.standard_key(b)}')" for a, rel, b, _ in grades.EQUIVALENCE)
ORACLE_SQL["standards_equivalence"] = f"""WITH RECURSIVE e(a, rel, b) AS (VALUES {_EQUAL}), names AS (SELECT a AS n FROM e UNION SELECT b FROM e),
steps(n, t) AS (SELECT n, n FROM names UNION SELECT n, b FROM steps JOIN e ON e.a = t AND rel = 'SUPERSEDED_BY'), today AS (SELECT n, t FROM steps WHERE t NOT IN (SELECT a FROM e WHERE rel = 'SUPERSEDED_BY')),
links AS (SELECT a, b FROM e WHERE rel = 'IDENTICAL' UNION SELECT b, a FROM e WHERE rel = 'IDENTICAL'), same(x, y) AS (SELECT n, n FROM names UNION SELECT x, b FROM same JOIN links ON links.a = y),
near AS (SELECT a, b FROM e WHERE rel = 'NEAREST' UNION SELECT b, a FROM e WHERE rel = 'NEAREST')
SELECT p.n AS x, q.n AS y, CASE WHEN same.x IS NULL THEN 'NEAREST' WHEN p.t <> p.n OR q.t <> q.n THEN 'SUPERSEDED' ELSE 'IDENTICAL' END AS relation
FROM today p JOIN today q ON p.n <> q.n LEFT JOIN same ON same.x = p.t AND same.y = q.t LEFT JOIN near ON near.a = p.t AND near.b = q.t WHERE same.x IS NOT NULL OR near.a IS NOT NULL"""
