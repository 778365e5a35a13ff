"""Tables of standards, what follows from them, and contradictions against them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up

# ISO 15 deep groove ball bearings, designation: bore, outside diameter, width in mm.
ISO15 = {
    "6000": (10, 26, 8), "6001": (12, 28, 8), "6002": (15, 32, 9), "6003": (17, 35, 10), "6004": (20, 42, 12), "6005": (25, 47, 12), "6006": (30, 55, 13), "6007": (35, 62, 14), "6008": (40, 68, 15),
    "6009": (45, 75, 16), "6010": (50, 80, 16), "6011": (55, 90, 18), "6012": (60, 95, 18), "6013": (65, 100, 18), "6014": (70, 110, 20), "6015": (75, 115, 20), "6016": (80, 125, 22),
    "6200": (10, 30, 9), "6201": (12, 32, 10), "6202": (15, 35, 11), "6203": (17, 40, 12), "6204": (20, 47, 14), "6205": (25, 52, 15), "6206": (30, 62, 16), "6207": (35, 72, 17), "6208": (40, 80, 18),
    "6209": (45, 85, 19), "6210": (50, 90, 20), "6211": (55, 100, 21), "6212": (60, 110, 22), "6213": (65, 120, 23), "6214": (70, 125, 24), "6215": (75, 130, 25), "6216": (80, 140, 26),
    "6217": (85, 150, 28), "6218": (90, 160, 30), "6219": (95, 170, 32), "6220": (100, 180, 34),
    "6300": (10, 35, 11), "6301": (12, 37, 12), "6302": (15, 42, 13), "6303": (17, 47, 14), "6304": (20, 52, 15), "6305": (25, 62, 17), "6306": (30, 72, 19), "6307": (35, 80, 21), "6308": (40, 90, 23),
    "6309": (45, 100, 25), "6310": (50, 110, 27), "6311": (55, 120, 29), "6312": (60, 130, 31), "6313": (65, 140, 33), "6314": (70, 150, 35), "6315": (75, 160, 37), "6316": (80, 170, 39),
}
# ASME B36.10M and B36.19M walls in mm by size for schedules 10S, 40, 80, 160.
SCHEDULES = ("SCH 10S", "SCH 40", "SCH 80", "SCH 160")
WALLS = {
    0.5: (2.11, 2.77, 3.73, 4.78), 0.75: (2.11, 2.87, 3.91, 5.56), 1.0: (2.77, 3.38, 4.55, 6.35), 1.5: (2.77, 3.68, 5.08, 7.14), 2.0: (2.77, 3.91, 5.54, 8.74), 3.0: (3.05, 5.49, 7.62, 11.13),
    4.0: (3.05, 6.02, 8.56, 13.49), 6.0: (3.40, 7.11, 10.97, 18.26), 8.0: (3.76, 8.18, 12.70, 23.01), 10.0: (4.19, 9.27, 15.09, 28.58), 12.0: (4.57, 10.31, 17.48, 33.32), 14.0: (4.78, 11.13, 19.05, 35.71),
    16.0: (4.78, 12.70, 21.44, 40.49), 18.0: (4.78, 14.27, 23.83, 45.24), 20.0: (5.54, 15.09, 26.19, 50.01), 24.0: (6.35, 17.48, 30.96, 59.54),
}
# Names in mm (DN) and inches (NPS); outside diameters in mm, from 14 inches on the name times 25.4.
DN_NPS = {
    6: 0.125, 8: 0.25, 10: 0.375, 15: 0.5, 20: 0.75, 25: 1.0, 32: 1.25, 40: 1.5, 50: 2.0, 65: 2.5, 80: 3.0, 90: 3.5, 100: 4.0, 125: 5.0, 150: 6.0, 200: 8.0, 250: 10.0, 300: 12.0, 350: 14.0, 400: 16.0, 450: 18.0,
    500: 20.0, 550: 22.0, 600: 24.0, 650: 26.0, 700: 28.0, 750: 30.0, 800: 32.0, 850: 34.0, 900: 36.0, 1000: 40.0, 1050: 42.0, 1200: 48.0,
}
NPS_OD = {
    0.125: 10.3, 0.25: 13.7, 0.375: 17.1, 0.5: 21.3, 0.75: 26.7, 1.0: 33.4, 1.25: 42.2, 1.5: 48.3, 2.0: 60.3, 2.5: 73.0, 3.0: 88.9, 3.5: 101.6, 4.0: 114.3, 5.0: 141.3, 6.0: 168.3, 8.0: 219.1, 10.0: 273.0, 12.0: 323.8,
} | {float(n): round(n * 25.4, 1) for n in (14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 40, 42, 48)}
# Standard walls in inches.
WALLS_IN = (0.083, 0.109, 0.120, 0.125, 0.141, 0.154, 0.156, 0.172, 0.188, 0.203, 0.216, 0.219, 0.226, 0.237, 0.250, 0.258, 0.276, 0.280, 0.281, 0.300, 0.312, 0.318, 0.337, 0.344, 0.375, 0.400, 0.432, 0.438, 0.500, 0.531, 0.562, 0.600, 0.625, 0.636, 0.674, 0.688, 0.719, 0.750, 0.864, 0.875)
# Tolerances of the self-check.
OD_TOLERANCE, WALL_TOLERANCE, POWER_TOLERANCE, BEARING_TOLERANCE = 0.03, 0.05, 0.06, 0.5
KW_PER_HP = 0.746


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(z) for pair in entries.items() for z in pair])


def bearing_dims(designation: Column) -> Column:
    """Struct (bore, od, width) in mm of a designation; null if it isn't in the table."""
    table = F.create_map(*[z for k, (b, o, w) in ISO15.items() for z in (F.lit(k), F.struct(F.lit(float(b)).alias("bore"), F.lit(float(o)).alias("od"), F.lit(float(w)).alias("width")))])
    return table[F.trim(designation)]


def pipe_wall(nps: Column, schedule: Column) -> Column:
    """Wall in mm; a trailing S is dropped except from 10S."""
    table = _map({f"{n}|{s}": w for n, row in WALLS.items() for s, w in zip(SCHEDULES, row, strict=True)})
    name = F.upper(F.trim(schedule))
    folded = F.when(name.endswith("S") & (name != "SCH 10S"), F.regexp_replace(name, "S$", "")).otherwise(name)
    at = lambda s: table[F.concat_ws("|", nps.cast("double").cast("string"), s)]
    return F.coalesce(at(name), at(folded))


def od_for_nps(nps: Column) -> Column:
    return _map(NPS_OD)[nps.cast("double")]


def nps_for_dn(dn: Column) -> Column:
    return F.when(F.abs(dn - F.rint(dn)) < 1e-6, _map(DN_NPS)[F.rint(dn).cast("int")])


def nps_for_od(od: Column, tolerance: float = 0.01) -> Column:
    """The nearest size whose outside diameter lies within the tolerance."""
    rows = F.array(*[F.struct(F.lit(o).alias("od"), F.lit(n).alias("nps")) for n, o in NPS_OD.items()])
    near = F.transform(F.filter(rows, lambda r: F.abs(r.od - od) <= r.od * tolerance), lambda r: F.struct(F.abs(r.od - od).alias("gap"), r.nps.alias("nps")))
    return F.array_min(near).nps


def nps_from_mm(mm: Column) -> Column:
    """A size name that someone has converted to mm; the first of the table that fits."""
    sizes = F.array(*[F.lit(n) for n in NPS_OD])
    return F.get(F.filter(sizes, lambda n: F.abs(n - mm / 25.4) <= n * 0.004 + 0.002), 0)


def pipe_weight(od_in: Column, wall_in: Column) -> Column:
    """Pounds a foot of a plain-end pipe."""
    return (od_in - wall_in) * wall_in * 10.69


def wall_from_weight(od_mm: Column, weight: Column, tolerance: float = 0.006) -> Column:
    """The standard wall in mm that gives this weight best, within the tolerance."""
    d = od_mm / 25.4
    rows = F.transform(F.filter(F.array(*[F.lit(w) for w in WALLS_IN]), lambda t: t < d / 2), lambda t: F.struct((F.abs(pipe_weight(d, t) - weight) / weight).alias("err"), t.alias("t")))
    return half_up(F.array_min(F.filter(rows, lambda r: r.err <= tolerance)).t * 25.4, 2)


def is_oilfield(attributes: Column) -> Column:
    """Casing, tubing and drill pipe are named by their outside diameter."""
    name = F.upper(F.coalesce(attributes["standard"].str, F.lit("")))
    return name.startswith("API 5CT") | name.startswith("API 5DP")


def derive(category: Column, attributes: Column) -> Column:
    """The attributes with what they imply: kW as hp, speed as poles, bearing dimensions, pipe sizes and walls. Stated values stay; derived ones have less confidence."""
    num = lambda n: attributes[n].num
    dims = bearing_dims(attributes["iso_designation"].str)
    oil = is_oilfield(attributes)
    od = F.coalesce(num("od_mm"), F.when(~oil, od_for_nps(num("nominal_size_in"))))
    wall = F.coalesce(F.when(~oil, pipe_wall(num("nominal_size_in"), attributes["schedule"].str)), wall_from_weight(od, num("weight_ppf")))
    rules = [
        ("electrical", "power_hp", half_up(num("power_kw") / KW_PER_HP, 2), 0.85),
        ("electrical", "poles", F.greatest(F.lit(1.0), F.rint(3000 / F.nullif(num("speed_rpm"), F.lit(0.0)))) * 2, 0.8),
        ("bearing", "bore_mm", dims.bore, 0.85),
        ("bearing", "od_mm", dims.od, 0.85),
        ("bearing", "width_mm", dims.width, 0.85),
        ("bearing", "sub_type", F.when(dims.isNotNull(), "deep_groove_ball"), 0.85),
        ("pipe", "od_mm", F.when(~oil, od_for_nps(num("nominal_size_in"))), 0.8),
        ("pipe", "nominal_size_in", F.when(~oil, nps_for_od(num("od_mm"))), 0.8),
        ("pipe", "wall_mm", wall, 0.8),
    ]
    made = []
    for kind, name, value, confidence in rules:
        text = name == "sub_type"
        number, word = (F.lit(None).cast("double"), value) if text else (value, F.lit(None).cast("string"))
        wanted = (category == kind) & ~F.map_contains_key(attributes, name) & value.isNotNull()
        made.append(F.when(wanted, F.struct(F.lit(name).alias("key"), F.struct(number.alias("num"), word.alias("str"), F.lit(confidence).alias("conf")).alias("value"))))
    return F.map_concat(attributes, F.map_from_entries(F.filter(F.array(*made), lambda e: e.isNotNull())))


def contradictions(category: Column, attributes: Column) -> Column:
    """ARRAY<STRUCT<field, stated, expected, rule>>: stated facts of a record that can't all be true."""
    num = lambda n: attributes[n].num
    show = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")

    def flag(when: Column, field: str, stated: Column, expected: Column, rule: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), show(stated).alias("stated"), show(expected).alias("expected"), F.lit(rule).alias("rule")))

    dims, oil = bearing_dims(attributes["iso_designation"].str), is_oilfield(attributes)
    off = lambda n, d: F.coalesce(F.abs(num(n) - d) > BEARING_TOLERANCE, F.lit(False))
    nps, od, wall = num("nominal_size_in"), num("od_mm"), num("wall_mm")
    table_od, table_wall = od_for_nps(nps), pipe_wall(nps, attributes["schedule"].str)
    pipe = (category == "pipe") & ~oil
    hp = num("power_kw") / KW_PER_HP
    motor, instrument = category == "electrical", category == "instrument"
    poles, rpm = num("poles"), num("speed_rpm")
    runs = lambda f: (rpm >= F.lit(0.85 * 120 * f) / poles) & (rpm <= F.lit(120.0 * f) / poles)
    sizes = ("bore_mm", "od_mm", "width_mm", "wall_mm", "thickness_mm", "length_mm", "shaft_dia_mm", "dial_size_mm", "nominal_size_in")
    every = [flag(num(n) <= 0, n, num(n), F.lit("> 0"), "a size cannot be zero or negative") for n in sizes]
    every += [
        flag((category == "bearing") & (off("bore_mm", dims.bore) | off("od_mm", dims.od) | off("width_mm", dims.width)), "dimensions", F.concat_ws(" x ", *[F.coalesce(show(num(n)), F.lit("?")) for n in sizes[:3]]), F.concat_ws(" x ", show(dims.bore), show(dims.od), show(dims.width)), "ISO 15: the designation has other dimensions"),
        flag((category == "bearing") & (num("bore_mm") >= num("od_mm")), "bore_mm", num("bore_mm"), num("od_mm"), "the bore must be smaller than the outside diameter"),
        flag(pipe & (F.abs(od - table_od) / table_od > OD_TOLERANCE), "od_mm", od, table_od, "ASME B36.10M: the size has another outside diameter"),
        flag(pipe & (F.abs(wall - table_wall) / table_wall > WALL_TOLERANCE), "wall_mm", wall, table_wall, "ASME B36.10M: the schedule has another wall"),
        flag(pipe & (wall >= F.coalesce(od, table_od) / 2), "wall_mm", wall, F.coalesce(od, table_od) / 2, "the wall must be less than half the outside diameter"),
        flag(motor & (F.abs(num("power_hp") - hp) / hp > POWER_TOLERANCE), "power_hp", num("power_hp"), half_up(hp, 1), "kilowatts and horsepower differ"),
        flag(motor & (poles >= 2) & ~(runs(50) | runs(60)), "speed_rpm", rpm, F.lit(6000.0) / poles, "the number of poles gives another speed"),
        flag(instrument & (num("range_min") >= num("range_max")), "range_min", num("range_min"), num("range_max"), "the range must run from low to high"),
    ]
    return F.filter(F.array(*every), lambda c: c.isNotNull())


def describe(c: Column) -> Column:
    """A contradiction as a sentence."""
    return F.concat(F.regexp_replace(c.field, "_", " "), F.lit(" "), c.stated, F.lit(" - "), c["rule"])


def table(name: str) -> pd.DataFrame:
    """A table of this module as rows, for joins and checks."""
    if name == "bearings":
        return pd.DataFrame([(k, *map(float, v)) for k, v in ISO15.items()], columns=["designation", "bore", "od", "width"])
    if name == "walls":
        return pd.DataFrame([(n, s, w) for n, row in WALLS.items() for s, w in zip(SCHEDULES, row, strict=True)], columns=["nps", "schedule", "wall"])
    return pd.DataFrame(list(NPS_OD.items()), columns=["nps", "od"])
