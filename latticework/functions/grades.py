"""Material grades and standards: spellings, families, equivalence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of one requirement under two bodies, successors, and near ones, with their sources.
EQUIVALENCE = (
    ("IS 1367", "IDENTICAL", "ISO 898-1", "IS 1367 (Part 3) is an identical adoption of ISO 898-1"),
    ("IS 1367-3", "IDENTICAL", "ISO 898-1", "IS 1367 (Part 3) is an identical adoption of ISO 898-1"),
    ("IS 1364", "IDENTICAL", "ISO 4014", "IS 1364 (Part 1) hexagon head bolts is an identical adoption of ISO 4014"),
    ("IS 1364-1", "IDENTICAL", "ISO 4014", "IS 1364 (Part 1) hexagon head bolts is an identical adoption of ISO 4014"),
    ("A325", "SUPERSEDED_BY", "F3125 A325", "ASTM A325 withdrawn 2016, now ASTM F3125 Grade A325"),
    ("A490", "SUPERSEDED_BY", "F3125 A490", "ASTM A490 withdrawn 2016, now ASTM F3125 Grade A490"),
    ("ASTM A325", "SUPERSEDED_BY", "ASTM F3125", "ASTM A325 withdrawn 2016, now ASTM F3125"),
    ("ASTM A490", "SUPERSEDED_BY", "ASTM F3125", "ASTM A490 withdrawn 2016, now ASTM F3125"),
    ("8.8", "NEAREST", "F3125 A325", "ISO 898-1 class 8.8 is close to A325 in strength; different standard, sizes and tests"),
    ("10.9", "NEAREST", "F3125 A490", "ISO 898-1 class 10.9 is close to A490 in strength; different standard, sizes and tests"),
)
# Grade families by pattern of the whole canonical spelling, first hit; True: only the family is named.
FAMILIES = (
    ("CS", r"CARBON_STEEL|CS|CARBON STEEL", True),
    ("MS", r"MILD_STEEL|MS|MILD STEEL", True),
    ("SS", r"SS|STAINLESS_STEEL|STAINLESS STEEL", True),
    ("AS", r"ALLOY_STEEL|AS|ALLOY STEEL", True),
    ("CS", r"CAST_STEEL|CAST STEEL", True),
    ("CI", r"CAST_IRON|CI|CAST IRON", True),
    ("CU", r"COPPER|CU", True),
    ("AL", r"ALUMINIUM|AL", True),
    ("SS", r"A312|A182|A240|A213 TP", True),
    ("SS", r"SS\d{3}[LH]?", False),
    ("AS", r"A213 T\d+|A335 P\d+|A182 F(11|22|5|9|91)|A193[ _]B7|A387.*|1\.7\d{3}", False),
    ("CS", r"A106 GR [ABC]|A53 GR [AB]|API 5L GR [AB]|API 5L X\d{2}|A333 GR \d|FE\s?\d{3}|IS2062.*|E\d{3}[A-D]?|ASTM_A105|A105|A234 WPB|A216 WCB|A350 LF2", False),
    ("WS", r"CORTEN.*|A423.*", False),
    ("OCTG", r"[NPKJL]\d{2,3}|C\d{2,3}|Q125", False),
    ("DP", r"[EGXS]\d{2,3}(?:\s*DP)?|G105|S135", False),
)
# Spellings of family names and renamed grades.
RENAMED = {"IS2062 A": "IS2062 E250A", "A105": "ASTM_A105", "CARBON STEEL": "CARBON_STEEL", "MILD STEEL": "MILD_STEEL", "CAST STEEL": "CAST_STEEL", "STAINLESS STEEL": "SS", "ALLOY STEEL": "ALLOY_STEEL", "CAST IRON": "CAST_IRON"}


def standard_key(name: str) -> str:
    """A name's spelling for look-ups: upper case, single blanks, no 'GRADE', '(PART 3)' as '-3'."""
    name = re.sub(r"[\s_]+", " ", name.strip().upper())
    return re.sub(r"\s*\(PART\s*(\d)\)", r"-\1", re.sub(r"\bGR(?:ADE)?\.?\s*", "", name)).strip()


def standard_key_column(x: Column) -> Column:
    upper = F.trim(F.regexp_replace(F.upper(x), r"[\s_]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(upper, r"\bGR(?:ADE)?\.?\s*", ""), r"\s*\(PART\s*(\d)\)", "-$1"))


def equivalence_closure() -> dict[str, tuple[str, str]]:
    """'x~y' -> (relation, source) for all names of the table and their combinations; built once, on ten rows.

    Identical names chain and a name is followed to its successor; near ones never chain.
    """
    rows = [(standard_key(a), rel, standard_key(b), src) for a, rel, b, src in EQUIVALENCE]
    names = sorted({n for a, _, b, _ in rows for n in (a, b)})
    successor = {a: b for a, rel, b, _ in rows if rel == "SUPERSEDED_BY"}
    identical = {n: {n} for n in names}
    for a, rel, b, _ in rows:
        if rel == "IDENTICAL":
            merged = identical[a] | identical[b]
            for n in merged:
                identical[n] = merged

    def today(name: str) -> str:
        while name in successor:
            name = successor[name]
        return name

    out = {}
    for x in names:
        for y in names:
            if x == y:
                continue
            cx, cy = today(x), today(y)
            if cx == cy or cy in identical[cx]:
                source = next((s for a, _, b, s in rows if {a, b} & {x, y}), "")
                out[f"{x}~{y}"] = ("SUPERSEDED" if (cx, cy) != (x, y) else "IDENTICAL", source)
            else:
                near = next((s for a, rel, b, s in rows if rel == "NEAREST" and {a, b} == {cx, cy}), None)
                if near:
                    out[f"{x}~{y}"] = ("NEAREST", near)
    return out


def equivalence(x: Column, y: Column) -> Column:
    """Struct (relation, source) of two names, or null: IDENTICAL, SUPERSEDED or NEAREST."""
    entries = equivalence_closure()
    table = F.create_map(*[z for k, (rel, src) in sorted(entries.items()) for z in (F.lit(k), F.struct(F.lit(rel).alias("relation"), F.lit(src).alias("source")))])
    return table[F.concat_ws("~", standard_key_column(x), standard_key_column(y))]


def canonical_grade(x: Column) -> Column:
    """One spelling for each grade."""
    v = F.regexp_replace(F.trim(F.regexp_replace(F.upper(x), r"[\s_]+", " ")), r"^ASTM\s?", "")
    renamed = F.create_map(*[F.lit(z) for pair in RENAMED.items() for z in pair])
    return F.coalesce(renamed[v], v)


def grade_family(x: Column) -> Column:
    """Struct (family, bare) of a canonical grade; family is null if none fits."""
    upper = F.upper(F.trim(x))
    out = None
    for family, pattern, bare in FAMILIES:
        made, hit = F.struct(F.lit(family).alias("family"), F.lit(bare).alias("bare")), upper.rlike(f"^(?:{pattern})$")
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("family"), F.lit(False).alias("bare")))


def compare_grades(x: Column, y: Column) -> Column:
    """'agree', 'mismatch' or 'unknown': a bare family against one of its grades says neither; carbon and mild steel are mixed up in use."""
    a, b = canonical_grade(x), canonical_grade(y)
    rel, fa, fb = equivalence(a, b).relation, grade_family(a), grade_family(b)
    return (
        F.when(a == b, "agree")
        .when(rel == "NEAREST", "unknown")
        .when(rel.isNotNull(), "agree")
        .when(fa.family.isNull() | fb.family.isNull(), "mismatch")
        .when(fa.family.isin("CS", "MS") & fb.family.isin("CS", "MS") & (fa.family != fb.family), "unknown")
        .when(fa.family != fb.family, "mismatch")
        .when(fa.bare | fb.bare, "unknown")
        .otherwise("mismatch")
    )
