"""Scores of record pairs: text, specification and procurement, with vetoes before any score and caps that keep doubt out of the automatic band."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import canonical_grade, compare_grades, equivalence, grade_family
from ..functions.numbers import half_up
from ..functions.registry import GRADE_FIELDS, NO_AUTO, NOT_SAFETY, REGISTRY, Field, Registry
from .storage import cut

AUTO, REVIEW = 0.90, 0.70
# Share of the specification with one comparable field, for each more, at most; the text's share of the rest.
SPEC_BASE, SPEC_PER_FIELD, SPEC_MAX, TEXT_SHARE = 0.50, 0.08, 0.88, 0.45
#: Score of a pair without comparable fields.
NOTHING_COMPARED = 0.25
MAX_FLIPS = 3


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(x: Column, y: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def text_similarity(vector_a: Column, vector_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """Cosine where both have a vector (of unit length), else Jaccard of tokens."""
    return F.coalesce(F.when(vector_a.isNotNull() & vector_b.isNotNull(), dot(vector_a, vector_b)), jaccard(tokens_a, tokens_b))


def numbers_agree(x: Column, y: Column, exact: bool) -> Column:
    """Names and counts within 0.2 %; measurements within 2 %, or 0.05."""
    gap, big = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    return gap <= big * 0.002 + 1e-6 if exact else gap <= F.greatest(big * 0.02, F.lit(0.05))


def canonical_text(x: Column) -> Column:
    """Upper case, single blanks."""
    return F.regexp_replace(F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")), r"\s+", " ")


_CONNECTION = r"(\d/\d|\d)\s*(?:IN\b|INCH|\")?\s*(NPT|BSP)?\s*(BOTTOM|LOWER|BACK|REAR|SIDE)?"


def compare_connections(x: Column, y: Column) -> Column:
    """Thread size and type must agree; so must the position where both give one; a position on one side only is unknown."""

    def parts(v: Column) -> tuple[Column, Column, Column]:
        size, kind, place = (F.nullif(F.regexp_extract(F.upper(v), _CONNECTION, i), F.lit("")) for i in (1, 2, 3))
        return size, kind, F.when(place == "LOWER", "BOTTOM").when(place == "REAR", "BACK").otherwise(place)

    (sx, kx, px), (sy, ky, py) = parts(x), parts(y)
    return (
        F.when(sx.isNull() | sy.isNull(), F.when(F.upper(x) == F.upper(y), "agree").otherwise("mismatch"))
        .when((sx != sy) | (kx.isNotNull() & ky.isNotNull() & (kx != ky)), "mismatch")
        .when(px.isNotNull() & py.isNotNull(), F.when(px == py, "agree").otherwise("mismatch"))
        .when(px.isNotNull() | py.isNotNull(), "unknown")
        .otherwise("agree")
    )


def compare(field: Field, x: Column, y: Column, canonical: bool = False) -> Column:
    """'agree', 'mismatch' or 'unknown' of two attribute values (structs). ``canonical``: texts have been through ``canonical_text`` already."""
    if field.name in GRADE_FIELDS:
        return compare_grades(x.str, y.str)
    if field.name == "connection":
        return compare_connections(x.str, y.str)
    if field.kind == "num":
        return F.when(F.coalesce(numbers_agree(x.num, y.num, field.exact), F.lit(False)), "agree").otherwise("mismatch")
    same = x.str == y.str if canonical else canonical_text(x.str) == canonical_text(y.str)
    plain = F.when(same, "agree").otherwise("mismatch")
    if field.name == "standard":
        relation = equivalence(x.str, y.str).relation
        return F.when(relation == "NEAREST", "unknown").when(relation.isNotNull(), "agree").otherwise(plain)
    return plain


def field_outcome(field: Field, a: Column, b: Column, varied: Column | None) -> Column:
    """Struct (name, outcome, w, alt) of one field. Outcomes: ignored, silent, unverified, unsure, unsure_soft, agree, mismatch, veto."""
    x, y = a[field.name], b[field.name]
    one, both = x.isNull() != y.isNull(), x.isNotNull() & y.isNotNull()
    if field.ignore:
        outcome = F.when(both, "ignored").otherwise("silent")
    else:
        result = compare(field, x, y)
        if field.name in GRADE_FIELDS and varied is not None:
            vague = grade_family(canonical_grade(x.str)).bare & F.array_contains(varied, field.name)
            result = F.when((result == "agree") & F.coalesce(vague, F.lit(False)), "unknown").otherwise(result)
        if field.hard:
            unstated = F.lit(True) if field.required else one
            outcome = F.when(both, F.when(result == "unknown", "unsure").when(result == "mismatch", "veto").otherwise("agree")).when(unstated, "unverified").otherwise("silent")
            if varied is not None:
                outcome = F.when(~both & ~one & F.array_contains(varied, field.name), "unsure").otherwise(outcome)
        else:
            outcome = F.when(both, F.when(result == "unknown", "unsure_soft").otherwise(result)).otherwise("silent")
    confidence = F.least(F.coalesce(x.conf, F.lit(0.8)), F.coalesce(y.conf, F.lit(0.8)))
    return F.struct(F.lit(field.name).alias("name"), outcome.alias("outcome"), (confidence * field.weight).alias("w"), F.array(*map(F.lit, field.alt)).cast("array<string>").alias("alt"))


def by_fields(registry: Registry, category: Column, of) -> Column:
    """``of(fields)`` of a row's category; categories with the same fields share one expression. Null where the category has none."""
    alike: dict[tuple[Field, ...], list[str]] = {}
    for name, fields in registry.items():
        alike.setdefault(fields, []).append(name)
    return F.coalesce(*[F.when(category.isin(*names), of(fields)) for fields, names in alike.items()])


def hard_slots(registry: Registry = REGISTRY) -> int:
    return max((sum(f.hard for f in fields) for fields in registry.values()), default=0)


def slots(category: Column, attributes: Column, registry: Registry = REGISTRY) -> list[Column]:
    """Structs (num, str): the value of each category's first, second, ... veto field. Cheap to compare for very many pairs, as no map is searched."""

    def at(j: int) -> Column:
        names: dict[str, list[str]] = {}
        for category_name, fields in registry.items():
            for f in [f for f in fields if f.hard][j : j + 1]:
                names.setdefault(f.name, []).append(category_name)
        value = F.coalesce(*[F.when(category.isin(*c), attributes[n]) for n, c in names.items()])
        return F.struct(value.num.alias("num"), value.str.alias("str"))

    return [at(j) for j in range(hard_slots(registry))]


def slot_veto(category: Column, a: list[Column], b: list[Column], registry: Registry = REGISTRY) -> Column:
    """``first_veto`` of two records' slots. Fields that compare alike share one expression."""

    def at(j: int) -> Column:
        kinds: dict[tuple, tuple[Field, list[str]]] = {}
        names: dict[str, list[str]] = {}
        for category_name, fields in registry.items():
            for f in [f for f in fields if f.hard][j : j + 1]:
                special = f.name if f.name in ("connection", "standard") else f.name in GRADE_FIELDS
                kinds.setdefault((f.kind, f.exact and f.kind == "num", special), (f, []))[1].append(category_name)
                names.setdefault(f.name, []).append(category_name)
        stated = (a[j].num.isNotNull() | a[j].str.isNotNull()) & (b[j].num.isNotNull() | b[j].str.isNotNull())
        differ = F.coalesce(*[F.when(category.isin(*c), compare(f, a[j], b[j], True) == "mismatch") for f, c in kinds.values()], F.lit(False))
        return F.when(stated & differ, F.coalesce(*[F.when(category.isin(*c), F.lit(n)) for n, c in names.items()]))

    return F.coalesce(*[at(j) for j in range(len(a))], F.lit(None).cast("string"))


def first_veto(category: Column, a: Column, b: Column, registry: Registry = REGISTRY) -> Column:
    """Name of the first veto field that both state differently: ``agreement``'s blocked_by inside a category, without the rest of the evidence, so that it is cheap.

    Texts must be canonical already: that is done once a record, not once a pair.
    """

    def of(fields: tuple[Field, ...]) -> Column:
        named = [F.when(a[f.name].isNotNull() & b[f.name].isNotNull() & (compare(f, a[f.name], b[f.name], True) == "mismatch"), f.name) for f in fields if f.hard]
        return F.coalesce(*named, F.lit(None).cast("string"))

    return F.coalesce(by_fields(registry, category, of), F.lit(None).cast("string"))


def outcomes(category: Column, a: Column, b: Column, registry: Registry = REGISTRY, varied: Column | None = None) -> Column:
    """What each field of the category says about two attribute maps, in registry order; silent fields are left out.

    ``varied``: names of fields that the registry has seen in several values for this item; silence of both sides on one of them is a doubt.
    """
    made = by_fields(registry, category, lambda fields: F.array(*[field_outcome(f, a, b, varied) for f in fields]))
    return F.filter(made, lambda o: o.outcome != "silent")


def _names(outs: Column, *kinds: str) -> Column:
    return F.transform(F.filter(outs, lambda o: o.outcome.isin(*kinds)), lambda o: o["name"])


def _weight(outs: Column, *kinds: str) -> Column:
    return F.aggregate(F.filter(outs, lambda o: o.outcome.isin(*kinds)), F.lit(0.0), lambda s, o: s + o.w)


def agreement(same_category: Column, outs: Column) -> Column:
    """Struct of the specification's verdict: score, blocked_by, matched, mismatched, ignored, compared, unverified, unsure, vetoes.

    The first veto in registry order blocks, and nothing behind it is looked at. A required field is verified by a matched alternative.
    """
    at = F.array_position(F.transform(outs, lambda o: o.outcome), "veto")
    seen = F.when(at > 0, F.slice(outs, 1, at.cast("int") - 1)).otherwise(outs)
    matched, other = _names(seen, "agree"), _names(seen, "mismatch")
    total = _weight(outs, "agree", "mismatch")
    unverified = F.transform(F.filter(outs, lambda o: (o.outcome == "unsure") | ((o.outcome == "unverified") & ~F.arrays_overlap(o.alt, matched))), lambda o: o["name"])
    score = F.when(total == 0, NOTHING_COMPARED).otherwise(_weight(outs, "agree") / total)
    blocked = F.when(~same_category, "category").when(at > 0, F.get(outs, at.cast("int") - 1)["name"])
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(blocked.isNotNull(), 0.0).otherwise(score).alias("score"), blocked.alias("blocked_by"), F.when(same_category, matched).otherwise(none).alias("matched"), F.when(same_category, other).otherwise(none).alias("mismatched"),
        F.when(same_category, _names(seen, "ignored")).otherwise(none).alias("ignored"),
        F.when(~same_category, 0).otherwise(F.size(matched) + F.size(other) + F.when(at > 0, 1).otherwise(0)).alias("compared"),
        F.when(blocked.isNull(), unverified).otherwise(none).alias("unverified"), F.when(blocked.isNull(), _names(outs, "unsure", "unsure_soft")).otherwise(none).alias("unsure"),
        F.when(same_category, _names(outs, "veto")).otherwise(none).alias("vetoes"),
    )


def flipped(outs: Column) -> Column:
    """The outcomes as they would be if every vetoing field agreed."""
    return F.transform(outs, lambda o: F.struct(o["name"].alias("name"), F.when(o.outcome == "veto", "agree").otherwise(o.outcome).alias("outcome"), o.w.alias("w"), o.alt.alias("alt")))


def signal_weights(compared: Column) -> Column:
    """Struct (text, spec, proc), together 1: the more fields were compared, the more the specification counts."""
    spec = F.least(F.lit(SPEC_MAX), F.greatest(F.lit(0), compared - 1) * SPEC_PER_FIELD + SPEC_BASE)
    return F.struct(((1.0 - spec) * TEXT_SHARE).alias("text"), spec.alias("spec"), ((1.0 - spec) * (1 - TEXT_SHARE)).alias("proc"))


def weighed(category: Column, text: Column, spec: Column, contradictions: Column | None = None) -> Column:
    """Struct of what ``finished`` needs of a pair besides its purchases: the weighted sum of text and specification, their weight and that of purchases, whether there is a doubt, and which."""
    w = signal_weights(spec.compared)
    odd = F.lit(False) if contradictions is None else F.coalesce(F.size(contradictions) > 0, F.lit(False))
    outside = category.isin(*NO_AUTO)
    doubt = (F.size(spec.unverified) > 0) | odd
    reason = F.when(odd, "a record contradicts itself").when(F.size(spec.unsure) > 0, F.concat(F.lit("could not tell "), F.array_join(spec.unsure, ", "))).when(F.size(spec.unverified) > 0, F.concat(F.lit("could not verify "), F.array_join(spec.unverified, ", ")))
    return F.struct((w.text * text + w.spec * spec.score).alias("both"), (w.text + w.spec).alias("rest"), w.proc.alias("proc"), (doubt | outside).alias("held"), (outside & ~doubt).alias("outside"), reason.alias("reason"))


def finished(said: Column, proc: Column) -> Column:
    """Struct (final, uncapped, review_reason) of what was ``weighed`` and the score of purchases."""
    final = half_up(F.when(proc.isNull(), said.both / said.rest).otherwise(said.both + said.proc * proc), 3)
    capped = F.when((final >= AUTO) & said.held, AUTO - 0.01).otherwise(final)
    reason = F.when((final >= AUTO) & said.outside, "outside every schema - matched on noun and numbers only").otherwise(said.reason)
    return F.struct(capped.alias("final"), final.alias("uncapped"), reason.alias("review_reason"))


def fuse(category: Column, text: Column, spec: Column, proc: Column, contradictions: Column | None = None) -> Column:
    """Struct (final, uncapped, review_reason): the three signals in one number.

    Without purchases their weight goes to the others. What couldn't be verified, a record that contradicts itself or a category without schema keeps a pair below
    the automatic band.
    """
    return finished(weighed(category, text, spec, contradictions), proc)


def compared(pairs: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Adds spec, and _f, what it would be if every vetoing field agreed: what a pair's categories and attributes alone say."""
    c = F.col
    varied = c("varied") if "varied" in pairs.columns else None
    same = c("category_a") == c("category_b")
    made = pairs.withColumn("_o", outcomes(c("category_a"), c("attributes_a"), c("attributes_b"), registry, varied))
    return made.withColumn("spec", agreement(same, c("_o"))).withColumn("_f", agreement(same, flipped(c("_o")))).drop("_o")


def _flags(pairs: DataFrame) -> Column | None:
    return F.concat("contradictions_a", "contradictions_b") if {"contradictions_a", "contradictions_b"} <= set(pairs.columns) else None


def signals(made: DataFrame) -> DataFrame:
    """Adds _w and _wf to pairs that were ``compared`` and have their text's similarity: all of the score but for purchases, real and if every vetoing field agreed."""
    c, flags = F.col, _flags(made)
    return made.withColumn("_w", weighed(c("category_a"), c("text"), c("spec"), flags)).withColumn("_wf", weighed(c("category_a"), c("text"), c("_f"), flags))


def fused(made: DataFrame) -> DataFrame:
    """Adds the rest of what ``score_pairs`` adds to pairs that have their ``signals``."""
    c = F.col
    has = set(made.columns)
    flags = _flags(made)
    same = c("category_a") == c("category_b")
    blocked = F.coalesce(c("spec.blocked_by"), c("proc.blocked_by"))
    real, what_if = finished(c("_w"), c("proc.score")), finished(c("_wf"), F.when(c("proc.blocked_by").isNull(), c("proc.score")))
    made = made.withColumn("_real", real).withColumn("_if", what_if).withColumn("blocked_by", blocked)
    fields = F.concat(c("spec.vetoes"), F.when(c("proc.blocked_by").isNotNull(), F.array(c("proc.blocked_by"))).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    cause = F.struct(F.lit("blocked").alias("kind"), fields.alias("fields"), c("_if.final").alias("score"), c("_f.unverified").alias("capped_by"))
    held = F.struct(F.lit("unverified").alias("kind"), c("spec.unverified").alias("fields"), c("_real.uncapped").alias("score"), none.alias("capped_by"))
    clean = F.lit(True) if flags is None else F.coalesce(F.size(flags) == 0, F.lit(True))
    settable = F.size(F.array_except(c("spec.vetoes"), F.array_union(c("stated_a"), c("stated_b")))) == 0 if {"stated_a", "stated_b"} <= has else F.lit(True)
    counter = F.when(blocked.isNotNull(), F.when(same & (F.size(c("spec.vetoes")) <= MAX_FLIPS) & F.coalesce(settable, F.lit(True)), cause)).when((c("_real.uncapped") > c("_real.final")) & (F.size(c("spec.unverified")) > 0) & clean, held)
    return (
        made.withColumn("counterfactual", counter)
        .withColumn("final", F.when(blocked.isNotNull(), 0.0).otherwise(c("_real.final")))
        .withColumn("uncapped", F.when(blocked.isNull(), c("_real.uncapped")))
        .withColumn("review_reason", F.when(blocked.isNull(), c("_real.review_reason")))
        .drop("_f", "_w", "_wf", "_real", "_if")
    )


def score_pairs(pairs: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Scores every pair.

    ``pairs`` has a, b and, ending in _a and _b, category, attributes (map of num, str, conf), cpse and, if there are any, contradictions; text (similarity), proc (struct
    of procurement.procurement_similarity) and perhaps varied. With stated (names of the fields that a record states itself, as extract gives them), a pair that is blocked
    by a field which both records only derive has no counterfactual, as there is nothing to set. Added: spec, blocked_by, final, uncapped, review_reason, counterfactual.
    """
    # checkpointed: scores are read more than once, and a filter on them must not be pushed into these expressions
    return cut(fused(signals(compared(pairs, registry))))


def scope(cpse_a: Column, cpse_b: Column, plant_a: Column, plant_b: Column) -> Column:
    """Who decides on a pair: the registrar, a plant or a company."""
    known = F.coalesce(plant_a, F.lit("")) != ""
    return F.when(~cpse_a.eqNullSafe(cpse_b), "CROSS_CPSE").when(known & (plant_a == plant_b), "SAME_PLANT").otherwise("SAME_CPSE")


def band(score: Column) -> Column:
    return F.when(score >= AUTO, "auto").when(score >= REVIEW, "review").when(score.isNotNull(), "low")


def is_review(blocked_by: Column, final: Column) -> Column:
    return blocked_by.isNull() & (final >= REVIEW) & (final < AUTO)


def is_safety_refusal(blocked_by: Column) -> Column:
    return blocked_by.isNotNull() & ~blocked_by.isin(*NOT_SAFETY)


def one_field_from_auto(counterfactual: Column) -> Column:
    return F.coalesce((F.size(counterfactual.fields) == 1) & (counterfactual.score >= AUTO), F.lit(False))


def is_kept(final: Column, blocked_by: Column) -> Column:
    return (final > 0) | blocked_by.isNotNull()


def anchor(category: Column, attributes: Column, anchors: dict[str, tuple[str, ...]]) -> Column:
    """What names the item, or null if a part of the name is missing."""
    from .blocking import key_value

    def of(name: str, fields: tuple[str, ...]) -> Column:
        whole = reduce(lambda p, f: p & attributes[f].isNotNull(), fields, F.lit(True))
        return F.when((category == name) & whole, F.concat_ws("|", F.lit(name), *[key_value(attributes[f]) for f in fields]))

    return F.coalesce(*[of(n, f) for n, f in anchors.items()])


def variants(records: DataFrame, anchors: dict[str, tuple[str, ...]], registry: Registry = REGISTRY) -> DataFrame:
    """(anchor, varied): for each named item, the veto fields (not required, or grades) that its records state in more than one value."""
    wanted = F.create_map(*[z for n, fields in registry.items() for z in (F.lit(n), F.array(*[F.lit(f.name) for f in fields if f.hard and (not f.required or f.name in GRADE_FIELDS)]).cast("array<string>"))])
    rows = records.select(anchor(F.col("category"), F.col("attributes"), anchors).alias("anchor"), wanted[F.col("category")].alias("wanted"), F.explode(F.map_entries("attributes")).alias("e")).where("anchor is not null")
    value = F.when(F.col("e.key").isin(*GRADE_FIELDS), canonical_grade(F.col("e.value.str"))).otherwise(F.coalesce(F.col("e.value.num").cast("string"), canonical_text(F.col("e.value.str"))))
    counted = rows.where(F.array_contains("wanted", F.col("e.key"))).groupBy("anchor", F.col("e.key").alias("field")).agg(F.count_distinct(value).alias("n")).where("n > 1")
    return counted.groupBy("anchor").agg(F.sort_array(F.collect_set("field")).alias("varied"))


def explained(spec: Column) -> Column:
    """ARRAY<STRUCT<field, part>>: what each field that took part did."""

    def rows_of(part: str) -> Column:
        return F.transform(spec[part], lambda n: F.struct(n.alias("field"), F.lit(part).alias("part")))

    return F.concat(*[rows_of(x) for x in ("matched", "mismatched", "ignored", "unverified", "vetoes")])


def explain(scored: DataFrame) -> DataFrame:
    """A row for each pair and field that took part: what it did."""
    return scored.select("a", "b", "final", "blocked_by", F.explode(explained(F.col("spec"))).alias("r")).select("a", "b", "r.field", "r.part", "final", "blocked_by")
