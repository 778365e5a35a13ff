"""Hand-written cases of extraction, comparison, scoring, clustering, the gate, governance and labels."""

import json

import pytest
from pyspark.sql import functions as F

from latticework.functions import extract, grades, standards, text
from latticework.functions.numbers import half_up, plain_number, two_figures
from latticework.functions.registry import ANCHORS, REGISTRY
from latticework.operators import blocking, canonical, clustering, evaluation, gate, generate, governance, graph, labels, mining, ordering, procurement, reports, scoring, units

ATTRS = "map<string,struct<num:double,str:string,conf:double>>"


def attrs(**values):
    return {k: (float(v), None, 0.9) if isinstance(v, int | float) else (None, v, 0.9) for k, v in values.items()}


def scores(spark, *pairs, **more):
    """Each pair: (category, attributes of a, attributes of b)."""
    rows = [(f"a{i}", f"b{i}", c, c2 if isinstance(c2, str) else c, x, y, "C1", "C2", 1.0) for i, (c, x, y, c2) in enumerate((*p, None) if len(p) == 3 else p for p in pairs)]
    df = spark.createDataFrame(rows, f"a string, b string, category_a string, category_b string, attributes_a {ATTRS}, attributes_b {ATTRS}, cpse_a string, cpse_b string, text double")
    df = df.withColumn("proc", F.lit(None).cast("struct<score:double,blocked_by:string>"))
    for k, v in more.items():
        df = df.withColumn(k, v)
    used = {c for p in pairs for c in (p[0], p[3] if len(p) == 4 else p[0])}
    return scoring.score_pairs(df, {c: REGISTRY[c] for c in sorted(used)}).orderBy("a").collect()


FULL = {
    "bearing": attrs(iso_designation="6205", bore_mm=25, od_mm=52, width_mm=15, seal_type="2RS", sub_type="deep_groove_ball"),
    "gasket": attrs(gasket_type="spiral_wound", material_grade="SS316", nominal_size_in=4, pressure_class="150#", filler="GRAPHITE", thickness_mm=4.5),
    "pipe": attrs(construction="seamless", material_grade="A106 GR B", nominal_size_in=4, schedule="SCH 40", od_mm=114.3, wall_mm=6.02, finish="black", end_type="bevel"),
    "cable": attrs(cable_type="power", cores=3.5, cross_section_mm2=70, conductor="AL", voltage_kv=1.1, insulation="XLPE", armour="armoured"),
    "fastener": attrs(fastener_type="bolt", head_type="hex", thread="M16", length_mm=60, material_grade="8.8"),
}


@pytest.mark.parametrize("category", sorted(FULL))
def test_one_changed_veto_field_blocks_and_is_named(spark, category):
    whole, changed, fields = FULL[category], [], []
    for f in REGISTRY[category]:
        if f.hard and f.name in whole:
            other = (whole[f.name][0] * 3 + 1, None, 0.9) if f.kind == "num" else (None, "SS304" if "material" in f.name else "OTHER", 0.9)
            changed.append((category, whole, whole | {f.name: other}))
            fields.append(f.name)
    got = scores(spark, (category, whole, whole), *changed)
    by_name = {r.a: r for r in got}
    assert by_name["a0"].final >= 0.9 and by_name["a0"].blocked_by is None
    for i, f in enumerate(fields, 1):
        r = by_name[f"a{i}"]
        assert r.blocked_by == f and r.final == 0 and r.counterfactual.fields == [f] and r.counterfactual.score >= 0.9


def test_silence_holds_a_pair_back_and_an_alternative_verifies(spark):
    g, p = FULL["gasket"], FULL["pipe"]
    without = lambda d, *names: {k: v for k, v in d.items() if k not in names}
    one_sided, no_grade, by_wall, unstated_schedule = scores(spark, ("gasket", g, without(g, "filler")), ("gasket", without(g, "material_grade"), without(g, "material_grade")), ("pipe", without(p, "schedule"), without(p, "schedule")), ("pipe", without(p, "schedule", "wall_mm"), without(p, "schedule", "wall_mm")))
    assert one_sided.final < 0.9 and one_sided.spec.unverified == ["filler"] and one_sided.counterfactual.kind == "unverified"
    assert no_grade.final < 0.9 and by_wall.final >= 0.9 and unstated_schedule.final < 0.9


def test_brand_never_counts_and_categories_part(spark):
    b = FULL["bearing"]
    brands, kinds, other = scores(spark, ("bearing", b | attrs(brand="SKF"), b | attrs(brand="FAG")), ("bearing", b, FULL["pipe"], "pipe"), ("other", attrs(noun="HOSE", quantities="2IN"), attrs(noun="HOSE", quantities="2IN")))
    assert brands.final >= 0.9 and brands.spec.ignored == ["brand"]
    assert kinds.blocked_by == "category" and kinds.counterfactual is None
    assert other.final < 0.9 and other.review_reason.startswith("outside every schema")


def test_variants_that_the_registry_has_seen_hold_a_pair_back(spark):
    g = {k: v for k, v in FULL["gasket"].items() if k != "filler"}
    (r,) = scores(spark, ("gasket", g, g), varied=F.array(F.lit("filler")))
    assert r.final < 0.9 and "filler" in r.spec.unsure
    rows = spark.createDataFrame([(i, "gasket", FULL["gasket"] | attrs(filler=f)) for i, f in enumerate(("GRAPHITE", "PTFE"))], f"id int, category string, attributes {ATTRS}")
    assert scoring.variants(rows, ANCHORS).collect()[0].varied == ["filler"]


def test_grades_standards_and_connections(spark):
    cases = [("SS316", "ss 316", "mismatch"), ("A193_B7", "ASTM A193 B7", "agree"), ("CARBON_STEEL", "A106 GR B", "unknown"), ("CARBON_STEEL", "SS316", "mismatch"), ("CS", "MS", "unknown"), ("SS304", "SS316", "mismatch"), ("A325", "F3125 A325", "agree"), ("8.8", "A325", "unknown"), ("XYZ", "SS316", "mismatch")]
    df = spark.createDataFrame(cases, "x string, y string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", grades.compare_grades(F.col("x"), F.col("y"))).collect())
    rel = spark.createDataFrame([("IS 1367 (Part 3)", "ISO 898-1", "IDENTICAL"), ("IS 1367", "IS 1367-3", "IDENTICAL"), ("A325", "F3125 Grade A325", "SUPERSEDED"), ("8.8", "A325", "NEAREST"), ("8.8", "10.9", None), ("ISO 898-1", "8.8", None)], "x string, y string, want string")
    assert all(r.got == r.want for r in rel.withColumn("got", grades.equivalence(F.col("x"), F.col("y")).relation).collect())
    con = spark.createDataFrame([("1/2 IN NPT BOTTOM", "1/2 NPT LOWER", "agree"), ("1/2 NPT", "3/4 NPT", "mismatch"), ("1/2 NPT BACK", "1/2 NPT", "unknown"), ("1/2 NPT", "1/2 BSP", "mismatch"), ("WELDED", "welded", "agree")], "x string, y string, want string")
    assert all(r.got == r.want for r in con.withColumn("got", scoring.compare_connections(F.col("x"), F.col("y"))).collect())


def test_extraction_and_its_contradictions(spark):
    lines = {
        "SKF 6205-2RS DEEP GROOVE BALL BEARING": ("bearing", {"iso_designation": "6205", "seal_type": "2RS", "bore_mm": 25.0}, []),
        "GASKET SPIRAL WOUND SS316 4IN 150#": ("gasket", {"material_grade": "SS316", "nominal_size_in": 4.0, "pressure_class": "150#"}, []),
        "PIPE, BLK, CS, FE410, ERW, 100 NB": ("pipe", {"construction": "erw", "finish": "black", "nominal_size_in": 4.0, "od_mm": 114.3}, []),
        "6205 BEARING 30X62X16 MM": ("bearing", {"bore_mm": 30.0}, ["dimensions"]),
        "MOTOR 7.5 KW 20 HP 1440 RPM 4 POLE 415V": ("electrical", {"power_kw": 7.5, "poles": 4.0}, ["power_hp"]),
        "MOTOR 3 PHASE 7.5 KW 1440 RPM 2 POLE": ("electrical", {"phases": 3.0}, ["speed_rpm"]),
        "TRANSFORMER BUSHING 33 KV": ("other", {"noun": "BUSHING"}, []),
        "GASKTE SS304 2\" 300#": ("gasket", {"material_grade": "SS304"}, []),
        "VALVE, PLUG, 2 INCH": ("valve", {"valve_type": "plug"}, []),
        "": ("other", {}, []),
    }
    got = {r.description: r for r in extract.extract(spark.createDataFrame([(x,) for x in lines], "description string")).collect()}
    for line, (category, facts, odd) in lines.items():
        r = got[line]
        assert r.category == category, line
        for f, v in facts.items():
            assert (r.attributes[f].num if isinstance(v, float) else r.attributes[f].str) == v, (line, f)
        assert [c.field for c in r.contradictions] == odd, line


def test_cleaning_agrees_in_both_forms_and_points_at_its_source(spark):
    lines = ["Pipe, BLK, gi, 2.1/16\" x 10M", "N-80 casing, 9.5/8 INCH", "A 105 flange: RF; 150#", "cost 10, 000 PSI – API-5L", "a  ,, b", "", "SMLS, CS, ASTM-A106 GR B"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", text.normalise(F.col("x")).alias("y"), text.normalise_with_positions(F.col("x")).alias("z"))
    for r in df.collect():
        assert r.y == r.z.clean and len(r.z.at) == len(r.y) and all(0 <= p < len(r.x) for p in r.z.at)
    spans = extract.evidence(spark.createDataFrame([("PIPE, BLK, 100 NB",)], "d string"), "d", {"finish": "BLACK", "size": r"\d+ NB"}).collect()[0].evidence
    assert "PIPE, BLK, 100 NB"[spans["size"].s : spans["size"].e] == "100 NB" and spans["finish"].s == 6


def test_numbers(spark):
    r = spark.range(1).select(half_up(F.lit(2.675), 2).alias("a"), plain_number(F.lit(25.0)).alias("b"), plain_number(F.lit(2.5)).alias("c"), plain_number(F.lit(None).cast("double")).alias("d"), two_figures(F.lit(457.0)).alias("e"), two_figures(F.lit(0.0)).alias("f"), text.inches(F.lit("2-1/16")).alias("g"), text.inches(F.lit("1/2")).alias("h"), text.inches(F.lit("3/0")).alias("i"), procurement.rupees(F.lit(2.5e7)).alias("j"), text.one_slip(F.lit("GASKTE"), F.lit("GASKET")).alias("k"), text.one_slip(F.lit("VALVE"), F.lit("VALVE")).alias("l")).first()
    assert (r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l) == ("25", "2.5", None, 460.0, 0.0, 2.0625, 0.5, None, "Rs 2.50 cr", True, False)
    assert abs(r.a - 2.68) < 1e-9
    s = spark.range(1).select(standards.pipe_wall(F.lit(4.0), F.lit("SCH 40S")).alias("w"), standards.nps_from_mm(F.lit(50.8)).alias("n"), standards.nps_for_od(F.lit(115.0)).alias("o"), standards.nps_for_dn(F.lit(100.0)).alias("d"), standards.wall_from_weight(F.lit(114.3), F.lit(10.79)).alias("t")).first()
    assert (s.w, s.n, s.o, s.d) == (6.02, 2.0, 4.0, 4.0) and abs(s.t - 6.02) < 0.01


def test_blocking_keeps_ties_and_meets_records_that_lack_a_field(spark):
    g = FULL["gasket"]
    rows = [(1, "gasket", g), (2, "gasket", {k: v for k, v in g.items() if k != "material_grade"}), (3, "gasket", g | attrs(brand="X")), (4, "bearing", FULL["bearing"]), (5, "unknown", {})]
    df = spark.createDataFrame(rows, f"id int, category string, attributes {ATTRS}")
    got = {tuple(r) for r in blocking.candidate_pairs(df, "id", blocking.keys(F.col("category"), F.col("attributes"))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 12)] + [(0, 20, 0.5)], "a int, b int, weight double")
    kept = {r.b for r in blocking.best_partners(star).collect() if r.a == 0}
    assert set(range(1, 12)) <= kept
    assert blocking.best_partners(star.where("b < 12")).count() == 11
    t = df.select("id", blocking.thin(F.col("category"), F.col("attributes")).alias("thin")).collect()
    assert {r.id for r in t if r.thin} == {5}


def test_clusters_split_where_a_chain_does_not_hold(spark):
    ids = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    pairs = [("a", "b", 0.95), ("b", "c", 0.75), ("a", "c", 0.3), ("d", "e", 0.95), ("e", "f", 0.8), ("d", "f", 0.85)]
    got = {r.id: r for r in clustering.build(ids, spark.createDataFrame(pairs, "a string, b string, final double"), "id").collect()}
    assert got["a"].cluster == got["b"].cluster == "a" and got["a"].band == "auto" and got["c"].band == "single"
    assert {got[x].cluster for x in "def"} == {"d"} and got["d"].band == "review" and got["d"].weakest_pair == 0.8
    assert got["g"].band == "single" and got["g"].size == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_gate_order_of_verdicts(spark):
    b, g = FULL["bearing"], FULL["gasket"]
    catalogue = spark.createDataFrame([("N1", "bearing", b, "BEARING 6205"), ("N2", "gasket", g, "GASKET SS316")], f"code string, category string, attributes {ATTRS}, description string")
    requests = [("r1", "bearing", b, "BEARING 6205", []), ("r2", "gasket", g | attrs(material_grade="SS304"), "GASKET SS304", []), ("r3", "bearing", attrs(iso_designation="6205"), "BEARING", []), ("r4", "bearing", b, "BEARING 6205", ["x"]), ("r5", "unknown", attrs(noun="X"), "X", [])]
    df = spark.createDataFrame(requests, f"request string, category string, attributes {ATTRS}, description string, contradictions array<string>")
    got = {r.request: r for r in gate.verdicts(df, catalogue, {c: REGISTRY[c] for c in ("bearing", "gasket", "unknown")}).collect()}
    assert [got[f"r{i}"].verdict for i in range(1, 6)] == ["EXISTS", "NEW", "INCOMPLETE", "CONTRADICTS", "INCOMPLETE"]
    assert got["r1"].best == "N1" and got["r2"].n_refused == 1 and got["r2"].distinguished_from[0].blocked_by == "material_grade" and got["r3"].missing_hard[0] == "bore_mm" and got["r1"].compared_against == 2


def test_golden_votes_and_descriptions(spark):
    rows = [(1, "k", "bearing", attrs(iso_designation="6205", seal_type="2RS")), (2, "k", "bearing", attrs(iso_designation="6205", seal_type="2Z")), (3, "k", "bearing", attrs(seal_type="2Z")), (4, "k", "pipe", attrs(seal_type="ODD"))]
    got = {r.field: r for r in canonical.golden_fields(spark.createDataFrame(rows, f"id int, cluster string, category string, attributes {ATTRS}"), "cluster", "id").collect()}
    assert got["seal_type"].value == "2Z" and got["seal_type"].agreement == 0.67 and got["iso_designation"].agreement == 1.0
    df = spark.createDataFrame([("bearing", FULL["bearing"]), ("fastener", FULL["fastener"]), ("other", attrs(noun="HOSE")), ("gasket", {})], f"category string, attributes {ATTRS}")
    texts = [r[0] for r in df.select(canonical.standard_description(F.col("category"), F.col("attributes"))).collect()]
    assert texts == ["BEARING, DEEP GROOVE BALL, 6205, 25X52X15 MM, 2RS SEALED", "BOLT, HEX, M16 X 60, 8.8", "MATERIAL, HOSE", "GASKET"]


def test_numbers_within_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = ordering.numbered(df, ["g"], [F.desc("id")], "n").collect()
    for g in range(3):
        rows = sorted((r for r in got if r.g == g), key=lambda r: -r.id)
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))


def _log(spark):
    base = dict(ts="1", role="registrar", org="R", object=None, note='é "q"\n', code=None, source=None)
    rows = [dict(base, seq=i, log="L", id=f"e{i}", actor="x", verb="ACCEPT", pair=f"p{i % 3}~q") for i in range(6)]
    return spark.createDataFrame(rows, "seq long, log string, id string, ts string, actor string, role string, org string, verb string, object string, pair string, note string, code string, source string")


def test_chain_breaks_where_it_was_touched(spark):
    sealed = governance.seal(_log(spark), "log", "seq").cache()
    first = sealed.orderBy("seq").first()
    import hashlib

    fields = [first[f] for f in governance.SEALED]
    assert first.prev == governance.GENESIS and first.hash == hashlib.sha256(json.dumps(fields, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    check = lambda df: governance.verify(df, "log", "seq").first()
    assert check(sealed).ok and check(sealed).checked == 6 and not check(sealed).trimmed
    assert check(sealed.withColumn("note", F.when(F.col("seq") == 3, "x").otherwise(F.col("note")))).broken_at == 3
    assert check(sealed.where("seq != 2")).broken_at == 2 and "link" in check(sealed.where("seq != 2")).reason
    assert check(sealed.withColumn("hash", F.when(F.col("seq") == 1, F.lit(None)).otherwise(F.col("hash")))).reason == "an event has no seal"
    assert check(sealed.where("seq > 1")).trimmed


def test_consent_and_latest_decision(spark):
    pairs = spark.createDataFrame([("p0~q", "A", "B"), ("p1~q", "A", "A")], "pair string, a_cpse string, b_cpse string")
    got = {r.pair: r.state for r in governance.replay(_log(spark), pairs, "seq").collect()}
    assert got == {"p0~q": "LINKED"}
    why = {r.id: r.why for r in governance.judged_decisions(_log(spark), pairs).collect()}
    assert why["e0"] == "" and "company's reviewer" in why["e1"] and why["e2"] == "no such proposal"
    retire = _log(spark).withColumns({"verb": F.lit("RETIRE_PROPOSED"), "code": F.lit("N"), "source": F.lit("s"), "role": F.lit("reviewer"), "org": F.when(F.col("seq") == 0, "A").otherwise("B")})
    owners = spark.createDataFrame([("N", "s", "A")], "national_code string, source_code string, cpse string")
    assert [r.ok for r in governance.judged_retirements(retire, owners).orderBy("seq").collect()] == [True] + [False] * 5


def test_bounds_kappa_and_thresholds(spark):
    got = [r.bound for r in evaluation.error_bound(spark.createDataFrame([(0, 10, 0), (3, 10, 1), (10, 10, 2), (0, 0, 3)], "w int, n int, o int"), "w", "n").orderBy("o").collect()]
    assert got[0] == pytest.approx(1 - 0.05**0.1) and got[1] == pytest.approx(0.6066, abs=1e-3) and got[2] == 1.0 and got[3] is None
    same = spark.createDataFrame([(1, 1)] * 3, "x int, y int")
    assert labels.kappa(same, "x", "y").first().kappa == 1.0 and labels.kappa(same.limit(0), "x", "y").first().kappa == 0.0
    sheet = spark.createDataFrame([("1", "y", "g"), ("2", "y", "g"), ("3", "y", ""), ("4", "n", "g")], "id string, keep string, group string")
    done = {r.id: r.group for r in labels.finalise(sheet, spark.createDataFrame([("pair", "2", "3", "same")], "kind string, id_a string, id_b string, decision string"), labels.same_pairs(sheet)).collect()}
    assert done == {"1": "1", "2": "1", "3": "1"}
    fresh = labels.disagreements(sheet, sheet.withColumn("keep", F.lit("n")), ["keep"])
    earlier = fresh.withColumn("decision", F.lit("one")).withColumn("reason", F.lit("r")).limit(1)
    assert labels.carried(fresh, earlier).where("decision = 'one'").count() == 1


def test_units_packs_and_mining(spark):
    raw = spark.createDataFrame([("no.",), ("MTS",), ("PKT",), (None,), (" ea ",)], "uom string")
    assert sorted((r.raw, r.canon, r.status) for r in units.spellings(raw).collect()) == [("EA", "EA", "folded"), ("MTS", None, "ambiguous"), ("NO.", "EA", "folded"), ("PKT", None, "unrecognised")]
    prices = spark.createDataFrame([("N", "A", "1", 5.0), ("N", "B", "2", 500.0), ("M", "A", "3", 5.0), ("M", "B", "4", 6.0)], "national_code string, cpse string, source_code string, median_price double")
    (flag,) = units.pack_size_flags(prices).collect()
    assert flag.national_code == "N" and flag.ratio == 100.0
    rows = spark.createDataFrame([(1, "GATE VALVE 2 INCH 150# ASTM A105, FLANGED"), (2, "gate valve 2 inch 150# astm a105 flanged"), (3, "SUPPLY CONTRACT"), (4, "PIPE 4 INCH SCH 40, ERW")], "id int, line string")
    ranked = mining.ranked_lines(rows, "line", ["id"]).orderBy("rank").collect()
    assert [r.id for r in ranked] == [1, 4] and [r["rank"] for r in ranked] == [1, 2]
    assert mining.packed_cells(spark.createDataFrame([("", "a | b||c")], "x string, y string"), ["x", "y"], []).count() == 3


def test_material_score_is_the_references(spark):
    want = {
        "GATE VALVE 2 INCH 150# ASTM A105, FLANGED": 56, "PIPE:BLK,2 INCH,SCH 40": 73, "pipe 2 inch 4 inch 12345678901234567890123456789": 8, "PIPE 2 INCH": 0, "GATE VALVE LARGE SIZE": 0, "WIDGET 2 INCH ASTM A105": 0,
        "ANNUAL TENDER FOR VALVE 2 INCH, ASTM A105": 0, "PIPE 2 INCH " + "X" * 140: 0,
    }
    lines = spark.createDataFrame([(x,) for x in want], "line string").select("line", mining.material_score(F.col("line")).alias("score"))
    assert {r.line: r.score for r in lines.collect()} == want


def test_generated_items_differ_as_they_should(spark):
    items = generate.universe(spark, {"size": [1, 2, 3], "grade": ["A", "B"], "end": ["x", "y"]}, (F.col("size") < 3) | (F.col("grade") == "A")).withColumn("id", F.concat_ws("-", F.col("size").cast("string"), "grade", "end"))
    assert items.count() == 10
    found = {(r.a, r.b, r.field) for r in generate.traps(items, "id", ["size", "grade"], ["size", "grade", "end"]).collect()}
    assert ("1-A-x", "1-B-x", "grade") in found and not any(a[-1] != b[-1] for a, b, _ in found)
    a, b = (sorted(r.id for r in generate.sample(items, 4, F.lit(1.0), ["id"], 7).collect()) for _ in "ab")
    assert a == b and len(a) == 4
    styled = generate.copies(items, "id").withColumn("s", generate.style("id")).withColumn("t", generate.describe(F.lit("VALVE"), [F.col("grade"), F.col("end")], F.col("s")))
    assert styled.count() >= 10 and styled.where("t is null").count() == 0
    r = spark.range(1).select(generate.with_typo(F.lit("FLANGED"), F.lit(0.3)).alias("t"), generate.without_part(F.lit("A, B, C"), F.lit(0.1)).alias("p")).first()
    assert sorted(r.t) == sorted("FLANGED") and r.p == "A, C"


def test_reports(spark):
    rows = spark.createDataFrame([("N1", "hot gear", 3), ("N2", "cold gear", 2), ("N3", "pin", 1)], "code string, text string, n int")
    assert [r.code for r in reports.search(rows, " GEAR hot", ["code", "text"]).collect()] == ["N1"] and reports.search(rows, "", ["text"]).count() == 3
    total, shown = reports.capped(rows, [F.desc("n")], 2)
    assert total.first().total == 3 and [r.code for r in shown.collect()] == ["N1", "N2"]
    assert reports.demo_pair(spark.createDataFrame([("x", "y")], "a string, b string"), "y", "x").count() == 1


def test_seals_carry_on_over_batches_logs_and_nulls(spark):
    import hashlib

    one = _log(spark)
    rows = one.unionByName(one.withColumn("log", F.lit(None).cast("string"))).unionByName(one.withColumn("log", F.lit("M")))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        sealed = governance.seal(rows, "log", "seq").cache()
        got = sealed.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == 18
    for name in ("L", None, "M"):
        last = governance.GENESIS
        for r in sorted((r for r in got if r.log == name), key=lambda r: r.seq):
            text = json.dumps([r[f] for f in governance.SEALED], ensure_ascii=False, separators=(",", ":"))
            assert r.prev == last and r.hash == hashlib.sha256(text.encode()).hexdigest()
            last = r.hash
    assert sorted((str(r.log), r.ok, r.checked) for r in governance.verify(sealed, "log", "seq").collect()) == [("L", True, 6), ("M", True, 6), ("None", True, 6)]


def test_merged_traps_and_splits(spark):
    truth = spark.createDataFrame([(1, "p", "dev"), (2, "q", "dev"), (3, "p", "dev"), (4, "r", "test")], "id int, item string, split string")
    pairs = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.95), (2, 3, 0.8), (3, 4, 0.99)], "a int, b int, final double")
    hits = evaluation.merged_traps(pairs, truth, "id", F.col("item"), spark.createDataFrame([("q", "p")], "x string, y string")).collect()
    assert [(r.a, r.b, r.item_a, r.item_b) for r in hits] == [(1, 2, "p", "q")]
    got = {r.split: r for r in evaluation.dev_test_metrics(pairs, truth, "id", ["item"], "split").collect()}
    assert (got["dev"].records, got["dev"].auto_merged, got["dev"].auto_wrong, got["dev"].auto_precision, got["dev"].recall, got["dev"].true_pairs) == (3, 2, 1, 0.5, 1.0, 1)
    assert (got["test"].records, got["test"].auto_merged, got["test"].auto_precision, got["test"].recall) == (1, 0, 1.0, 1.0)
    copies = spark.createDataFrame([("Gate valve, 2 in",), ("GATE VALVE 2 IN",)], "d string").select(labels.split_of(F.col("d")).alias("s"), labels.split_of(F.col("d"), F.lit(True)).alias("t")).collect()
    assert copies[0].s == copies[1].s and copies[0].t == "dev"


def test_no_counterfactual_for_a_field_that_both_records_only_derive(spark):
    b = FULL["bearing"]
    pair = ("bearing", b, b | attrs(bore_mm=75))
    names = lambda *x: F.array(*map(F.lit, x))
    (derived,) = scores(spark, pair, stated_a=names("iso_designation"), stated_b=names("iso_designation"))
    (stated,) = scores(spark, pair, stated_a=names("iso_designation"), stated_b=names("bore_mm"))
    assert derived.blocked_by == stated.blocked_by == "bore_mm" and derived.counterfactual is None and stated.counterfactual.fields == ["bore_mm"]
    (r,) = extract.extract(spark.createDataFrame([("PIPE, BLK, CS, FE410, ERW, 100 NB",)], "description string")).collect()
    assert "nominal_size_in" in r.stated and "od_mm" not in r.stated and "od_mm" in r.attributes
