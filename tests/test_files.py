"""Sources, sinks and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from latticework.functions.registry import REGISTRY
from latticework.operators import governance
from latticework.sources import readers, sinks
from latticework.streaming import streams

from test_matching import ATTRS, FULL, _log


def test_csv_with_mark_quotes_and_missing_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿record_id,cpse,description,extra\nR1,A,"PIPE, 4 IN",z\nR2,B,,\n', encoding="utf-8")
    rows = readers.csv(spark, str(tmp_path / "m.csv"), readers.MATERIALS).orderBy("record_id").collect()
    assert rows[0].record_id == "R1" and rows[0].description == "PIPE, 4 IN" and rows[1].description is None and rows[0].plant is None
    (tmp_path / "old.csv").write_bytes("id,t\n1,5° elbow\n".encode("cp1252"))
    assert readers.csv_any_codec(spark, str(tmp_path / "old.csv"), "id string, t string").first().t == "5° elbow"


def test_json_logs_vectors_and_seeds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}], indent=1))
    assert readers.json_rows(spark, str(tmp_path / "a.json"), "x int").count() == 2
    (tmp_path / "k.json").write_text(json.dumps({"R1": {"category": "pipe"}, "R2": {"category": "valve"}}))
    assert {r.record_id: r.category for r in readers.json_by_key(spark, str(tmp_path / "k.json"), "category string").collect()} == {"R1": "pipe", "R2": "valve"}
    (tmp_path / "log.jsonl").write_text('{"id":"e1","verb":"SKIP"}\n\n{"id":"e2"}\n')
    assert [r.id for r in readers.log_lines(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()] == ["e1", "e2"]
    np.savez(tmp_path / "v.npz", ids=np.array(["a", "b"]), vectors=np.eye(2, dtype="float32"))
    assert {r.record_id: list(r.vector) for r in readers.vectors_from_npz(spark, str(tmp_path / "v.npz")).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    assert readers.vectors(spark, str(tmp_path / "none")) is None
    (tmp_path / "s.csv").write_text("item,values\nx,a | b||c\n")
    assert list(readers.seed_list(spark, str(tmp_path / "s.csv"), "item string, values string", ["values"]).first()["values"]) == ["a", "b", "c"]
    assert readers.run_path("/d", "t", "15k") == "/d/runs/15k/t" and readers.run_path("/d", "t") == "/d/t"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', None), (2, "c,d", "e")], "n int, x string, y string")
    sinks.csv(df, str(tmp_path / "c"), ["n", "x"])
    assert {tuple(r) for r in readers.csv(spark, str(tmp_path / "c"), "n int, x string").collect()} == {(1, 'a "b"'), (2, "c,d")}
    sinks.erp_csv(df.where("n = 1"), str(tmp_path / "e"))
    assert next(tmp_path.glob("e/part*")).read_bytes() == b'"1","a ""b""",""\r\n'
    sinks.spreadsheet_csv(df, str(tmp_path / "s"), ["n", "x"])
    assert next(tmp_path.glob("s/part*")).read_text(encoding="utf-8").startswith("﻿n,x")
    sinks.documents(df, str(tmp_path / "d"))
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4 and spark.read.json(str(tmp_path / "d")).count() == 2
    sinks.table(df, str(tmp_path / "t"))
    assert sinks.resume(df.withColumn("n", F.col("n") + 1), str(tmp_path / "t"), "n").count() == 1 and sinks.resume(df, str(tmp_path / "no"), "n").count() == 2
    assert sinks.capped_bundle({"t": (df, [F.desc("n")], 1)}, str(tmp_path / "b")) == {"t": 2}
    assert readers.bundle(spark, str(tmp_path / "b"), ["t"])["t"].first().n == 2


def test_streamed_log_is_checked_across_batches(spark, tmp_path):
    sealed = governance.seal(_log(spark), "log", "seq")
    for part in (0, 1):
        changed = sealed.withColumn("note", F.when(F.col("seq") == 4, "x").otherwise(F.col("note"))).where((F.col("seq") >= 3) == F.lit(bool(part)))
        changed.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(sealed.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = streams.verified_log(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 6 and [s for s in got if not got[s].ok] == [4]


def test_streamed_requests_meet_the_catalogue(spark, tmp_path):
    catalogue = spark.createDataFrame([("N1", "bearing", FULL["bearing"], "BEARING 6205")], f"code string, category string, attributes {ATTRS}, description string")
    requests = spark.createDataFrame([("r1", "bearing", FULL["bearing"], "BEARING 6205")], f"request string, category string, attributes {ATTRS}, description string")
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    streams.gate_stream(stream, catalogue, str(tmp_path / "out"), str(tmp_path / "cp"), {"bearing": REGISTRY["bearing"]}).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().verdict == "EXISTS"
