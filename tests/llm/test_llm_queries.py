"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from latticework.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_every_query_is_registered():
    assert {re.match(r"op\d+", n)[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, SF).select(columns).collect()
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert Counter(map(plain, got)) == Counter(map(plain, found.fetchall()))


def _similar(rows, width=5, percent=80):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])
    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    comp = {k: k for k in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(k), find(j)))
                comp[b] = a
    return {k for k in sets if find(k) == k}


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "pack sequences"]
    before = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        if name != "pack sequences":
            assert docs.columns == columns and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "quality rules":
            assert 0.75 * len(before) < len(after) < len(before)
            assert all(len(r.text.split()) >= 10 for r in after)
        elif name == "exact dedup":
            squeezed = lambda rows: Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in rows)
            assert set(squeezed(before)) == set(squeezed(after)) and max(squeezed(after).values()) == 1
        elif name == "near dedup":
            assert {r.doc_id for r in after} == _similar([(r.doc_id, r.text) for r in before])
        elif name == "mix sources":
            assert max(Counter(r.doc_id for r in after).values()) <= 3
        else:
            pieces = Counter(r.doc_id for r in after if r.piece == 0)
            assert pieces == Counter(r.doc_id for r in before)
            room = defaultdict(int)
            for r in after:
                room[r.sequence_id] += r.length
            assert max(room.values()) <= 1024 and len(room) <= 1.05 * sum(room.values()) / 1024 + 1
        before = after


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
