"""Every query with SQL against DuckDB over the smallest tables, and again with other partitionings."""

import re
from collections import Counter
from decimal import Decimal
from itertools import combinations
from pathlib import Path

import duckdb
import pytest

from latticework.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float | Decimal):
        return round(float(x), 6)
    return x


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    found.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert df.columns and df.count() >= 0
        return
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert Counter(plain(tuple(r)) for r in df.select(columns).collect()) == Counter(plain(r) for r in want.fetchall())


@pytest.mark.parametrize("name", ["savings_by_item", "blocking_candidates", "audit_replay", "national_codes", "state_digest"])
def test_partitioning_changes_nothing(spark, name):
    first = Counter(map(str, QUERIES[name](spark, SF).collect()))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert Counter(map(str, QUERIES[name](spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_near_misses_hold_pairs_that_differ_in_one_token(spark):
    import __spark_entry__
    from latticework.plans.standins import parts

    rows = [(r.record_id, r.category, set(re.findall("[a-z0-9]+", r.description.lower()))) for r in parts(spark, SF).collect()]
    want = {(min(a, b), max(a, b)) for (a, c, t), (b, d, u) in combinations(rows, 2) if c == d and len(t & u) / len(t | u) >= 0.6}
    got = [(r.a, r.b) for r in __spark_entry__.queries()["near_miss_pairs"](spark, SF).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_gate_compares_with_the_code_of_every_item(spark):
    import __spark_entry__

    codes = QUERIES["national_codes"](spark, SF)
    single = {r.first_record for r in codes.where("member_count = 1").collect()}
    got = {r.request: r for r in __spark_entry__.queries()["gate_all_codes"](spark, SF).collect()}
    assert single and {r.compared_against for r in got.values()} == {codes.count()}
    assert all(got[i].n_candidates > 0 and got[i].verdict == "EXISTS" for i in single)


def test_mined_lines_have_every_positive_score_and_a_rank(spark):
    import __spark_entry__

    got = sorted(__spark_entry__.queries()["mined_lines"](spark, SF).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert got[-1].score == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_subpackage():
    for p in Path(__file__).resolve().parent.parent.glob("latticework/**/*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_gate_in_blocks_is_the_gate(spark, monkeypatch):
    from latticework.operators import gate

    whole = sorted(map(tuple, QUERIES["gate_shown"](spark, SF).collect()), key=str)
    for name, value in (("BROADCAST_BYTES", 0), ("BLOCK_CODES", 40), ("SHARE_REQUESTS", 60), ("WORDS", 1)):
        monkeypatch.setattr(gate, name, value)
    assert sorted(map(tuple, QUERIES["gate_shown"](spark, SF).collect()), key=str) == whole
