"""Queries with SQL against DuckDB over tables made to be odd: letters that engines treat differently, many copies of a part."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from latticework.plans.catalogue import ORACLE_SQL, QUERIES

from test_queries import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def agrees(spark, folder, name):
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    rows = Counter(plain(r) for r in want.fetchall())
    assert Counter(plain(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(columns).collect()) == rows
    return rows


@pytest.mark.parametrize("name", ["line_mining_rank", "mined_lines"])
def test_a_letter_is_one_letter_in_upper_case(spark, tmp_path, name):
    texts = ["Order 12, Straße", "Order 12, Strasse", "order 12, strae", "order 34, ﬁn", "order 34, fin", "order 34, n", "IDIOẗ 5, 6"]
    duckdb.sql("SELECT unnest(?) AS doc_id, unnest(?) AS text", params=[list(range(len(texts))), texts]).write_parquet(str(tmp_path / "documents.parquet"))
    assert sum(agrees(spark, tmp_path, name).values()) >= 4


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest tables, parts, suppliers and line items 20 times with keys of their own."""
    folder = tmp_path_factory.mktemp("copies")
    for name in ("region", "nation"):
        duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").write_parquet(str(folder / f"{name}.parquet"))
    shifts = {"part": {"p_partkey": 200}, "supplier": {"s_suppkey": 10}, "lineitem": {"l_orderkey": 1500, "l_partkey": 200, "l_suppkey": 10}}
    for name, keys in shifts.items():
        moved = ", ".join(f"({k} + i * {by})::BIGINT AS {k}" for k, by in keys.items())
        duckdb.sql(f"SELECT t.* REPLACE ({moved}) FROM '{SF}/{name}.parquet' t, range(20) r(i)").write_parquet(str(folder / f"{name}.parquet"))
    return folder


def test_scores_of_copies_leave_no_row_for_each_pair_behind(spark, copies, monkeypatch):
    from latticework.operators import blocking, scoring
    from latticework.plans import matching_queries

    kept = []

    def counted(df, cut=blocking.cut):
        kept.append(cut(df))
        return kept[-1]

    for module in (blocking, scoring, matching_queries):
        monkeypatch.setattr(module, "cut", counted)
    pairs = sum(agrees(spark, copies, "pair_scores").values())
    assert max(df.count() for df in kept) < pairs


def test_candidates_of_copies(spark, copies):
    assert agrees(spark, copies, "blocking_candidates")


def test_fuzzy_ratio_reads_two_texts_once(spark, copies, monkeypatch):
    from difflib import SequenceMatcher

    from latticework.operators import evaluation
    from latticework.plans.procurement_queries import twin_pairs
    from latticework.plans.standins import parts

    met = []

    def counted(pairs, x, y, ratio=evaluation.fuzzy_ratio):
        met.append(pairs)
        return ratio(pairs, x, y)

    monkeypatch.setattr(evaluation, "fuzzy_ratio", counted)
    got = {(r.a, r.b): r.fuzzy for r in QUERIES["fuzzy_ratio"](spark, str(copies)).collect()}
    assert set(got) == {(r.a, r.b) for r in twin_pairs(spark, str(copies)).select("a", "b").collect()}
    assert met[0].count() * 10 < len(got)
    text = {r.record_id: r.description.lower() for r in parts(spark, str(copies)).collect()}
    assert all(abs(got[a, b] - SequenceMatcher(None, text[a], text[b], autojunk=False).ratio()) < 6e-5 for a, b in list(got)[:500])


def test_tfidf_weighs_a_text_once(spark, copies, monkeypatch):
    from latticework.operators import evaluation
    from latticework.plans.procurement_queries import twin_pairs
    from latticework.plans.standins import parts

    met = []

    def counted(docs, *args, vectors=evaluation.tfidf_vectors, **named):
        met.append(docs)
        return vectors(docs, *args, **named)

    monkeypatch.setattr(evaluation, "tfidf_vectors", counted)
    got = {(r.a, r.b): r.tfidf for r in QUERIES["tfidf_cosine"](spark, str(copies)).collect()}
    assert met[0].count() <= 200  # of 4000 parts
    monkeypatch.undo()
    each = evaluation.tfidf_scores(twin_pairs(spark, str(copies)), evaluation.tfidf_vectors(parts(spark, str(copies)), "record_id", "description"), "record_id")
    assert got == {(r.a, r.b): r.tfidf for r in each.collect()}
