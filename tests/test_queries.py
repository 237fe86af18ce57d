"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import queries_more, queries_records  # noqa: F401
from tessera.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    num = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else v
    return sorted(map(repr, ([num(v) for v in r] for r in df[cols].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_criteria_meet_every_document_of_their_source(spark, duck):
    got = QUERIES["criterion_coverage_all"](spark, SF).toPandas()
    want = duck.execute("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON d.source = 'src' || b.item_id % 20").fetchall()
    assert sorted(zip(got.item_id, got.doc_id, strict=True)) == sorted(want) and got.doc_id.nunique() > got.item_id.nunique()


def test_every_line_is_judged_by_itself(spark, duck):
    got = QUERIES["claim_statuses_all"](spark, SF).toPandas()
    own, same = "'o' || (p_partkey % 10 + 1) = 'o' || l_suppkey", "p_size = l_quantity"
    has = lambda c: f"EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND {c})"
    want = duck.execute(f"""SELECT l_orderkey, l_linenumber, CASE WHEN {has(f"{own} AND {same}")} THEN 'supported' WHEN {has(f"{own} AND NOT {same} AND p_size > 25")} THEN 'contradicted'
        WHEN {has(f"NOT {own} AND {same}")} THEN 'wrong_source' ELSE 'unknown' END FROM lineitem""").fetchall()
    assert sorted(zip(got.l_orderkey, got.l_linenumber, got.status, strict=True)) == sorted(want) and (got.l_linenumber > 1).any()


def test_structure_of_headings_with_numbers_fences_and_marks(spark, tmp_path):
    """Sections with a number of their own, none at all, and lines that look like other headings."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f)
    os.remove(tmp_path / "documents.parquet")
    lines = ["28.68 a b", "!!!", "2024 x", "1) 2) z", "一、甲", "## own", "### low", "# top", "```", "x y", "x y", "## ### 1. deep"]
    docs = pd.DataFrame([(i, None if i == 40 else "\n".join(lines[(i * 7 + k * k) % len(lines)] for k in range(i % 23 + 1)), "en", f"src{i % 4}", 1) for i in range(1, 60)], columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs.to_parquet(tmp_path / "documents.parquet")
    for f in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tmp_path}/{f}')")
    assert rows(QUERIES["report_structure"](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE_SQL["report_structure"]).df())
