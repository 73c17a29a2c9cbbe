"""Every core query against its SQL at the smallest size."""

import duckdb
import pytest

from tidemark.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "conversations", "benchmark")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sql, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in Q.ORACLE_SQL:
        assert got
        return
    result = sql.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_known_counts(spark):
    got = {(r.method, r.decision): r.pages for r in Q.QUERIES["gate_summary"](spark, SF).collect()}
    assert got == {("fast_discard", "discard"): 7, ("keyword_fast_pass", "keep"): 114, ("llm_fallback", "keep"): 8, ("llm_zero_hits_fallback", "keep"): 16, ("llm_zero_hits_fallback", "discard"): 54, ("rule_based", "discard"): 1}


def both(spark, folder, name):
    """A query's rows over the tables of a folder, and those of its SQL; sorted."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = Q.QUERIES[name](spark, str(folder))
    result = con.execute(Q.ORACLE_SQL[name])
    columns, names = sorted(df.columns), [d[0] for d in result.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr), want


def test_links_of_pages_that_share_a_url_or_a_number(spark, tmp_path):
    """Each row has its own links, as in SQL: several pages of one URL, and a repeated page."""
    pages = [(k, f"http://h{k // 4}.example/p.html", "<p>x</p>") for k in range(12)] + [(3, "http://h0.example/p.html", "<p>x</p>")]
    duckdb.connect().execute("create table p(page_id bigint, url varchar, html varchar)").executemany("insert into p values (?, ?, ?)", pages).execute(f"copy p to '{tmp_path}/pages.parquet'")
    got, want = both(spark, tmp_path, "combined_links")
    assert len(want) == 13
    assert got == want
