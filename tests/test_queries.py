import duckdb
import pytest

import __spark_entry__
from driftloom.plans import queries as Q
from driftloom.streaming import incremental


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        c.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, small, con, name):
    got = Q.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    if name in Q.SQL:
        want = con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({Q.SQL[name]})").fetchall()
        assert rows == sorted(want, key=repr)
    else:
        assert rows


@pytest.mark.parametrize("name", ["extract_pages", "corpus_manifest"])
def test_cut_references(spark, tmp_path, name):
    """Titles that end inside a character reference come out as the SQL has them."""
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>" + "Some words of a page. " * 9 + "</p></article></body></html>"
    titles = ["one &amp; two&amp", "three&lt", "four &quot", "five&am", "six &amp;lt"]
    rows = [(i, f"https://e.com/en/{i}/p", page.format(t)) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = Q.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({Q.SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_regular_links_equal_tree_links(spark, small):
    """Expressions find the links that the tree finds, but for escapes of characters beyond ASCII."""
    tree = {(r.src, r.dst) for r in Q.QUERIES["dom_links"](spark, small).collect() if "%" not in r.dst}
    plain = {(r.src, r.dst) for r in Q.QUERIES["page_links"](spark, small).collect() if r.dst.isascii()}
    assert plain == tree


def test_modes_of_dedup_agree(spark, small):
    ways = [{(r.ord, r.url) for r in Q.QUERIES[n](spark, small).where("ok").collect()} for n in ("dedup_survivors", "dedup_components", "dedup_sequential") if n != "dedup_survivors"]
    assert ways[0] == ways[1] == {(r.ord, r.url) for r in Q.QUERIES["dedup_survivors"](spark, small).collect()}


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_incremental(spark, tmp_path):
    pages = lambda n: [(i, f"https://e.com/{i % 5}", f"<main><h1>P{i}</h1><p>{'word ' * 50}</p></main>") for i in range(n)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (3, 9):
        spark.createDataFrame(pages(n), incremental.PAGES).coalesce(1).write.mode("append").parquet(source)
        incremental.start(incremental.new_pages(spark, source), out, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(out).select("url").distinct().count() == spark.read.parquet(out).count() == 5
