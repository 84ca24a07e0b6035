"""How links in HTML are read and resolved, against the SQL as well."""

import duckdb
import pandas as pd
import pytest

from credit_engine.llm import urls

HERE = "http://a.org/x/y/z?q=1"
CASES = [
    ("<!-- <link rel=canonical href=/en/c> --><link rel=canonical href=/ok>", ["http://a.org/ok"]),
    ("<script>var s = '<link rel=canonical href=/en/s>';</script><style><link rel=canonical href=/t></style>", []),
    ("<!-- open <link rel=canonical href=/en/c>", []),
    ("<link data-rel=canonical href=/en/d>", []),
    ("<link title='a rel=canonical b' href=/en/t>", []),
    ('<link title="a > b" rel="alternate canonical" href=" /both ">', ["http://a.org/both"]),
    ("<LINK HREF='/case' REL = CANONICAL >", ["http://a.org/case"]),
    ("<link rel=canonicals href=/no><link rel=next href=/no>", []),
    ("<link rel=canonical href=../../en/x><link rel=canonical href=./b/../c/.>", ["http://a.org/en/x", "http://a.org/x/y/c/"]),
    ("<link rel=canonical href=../../../../up?a=../b#c/../d>", ["http://a.org/up?a=../b#c/../d"]),
    ("<link rel=canonical href='?p=2'><link rel=canonical href='#top'><link rel=canonical href=''>", ["http://a.org/x/y/z?p=2"]),
    ("<base href='http://b.net/deep/dir/page'><link rel=canonical href=leaf>", ["http://b.net/deep/dir/leaf"]),
    ("<base target=_top><base href='/sub/'><base href='/no/'><link rel=canonical href=leaf>", ["http://a.org/sub/leaf"]),
    ("<link rel=canonical href='HTTPS://C.Net/p'><link rel=canonical href='//d.net/q'><link rel=canonical href='mailto:x'>", ["HTTPS://C.Net/p", "http://d.net/q"]),
    ("<meta http-equiv=refresh content='5; URL=\"/r?a=1&amp;b=2\"'><meta http-equiv=refresh content=5>", ["http://a.org/r?a=1&b=2"]),
    ("<meta name=refresh content='0;url=/no'><meta http-equiv='content-type' content='url=/no'>", []),
    ("<linkrel=canonical href=/no><link\nrel=canonical\nhref=/lines\n/>", ["http://a.org/lines"]),
    ("canonical " + "<p>" * 20_000 + "<link rel=canonical " + "data-x='" + ">" * 30_000 + "' href=/long>", ["http://a.org/long"]),
    (None, []), ("", []),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, HERE, html) for i, (html, _) in enumerate(CASES)] + [(900, None, CASES[0][0]), (901, "no scheme", CASES[0][0])]


def test_links(spark, rows):
    pages = spark.createDataFrame([(i, f"{u}&n={i}" if u else None, h, {"x": 1}) for i, u, h in rows], "page_id long, url string, html string, tags map<string,int>")
    got = {}
    for r in urls.html_links(pages.filter("url LIKE '%://%'")).collect():
        got.setdefault(int(r.src.rpartition("=")[2]), []).append(r.dst)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(want) for i, (_, want) in enumerate(CASES) if want}
    assert urls.html_links(pages.limit(0)).count() == 0 and urls.html_links(pages.filter("page_id >= 900")).count() == 0


def test_links_block_as_the_sql_says(spark, rows):
    """Each case with a page that a rule blocks at the end of its links."""
    pages = [(i, f"http://a{i}.org/x/y/z", h and h.replace("/en/", "http://example.com/en/").replace("/ok", "http://example.com/en/ok").replace("/long", "http://www.example.com/en/")) for i, _, h in rows]
    pages += [(1000, "http://a8.org/en/x", ""), (1001, "http://b.net/deep/dir/leaf", "<link rel=canonical href='http://example.com/en/leaf'>"), (1002, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in urls.judge(df).select("page_id", "rule", "verdict", "via").collect())
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert got == sorted(con.execute(f"SELECT page_id, rule, verdict, via FROM ({urls.OP2_SQL})").fetchall(), key=lambda r: r[0])
    blocked = {r[0] for r in got if r[2] == "block"}
    assert {0, 11, 1001} <= blocked and not blocked & {1, 2, 3, 4}
