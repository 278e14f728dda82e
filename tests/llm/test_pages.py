from __future__ import annotations

import re

import duckdb
import pytest

from panelcast.llm import html_text as ht
from panelcast.llm import url_filter as uf
from panelcast.llm.queries import URL_RULES

LONG = "This is a paragraph of running text with many of the words that every text has, and it goes on for a while."


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body,text", [
    (f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1><p>{LONG}<p>Short end.</article><footer>(c) us</footer>", f"Head\n{LONG}\nShort end."),
    (f"<div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=x>one two three four five six</a></div>", f"{LONG}\nYes.\n{LONG}"),
    (f"<article><p>a &lt;b&gt; &amp; c\n  d<br>e</p><script>var t='</p>';</script><p>{LONG}</p></article>", f"a <b> & c d e\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><aside>{LONG}</aside><form>{LONG}</form></article>", LONG),
    (f"<article><p>{LONG}</p><!-- <p>{LONG}</p> --><div class=ad>Buy now.</div><p>Fin.</p></article>", f"{LONG}\nFin."),
    (f"<article><p>{LONG} <a href='x", LONG),
    ("", ""), ("<nav><a href=x>menu</a></nav>", ""),
])
def test_extract(body, text):
    assert ht.extract(page(body)) == text


def test_pages(spark):
    rows = [(1, "u", page(f"<p>{LONG}</p>")), (1, "u", page(f"<p>{LONG}</p>")), (2, None, None), (None, "v", ""), (3, "w", "no markup at all"), (4, "x", "<p>" * 3000 + LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted((tuple(r) for r in ht.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0), (4, "x", LONG, len(LONG))], key=repr)
    assert ht.extract_pages(df.limit(0)).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(p), v, p) for v, p in URL_RULES for h, s, t in [p.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + t)]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None


URLS = [
    None, "", "nonsense", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://x.com/de/5", "http://com/de/", "http://notcom/de/", "http://a.com?x=/de/",
    "http://a.com#/de/", "http://a.net/en/1/2/3/4/5/6/7/8/9", "http://a.org", "http://a.org/", "ftp://b.COM/fr/x", "http://ÄB.com/fr/", "x://y://z.org/a",
]


def test_rules_and_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    rows += [(1000 + i, f"http://m.site{i % 3}.com/{lang}/{i}.html") for i in range(300) for lang in ("de", "fr", "en")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'c' AS host", "'d' AS key", "1 AS n")
    got = uf.judge(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
    for r in got.collect():
        if r.page_id is not None and r.page_id < 1000:
            host, path, rule, verdict = brute_rule(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    con = duckdb.connect()
    pages = df.select("page_id", "url").toPandas()
    con.register("pages", pages)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(uf.judge_sql(URL_RULES)).fetchall(), key=repr)
    assert uf.judge(df.limit(0), URL_RULES).count() == 0


def test_bad_branch_is_rejected(spark):
    """Unjudged urls beside blocked ones are rejected with them, and varying segments become a wildcard."""
    rules = [("block", "bad.net/x/9"), ("allow", "bad.net/y/")]
    urls = [f"http://bad.net/x/{i}k" for i in range(90, 100)] + [f"http://bad.net/x/{w}" for w in ("aa", "bb", "cc")] + [f"http://bad.net/y/{i}" for i in range(20)]
    out = uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    verdicts = {r.path: (r.verdict, r.template) for r in out.collect()}
    assert verdicts["/x/bb"] == ("block", "/x/*") and verdicts["/y/3"][0] == "allow"


@pytest.mark.parametrize("inside", [
    '<svg class="i" viewBox="0 0 1 1"/>', "<math/>", '<svg><path d="M0"/></svg>', '<video src="a.mp4">', "<p>Look: <audio src=a.mp3>", "<div><canvas></div>", '<video src="a"><source src="b"/>old browser</video>',
])
def test_embedded_elements_do_not_swallow_the_page(inside):
    first, second = (f"{w} is the text of the article and it is as long as it has to be for the first of the two passes." for w in ("This", "That"))
    page = f"<html><body><article><div><p>{first}</p>{inside}</div><p>{second}</p></article><video src=x></video></body></html>"
    got = ht.extract(page)
    assert first in got and second in got and "old browser" not in got
