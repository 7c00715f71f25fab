from __future__ import annotations

import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from leaksieve.functions import urls
from leaksieve.operators.crawl import crawl, reach
from leaksieve.operators.links import at_depth, extract_links, filter_links, page_edges
from leaksieve.operators.web import name_files, route_responses, skipped_responses


def test_resolution_agrees_with_the_standard_library(spark):
    bases = ["http://h.org/a/b/c.html?q=1#f", "https://h.org", "http://h.org?x", "https://u@h.org:8/a/", "HTTP://H.org/x", "http://h.org/a;p/b"]
    parts = ["/", "//", "a", "..", ".", "?", "q=1", "#", "f", "http://", "HTTPS://", "x.org", ":80", ";", " ", "é", "mailto:", "b.js", "[", "\t", "javascript:"]
    rng = random.Random(3)
    links = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(4_000)}
    links |= {"/a.js", "/a/../b.js", "//x.org/y", "http://x.org/y?z#w", "http://x.org/y?#", "http://x.org", "/x?", "/x#", "", "/é.js", "/a//b"}
    rows = [(b, link) for b in bases for link in sorted(links)]

    def expected(base, link):
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    got = spark.createDataFrame(rows, "b string, l string").select("b", "l", urls.resolve(F.col("b"), F.col("l")).alias("r"))
    wrong = [(r.b, r.l, r.r, expected(r.b, r.l)) for r in got.collect() if r.r != expected(r.b, r.l)]
    assert not wrong, wrong[:5]


def test_every_kind_of_link_is_resolved_without_python(spark):
    bases = ["http://h.org/a/b/../c/./d.html;p?q#f", "http://h.org/a/../", "a/b/c", "/x/..", "//h.org/a", "", "ftp://h/a/b;t", "mailto:x@y", "http://[::1]:8/a", "http://[::1/a", "http://h\uff0fx/a"]
    links = ["../x", "../../..", "./", ".", "..", "a/./../b/", "a//b/../c", "/../x", "/a/./b/..", "?", "?z=1", "#", "#g", "//i.org", "//i.org/../x", ";p", ";", "x;y/z;w", "?a#b?c", "#b?c"]
    links += [f"http://[{a}]/x/../y" for a in ("::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1::2:3:4:5:6:7:8", "::1.2.3.4", "::01.2.3.4", "::256.0.0.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5::1.2.3.4", "fe80::1%eth0", "fe80::1%", "a%b%c", "", "1.2.3.4", "vF.x", "v.x", "12345::", "::1::", ":", "1:2")]
    links += ["http://a]b/", "http://a]b[c/", "http://h\u2100/x", "http://\u00fc.org/x", "  http:x", "\x01/y", "a\tb", "HTTP:a/../b", "http:", "http:?q", "ws://x/../y", "data:a/../b", "sip:a;b", "1a:b", "\u00e9:b", None]
    rows = [(b, link) for b in [*bases, None] for link in links]

    def expected(base, link):
        try:
            return None if base is None or link is None else urljoin(base, link)
        except ValueError:
            return None

    resolved = spark.createDataFrame(rows, "b string, l string").select("b", "l", urls.resolve(F.col("b"), F.col("l")).alias("r"))
    wrong = [(r.b, r.l, r.r, expected(r.b, r.l)) for r in resolved.collect() if r.b is not None and r.r != expected(r.b, r.l)]
    assert not wrong, wrong[:5]
    assert "Python" not in resolved._jdf.queryExecution().executedPlan().toString()


def test_url_parts(spark):
    texts = ["http://h:8/a/b.js;v=1?x#y", "https://h", "http://h?a/b.js", "//h/x", "/only/p.js", "ftp://h/x.js", "http://h/a;b/c;d", "HTTP://h/#/x.js", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "u string").select(
        "u", urls.netloc_of(F.col("u")).alias("n"), urls.path_of(F.col("u")).alias("p"), urls.scheme_of(F.col("u")).alias("s")
    )
    for row in rows.collect():
        # The standard library cuts parameters for the schemes that have them.
        parsed = urlparse(row.u)
        assert (row.n, row.p, row.s) == (parsed.netloc, parsed.path, parsed.scheme), row.u


def test_file_urls_and_left_out_links(spark):
    files = ["http://h/a.JS", "http://h/x/package.json", "http://h/pipfile", "http://h/favicon.ico", "http://h/a/webmanifest", "http://h/a.env.local?x"]
    others = ["http://h/", "http://h/a", "http://h/x.js/", "http://h/api/v1/users", "http://h/a.png", "http://h?x=a.js"]
    rows = spark.createDataFrame([(u,) for u in files + others], "u string")
    assert [r.u for r in rows.where(urls.is_file_url(F.col("u"))).collect()] == files
    gone = ["https://unpkg.com/x.js", "ftp://h/x.js", "https://my.unpkg.com.evil.org/x", "mailto:a@b", "/rel"]
    kept = ["https://h/unpkg.com/x.js", "HTTP://h/x.js"]
    targets = spark.createDataFrame([(u,) for u in gone + kept], "target string")
    assert [r.target for r in filter_links(targets).collect()] == kept


def test_links_of_a_page(spark):
    html = (
        '<script src="app.js?v=1"></script><SCRIPT SRC=\'B.JS\'></SCRIPT><a href="/doc.pdf">'
        "<style>x{background:url('img/a.PNG?x=1')}</style>"
        '<i a="/conf/x.toml" b="../go.mod" c="/v2/x" d="/ws/live" e="/a/robots.txt" f="/plain">'
    )
    pages = spark.createDataFrame([("http://h.org/p/", html)], "url string, html string")
    expected = {"app.js?v=1", "B.JS", "/doc.pdf", "img/a.PNG?x=1", "/conf/x.toml", "../go.mod", "/v2/x", "/ws/live", "/a/robots.txt"}
    assert {r.link for r in extract_links(pages).collect()} == expected
    edges = {(r.dst, r.is_file) for r in page_edges(pages).collect()}
    assert ("http://h.org/go.mod", True) in edges and ("http://h.org/v2/x", False) in edges
    assert len(edges) == len(expected)


def test_depth_rule(spark):
    rows = [("http://h/a/app.js", True), ("http://h/api/v1/users", False)]
    edges = spark.createDataFrame(rows, "dst string, is_file boolean")
    assert [r.dst for r in at_depth(edges, 3, 3).collect()] == ["http://h/a/app.js"]
    assert at_depth(edges, 2, 3).count() == 2


def _reach(seed, links, max_depth, leaf_files):
    depths, frontier = {seed: 0}, [seed]
    for depth in range(max_depth + leaf_files):
        frontier = sorted(
            {
                d
                for s, d, is_file in links
                if s in frontier and d not in depths and (depth < max_depth or is_file)
            }
        )
        depths |= dict.fromkeys(frontier, depth + 1)
    return {(seed, url, depth) for url, depth in depths.items()}


def test_crawl_agrees_with_a_walk_by_hand(spark):
    rng = random.Random(11)
    links = sorted({(f"http://h{rng.randint(0, 1)}/{rng.randint(0, 40)}", f"http://h{rng.randint(0, 1)}/{rng.randint(0, 40)}", rng.random() < 0.3) for _ in range(90)})
    links = list({(s, d): (s, d, f) for s, d, f in links}.values())
    edges = spark.createDataFrame(links, "src string, dst string, is_file boolean")
    seeds = [links[0][0], links[1][0], "http://nowhere/"]
    table = spark.createDataFrame([(s,) for s in seeds], "url string")
    for max_depth, leaf_files in ((0, False), (2, False), (3, True)):
        expected = set().union(*(_reach(s, links, max_depth, leaf_files) for s in seeds))
        for rows_per_task in (1, 1_000_000):  # every page shared by two seeds a hub, or none
            got = crawl(table, edges, max_depth=max_depth, leaf_files=leaf_files, rows_per_task=rows_per_task)
            assert sorted(map(tuple, got.collect())) == sorted(expected)
        least = {}
        for _, url, depth in expected:
            least[url] = min(depth, least.get(url, depth))
        at_once = reach(table, edges, max_depth=max_depth, leaf_files=leaf_files)
        assert sorted(map(tuple, at_once.collect())) == sorted(least.items())
    at_home = crawl(table, edges, max_depth=9, same_host=True)
    assert at_home.where("split(seed, '/')[2] != split(url, '/')[2]").count() == 0


def test_responses_and_names(spark):
    rows = [
        ("http://h/a/app.js", 200, "text/javascript", 10),
        ("http://h/b/app.js", 200, "text/javascript", None),
        ("http://h/", 200, "text/HTML; charset=x", 99_999_999),
        ("http://h/data", 200, "application/json", 10_485_760),
        ("http://h/big", 200, "application/json", 10_485_761),
        ("http://h/gone.js", 404, "text/javascript", 1),
        ("http://h/page.php", 200, "text/html", 1),
        ("http://g/app.js", 200, None, 1),
        ("http://g/x.tar.gz", 200, None, 1),
        ("http://g/y/x.tar.gz", 200, None, 1),
    ]
    table = spark.createDataFrame(rows, "url string, status int, content_type string, content_length long")
    routed = route_responses(table, max_bytes=10 * 1024 * 1024)
    assert {(r.url, r.kind) for r in routed.collect()} == {
        (r[0], "page" if "html" in (r[2] or "").lower() else "file") for r in rows if r[0] not in ("http://h/big", "http://h/gone.js")
    }
    skipped = {r.url: (r.kind, r.reason) for r in skipped_responses(table, max_bytes=10 * 1024 * 1024).collect()}
    assert skipped == {"http://h/big": ("file", "size"), "http://h/gone.js": ("file", "status")}
    unknown = spark.createDataFrame([("u", None, None, None)], table.schema)
    assert [r.reason for r in skipped_responses(unknown).collect()] == ["status"] and route_responses(unknown).count() == 0
    named = {r.url: r.file_name for r in name_files(routed).collect()}
    assert {named["http://h/a/app.js"], named["http://h/b/app.js"]} == {"app.js", "app_1.js"}
    assert named["http://h/page.php"] == "page.php.html" and named["http://g/app.js"] == "app.js"
    assert {named["http://g/x.tar.gz"], named["http://g/y/x.tar.gz"]} == {"x.tar.gz", "x.tar_1.gz"}
    assert named["http://h/"].startswith("file_000") and named["http://h/"].endswith(".html")
    assert named["http://h/data"].startswith("file_000") and named["http://h/data"].endswith(".json")


def test_no_name_comes_twice_on_a_host(spark):
    paths = ["x/a.js", "y/a.js", "z/a_1.js", "w/a.js", "v/a_1.js", "a_1_1.js", "..", "q/..", "...", "data", "file_0001.json"]
    rows = [(f"http://{host}/{path}", "file", "application/json") for host in "gh" for path in paths]
    named = name_files(spark.createDataFrame(rows, "url string, kind string, content_type string")).collect()
    assert len(named) == len(rows) == len({(r.host, r.file_name) for r in named})
    assert {r.file_name for r in named if r.host == "g"} >= {"a.js", "a_1.js", "a#1.js", "a_2.js", "a#1.js", "a_1_1.js"}
