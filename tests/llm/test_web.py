import random

import pytest

from tabwise.llm import pages, urls
from tests.llm.conftest import prose

PAGES = "page_id long, url string, html string, text string, host string, wrapper string, n_chars long"


def page_table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], PAGES)


@pytest.mark.parametrize("source, text", [
    ("", ""), ("<p>a", "a"), ("plain  text", "plain text"), ("x &am", "x &am"), ("a &lt; b &#233; &amp", "a < b é &"),
    ("<p>x</p", "x"), ("5 < 6", "5 < 6"), ("a<b>c</b>d<br>e", "acd e"), ("a<!-- x", "a"), ("a<script>'</p>'", "a"),
    ("<p><b>one<br><p>two", "one\n\ntwo"), ("<ul><li>a<li>b</ul>c", "a\n\nb\n\nc"),
    ("<nav>n</nav><p>x<aside>s</aside></p><footer>f</footer>", "x"),
    ("<article><p>m</p></article><p>outside</p>", "m"), ("<form><p>f</p></form><div class='ad box'>a</div>m", "m"),
    ("<div class=sidebar>s</div><div class='Comment-List'><p>c</p></div><div id=content>m</div>", "m"),
    ("<body class='with-sidebar'><main><h1>t</h1><p>m</p></main>", "t\n\nm"),
    ("<div class='comments-on'><article><p>m</p></article></div>", "m"),
    ("<article><header><h1>t</h1></header><p>m</p><section id=comments><p>c</p></section></article>", "t\n\nm"),
    ("<p hidden>x</p><p style='display: none'>y</p><p>z", "z"), ("<TITLE>t</TITLE><P>Z", "Z"),
    ("<div>" * 3000 + "deep", "deep")])
def test_main_text_of_one_page(source, text):
    assert pages.Page(source).main_text() == text


def test_alignment_skips_what_one_page_lacks():
    a, b = (pages.Page(f"<body><div class=top>x</div>{extra}<div class=body><p>t</p></div></body>").shape()
            for extra in ("", "<div class=mid>m</div>"))
    to = pages.align(a, b)
    labels_a, labels_b = pages.tree(a)[0], pages.tree(b)[0]
    assert len(to) == len(labels_a) and all(labels_a[i] == labels_b[j] for i, j in to.items())


def test_wrapper_drops_what_the_hosts_pages_share(spark):
    rows, want = [], {}
    for i in range(30):
        body = [prose(i * 10 + k, 15) for k in range(1 + i % 3)]
        html = ("<html><body><div class=x1>Daily paper, founded long ago</div><div class=x2>"
                + "".join(f"<p>{p}</p>" for p in body) + f"</div><div class=x3>Call {['us', 'now'][i % 2]}</div></body></html>")
        rows.append((i, "http://News.example.com/" + str(i), html))
        want[i] = "\n\n".join(body)
    rows.append((99, "http://single.example.org/", "<div class=x1>Daily paper, founded long ago</div>"))
    want[99] = "Daily paper, founded long ago"
    for limit in (200_000, 0):
        got = {r["page_id"]: r["text"] for r in pages.extract(page_table(spark, rows), max_hosts=limit).collect()}
        assert got == want


def test_copies_do_not_make_a_template(spark):
    html = f"<div class=a><p>{prose(1, 30)}</p></div>"
    rows = [(i, "http://h.example.com/", html) for i in range(20)]
    assert {r["text"] for r in pages.extract(page_table(spark, rows)).collect()} == {prose(1, 30)}


def test_articles_keep_what_they_share(spark):
    rows, want = [], {}
    for i in range(12):
        first, rest = prose(77, 20), prose(i, 20)
        rows.append((i, "http://h.example.com/", f"<article><h1>Same title</h1><p>{first if i % 2 else rest}</p><ul><li>{rest}</li>"
                     f"</ul><div class=x>Print this page</div></article>"))
        want[i] = f"Same title\n\n{first if i % 2 else rest}\n\n{rest}"
    got = {r["page_id"]: r["text"] for r in pages.extract(page_table(spark, rows)).collect()}
    assert got == want


def test_page_edges(spark):
    rows = [(1, None, None), (None, "no scheme", "<p>a"), (2, "http://h/", ""), (3, "http://h/", "<p>" + "long " * 200000),
            (4, "", "<p>b"), (4, "", "<p>b")]
    got = sorted((str(r["page_id"]), len(r["text"])) for r in pages.extract(page_table(spark, rows)).collect())
    assert got == [("1", 0), ("2", 0), ("3", 999999), ("4", 1), ("4", 1), ("None", 1)]
    assert pages.extract(page_table(spark, [])).count() == 0


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net/de/", "http://net/", "http://xnet/",
        "http://sub.org/fr/a", "http://org/fr", "ftp://user@EXAMPLE.com:80/de/1", "http://example.com?q=/de/", "a://b://c/d",
        "http://free-casino.example.com/en/1", "http://garden.example.com/en/1", "http://h/" + "p" * 50000, "://", "http://É.net/"]


def by_force(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_urls(spark):
    model = urls.train(urls.labelled_urls(spark))
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id int, url string, host string, rule string")
    rows = urls.judge(table, model, keep=("page_id",)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [by_force(u) for u in URLS]
    for r in rows:
        if r["rule"]:
            assert r["verdict"] == urls.RULES[r["rule"]]
        else:
            assert r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")
    assert rows[12]["verdict"] == "block" and rows[13]["verdict"] == "allow"
    assert urls.judge(table.limit(0), model, keep=("page_id",)).count() == 0


def test_url_score_is_the_logistic_of_hashed_ngrams(spark):
    import math

    model = urls.train(urls.labelled_urls(spark))
    grams, seen = [], random.Random(5).sample(urls.LABELLED_URLS, 6)
    for url, _ in seen:
        host, path, _ = by_force(url)
        own = []
        for tag, text in (("h", host), ("p", path)):
            text = "^" + "".join("0" if c.isdigit() else c for c in text) + "$"
            own += [tag + text[i:i + n] for n in model.sizes for i in range(len(text) - n + 1)]
        grams.append(own)
    flat = sorted({g for own in grams for g in own})
    df = spark.createDataFrame([(g,) for g in flat], "g string").selectExpr(
        "g", f"pmod(xxhash64(g), {len(model.coefficients)}) b")
    bucket = {r["g"]: r["b"] for r in df.collect()}
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(seen)], "page_id int, url string")
    for r in urls.judge(table, model, keep=("page_id",)).collect():
        own = grams[r["page_id"]]
        logit = model.intercept + sum(model.coefficients[bucket[g]] for g in own) / math.sqrt(len(own))
        assert abs(r["score"] - 1 / (1 + math.exp(-logit))) < 1e-9
