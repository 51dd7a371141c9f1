import random
from itertools import combinations

import pytest

from ripplet.llm.html_extraction import extract_pages, main_text
from ripplet.llm.url_filter import filter_urls, mine_rules

ARTICLE = "<p>First, a longer sentence with words; and more of them.</p><p>Second &amp; last:\n  one <b>bold</b> word &lt;here&gt;.</p>"
TEXT = "First, a longer sentence with words; and more of them.\n\nSecond & last: one bold word <here>."


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1>{ARTICLE}</article><footer>c</footer>", "Head\n\n" + TEXT),
    (f"<body><div class='site-header'>Brand</div><div id=content>{ARTICLE}<ul><li>one<li>two</ul></div><div class=sidebar><p>Other, much longer text. {'word ' * 80}</p></div>", TEXT + "\n\none\n\ntwo"),
    (f"<main>{ARTICLE}<aside>Buy, now!</aside><form><p>Name</p></form><section class=comments><p>I, too, think so. {'yes, ' * 50}</p></section></main>", TEXT),
    (f"<div>{ARTICLE}<script>var a='<p>no</p>';</script><!-- <p>no</p> --><div class='cookie-notice'>We use cookies.</div></div>", TEXT),
    (f"<article><p>Only <a href='a>b'>one</a><br>line<p>x<p></article>", "Only one line\n\nx"),
    ("no tags at all,\n just text", "no tags at all, just text"), ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<p>5 < 6 and &unknown; &#65;</p>", "5 < 6 and &unknown; A"),
    ("<script>never closed <p>x</p>", ""), ("<p unclosed", "<p unclosed"), ("<div hidden><p>no</p></div><p>yes, it is.</p>", "yes, it is."),
])
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("times", [1, 200])
@pytest.mark.parametrize("page", [
    "<nav>n</nav><article><h1>Title</h1><p>Lead, short.</p><div class=body><p>{}</p></div><p>Closing.</p></article><div class=sidebar>s</div>",
    "<body class=main><div class=left>Other</div><main><section id=a><p>Title</p><p>Lead, short.</p></section><section id=b><p>{}</p></section><section id=c><p>Closing.</p></section></main>",
    "<div id=content><h1>Title</h1><div id=intro>Lead, short.</div><div class=body><div><p>{}</p></div></div><div id=end>Closing.<aside>no</aside></div></div><footer>f</footer>",
])
def test_what_stands_beside_a_long_body_stays(page, times):
    body = ("A sentence of the body, with words; and more of them. " * times).strip()
    assert main_text(page.format(body)) == "\n\n".join(["Title", "Lead, short.", body, "Closing."])


def test_extract_pages(spark):
    data = [(1, "u", f"<article>{ARTICLE}</article>", "old", 3), (1, None, None, None, None), (None, "u", "<p>" + "long " * 100_000 + "</p>", "x", 1)]
    found = extract_pages(spark.createDataFrame(data, "page_id long, url string, html string, text string, lang int"))
    assert found.columns == ["page_id", "url", "lang", "text", "n_chars"]
    assert sorted((r["n_chars"], len(r["text"])) for r in found.collect()) == [(0, 0), (len(TEXT), len(TEXT)), (499_999, 499_999)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
URLS = [
    ("https://www.EXAMPLE.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://a.example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://x.com", "x.com", "", None, "allow"), ("http://net/es/?a", "net", "/es/", "net/es/", "block"),
    ("ftp://x.net/ES/", "x.net", "/ES/", None, "allow"), ("no-scheme.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://h.org?x=://other.com/en/", "h.org", "", None, "allow"), ("http://www.example.com:80/en/", "www.example.com:80", "/en/", None, "allow"),
]


def pages(spark, urls, first=0):
    return spark.createDataFrame([(first + k, u, "kept") for k, u in enumerate(urls)], "page_id long, url string, verdict string")


LABELS = "doc_id long, quality int"


def test_given_rules(spark):
    none = spark.createDataFrame([], LABELS)
    found = filter_urls(pages(spark, [u[0] for u in URLS]), none, RULES).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == URLS
    assert filter_urls(pages(spark, []), none, RULES).collect() == []


def test_mined_rules(spark):
    urls = [f"http://{'casino' if k % 3 == 0 else 'blog'}.site{k % 7}.org/{'win' if k % 3 == 0 or k % 5 == 0 else 'post'}/{k}" for k in range(210)]
    labels = [(k, 0 if k % 3 == 0 else 1) for k in range(150)] + [(7, None), (None, 0), (8, 5)]
    found = filter_urls(pages(spark, urls + [None]), spark.createDataFrame(labels, LABELS), [], min_confidence=0.9).collect()
    assert {r["page_id"] for r in found if r["verdict"] == "block"} == {k for k in range(210) if k % 3 == 0}
    assert all((r["block_confidence"] >= 0.9) == (r["verdict"] == "block") for r in found)


def test_rules_are_pruned_and_none_is_cut(spark):
    draw = random.Random(5)
    data = [([t for t in "abcdef" if draw.random() < 0.5] + ["z"], draw.random() < 0.4) for _ in range(300)]
    found = mine_rules(spark.createDataFrame(data, "tokens array<string>, block boolean"), 0.01, 0.3)
    every = {}
    for n in range(1, 5):
        for c in combinations("abcdefz", n):
            held = [block for tokens, block in data if set(c) <= set(tokens)]
            if sum(held) >= 3 and sum(held) / len(held) >= 0.3 and sum(held) / len(held) > sum(b for _, b in data) / len(data):
                every[frozenset(c)] = sum(held) / len(held)
    wanted = {r: s for r, s in every.items() if not any(o < r and t >= s for o, t in every.items())}
    assert dict(found) == pytest.approx(wanted) and 5 <= len(wanted) < len(every)


def test_a_hot_host_leaves_rules_of_other_hosts(spark):
    urls = [f"http://www.hot.bad.org/a/b/c/{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}?s=1" for k in range(400)]
    urls += [f"http://weak.net/page{k}" for k in range(40)] + [f"http://good{k % 9}.com/page{k}" for k in range(400)]
    labels = [(k, 0) for k in range(400)] + [(k, int(k % 4 == 0)) for k in range(400, 440)] + [(k, 1) for k in range(440, 840)]
    found = filter_urls(pages(spark, urls), spark.createDataFrame(labels, LABELS), []).collect()
    assert {r["page_id"] for r in found if r["verdict"] == "block"} == set(range(440))
