import html
import re

import pytest
from pyspark.sql import functions as F

from evidra.llm.main_text import content_clusters, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x:y}</style><script>var t="</p><p>no";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href=x>Home</a></ul></nav>%s<footer>&copy; x</footer></body></html>"""
SKIPPED = [
    "<aside>side</aside>", "<div class='sidebar-left'>side</div>", "<div id=cookieNotice>we use cookies</div>", "<form><label>Mail</label><input></form>",
    "<div class=ad>buy</div>", "<section id='comments'><p>Reader says hi to all of you out there</p></section>", "<article class='comment'><p>me too</p></article>",
    "<noscript>turn it on</noscript>", "<!-- gone -->", "<div hidden>h</div>", "<div role=navigation>n</div>",
]
LONG = " ".join(["words of an article that goes on"] * 12)


@pytest.mark.parametrize("skipped", SKIPPED)
@pytest.mark.parametrize("region", ["article", "main", "div class='post-content'"])
def test_regions(skipped, region):
    body = f"<{region}><h1>Head &amp; more</h1><p>{LONG}<p>Short.</p>{skipped}<p>Second&nbsp;para <b>bold\n text</b><br>here</p><ul><li>item</ul></{region.split()[0]}>{skipped}"
    assert main_text(PAGE % body) == f"Head & more\n\n{LONG}\n\nShort.\n\nSecond para bold text here\n\nitem"


def test_pages_as_made(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert out[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert out[r.page_id].n_chars == len(out[r.page_id].text) and out[r.page_id].url == r.url


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text"), (3, "u", "<p>a<p>a"), (3, "u", "<p>a<p>a"), (4, "u", "</div></p><b>x<i></b>y</i> &#x41;&lt;b&gt;"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p>" + "z " * 200000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("c"))
    out = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect())
    assert out == [(0, "plain text", 10), (1, "", 0), (2, "", 0), (3, "a\n\na", 4), (3, "a\n\na", 4), (4, "xy A<b>", 7), (5, "deep", 4), (6, "z " * 199999 + "z", 399999)]
    assert extract(df.limit(0)).count() == 0


def test_clusters_follow_the_ratio():
    import numpy as np

    lengths = np.array([5, 6, 4, 5, 6, 5, 300, 280, 20, 310, 290, 5, 4, 6, 5, 5])
    found = content_clusters(lengths, np.full(16, 2))
    assert found[6:11].all() and not found[:5].any() and not found[12:].any()


def test_unmarked_pages_are_whole():
    short, tail = "Words of the second part of the article, which is shorter.", "And its end."
    parts = f"<h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{short * 3}</p><p>{tail}</p></div>"
    wanted = f"Head\n\n{LONG}\n\n{LONG}\n\n{short * 3}\n\n{tail}"
    assert main_text(PAGE % parts) == wanted
    assert main_text(PAGE % f"<div>{parts}</div>") == wanted
    assert main_text(PAGE % f"<h1>Head</h1><div><p>{LONG}</p><p>{tail}</p></div>") == f"Head\n\n{LONG}\n\n{tail}"
    assert main_text(PAGE % f"<h1>Head</h1><p>Lead.</p><p>{LONG}</p><p>{tail}</p>") == f"Head\n\nLead.\n\n{LONG}\n\n{tail}"


@pytest.mark.parametrize("names", ["class='content has-sidebar'", "class=no-sidebar", "class='site menu-open'", "id=page-with-banner", "class=sidebar", "class=layout-sidebar"])
def test_wrappers_stay(names):
    inner = f"<h1>Head</h1><p>{LONG}</p><div class=ad>buy</div>"
    assert main_text(PAGE % f"<div {names}><article>{inner}</article></div><div class=sidebar>side</div>") == f"Head\n\n{LONG}"
    if names != "class=sidebar":
        assert main_text(PAGE % f"<div {names}>{inner}</div><div class=sidebar>side</div>") == f"Head\n\n{LONG}"


@pytest.mark.parametrize("names", ["commentary", "comments-open", "no-comments"])
def test_articles_that_are_no_comments(names):
    assert main_text(PAGE % f"<article class='{names}'><p>{LONG}</p></article><article class=comment-body><p>me too</p></article>") == LONG
    assert main_text(PAGE % f"<article><p>{LONG}</p></article><section id=comments><article><p>{LONG}</p></article></section>") == LONG
    assert main_text(PAGE % f"<div><p>{LONG}</p></div><section id=comments><article><p>{LONG}</p></article></section>") == LONG


@pytest.mark.parametrize("region", ["article", "main", "div class='post-content'"])
def test_lists_of_links(region):
    """In the content they are content, beside it a menu."""
    links = "<ul><li><a href=a>one</a><li><a href=b>two</a></ul>"
    body = f"{links}<{region}><h1>Head</h1><p>{LONG}</p>{links}<p>{LONG}</p></{region.split()[0]}>{links}"
    assert main_text(PAGE % body) == f"Head\n\n{LONG}\n\none\n\ntwo\n\n{LONG}"
    assert main_text(PAGE % f"{links}<h1>Head</h1><p>{LONG}</p>{links}") == f"Head\n\n{LONG}"
    assert main_text(PAGE % links) == ""


@pytest.mark.parametrize("section", ["<![foo[bar]]>", "<![CDATA[x]]>", "<![if !IE]>", "<![endif]-->", "<!x>", "<![>"])
def test_marked_sections_are_comments(section):
    assert main_text(PAGE % f"<article><p>one {section}two</p></article>").replace("-->", "") == "one two"
    assert main_text(f"<p>one</p><![foo[").startswith("one")


def test_deep_and_odd_markup():
    import random
    import time

    began = time.process_time()
    assert main_text("<div>x" * 50_000).count("x") == 50_000
    assert main_text("<b>" * 50_000 + "<div>x</div>" * 50_000).count("x") == 50_000
    assert main_text("<p>y" + "</i>" * 100_000) == "y"
    assert time.process_time() - began < 60
    pick = random.Random(3)
    bits = ["<p>", "</p>", "<div", ">", "<", "</", "<!", "<![", "]]>", "<!--", "-->", "&#x", "&amp", "a b", "<a href='", "'", '"', "<li>", "<script>", "</script>", "<article>", "<?", "\n", "\0", "é"]
    for _ in range(3000):
        main_text("".join(pick.choice(bits) for _ in range(pick.randint(0, 40))))


@pytest.mark.parametrize("tag", ["div", "", "section"])
def test_clusters_find_articles_without_their_tags(spark, tag):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = sum(main_text(x) == main_text(re.sub(r"<(/?)article>", rf"<\1{tag}>" if tag else "", x)) for x in pages)
    assert same >= 0.95 * len(pages)


FEW = " ".join(["A shorter block of sixty words or so"] * 8)


@pytest.mark.parametrize("wrapper", ["form id=aspnet action=/", "form", "fieldset", "form class=page-form"])
@pytest.mark.parametrize("inner", ["article", "main", "div", "section"])
def test_forms_around_pages_stay(wrapper, inner):
    page = f"<{wrapper}><nav><a href=x>Home</a></nav><{inner}><h1>Head</h1><p>{LONG}</p><form><label>Mail</label><input><button>Send</button></form></{inner}><footer>f</footer></{wrapper.split()[0]}>"
    assert main_text(f"<html><body>{page}</body></html>") == f"Head\n\n{LONG}"
    assert main_text("<body><form><label>Name</label><input>Your mail <input></form></body>") == ""


@pytest.mark.parametrize("tag", ["header", "aside", "footer", "nav"])
def test_sections_around_pages_stay(tag):
    assert main_text(f"<body><{tag}><article><h1>Head</h1><p>{LONG}</p></article></{tag}></body>") == f"Head\n\n{LONG}"
    assert main_text(f"<body><div><p>{LONG}</p></div><{tag}><p>{FEW}</p></{tag}></body>") == LONG
    links = "".join(f"<li><a href={k}>a long entry of the menu of this page</a>" for k in range(40))
    assert main_text(f"<body><{tag}><ul>{links}</ul></{tag}><div><p>{FEW}</p></div></body>") == FEW


@pytest.mark.parametrize("words", [60, 30, 12, 5, 1])
def test_shorter_sibling_blocks_stay(words):
    few = " ".join(["word"] * words)
    assert main_text(f"<body><div><p>{LONG}</p></div><div><p>{few}</p></div></body>") == f"{LONG}\n\n{few}"
    assert main_text(f"<body><div><p>{few}</p></div><div><p>{LONG}</p></div></body>") == f"{few}\n\n{LONG}"
    assert main_text(f"<body><div><div><p>{LONG}</p></div><div><h2>{few}</h2><p>{few}</p></div></div></body>") == f"{LONG}\n\n{few}\n\n{few}"


def test_two_articles_stay():
    assert main_text(PAGE % f"<article><p>{LONG}</p></article><article><p>Short one.</p></article>") == f"{LONG}\n\nShort one."
    assert main_text(PAGE % f"<h1>Head</h1><article><p>{LONG}</p></article>") == f"Head\n\n{LONG}"
    assert main_text(PAGE % f"<main><div><p>{LONG}</p></div><div><p>Short one.</p></div></main><div><p>{FEW}</p></div>") == f"{LONG}\n\nShort one."


def bare_pages():
    """Pages of nothing but div elements without names, and their articles: only the ratio of text to tags tells them."""
    import random

    pick = random.Random(11)
    words = "some words that a page may hold in any order and at any length".split()
    say = lambda n: " ".join(pick.choice(words) for _ in range(n))
    for _ in range(60):
        menu = [(f"<a href=x>{say(2)}</a>" if pick.random() < 0.7 else say(2)) for _ in range(pick.randint(4, 9))]
        foot = [(f"<a href=y>{say(3)}</a>" if pick.random() < 0.7 else "&copy; 2024 " + say(2)) for _ in range(pick.randint(3, 6))]
        article = [say(pick.randint(60, 200)) for _ in range(pick.randint(2, 5))]
        article.insert(pick.randint(1, len(article) - 1), say(3))  # a short line among long ones
        yield "".join(f"<div>{x}</div>" for x in menu + article + foot), "\n\n".join(article)


def test_only_clusters_tell(monkeypatch):
    from evidra.llm import main_text as module

    pages = list(bare_pages())
    assert sum(main_text(f"<body>{x}</body>") == y for x, y in pages) >= 0.95 * len(pages)
    assert sum(main_text(f"<body><div>{x}</div></body>").replace("\n\n", " ").find(y.replace("\n\n", " ")) >= 0 for x, y in pages) >= 0.95 * len(pages)
    import numpy as np

    rng = np.random.default_rng(1)
    for other in (lambda n, t: np.ones(len(n), bool), lambda n, t: rng.random(len(n)) < 0.5):
        monkeypatch.setattr(module, "content_clusters", lambda n, t, f=other: x if (x := f(n, t)).any() else np.ones(len(n), bool))
        assert sum(main_text(f"<body>{x}</body>") == y for x, y in pages) <= 0.3 * len(pages)
