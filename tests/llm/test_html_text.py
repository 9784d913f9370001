"""Main text of pages: known pages, the cut against trying all labellings, odd rows."""

import html
import itertools
import random
import re

from obsexp.llm.html_text import _lean, _ties, blocks_of, extract, main_text
from obsexp.llm.mincut import cut_labels

SCHEMA = "page_id long, url string, html string, text int, n_chars string"


def cost(labels, lean, edges):
    return sum(x if not y else 0 for x, y in zip(lean, labels) if x > 0) + sum(
        -x if y else 0 for x, y in zip(lean, labels) if x < 0) + sum(w for u, v, w in edges if labels[u] != labels[v])


def test_cut_is_the_minimum_over_all_labellings():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        lean = [rng.choice([-1, 1]) * rng.randint(0, 6) / 2 for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 5) / 2) for _ in range(rng.randint(0, 12))]
        edges = [e for e in edges if e[0] != e[1]]
        want = min(cost(y, lean, edges) for y in itertools.product([False, True], repeat=n))
        assert cost(cut_labels(lean, edges), lean, edges) == want


def test_long_chain_of_undecided_nodes():
    n = 20_000
    lean = [0.4 if i % 2 else -0.3 for i in range(n)]
    labels = cut_labels(lean, [(i, i + 1, 1.0) for i in range(n - 1)])
    assert all(labels)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><div>Site name</div></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Two</a></ul></nav>
<div class="page with-sidebar"><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; bold</h1><p><b>First   para&shy;graph<br>goes on.<p>Second&nbsp;one &#8212; ok.</p>
<div class="ad">Buy now</div><ul><li>point one<li>point <a href=x>two</a></ul><!-- hidden --><aside>See also</aside>
<form action=/s><label>Mail</label><input name=m><button>Go</button></form><table><tr><td>cell a<td>cell b</table>
</article><section id="comments"><article class="comment"><p>Nice article, thank you so much for writing it.</p></article></section>
<aside class="sidebar"><p>Other stories that you may like to read some day, if time permits it.</p></aside></div>
<footer>&copy; 2020 Somebody</footer></body></html>"""


def test_known_page():
    assert main_text(PAGE)[0].split("\n") == [
        "Big & bold", "First para\u00adgraph goes on.", "Second one \u2014 ok.", "point one", "point two", "cell a", "cell b"]


def test_page_without_article_element():
    page = ("<body><div class=menu><a href=1>Home</a> <a href=2>News</a></div><div id=content><h2>Title here</h2>"
            "<p>" + "A sentence of some length, with words. " * 5 + "</p><p>Short one.</p><p>" + "More of it, and more. " * 9 +
            "</p></div><div>Copyright \u00a9 2021 by us</div><div><a href=3>Terms</a> <a href=4>Privacy</a></div>")
    lines = main_text(page)[0].split("\n")
    assert lines[0] == "Title here" and lines[2] == "Short one." and len(lines) == 4


def test_unclosed_boilerplate_before_the_article():
    page = "<body><nav><a href=1>Home</a><div class=ad>Buy<div class='notice'>Look<article><h1>A</h1><p>b c<p>d</article><aside>"
    assert main_text(page)[0] == "A\nb c\nd"
    cards = "<body><article><p>Real text.</p></article><aside><article><p>Another page's lead that is quite long indeed.</p></article></aside>"
    assert main_text(cards)[0] == "Real text."


def test_names_that_only_mention_boilerplate():
    for start, end in (('<article class="post comments-open">', "</article>"), ('<main class="no-comments">', "</main>"),
                       ('<div class="content has-replies">', "</div>"), ('<div class="news-alert-page">', "</div>"),
                       ('<div id="share-story">', "</div>"), ('<section class="story related-topic">', "</section>")):
        page = f"<body><nav><a href=1>Home</a></nav>{start}<h1>Title</h1><p>{'Some words of a story. ' * 6}</p><p>Short.</p>{end}<footer>x</footer>"
        assert main_text(page)[0] == f"Title\n{('Some words of a story. ' * 6).strip()}\nShort.", start


def test_names_of_boilerplate_go_inside_an_article_too():
    for name in ("ad", "ad-slot-top", "cookieNotice", "site-header", "comment-list", "post-comments", "comment-body", "sidebar-content",
                 "newsletter-signup", "share-buttons", "related", "promo_box"):
        page = f"<article><p>First one.</p><div class='x {name}'><p>{'Words that sound like prose, all of them. ' * 4}</p></div><p>Last one.</p></article>"
        assert main_text(page)[0] == "First one.\nLast one.", name


def test_buttons_and_formulas_inside_sentences_stay():
    page = "<article><p>Use the <button>Save</button> key.</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><div><button>Go</button></div></article>"
    assert main_text(page)[0] == "Use the Save key.\nSo x=1 holds."


def test_the_cut_decides_and_is_better_than_each_block_alone(spark, small):
    """The given pages without their article element, with a byline in each text and links in a plain element after it."""
    differ, wrong_cut, wrong_alone = 0, 0, 0
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        inner = inner.replace("</h1>", "</h1><div>By somebody</div>", 1)
        parts = re.split(r"</?(?:p|h1|div)>", inner.replace("<br>", " "))
        want = [t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()))]
        page = re.sub(r"<article>.*</article>", lambda _: f"<div>{inner}</div><div><a href='/t'>Terms</a> <a href='/p'>Privacy</a></div>", r.html, flags=re.S)
        found = blocks_of(page)
        alone = [b.text for b in found if _lean(b) > 0]
        cut = main_text(page)[0].split("\n")
        differ += alone != cut
        wrong_cut += len(set(cut) ^ set(want))
        wrong_alone += len(set(alone) ^ set(want))
    assert differ > 0 and wrong_cut < wrong_alone / 2, (differ, wrong_cut, wrong_alone)


def test_broken_markup_ends_and_is_linear():
    for page in ("<", "<p", "<!--", "</", "<script>", "<p>" * 30000, "<div>" * 3000 + "x", "a<b>c</p></div>", "<a href='" * 2000,
                 "<" * 100000, "<p " * 50000):
        assert isinstance(main_text(page)[0], str)
    assert main_text("<p>" + "word " * 200_000)[0] == ("word " * 200_000).strip()


def test_rows_with_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1, "x"), (1, "u", "", 1, "x"), (2, "u", PAGE, 1, "x"), (2, "u", PAGE, 1, "x")], SCHEMA)
    rows = extract(df).collect()
    assert [r.n_chars for r in rows if r.page_id != 2] == [0, 0] and len(rows) == 4
    assert all(r.n_chars == len(r.text) for r in rows)
    assert extract(df.limit(0)).collect() == []


def test_registered_query_against_the_article_element(spark, small, registered):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = registered.queries()["op1_html_extraction"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = re.split(r"</?(?:p|h1)>", inner)
        clean = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r.text == "\n".join(p for p in clean if p)
