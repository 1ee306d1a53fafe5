"""HTML extraction: planted pages, entropies by brute force, broken markup, edge rows."""

import math
import random
import re
from collections import Counter

import pytest

from tests.llm.frames import prose
from tillroll.llm import html_extract as H
from tillroll.sources.tables import read_table


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def site(rng, host, n):
    """Pages whose noise is only known by being the same on every page."""
    menu, legal, out = prose(rng, 12), prose(rng, 15), []
    for i in range(n):
        body = [prose(rng, 40).replace("\n", " ") for _ in range(3)]
        html = (
            f"<html><body><div class=top><p>{menu}</p></div><div id=x{i}><h2>{body[0]}</h2><p>{body[1]} &amp; &eacute;<p>{body[2]}</div>"
            f"<div class=low><p>{legal}</p></div></body></html>"
        )
        out.append((f"https://{host}/p/{i}", html, " ".join(" ".join(b.split()) for b in (body[0], body[1] + " & é", body[2]))))
    return out


def test_what_every_page_shows_goes(spark):
    rng = random.Random(11)
    made = site(rng, "a.example", 9) + site(rng, "b.example", 7)
    got = {r.page_id: r for r in H.op7_extract(pages(spark, [(i, u, h) for i, (u, h, _) in enumerate(made)])).collect()}
    for i, (_, _, want) in enumerate(made):
        assert got[i].text == want and got[i].n_chars == len(want)


def test_importance_is_the_entropy(spark):
    rng = random.Random(12)
    rows = [(i, f"http://h.example/{i}", f"<body><div class=m>{'abcab'[i % 5]}</div><div class=c>{prose(rng, 9)}</div></body>") for i in range(10)]
    tree = {r.node: r for r in H.style_tree(pages(spark, rows)).collect()}
    _, _, nodes = H.parse(rows[0][2])
    by = {n.tag + str(k): n.key for k, n in enumerate(nodes)}
    counts = Counter("abcab"[i % 5] for i in range(10))
    want = -sum(c / 10 * math.log(c / 10) for c in counts.values()) / math.log(10)
    assert tree[by["div2"]].importance == pytest.approx(want) and tree[by["div2"]].pages == 10
    assert tree[by["div3"]].importance == pytest.approx(1.0)


def test_given_pages(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "pages")
    import html as lib

    for r in H.op7_extract(df).join(df.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        assert r.text == " ".join(lib.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


CASES = [
    ("<body><article><p>One<b>two</b> three<br>four<p>five</article><aside>no</aside>", "Onetwo three four five"),
    ("<header>no</header><main><header><h1>Title</h1></header><p>a&nbsp;b&#8217;s &lt;i&gt;</p></main><footer>no", "Title a b’s <i>"),
    ("<p>a<!-- <p>no --><script>if (a<b) '</p>'</script>b</p><style>p{}</style><!-- open", "ab"),
    ("<div class='Cookie-Notice x'>no</div><p title='a > b'>yes</p><div hidden>no</div><div style='DISPLAY: none'>no</div>", "yes"),
    ("<ul><li>a<li>b</ul></div></p>c<table><tr><td>d<td>e</table>", "a b c d e"),
    ("<form><p>no</form><div role=navigation>no</div><section id=comments><p>no</section><article>yes</article>", "yes"),
    ("plain text, 1 < 2 & 3 > 2", "plain text, 1 < 2 & 3 > 2"),
    ("<div class=shadow><p>kept</p></div><div class=article-ads>no</div>", "kept"),
    ("<textarea><p>no</textarea>x<button>no</button><p>  \n </p><p>y", "x y"),
    ("", ""),
    (None, ""),
    ("<", "<"),
]


def test_cases(spark):
    rows = [(i, None if i % 2 else f"relative/{i}", h) for i, (h, _) in enumerate(CASES)]
    got = {r.page_id: r.text for r in H.op7_extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_copies_of_one_page_are_not_emptied(spark):
    html = "<body><div><p>the same article everywhere</p></div></body>"
    rows = [(i, "http://c.example/x", html) for i in range(8)] + [(None, "http://c.example/x", html)]
    assert {r.text for r in H.op7_extract(pages(spark, rows)).collect()} == {"the same article everywhere"}


def test_deep_long_and_extra_columns(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    quotes = "<a href='" * 500 + "<p>" + '"' * 2000
    df = pages(spark, [(1, "http://d.example/", deep), (2, "http://d.example/", long), (3, "http://d.example/", quotes)])
    got = {r.page_id: r for r in H.extract(df.selectExpr("*", "'own' as _h", "'own' as node", "'own' as text")).collect()}
    assert got[1].text == "x" and got[2].n_chars == len("word & word ") * 20_000 - 1 and got[1].node == "own"
    assert H.op7_extract(df.limit(0)).collect() == []


LONG, SHORT = "the article itself goes on for a good many words", "no"
WRAPPED = [
    (f"<div class='layout with-sidebar'><p>{LONG}</p><div class=sidebar>{SHORT}</div></div>", LONG),
    (f"<div class=no-sidebar><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>", LONG),
    (f"<div id=page class='has-banner'><div class=banner>{SHORT}</div><p>{LONG}</p></div>", LONG),
    (f"<form action=x><p>{LONG}</p><nav>{SHORT}</nav></form><p>after", f"{LONG} after"),
    (f"<div class=sidebar><article><p>{LONG}</p><div class=share>{SHORT}</div></article></div>", LONG),
    (f"<main><div class='widget'><article>{LONG}</article></div><section id=comments><article class=comment-body>{SHORT}</article></section></main>", LONG),
    (f"<nav><a>{LONG} {LONG}</a></nav><article>{LONG}</article><aside><article>{SHORT}</article></aside>", LONG),
    (f"<div class=search><p>{LONG}</p></div><div class=login><p>{LONG} x</p></div>", f"{LONG} x"),
    (f"<div class=search><p>{LONG}</p></div><div class=login><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<nav>menu<p>{LONG}", f"menu {LONG}"),
    (f"<html><head><title>{SHORT}</title><body><p>{LONG}", LONG),
    (f"<div hidden><article>{LONG}</article></div><noscript>{LONG}</noscript><title>{LONG}</title>", ""),
]


def test_names_do_not_drop_what_holds_the_article(spark):
    rows = [(i, None, h) for i, (h, _) in enumerate(WRAPPED)]
    got = {r.page_id: r.text for r in H.op7_extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(len(WRAPPED))] == [w for _, w in WRAPPED]


def test_entropies_decide_in_a_wrapper(spark):
    rng = random.Random(13)
    made = [(u, f"<form class=search-page>{h}</form>", w) for u, h, w in site(rng, "w.example", 8)]
    got = {r.page_id: r.text for r in H.op7_extract(pages(spark, [(i, u, h) for i, (u, h, _) in enumerate(made)])).collect()}
    assert [got[i] for i in range(8)] == [w for _, _, w in made]
