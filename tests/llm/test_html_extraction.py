import random

import pytest
from pyspark.sql import functions as F

from wayspark.llm import html_extraction as M

SCHEMA = "page_id long, url string, html string"
LONG = "This sentence is long enough to look like the prose of an article, with commas and a full stop at its end."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 9)
        own = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(8)) for _ in range(rng.randrange(3 * n))]
        cuts = []
        for bits in range(1 << n):
            side = [bool(bits >> k & 1) for k in range(n)]
            cost = sum(-x if s and x < 0 else x if not s and x > 0 else 0 for s, x in zip(side, own)) + sum(w for a, b, w in edges if side[a] != side[b])
            cuts.append((cost, sum(side), side))
        assert M.minimum_cut(own, edges) == min(cuts)[2]


def test_max_flow_takes_back_a_way():
    # all of 0..3 hang together so closely that none is decided alone
    own, edges = [5, 4, -4, -6], [(0, 2, 7), (1, 2, 6), (1, 3, 7), (0, 3, 6), (0, 1, 9), (2, 3, 9)]
    assert M.minimum_cut(own, edges) == [False] * 4
    assert M.minimum_cut([5, 4, -4, -4], edges) == [True] * 4


BOILERPLATE = [
    "<header><a href=/>Site</a> Since 1999.</header>", "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>", "<aside><h3>More</h3><p>%s</p></aside>" % LONG,
    '<div class="ad">%s</div>' % LONG, '<div id="sidebar-left"><p>%s</p></div>' % LONG, '<div class="cookie-notice" role="dialog"><p>%s</p><button>Accept</button></div>' % LONG,
    "<form action=/s><label>Search</label><input name=q><select><option>A<option>B</select><button>Go</button></form>", "<script>if (a < b) document.write('<p>%s</p>')</script>" % LONG,
    "<style>p > a { color: red }</style>", '<section class="comments"><h2>2 comments</h2><article class="comment"><p>%s</p></article></section>' % LONG, "<footer>&copy; 2024 <a href=/x>Imprint</a></footer>",
    "<!-- <p>%s</p> -->" % LONG, '<div style="display: none">%s</div>' % LONG, '<ul class="breadcrumbs"><li>a</li></ul>', "<noscript>Enable it.</noscript>", '<div class="articleSidebar">%s</div>' % LONG, '<div class="newsletter-signup"><p>%s</p></div>' % LONG,
]


@pytest.mark.parametrize("main", ["article", "main", "div class='post-content'", "div"])
@pytest.mark.parametrize("inside", [False, True])
def test_boilerplate_goes(main, inside):
    body = f"<h1>A title &amp; more</h1><p>First {LONG}<p>Be.</p><p>{LONG} <b>bold</b>er<br>line</p><p>So.<p>&lt;{LONG}"
    want = f"A title & more First {LONG} Be. {LONG} bolder line So. <{LONG}"
    noise = "".join(BOILERPLATE)
    if inside:
        noise = noise.replace("<header>", "<header class=banner>")
        page = f"<html><head><title>T</title></head><body><{main}>{body}{noise}</{main.split()[0]}></body></html>"
    else:
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{noise}<{main}>{body}</{main.split()[0]}>{noise}</body></html>"
    assert M.main_text(page) == want


def test_odd_markup():
    text = lambda x: M.main_text(f"<article>{x}</article>")
    assert text("a<script>x</script>b <!-- c -->c") == "ab c"
    assert text("<p>one<p>two<ul><li>three<li>four</ul>five") == "one two three four five"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a b c d"
    assert text("a&nbsp;b &amp;lt; &#x27; &eacute; &bogus; &copy 5 < 6 & 7") == "a b &lt; ' é &bogus; © 5 < 6 & 7"
    assert text('<p title="a > b" class=\'x\'>t</p>') == "t"
    assert text("</div></p>x</article></span><footer>y") == "x"
    assert text("<header><h1>Own title</h1></header><p>t") == "Own title t"
    assert text("<p>x<!-- never closed") == "x" and text("x<script>never closed") == "x"
    assert text('<p>see <span class="ad">Buy now!</span> it') == "see it"
    assert M.main_text("Just some text.") == "Just some text." and M.main_text("<p>Hi</p>") == "Hi"
    for nothing in (None, "", " \n", "<p></p>", "<nav>a b c</nav>", "<", "<article>"):
        assert M.main_text(nothing) in ("", "<")


def test_pages(spark):
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    wide = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(3000)) + "</article>"
    data = [(1, "u", None), (1, "u", ""), (2, None, f"<article>{LONG}</article>"), (2, None, f"<article>{LONG}</article>"), (None, "v", deep), (3, "w", wide), (4, "x", "<a '" * 20_000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(2).withColumns({"text": F.lit("z"), "a.b": F.lit(1)})
    got = {(r.page_id, r.url): r.text for r in M.extract(df, size=1000).collect()}
    assert M.extract(df).count() == 7 and M.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got[1, "u"] == "" and got[2, None] == LONG and got[None, "v"] == LONG
    assert got[3, "w"] == " ".join(f"{LONG} {k}" for k in range(3000))
    n = M.blocks(df).where("page_id = 3")
    assert n.count() == 3000 and n.where("content").count() == 3000
