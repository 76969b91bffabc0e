import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eigenframe.llm import main_text
from eigenframe.llm.main_text import Weights, best_stretch
from eigenframe.llm.main_text import main_text as extracted

SF = "/root/testdata/sf0.001"
BODY = "One of the first things that they saw was the long grey wall of the old harbour, which had been there for ages."


@pytest.fixture(scope="module")
def weights(spark):
    return main_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_stretch(scores):
    a, b = best_stretch(scores)
    sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert sum(scores[a:b]) == max([0, *sums]) and (a, b) <= (len(scores), len(scores))


def page(inner, before="", after="", mark="article"):
    top = '<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">'
    nav = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li></ul></nav>'
    opened, closed = (f"<{mark}>", f"</{mark}>") if mark else ("", "")
    return f"{top}{nav}{before}{opened}{inner}{closed}{after}<footer>&copy; Somebody</footer></body></html>"


PLAIN = f"<h1>Walls</h1><p>{BODY}</p><p>{BODY}</p>"
WANT = f"Walls\n{BODY}\n{BODY}"
BEFORE = [
    '<header><h2>The Daily Page</h2><p>News for all of us</p></header>', '<div class="cookie-notice">We use cookies, as everybody does.</div>',
    '<div id="topAd">Buy this wonderful thing today, it is cheap</div>', "<form><label>Search</label><input name=q><button>Go there</button></form>",
    "<!-- <p>not shown at all</p> -->", "<noscript><p>Please turn scripts on</p></noscript>",
    '<div role="alert">Server down</div>', '<div role="navigation">Home Sports Weather</div>',
]
AFTER = [
    f'<section class="comments"><h2>Comments</h2><p>{BODY}</p></section>', f'<aside><p>{BODY}</p></aside>', '<div class="related-posts"><p>Read this too</p></div>',
    f'<div class="comment-list"><article class="comment"><p>{BODY} I say</p></article></div>', "<script>document.write('<p>x</p>')</script>",
    '<div class="share-buttons">Share this page now</div>',
]


@pytest.mark.parametrize("mark", ["article", "main", ""])
@pytest.mark.parametrize("extra", [*BEFORE, *AFTER])
def test_regions_left_out(weights, mark, extra):
    if mark == "main" and "<article" in extra:
        return  # then the article would be the label
    before, after = (extra, "") if extra in BEFORE else ("", extra)
    if mark or "<article" not in extra:
        assert extracted(page(PLAIN, before, after, mark), weights) == WANT
    inside = f"<h1>Walls</h1><p>{BODY}</p>{extra}<p>{BODY}</p>"
    if mark and not extra.startswith(("<header", "<div class=\"comment-list")):
        assert extracted(page(inside, mark=mark), weights) == WANT


CASES = {
    "<p>a &amp; b &lt;c&gt; &#233;&#xe9; &nbsp;&hellip; AT&T &amp;amp;</p>": "a & b <c> éé … AT&T &amp;",
    "<p>one\n\t two<br>three<br/>four</p>": "one two three four",
    "<p><b>open<br><p>next</b> one<p>third</p>": "open\nnext one\nthird",
    "<p>in<b>li</b>ne <a href='x>y' title=it's>link</a>, <i>end</i></p>": "inline link, end",
    "<div>first<p>second</p>third</div>": "first\nsecond\nthird",
    "<ul><li>x1<li>x2</ul><table><tr><td>c1<td>c2</table>": "x1\nx2\nc1\nc2",
    "<p>1 < 2 and 3 > 2, a<b c</p>": "1 < 2 and 3 > 2, a",
    "<p>before</p><!-- gone <p> --><p>after</p><!-->kept": "before\nafter\nkept",
    "<p>zero width　space</p>": "zero width space",
    "<header><h1>Own title</h1></header><p>text</p>": "Own title\ntext",
    "<P CLASS=Lead>upper</P >case": "upper\ncase",
    "<pre>  a\n  b </pre>": "a b",
    "<p hidden>no</p><p aria-hidden=true>no</p><p aria-hidden=false>yes</p>": "yes",
    '<p>said <span class="ad">Buy</span>more</p>': "said more",
    "<blockquote><p>q</p></blockquote><figure><img src=a.png><figcaption>cap</figcaption></figure>": "q\ncap",
    "<p>x</p></div></span></p>y": "x\ny",
    "": "",
    "<p> </p>": "",
}


@pytest.mark.parametrize("inner", CASES)
def test_markup(weights, inner):
    assert extracted(page(inner), weights) == CASES[inner]


@pytest.mark.parametrize("source", ["", " ", "<", "<p", "</", "<!--", "<script>", "<nav>only a menu</nav>", "<article", "<title>t", "<!doctype html>"])
def test_pages_without_text(weights, source):
    assert extracted(source, weights) == "" or source in ("<", "</")


def test_no_markup(weights):
    assert extracted("just  words", weights) == "just words"
    assert extracted("just words", Weights()) == "just words"


def test_menu_left_open(weights):
    assert extracted(f"<body><div class=menu><a href=x>Home</a><article>{PLAIN}</article>", weights) == WANT


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='ad'>", "</div>", "<article>", "</article>", "<li>", "<td>", "<tr>", "w ", "<a href=\"", ">", "'", "\"", "<!--", "-->", "&amp;", "<script>", "</script>", "<br/>", "</", "<main>", "=", "<nav", "\x00", "é"]), max_size=40).map("".join))
def test_tag_soup(source):
    out = extracted(source, Weights())
    assert "\n\n" not in out and out == out.strip() and "  " not in out


@pytest.mark.parametrize("unit", ["<", "<a", "<a =\"", "<a ='\" ", "<b>", "</b>", "<div>", "<i><p>", "</i>", "<!--", "<script>", "<p>x", "<li>", "&am", "<td><b>", "<!", "</article>", "=\"'<a "])
def test_time_grows_with_the_page(unit):
    for tail in ("", ">", "\">"):
        began = time.process_time()
        extracted(unit * 40_000 + tail, Weights())
        assert time.process_time() - began < 10


def test_weights(weights):
    assert weights.word("p -") == 6 and weights.word("footer footer") < -3 and weights.word("li a menu") < -3
    assert weights.word("never seen -") > 0 > weights.word("never seen aside")
    assert all(weights.tag(t) < 0 for t in (*main_text.BLOCKS, "b", "unknown")) or weights.tag("article") == 0
    assert weights.tag("p") > weights.tag("li") == weights.tag("footer") == -1


def test_odd_pages(spark, weights):
    rows = [(1, "u", page(PLAIN), 1, 2), (1, "u", page(PLAIN), 1, 2), (None, None, None, 1, 2), (2, "v", "", 1, 2), (None, "w", page("<p>" + "ab " * 2_000_000 + "</p>"), 1, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int, kind int").repartition(3)
    got = main_text.extract(df, weights).collect()
    want = [(1, "u", WANT), (1, "u", WANT), (None, None, ""), (2, "v", ""), (None, "w", ("ab " * 2_000_000).strip())]
    assert sorted(map(str, got)) == sorted(f"Row(page_id={i}, url={u!r}, text={t!r}, n_chars={len(t)})" for i, u, t in want)
    assert main_text.fit(df).words["p -"] == (2 * 2 * len(BODY.split()) + 2_000_000, 0)
    none = df.limit(0)
    assert main_text.fit(none) == Weights() and main_text.extract(none, Weights()).count() == 0
