import html
import re

import numpy as np
import pytest

from profuse.llm import htmltext, queries

from .conftest import SF


def test_pages(spark):
    """The test pages keep their text in one article of headings and paragraphs."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    got = queries.op4_line_blocks(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


ARTICLE = "<h1>Big &amp; small</h1><p>First   paragraph of the text, long enough to matter.</p><p>Yes.</p><p>Second paragraph<br>with a break, and <a href=x>a link</a> in it.</p>"
TEXT = "Big & small\nFirst paragraph of the text, long enough to matter.\nYes.\nSecond paragraph with a break, and a link in it."


@pytest.mark.parametrize("page", [
    f"<body><nav><a>Home</a></nav><article>{ARTICLE}</article><footer>Foot</footer></body>",
    f"<body><header><h2>Site</h2></header><main><article>{ARTICLE}<div class='ad-box ad'>Buy</div></article><section class=comments><article>Nice!</article></section></main>",
    f"<div id=menu><ul><li>Home<li>About</ul></div><div class=content>{ARTICLE}</div><div class=sidebar><p>Also read this long line about something else here.</p></div>",
    f"<div class='cookie-notice'>We use cookies on this site to make it better for you and everyone.</div><div>{ARTICLE}</div><form><p>Search here for anything</p></form><div id='comments'><p>I like this very much, thank you for the text!</p></div>",
    f"<script>var a='</p><p>x';</script><style>p{{}}</style><!-- <p>c</p> --><article>{ARTICLE}<aside>See also</aside></article>",
    f"<article><header>{ARTICLE}</header></article><div role=complementary>More</div><article class='comment'>No</article>",
])
def test_parts_outside_the_article_go(page):
    assert htmltext.main_text(page) == TEXT


def test_surge_and_dive():
    plain = np.array([0, 5, 0, 0, 0, 0, 60, 80, 3, 70, 0, 0, 0, 4, 0])
    assert htmltext.blocks(plain) == [(6, 10)]
    assert htmltext.blocks(np.zeros(0, dtype=int)) == []
    assert htmltext.blocks(np.array([0, 3, 2])) == [(1, 3)]


def test_odd_pages(spark):
    broken = ["<p>unclosed <b>bold <p>next</p></article>", "no markup at all", "<<p>a<b", "<p title='>'>quoted</p>", "&#233;t&eacute; &amp", "<div " * 2000, "<p>" * 3000 + "deep"]
    for page in broken:
        assert isinstance(htmltext.main_text(page), str)
    assert htmltext.main_text(broken[1]) == "no markup at all"
    assert htmltext.main_text(broken[4]) == "été &"
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", "<article>x</article>", 3), (2, "u", "<article>x</article>", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, htmltext.extract(frame).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)], key=str)
    assert htmltext.extract(frame.limit(0)).count() == 0


LONG = "A sentence of the article that goes on for a while. " * 8
SHORT = "An introduction of ninety characters, which is short beside the rest but belongs to the text."


def test_removed_boxes_do_not_cut_the_text():
    long = LONG.strip()
    for box in ("<div class=ad>Buy</div>", "<aside><form>x</form></aside>", "<div class='share-buttons'><ul><li>Post</ul></div>"):
        page = f"<div class=content><p>{SHORT}</p>{box}<p>{long}</p><p>{long}</p>{box}<p>The end.</p></div>"
        assert htmltext.main_text(page) == "\n".join([SHORT, long, long, "The end."])
        assert htmltext.main_text(f"<body><div>Tag</div><nav>Home</nav>{page}<footer>Foot</footer><div>Imprint</div></body>") == "\n".join([SHORT, long, long, "The end."])
    # A second part counts by its own surge, however long the first is.
    assert htmltext.main_text(f"<div><p>{long * 5}</p></div><nav>x</nav><div><p>{SHORT}</p></div>") == f"{long * 5}\n{SHORT}"


def test_names_are_whole_and_most_of_the_text_stays():
    for page in ("<div class='content no-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>", "<div class='has-sidebar'>{}</div>",
                 "<div class='page sidebar-right'>{}</div>", "<article class='widget'>{}<div class='ad-slot'>Buy</div></article>"):
        assert htmltext.main_text(page.format(ARTICLE)) == TEXT
    assert htmltext.main_text(f"<div>{ARTICLE}</div><div class='comments-area'>{ARTICLE * 2}</div>") == TEXT
