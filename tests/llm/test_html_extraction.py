import re
from collections import Counter
from html.parser import HTMLParser

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from lorequarry.llm.html_extraction import BAD, GOOD, Block, Rules, decide, extract, extract_main_text, labelled, nearest, promote, settle

LONG = "This is the text of an article that goes on for a while and has many of the usual words in it, as it should be. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>no</article>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    html = page(
        "<header><a href='/'>Home</a></header><nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='cookie-notice'>We use cookies on this site</div>"
        "<article><h1>Title&amp;amp; more</h1><p><b>One &lt;two&gt;<br>three\n  four<p>Five</p><aside>Related</aside><form>Mail <input></form><div class='ad-box'>Buy</div>"
        "<section id='comments'><article><p>First!</p></article></section></article><div class='sidebar'><article><p>Other</p></article></div><footer>&copy; x</footer>"
    )
    assert extract(html) == "Title&amp; more\n\nOne <two> three four\n\nFive"


def test_article_header_stays_and_page_header_goes():
    assert extract(page("<header><p>Site</p></header><article><header><h1>Head</h1></header><p>Body</p></article>")) == "Head\n\nBody"


def test_block_rules_without_an_article():
    html = page(f"<div><a href='/'>one</a> <a href='/2'>two</a></div><h2>Short title</h2><p>{LONG * 3}</p><p>Ok.</p><p>{LONG * 3}</p><p><a href='/x'>{LONG}</a></p>")
    text = " ".join((LONG * 3).split())
    assert extract(html) == f"Short title\n\n{text}\n\nOk.\n\n{text}"


def test_other_containers():
    assert extract(page("<div>top</div><main><header><h1>T</h1></header><p>Short.</p><nav>n</nav></main><div>end</div>")) == "T\n\nShort."
    assert extract(page('<div id="top-menu">m</div><div id="content" class="x"><div class="article-header"><h1>T</h1></div><p>Short.</p><div class="shareBar">s</div></div>')) == "T\n\nShort."
    assert extract(page("<main><p>Teaser</p><article><p>Body <button>Save</button>text <span class='ad'>Buy</span>on <span class='term'>and</span> on</p></article></main>")) == "Body text on and on"
    assert extract(page("<div role='main'><p>One</p></div><div role='complementary'><p>Two</p></div>")) == "One"
    # a list of links is bad inside an article too, and what has no stop words goes with it
    text = " ".join((LONG * 3).split())
    assert extract(page(f"<article><p>{LONG * 3}</p><ul><li><a href=x>all link</a></li></ul><p>{LONG * 3}</p></article>")) == f"{text}\n\n{text}"
    assert extract(page(f"<article><p>{'<a href=x>Buy this now</a> ' * 40}</p><p>{'frobble snark wibble ' * 27}</p></article><div class='x'><p>{LONG * 3}</p></div>")) == ""


def test_odd_pages():
    assert extract(None) == extract("") == extract("<html></html>") == extract("<script>a<") == ""
    assert extract("<article>a<b c='d") == "a<b c='d"
    assert extract("<article><p>a &nbsp; b&#10;c</p><hidden hidden>x</hidden></article>") == "a b c"
    assert extract("<article><p>" + "w " * 200_000 + "</p>") == ("w " * 200_000).strip()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "text ", "&amp;", "<", ">", '"', "<!--", "-->", "<script>", "</script>", "<br>"]), max_size=30))
def test_any_markup(parts):
    out = extract("".join(parts))
    assert out == out.strip() and "\n\n\n" not in out


def test_operator(spark):
    rows = [(1, "u", "<article>é a</article>", "x"), (2, None, None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "v", "<article>b</article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(df).collect()}
    assert got == {(1, "u", "é a", 3), (2, None, "", 0), (None, "v", "b", 1)}
    assert extract_main_text(df).count() == 5
    assert extract_main_text(df.limit(0)).collect() == []


class Article(HTMLParser):
    """A plain reading of the corpus: the blocks of its one article, at tags of blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now = False, [], ""

    def end(self):
        self.out += [" ".join(self.now.split())] if self.inside and self.now.split() else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "h2", "li", "ul", "div", "footer", "table", "tr", "td"):
            self.end()
        self.inside |= tag == "article"
        self.now += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "li", "ul", "div", "footer", "table", "tr", "td"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.now += data


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def test_the_corpus_against_a_plain_reading(corpus):
    for html in corpus:
        plain = Article()
        plain.feed(html)
        plain.end()
        assert extract(html) == "\n\n".join(plain.out)


def plain_page(html):
    """A page without anything that names its containers."""
    html = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"""\s(?:class|id|role|itemprop|data-role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)


def test_the_article_container_adds_nothing(corpus):
    """With plain divs in place of the article every page gives the same text."""
    for html in corpus:
        assert extract(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", html)) == extract(html)
    rules = Counter(b.rule for html in corpus for b in labelled(html) if b.label == GOOD)
    assert rules["container"] == 0 and rules["stop words"] > 800 and rules["neighbours"] > rules["best of the page"]


def test_pages_without_names_of_containers(corpus):
    kept = lost = foreign = 0
    for html in corpus:
        found, wanted = Counter(extract(plain_page(html)).split("\n\n")), Counter(extract(html).split("\n\n"))
        kept += (found & wanted).total()
        lost += (wanted - found).total()
        foreign += (found - wanted).total()
    assert kept >= 0.98 * (kept + lost) and foreign < 0.2 * len(corpus)


@pytest.mark.parametrize(
    ("rules", "named", "plain"),
    [(Rules(stop_low=9, stop_high=9), 200, 200), (Rules(short_chars=10**9), 0, 200), (Rules(stop_high=0.4), 0, 10), (Rules(long_chars=0), 0, 10), (Rules(stop_low=0, stop_high=0), 0, 1), (Rules(short_chars=0), 0, 5)],
)
def test_other_thresholds_give_other_texts(corpus, rules, named, plain):
    assert sum(extract(html, rules) != extract(html) for html in corpus) >= named
    assert sum(extract(plain_page(html), rules) != extract(plain_page(html)) for html in corpus) >= plain


def test_links_decide_at_their_threshold():
    html = page(f"<article><p>{LONG * 3}</p><p>See <a href='/x'>this page</a> for all of it. {LONG * 2}</p><p>{LONG * 3}</p></article>")
    assert "this page" in extract(html) and "this page" not in extract(html, Rules(max_link_density=0))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("gbsnlh"), st.integers(0, 2), st.booleans()), max_size=12))
def test_neighbours_by_search(spec):
    """Pass two against a search outwards from each block, on a page without an article."""
    text = {"g": LONG * 3, "b": "link", "s": "Short.", "n": LONG[:100], "l": "link words", "h": "Heading"}
    blocks = [Block(text=" ".join(text[k].split()), link_chars=9 if k in "bl" else 0, heading=k == "h", container=c, boilerplate=bad) for k, c, bad in spec]
    for b in blocks:
        b.label, b.rule = decide(b, Rules(), 0)
    promote(blocks, Rules())
    first = [b.label for b in blocks]
    groups = [-1 if b.boilerplate else b.container for b in blocks]
    for i, (left, right) in enumerate(nearest(first, groups)):
        decided = [k for k, v in enumerate(first) if v in (GOOD, BAD) and groups[k] == groups[i]]
        assert left == max((k for k in decided if k < i), default=None) and right == min((k for k in decided if k > i), default=None)
    settle(blocks, Rules(), 0)
    assert all(b.label in (GOOD, BAD) for b in blocks)
    assert all(b.label == v for b, v in zip(blocks, first) if v in (GOOD, BAD))
    for i, b in enumerate(blocks):
        kin = [k for k, v in enumerate(first) if v in (GOOD, BAD) and groups[k] == groups[i]]
        if first[i] not in (GOOD, BAD) and kin and len({first[k] for k in kin}) == 1 and any(x.label == GOOD for x in blocks):
            assert b.label == first[kin[0]]
