"""Main text against an article read by the standard library's parser, on the given pages and on awkward elements."""

from html.parser import HTMLParser

import duckdb
import pytest

from wardline.llm.html_extract import default_field, leaf_blocks, main_text

UNSEEN = {"script", "style", "template", "iframe", "textarea", "title"}
DRAWN = {"svg", "select"}
LINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img noscript object param math mi mo mn mrow mfrac msup msub msqrt mtext".split())
BREAKS = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class Article(HTMLParser):
    """Blocks in an article element: text between tags that are not of the line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.unseen, self.blocks, self.parts = 0, None, [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if self.unseen in DRAWN and tag in BREAKS:
            self.unseen = None
        if self.unseen:
            return
        if tag in UNSEEN | DRAWN:
            self.unseen = tag
        elif tag not in LINE:
            self.cut()
        elif tag == "br":
            self.parts.append(" ")
        self.inside += tag == "article"

    def handle_startendtag(self, tag, attrs):
        if tag in DRAWN:
            self.parts.append(" ")
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.unseen in DRAWN and tag in BREAKS:
            self.unseen = None
        if self.unseen:
            if tag == self.unseen:
                self.unseen = None
                self.parts.append(" ")
        elif tag not in LINE:
            self.cut()
            self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0 and not self.unseen:
            self.parts.append(data)


def article(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    reader.cut()
    return "\n\n".join(reader.blocks)


def test_given_pages():
    field = default_field()
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        assert main_text(page, field) == article(page)


@pytest.mark.parametrize(
    "inner",
    [
        "<p>One <svg class='i' /> two, as it was.</p><p>Three follows, in full.</p>",
        "<p>One <svg viewBox='0 0 1 1'><path d='M0'/><text>no</text></svg> two, as it was.</p><p>Three follows.</p>",
        "<p>One, before it <svg><path d='M0'></p><p>Two comes after an open drawing.</p>",
        "<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> hold, and <math>y</math> too.</p>",
        "<p>Seen by all, <noscript>and <b>without</b> scripts</noscript> too.</p><noscript>A line of its own, in full.</noscript>",
        "<p>A film, <object data='x'><param name='a' value='b'>or its words</object> here.</p>",
        "<p>Text, then <script>if (a < b) { document.write('<p>no</p>') }</script>more of it.</p>",
        "<p>Choose, <select><option>no<option>neither</select> or not.</p><p>Go on, then.</p>",
        "<p>Left open, <select><option>no</p><p>Text that follows it, in full.</p>",
        "<p>Caf&eacute; &lt;b&gt; &#x41;&#66; &amp;amp; done, as said.</p><!-- <p>no</p> --><p>Last, of all.</p>",
        "<p>Signs <svg data-x='a>b'/> and quotes, in tags.</p><p>End, of it.</p>",
        "<style>p > a { color: red }</style><p>Styled, yet plain.</p><template><p>no</p></template><p>Then, more.</p>",
    ],
)
def test_awkward_elements(inner):
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{inner}</article><footer><p>All rights reserved.</p></footer></body></html>"
    want = article(page)
    assert main_text(page, default_field()) == want and want
    assert "\n\n".join(b.text for b in leaf_blocks(page) if "article" in b.ancestors) == want


def test_a_tag_never_ends_the_page():
    for tag in ("svg", "select", "math", "object", "noscript"):
        page = f"<article><p>First words, of many.</p><{tag} a='1'><p>Second words, of more.</p></article>"
        assert main_text(page, default_field()) == "First words, of many.\n\nSecond words, of more.", tag


def test_long_and_hostile_pages():
    for page in ("<svg " * 20_000, "<svg>" * 20_000, "<select><option>" * 20_000, "<svg '" * 20_000, "<svg/><p>x" * 20_000, "<template" * 20_000):
        leaf_blocks(page)
