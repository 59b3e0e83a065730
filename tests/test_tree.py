import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.htmltree import fragment, parse, text_of, to_xml


@pytest.mark.parametrize(
    ("source", "body"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<div><b>x<br><p>y</p></div>q", "<div><b>x<br/><p>y</p></b></div><b>q</b>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<table>foo<tr><td>x</table>", "foo<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<p><a href=x>1<a href=y>2</a></p>", '<p><a href="x">1</a><a href="y">2</a></p>'),
        ("<p>a<div>b</div>", "<p>a</p><div>b</div>"),
        ("a</p>b", "a<p/>b"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ],
)
def test_body(source, body):
    assert to_xml(parse(source)) == f"<html><head/><body>{body}</body></html>"


def test_head_raw_text_and_references():
    root = parse('<!DOCTYPE html><html lang="de"><title>a &amp; b</title><script>var t="</p>";</script><p title="&quot;x&quot;">é&copy;')
    assert root.attrs == {"lang": "de"}
    assert text_of(root.elements("title")[0]) == "a & b"
    assert root.elements("script")[0].kids[0].text == 'var t="</p>";'
    assert root.elements("p")[0].attrs == {"title": '"x"'}
    assert text_of(root.elements("p")[0]) == "é©"


def test_text_joins_runs_between_elements():
    assert text_of(fragment("<p>Hello<b>World</b>,\n you</p>")) == "Hello World , you"


def test_matching_is_a_search_in_any_case():
    root = parse('<div id="AppleFooter"><p class="x">a</p></div>')
    assert [n.tag for n in root.matching("id", "foot")] == ["div"]
    assert root.matching("id", "foot", "p") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab p\"'=&;td! -rlivu", max_size=60))
def test_any_text_gives_a_tree(source):
    root = parse(source)
    for n in root.walk():
        for k in n.kids:
            assert k.up is n
    assert root.kids[-1].tag == "body"


def test_deep_nesting():
    root = parse("<div>" * 5000 + "x")
    assert text_of(root) == "x"
    assert len(root.copy().elements("div")) == 5000
