"""Visible text where the HTML standard's tree decides what an element holds."""

import pytest

from passerelle.functions.text import Page

CASES = [
    ('<div hidden><table><tr><td>a</div>b</table>shown</div>after', 'after'),
    ('<p>a<div hidden>b</p>c</div>d', 'ad'),
    ('<table>x<tr><td>y</table>', 'xy'),
    ('<table><tr><td>y</td>x</tr></table>z', 'xyz'),
    ('<table hidden><div>x</div><tr><td>y</table>z', 'xz'),
    ('<p><b hidden>x<p>y</b>z', 'z'),
    ('<b hidden>1<p>2</b>3</p>', '3'),
    ('<button hidden>a<p>b</button>c', 'c'),
    ('<p>a<button hidden>b</p>c</button>d', 'ad'),
    ('<ul><li hidden>a<li>b</ul>', 'b'),
    ('<ul><li hidden>a<ul><li>b</ul>c<li>d</ul>', 'd'),
    ('<dl><dt hidden>a<dd>b</dl>', 'b'),
    ('<div hidden/>x', ''),
    ('<br hidden/>x', 'x'),
    ('<svg><path/><g/></svg>x', 'x'),
    ('<svg><p>x', 'x'),
    ('<svg><title><p>q</p></title></svg>x', 'x'),
    ('<head><title>t</title><p>x', 'x'),
    ('<title>t</title>x', 'x'),
    ('x<title>t</title>', 'xt'),
    ('<select hidden><option>a<option>b</select>c', 'c'),
    ('<select hidden><option>a<input>c', 'c'),
    ('<form hidden><div></form>x</div>y', 'y'),
    ('<h1 hidden>a<h2>b</h2>c', 'bc'),
    ('<!-- x', ''),
    ('<!-->x', 'x'),
    ('a<!-- <b> -->b', 'ab'),
    ('<textarea><p hidden></textarea>x', '<phidden>x'),
    ('<iframe><div></iframe>x', 'x'),
    ('<noscript><div></noscript>x', 'x'),
    ('<a hidden href=1>x<a href=2>y</a>', 'y'),
    ('<table><caption hidden>a<tr><td>b</table>', 'b'),
    ('<table><tr hidden><td>a<tr><td>b</table>', 'b'),
    ('<table><tr><td hidden>a<td>b</table>', 'b'),
    ('<table><tbody hidden><tr><td>a<tbody><tr><td>b</table>', 'b'),
    ('<table><tr><td><table><tr><td hidden>a</table>b</table>', 'b'),
    ('<span hidden>a<div>b</span>c</div>d', ''),
    ('<span hidden>a</div>b</span>c', 'c'),
    ('<html><body>a</body></html>b', 'ab'),
    ('<body hidden>x', ''),
    ('<p hidden>a<table><tr><td>b</table>c', 'bc'),
    ('<ruby>a<rt hidden>b<rt>c</ruby>', 'ac'),
    ('<object hidden><p>a</object>b', 'b'),
    ('<i hidden><table>x<tr><td>y</table></i>z', 'z'),
]


def visible(html):
    page = Page()
    page.feed(html)
    page.close()
    return "".join(page.visible_text().split())


@pytest.mark.parametrize(("html", "text"), CASES)
def test_visible_text(html, text):
    assert visible(html) == text


def test_deep_and_unclosed():
    """What is nested ever deeper stays linear, and no text is lost."""
    assert visible("<div>" * 20_000 + "x" + "</div>" * 20_000 + "y") == "xy"
    assert visible("<p><b>x" * 5_000) == "x" * 5_000
    assert visible("<a href=x><i class=y>z" * 2_000) == "z" * 2_000
    assert visible("<table><tr><td>" * 500 + "x") == "x"


def test_links_of_the_source():
    page = Page()
    page.feed("<a href=1><p>x</a>y<table><a href=2><tr><td><a href=3></table>")
    page.close()
    assert page.links == ["1", "2", "3"]
