"""Blocks of HTML pages against rows worked out by hand."""

import pytest

from lectern.functions.html_tree import content_root, elements, tree
from lectern.plans.html import html_blocks

A, B, C = ("The first of the long sentences that a page of this kind would hold.", "Another sentence that is long enough to be kept as a block of its own here.", "A third sentence of the page, which is as long as the two others before it are.")
WIDE = A * 4  # long enough that nothing is merged


def blocks(spark, *pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "1 as tag", "'x' as content")
    out = {}
    for r in sorted(html_blocks(frame).collect(), key=lambda r: (r.page_id, r.block_no)):
        out.setdefault(r.page_id, []).append((r.kind, r.level, r.content))
    return out


def test_elements_in_tree_order():
    html = f"<html><head><title>t</title><script>x</script></head><body><div><section><h2>One</h2><p>{A}<p>{B}</section>{'direct text of a container that is long enough to count'}<ul><li>a<ul><li>b</ul><li>c</ul></div><blockquote><p>quoted</p></blockquote></body></html>"
    assert elements(html)[:-1] == [("h2", "One", ""), ("p", A, ""), ("p", B, ""), ("ul", "abc", ""), ("#direct", "direct text of a container that is long enough to count", ""), ("blockquote", "quoted", "")]
    assert elements("<figure title='f'><img src=a><figcaption> under it </figcaption></figure><table><caption>cap</caption><tr><td>1<td>2</table>")[:-1] == [("figure", "under it", "f"), ("figcaption", "under it", ""), ("table", "cap12", "cap")]
    assert elements(None) == elements("") == [("#all", "", "")]


def test_tree_ends_what_is_open():
    items = tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>").children()[0].children()
    assert [x.text() for x in items] == ["a", "bc", "d"]
    rows = tree("<table><tr><td>1<td>2<tr><td>3</table>after").children()
    assert [[c.text() for c in r.children()] for r in rows[0].children()] == [["1", "2"], ["3"]]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert elements(deep)[0][1] == "x"
    assert tree("<p>a</b>b</p>c").children()[0].text() == "ab"


@pytest.mark.parametrize("wrap, tag", [('<div id="readability-page-1">{}</div>', "div"), ('<div data-journey-hook="client-content">{}</div>', "div"), ('<main data-testid="BodyWrapper">{}</main>', "main"), ("{}", "body")])
def test_content_roots(wrap, tag):
    root = content_root(tree(f"<body><nav>menu</nav>{wrap.format('<p>inside</p>')}</body>"))
    assert root.tag == tag and "inside" in root.text() and ("menu" in root.text()) == (tag == "body")


def test_kinds_repeats_and_noise(spark):
    html = f"<body><h1>{A}</h1><h3>{A.upper()}</h3><p>{WIDE}</p><p>{WIDE.upper()}</p><div><li>{B} {B}</li></div><blockquote>{C}</blockquote><p>short</p><p>Copyright {B}</p><p>Read more: {C}</p><pre>{WIDE}</pre></body>"
    got = blocks(spark, html, None, "", "<p>tiny</p>")
    assert got == {0: [("heading", 1, A), ("paragraph", None, WIDE), ("list", None, f"{B} {B}"), ("quote", None, C), ("paragraph", None, WIDE)]}


def test_long_texts_are_cut_and_plain_pages_too(spark):
    long = " ".join([A] * 40)
    got = blocks(spark, f"<p>{long}</p><p>{WIDE}</p>", f"plain text without any tag. {long}", f"<div>{B * 3}\n\n{C * 3}</div>")
    assert [k for k, *_ in got[0]] == ["paragraph"] * len(got[0]) and got[0][-1][2] == WIDE
    assert " ".join(t for *_, t in got[0][:-1]) == long and all(len(t) <= 800 for *_, t in got[0][:-1])
    assert " ".join(t for *_, t in got[1]) == f"plain text without any tag. {long}"
    assert len(got[2]) == 1
