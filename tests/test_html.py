"""Trees, runs and segments; corruption of model outputs."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import segmenting as S
from spanloom.operators.html_tree import Tree, compare


@pytest.mark.parametrize("html", [
    "<p>upper<br>lower<img src='pic.gif' alt=k>tail</p>", "<!-- note --><h3>heading</h3>", "<DIV Class=x>q</DIV>", "a&nbsp;b&#160;c&#xA0;d&amp;e", "<p>R&amp;D 和 R&D 部门</p>", "&lt;br&gt;", "<br/><br >", "<script>for (k=0; k<9 && run; k++) {}</script>", "", "plain",
])
def test_valid_fragments_come_back_as_they_were(html):
    tree = Tree(html)
    assert tree.spelt and tree.serialized() == html


@pytest.mark.parametrize(("html", "out"), [
    ("<p>one<em>two<p>three</p>", "<p>one<em>two</em></p><p><em>three</em></p>"), ("<p>left</em>right", "<p>leftright</p>"), ("<p>a<div>b", "<p>a</p><div>b</div>"), ("<p><b>x<br><p>y", "<p><b>x<br></b></p><p><b>y</b></p>"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"), ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<a>1<a>2</a>", "<a>1</a><a>2</a>"), ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ("<table><tr><td>x<td>y</table>z", "<table><tbody><tr><td>x</td><td>y</td></tr></tbody></table>z"), ("<html><body><p>x</body></html>", "<p>x</p>"), ("x < y", "x &lt; y"), ("</p>", "<p></p>"), ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<p>a<table><tr><td>b</table>", "<p>a</p><table><tbody><tr><td>b</td></tr></tbody></table>"),
])
def test_malformed_documents_are_normalized(html, out):
    assert Tree(html).serialized() == out
    assert compare(Tree(html), Tree(out))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<div>", "</div>", "<a>", "</a>", "<li>", "<table>", "<td>", "</table>", "<br>", "x", " 中 ", "&amp;", "&", "<", "<!-- c -->"]), max_size=25).map("".join))
def test_serializing_is_stable(html):
    once = Tree(html).serialized()
    twice = Tree(once)
    assert len([n for n in twice.walk() if n.kind == "comment"]) == html.count("<!-- c -->")
    assert re.sub("<[^>]*>", "", once).replace("&lt;", "<") == re.sub("<(?=[^a-z/!])", "<", re.sub("<!-- c -->|</?[a-z]+>", "", html)) or "<<" in html or html.endswith("<") or "< " in html or "<x" in html or "<&" in html


def test_excluded_parts_and_what_is_below_them():
    tree = Tree('<style>h1{top:0}</style><h4>标题</h4><pre>make all</pre><section translate="no">子<i>丑</i></section><p class="notranslate z">寅</p>')
    assert [n.text for n in tree.walk() if n.kind == "text" and n.excluded] == ["h1{top:0}", "make all", "子", "丑", "寅"]
    assert [b[0][1].text for b in S.blocks(tree)] == ["标题"]


def test_english_blocks_are_not_sent():
    assert S.blocks(Tree("<p>only english</p><p>  </p>")) == []


def fake(text):
    return re.sub("([一-鿿]+)", r"EN:\1", text)


def translated(html, **kw):
    tree = Tree(html)
    done = S.segments(tree, "d", **kw)
    return S.rebuilt(tree, done, {s.segment_id: fake(s.source_text) for s in done})


@pytest.mark.parametrize(("html", "out"), [
    ("<p>前 <strong>中</strong> 后</p>", "<p>EN:前 <strong>EN:中</strong> EN:后</p>"), ("<p>中文&nbsp;English</p>", "<p>EN:中文&nbsp;English</p>"), ("<p>重量 1.5kg 好</p>", "<p>EN:重量 1.5kg EN:好</p>"),
    ("<p>one</p><p>二</p>", "<p>one</p><p>EN:二</p>"), ("<p>中<br/>文<BR></p>", "<p>EN:中<br/>EN:文<BR></p>"), ("<p>甲 ABC-123 乙 plain text 丙</p>", "<p>EN:甲 ABC-123 EN:乙 plain text EN:丙</p>"),
])
def test_translation_keeps_all_but_the_text(html, out):
    assert translated(html) == out


def test_runs_and_their_kinds():
    tree = Tree("<p>中文&nbsp;ABC/1234 Q7-2024 用 USB-C</p>")
    runs = S.segments(tree, "d", preserve=(r"[A-Z]{2,}/\d{4}", r"Q\d+-\d{4}"))[0].runs
    assert [r.kind for r in runs] == ["chinese", "entity_protected", "model_number_protected", "english_protected", "model_number_protected", "chinese", "identifier_protected"]


def test_numbers_and_context():
    done = S.segments(Tree("<p>一</p><p>二</p><p>三</p>"), "d")
    assert [s.segment_id for s in done] == ["d:0000", "d:0001", "d:0002"] and [s.block_key for s in done] == ["b0000", "b0001", "b0002"]


LONG = "<div>" + "".join(f"第{i}段文字，带有<b>粗体</b>和 ABC-{i:03d} 型号。还有一句话！" for i in range(60)) + "</div>"


@pytest.mark.parametrize("room", [30, 60, 450])
def test_segments_fit_and_cover(room):
    tree = Tree(LONG)
    done = S.segments(tree, "d", room)
    assert all(s.token_count <= room for s in done) and not S.uncovered(done)
    assert "".join(r.raw for s in done for r in s.runs) == done[0].block_text
    for s in done:
        slots = [r.slot_index for r in s.runs if r.translate]
        assert len(slots) == len(set(slots)) and len(S.TOKEN.split(s.source_text)) == len(s.order) + 1
    assert S.rebuilt(tree, done, {s.segment_id: s.source_text for s in done}) == LONG


def test_indivisible_text_is_an_error():
    with pytest.raises(S.TooLong):
        S.segments(Tree("<p>中" + "https://example.com/" + "x" * 50 + "</p>"), "d", 4)


def spoiled(rng, text):
    tokens = S.TOKEN.findall(text)
    way = rng.choice(["reorder", "missing", "double", "alter", "fake"])
    if way == "reorder" and len(tokens) > 1:
        a, b = rng.sample(tokens, 2)
        return text.replace(a, "\0").replace(b, a).replace("\0", b)
    if way == "missing" and tokens:
        return text.replace(rng.choice(tokens), "", 1)
    if way == "double" and tokens:
        return text + rng.choice(tokens)
    if way == "alter" and tokens:
        t = rng.choice(tokens)
        return text.replace(t, t[:-2] + "x_")
    return text + " __ITQQ11_S0007_"


def test_spoiled_outputs_are_rejected_whole():
    rng = random.Random(20260812)
    html = "<p>甲 <b>X13</b> 乙&nbsp;English A 丙 100W 丁 5V</p><p>戊&#160;己<br>庚</p><p>辛 &amp; 壬</p>"
    for _ in range(60):
        tree = Tree(html)
        done = S.segments(tree, "d")
        outputs = {s.segment_id: fake(s.source_text) for s in done}
        bad = rng.choice(done).segment_id
        outputs[bad] = spoiled(rng, outputs[bad])
        with pytest.raises(S.Rejected):
            S.rebuilt(tree, done, outputs)


def test_model_markup_stays_text():
    tree = Tree("<p>中文</p>")
    done = S.segments(tree, "d")
    assert S.rebuilt(tree, done, {"d:0000": "<b>x</b> &amp;"}) == "<p>&lt;b&gt;x&lt;/b&gt; &amp;amp;</p>"


def test_attributes_keep_what_follows_an_identifier():
    html = '<img alt="加厚 ABC-123 面料" src="https://example.com/x.png" title="耐磨">'
    tree = Tree(html)
    attrs = S.attribute_segments(tree, "d", ("alt", "title"))
    out = S.rebuilt(tree, [], {s.segment_id: fake(s.source_text) for s in attrs}, attrs, ("alt", "title"))
    assert out == '<img alt="EN:加厚 ABC-123 EN:面料" src="https://example.com/x.png" title="EN:耐磨">'
