import random
import re
import time

import pytest

from tarnwick.llm.html_text import extract_text, html_text


def test_blocks_lists_and_tables():
    page = "<p>a<p>b <b>c</b><ul><li>x<li>y<ul><li>z</ul><li>w</ul>t<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>"
    assert html_text(page) == "a\n\nb c\n\n- x\n- y\n  - z\n- w\n\nt\n\na     bbb\ncccc  d"


def test_hidden_content_gives_nothing():
    page = "<head><title>t</title></head><body>a<script>var x='</p>'</script><style>p{}</style><p hidden>b<p style='color:red; display : none'>c</p><!-- d --><template>e</template><input type=hidden value=f>g"
    assert html_text(page) == "ag"  # what is not displayed does not part the line either


def test_white_space_entities_breaks_and_pre():
    assert html_text("a  b\n c<br>d &amp; &lt;e&gt;&nbsp;f") == "a b c\nd & <e>\xa0f"
    assert html_text("<pre>\n  k\n   l</pre>m") == "  k\n   l\n\nm"
    assert html_text("<ol start=3><li>u<li>v</ol>") == "3. u\n4. v"
    assert html_text("<dl><dt>T<dd>D</dl><blockquote>q<p>r</blockquote>") == "T\n    D\n\n> q\n>\n> r"


def test_implied_table_parts_and_spans():
    assert html_text("<table><td>a<td>b<tr><td colspan=2>c<td>d</table>") == "a  b\nc     d"
    assert html_text("<table><td>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert html_text("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>") == "aa  b\n    c\nd   e"
    assert html_text("<table><tr><td colspan=2000>wide<tr><td>a<td>b</table>") == "wide\na  b"
    assert html_text("<table><tr><td>日本<td>b<tr><td>c<td>d</table>") == "日本  b\nc     d"
    assert html_text("<table><tr><td><table><tr><td>in</table><td>out</table>") == "in  out"
    assert html_text("a<table><tr>note<td>b<div>c</div></tr><p>stray</table>d") == "a note\n\nstray\n\nb\nc\n\nd".replace("a note", "anote")


def test_what_shows_in_hidden_and_closed_elements():
    assert html_text("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>d") == "b\n\nd"
    assert html_text("<p style='visibility:hidden'>a<span style='display:none;visibility:visible'>b</span></p>d") == "d"
    assert html_text("<details>x<summary>s</summary><p>t</details><details open><summary>u</summary>v</details>") == "s\nu\nv"
    assert html_text("a <select><option>b<option selected>c<optgroup><option>d</select> e") == "a c e"
    assert html_text("<select><option disabled>b<option>c</select>") == "c" and html_text("<select multiple><option>b<option>c</select>") == "b\nc"
    assert html_text("<svg><title>t</title><path/><text x=1>a</text><g><text>b<tspan>c</tspan></text></g></svg><math><mi>x</mi><mo>+</mo><mn>1</mn></math>") == "a bc x+1"
    assert html_text("<head><title>T</title>Hello<p>x") == "Hello\n\nx"


def test_broken_and_deep_markup():
    assert html_text("a <b c> </x> <<p") == "a <"  # the page ends within a tag
    assert html_text("1 < 2 <3 </ 4> <!x> <? y> <!--> z") == "1 < 2 <3 z"
    assert html_text("<p a='>' b=\"<p>\" c>x</p foo='>'>y") == "x\n\ny"
    assert html_text("<div>" * 20_000 + "x" + "<i>" * 20_000 + "y") == "x\ny"
    assert html_text("<script>never closed") == "" and html_text("<script>a</scriptx></SCRIPT >b") == "b"
    assert html_text("plain text") == "plain text"


HOSTILE = ["<a ", "<a b='", "<script>x</script ", "</textarea ", "<p><button><div>", "<table><tr>", "<td colspan=1000 rowspan=9999>x<tr>", "<details><summary>", "<select><option>", "<b><i>", "<!--", "<", "&amp"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_pages_of_a_megabyte_take_seconds(piece):
    began = time.perf_counter()
    html_text("<table>" * ("td" in piece) + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < (1 if piece == "<a " else 25)


#: Pages whose drawing could outgrow them: what is repeated, after what.
SPREADING = [
    ("<details>", "<summary>a</summary>"), ("<table><tr>" + "<td rowspan=65534>x" * 1000, "<tr><td>y"), ("<table><tr>" + "<td rowspan=65534>x" * 999, "<tr><td rowspan=2>y"), ("<ul><li>" * 200, "x<br>"),
    ("<blockquote>" * 200, "x<br>"), ("", "<ul><li>a"), ("<dl><dd>" * 200, "x<p>"), ("<ul><li>" * 200 + "<table>", "<tr><td>x<td>y"), ("<table><tr><td>" + "x" * 80 + "<td>y", "<tr><td><td>z"),
]


@pytest.mark.parametrize("before, piece", SPREADING)
def test_pages_of_a_megabyte_stay_within_five_times_their_size(before, piece):
    began = time.perf_counter()
    page = before + piece * (1_000_000 // len(piece))
    text = html_text(page)
    assert len(text) <= 5 * len(page) and time.perf_counter() - began < 25
    kept = re.sub("<[^>]*>", "", piece)
    assert "details" in before or all(text.count(c) >= kept.count(c) * (1_000_000 // len(piece)) for c in kept)  # nothing is lost


def test_marks_and_indents_through_levels():
    assert html_text("<blockquote>a<ul><li>b<br><br>c<ol><li>d<li>e<br>f</ol></ul><p>g</blockquote>") == "> a\n>\n> - b\n>\n>   c\n>   1. d\n>   2. e\n>      f\n>\n> g"
    assert html_text("<ul><li><blockquote>a<p>b</blockquote><li><ul><li>c<br>d</ul></ul>") == "- > a\n  >\n  > b\n- - c\n    d"
    assert html_text("<dl><dt>a<dd>b<br><br>c<dd></dl>") == "a\n    b\n\n    c"
    deep = html_text("<ul><li>" * 30 + "a<br>b")
    assert deep == "- " * 30 + "a\n" + " " * 40 + "b"


def twin(rng, depth, in_item=False):
    """A random block as (html, lines, gap): what it should look like is put together from the tree, not from the markup."""
    word = lambda: rng.choice(["ab", "c", "déf", "x&amp;y", "gh ij"])
    shown = lambda h: h.replace("&amp;", "&")
    noise = rng.choice(["", "", "<!-- n -->", "<i hidden>n</i>", "<b style='display:none'>n</b>", "<script>'<p>'</script>", " \n"])
    kind = rng.choice(["p", "h2", "pre", "table"] if depth == 0 else ["p", "div", "ul", "ol", "quote", "table", "section"])
    if kind in ("p", "h2"):
        a, b = word(), word()
        return f"<{kind}>{a} <em>{b}</em>{noise}" + (f"</{kind}>" if kind == "h2" or rng.random() < 0.5 else ""), [f"{shown(a)} {shown(b)}"], True
    if kind == "pre":
        return "<pre>\n a\n  b</pre>", [" a", "  b"], True
    if kind == "table":
        rows = [[word() for _ in range(3)] for _ in range(rng.randint(1, 3))]
        end = lambda t: f"</{t}>" * (rng.random() < 0.5)
        html = "".join("<tr>" + "".join(f"<td>{c}" + end("td") for c in row) + end("tr") for row in rows)
        wide = [max(len(shown(r[k])) for r in rows) for k in range(3)]
        lines = ["  ".join(shown(c).ljust(w) for c, w in zip(row, wide)).rstrip() for row in rows]
        return f"<table>{rng.choice(['', '<tbody>'])}{html}</table>", lines, True
    if kind in ("ul", "ol"):
        html, lines = "", []
        for k in range(rng.randint(1, 3)):
            head, (inner, below, gap) = word(), twin(rng, 0 if depth == 1 or rng.random() < 0.5 else depth - 1, True)
            below, gap = (below, gap) if rng.random() < 0.5 else ([], False)
            mark = "- " if kind == "ul" else f"{k + 1}. "
            item = [shown(head), *([""] if gap else []), *below] if below else [shown(head)]
            lines += [mark + item[0], *(" " * len(mark) + x if x else x for x in item[1:])]
            html += f"<li>{head}{inner if below else ''}" + ("</li>" if rng.random() < 0.5 else "")
        return f"<{kind}>{html}</{kind}>", lines, not in_item
    blocks = [twin(rng, depth - 1, in_item) for _ in range(rng.randint(1, 3))]
    lines, gap = [], False
    for _, inner, space in blocks:
        if lines and (gap or space):
            lines.append("")
        lines, gap = lines + inner, space
    if len(blocks) > 1:
        gap = False
    html = noise.join(h for h, _, _ in blocks)
    if kind == "quote":
        return f"<blockquote>{html}</blockquote>", ["> " + x if x else ">" for x in lines], True
    return f"<{kind}>{html}</{kind}>", lines, gap


def test_random_trees_look_as_put_together():
    for seed in range(300):
        html, lines, _ = twin(random.Random(seed), seed % 4)
        assert html_text(f"<html><head><title>n</title><body>{html}") == "\n".join(lines).strip("\n"), html


def test_table(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>a", "t"), (3, "<p>a", "t"), (None, "<p>b", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in extract_text(pages).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "a"), (3, "a"), (None, "b")], key=str)
    assert extract_text(pages.limit(0)).count() == 0
