from __future__ import annotations

import html.parser
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import DATA, rows_of

from spectraloom.llm.html_text import MAX_DEPTH, extract, rendered

CASES = {
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "<ul><li>one<li>two<ol start=3><li>x<li value=7>y<li>z</ol><li>three</ul>": "- one\n- two\n  3. x\n  7. y\n  8. z\n- three",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<table><tr><th>Name<th align=right>N<tr><td>longer<td>12<tr><td colspan=2>wide one</table>": "Name     N\nlonger  12\nwide one",
    "<table>stray<tr><td>a<table><tr><td>in<td>ner</table><td>b</table>": "stray\n\na        b\n\nin  ner",
    "<pre>\n x  y\n\tz</pre>": " x  y\n\tz",
    "a<br>b<br><br>c": "a\nb\n\nc",
    " a \n b&nbsp;&nbsp;c &amp;&lt;p&gt; ": "a b  c &<p>",
    "x<script>var s='</p>';</script>y<style>.k{display:none} #i , b.v {visibility:hidden}</style><i class='j k'>1</i><u id=i>2</u><b class=v>3<em style='visibility:visible'>4</em></b>": "xy4",
    "<div hidden>a</div><p style='DISPLAY : none'>b</p><template>c</template><noscript>d</noscript>e": "e",
    "<details><summary>s</summary>closed</details><details open><summary>t</summary>seen</details>": "s\nt\nseen",
    "<head><title>t</title><p>body starts": "body starts",
    "<!-- c --><!DOCTYPE html><html><body><?php x ?>a</b></i>b</div></body>c": "abc",
    "<dl><dt>k<dd>v<dt>k2<dd>v2</dl>": "k\n  v\nk2\n  v2",
    "<blockquote>q<blockquote>r</blockquote></blockquote>z": "  q\n\n    r\n\nz",
    "<select><option>a<option>b</select>": "a\nb",
    "<a href=\"x>y\">link</a> <b title='<p>'>t</b>": "link t",
    "1 < 2 and 3 > 2 <3": "1 < 2 and 3 > 2 <3",
    "": "",
    "<": "<",
    "<p": "",
    "<textarea> a <b> </textarea>": " a <b>",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert rendered(page) == CASES[page]


class Plain(html.parser.HTMLParser):
    """All text outside the elements that are never shown."""

    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_no_visible_word_is_lost():
    for (page,) in duckdb.sql(f"SELECT html FROM '{DATA}/pages.parquet'").fetchall():
        plain = Plain()
        plain.feed(page)
        want = re.findall(r"[^\W\d_]+", " ".join(plain.words))
        assert re.findall(r"[^\W\d_]+", rendered(page)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> <ul> <li> </ul> <table> <tr> <td> </td> </table> <b> </b> <pre> <br> word <!-- --> < > & &amp; <script> </script> <a href='".split()), max_size=30))
def test_never_fails(parts):
    rendered("".join(parts))


def test_depth_and_length():
    deep = "<div>" * 5_000 + "core" + "</div>" * 5_000 + "<ul><li>" * 2_000 + "x"
    assert "core" in rendered(deep) and "x" in rendered(deep) and MAX_DEPTH < 1_000
    assert rendered("<p>word " * 20_000).count("word") == 20_000


def test_query(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (3, ""), (None, "<ul><li>x")]
    df = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "'u' AS url", "'t' AS text").repartition(2)
    got = sorted(((r["page_id"], r["text"], r["n_chars"], r["n_lines"]) for r in rows_of(extract(df))), key=str)
    assert got == sorted([(1, "a", 1, 1)] * 2 + [(2, None, None, None), (3, "", 0, 0), (None, "- x", 3, 1)], key=str)
    assert extract(df.limit(0)).count() == 0
