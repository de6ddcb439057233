"""Text, URL and character functions."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions import urls as U
from caseloom.functions.charforms import fold, fold_map
from caseloom.functions.html_tree import blocks, decode, parse
from caseloom.functions.language import language_code


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "y"), [(" \t x ", "x"), ("", ""), (None, None), ("　", "")])
def test_strip(spark, x, y):
    assert one(spark, x, T.strip) == y


@pytest.mark.parametrize(("x", "n"), [("it’s a well-known fact_1", 4), ("Ærø Žižek", 2), ("", 0), ("—", 0), ("a b", 2)])
def test_words(spark, x, n):
    assert one(spark, x, T.word_count) == n


@pytest.mark.parametrize(
    ("x", "y"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("State v. Smith went on. He won.", ["State v. Smith went on.", "He won."]), ("It cost 3.5 francs. Then more.", ["It cost 3.5 francs.", "Then more."]),
        ("A first line\n\nsecond part", ["A first line", "second part"]), ("Items:\n- one\n- two", ["Items:", "- one", "- two"]), ("He said “Yes.” Then left.", ["He said “Yes.”", "Then left."]),
        # "no." abbreviates "number", in quotes and capitals too.
        ("He said “No.” Then left.", ["He said “No.” Then left."]), ("Prof. Smith of the U.S. Court spoke. mr. J. Jones, Jr. Left? Yes.", ["Prof. Smith of the U.S. Court spoke. mr. J. Jones, Jr. Left?", "Yes."]),
        ("Intro\n\t(a) One\n12. Two\nand 2 b", ["Intro", "(a) One", "12.", "Two and 2 b"]), ("See sec. 3. Then v. \"B.\" Or!) Now", ["See sec. 3.", "Then v. \"B.\" Or!)", "Now"]), ("", []), ("  ", []),
    ],
)
def test_sentences(spark, x, y):
    assert one(spark, x, T.sentences) == y


def test_long_text(spark):
    assert len(one(spark, "Word here. " * 30_000, T.sentences)) == 30_000


def test_block_and_excerpt(spark):
    assert one(spark, " a \t b\r\n\r\n\r\n c ", T.block) == "a b\n\nc"
    assert one(spark, "\n \n", T.block) is None
    assert one(spark, "aa bb cc", lambda x: T.excerpt(x, 6)) == "aa bb…"
    assert one(spark, "aabbcc", lambda x: T.excerpt(x, 4)) == "aabb…"


def test_list_cell(spark):
    assert one(spark, '["a", "b"]', T.list_cell) == ["a", "b"]
    assert one(spark, "a ; b;", T.list_cell) == ["a", "b"]
    assert one(spark, "[oops", T.list_cell) == ["[oops"]
    assert one(spark, None, T.list_cell) is None


def test_bool_of(spark):
    f = lambda x: T.bool_of(x, ("TRUE", "1"), ("FALSE", "0"))
    assert [one(spark, x, f) for x in ("true ", "0", "", None)] == [True, False, None, None]
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, "maybe", f)


def test_retry_after(spark):
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    f = lambda x: T.retry_after(x, now)
    assert [one(spark, x, f) for x in ("5", "Tue, 14 Nov 2023 22:13:50 GMT", "Tue, 14 Nov 2022 22:13:50 GMT", "soon", None)] == [5.0, 30.0, 0.0, None, None]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("https://Host.example:443/A%c3%BA/", "http://host.example/A%C3%BA?x=1#y"), ("https://h.example/a%28b%29", "//h.example/a(b)"), ("https://h.example", "h.example/"), ("http://h.example:80/x", "https://h.example/x/"),
    ],
)
def test_same_page(spark, a, b):
    assert one(spark, a, U.same_page_key) == one(spark, b, U.same_page_key) is not None


def test_other_pages(spark):
    keys = [one(spark, x, U.same_page_key) for x in ("https://h.example/a", "https://h.example/A", "https://h.example:8080/a", "https://g.example/a", "https://h.example/a%zz", "https://h.example/a+b", "https://h.example/a b")]
    assert len(set(keys)) == len(keys)
    assert [one(spark, x, U.same_page_key) for x in (None, "", "  ")] == [None] * 3


def test_escapes(spark):
    assert one(spark, "/a%7eb%2f%zz%", U.normal_escapes) == "/a~b%2F%25zz%25"
    assert one(spark, None, U.normal_escapes) is None


def test_language(spark):
    assert [one(spark, x, language_code) for x in ("EN", "en-GB", "fr-FR", None, "", "und")] == ["en", "en", "fr", "und", "und", "und"]


def test_fold():
    assert fold("Ｖelmοrа​ X") == "Velmora X"
    assert fold("é") == fold("é") != "e"
    assert fold("ё") == "ë"
    assert fold("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_fold_is_stable(x):
    assert fold(fold(x)) == fold(x)
    low, at = fold_map(x)
    assert len(low) == len(at) and all(0 <= i < len(x) for i in at)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<b>b</b><br>c<p>d", ["ab c", "d"]), ("<ul><li>a<li>b</ol><p>c", ["a", "b", "c"]), ("<dl><dt>a<dd>b<dt>c</dl>d", ["a", "b", "c", "d"]), ("<p>x&nbsp;&amp; y</p><script><p>no</p></script>", ["x & y"]),
        ("<div style='display: none'>no</div><p>yes", ["yes"]), ("a < b <!-- <p>no</p> --> c", ["a < b c"]), ("", []), ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
    ],
)
def test_html_blocks(html, want):
    assert [t for t, _ in blocks(parse(html)[0])] == want


def test_deep_html():
    assert [t for t, _ in blocks(parse("<div>" * 50_000 + "x")[0])] == ["x"]


def test_decode():
    assert decode('<meta charset="iso-8859-1">\x80é'.encode("cp1252", "replace").replace(b"?", b"\x80")).endswith("é")
    assert decode("é".encode()) == "é" and decode(b"\xe9") == "é"
