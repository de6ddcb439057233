"""Extraction of nested records from pages."""

from __future__ import annotations

import pytest

from caseloom.functions.html_tree import parse
from caseloom.plans import pages as P
from caseloom.plans import texts

PAGE = """<html lang="fr"><head><title>A &amp; B</title><meta property="og:url" content="https://h.example/x"><script>var pageLocale = 'en';</script></head><body>
<h2>A &amp; B</h2><dl><dt>Court<dd>Supreme <b>Court</b><dt>No<dd>7</dl>
<h3>Summary</h3><ul class="nav-tabs"><li>English<li>Other<li><a href="#x-ru">?</a></ul>
<div class="tab-content"><div class="tab-pane" id="t"><p>One.</p></div><div class="tab-pane" id="t"><p>Two.</p></div><div class="tab-pane" id="v"><p>Three.</p></div></div>
<h3>Charges</h3><ul><li>section 1: fined, 2</ul><p>It was said of Ana Ólafsdóttir (31 years) and Bo Ek (7 years) that.</p><ul><li>section 2: acquitted, 3<li>no charge</ul>
<aside><h3>Related</h3><p>x</p><p>y</p><h3>Latest</h3><ul><li>z</ul></aside><style>p{}</style><template><p>hidden</p></template></body></html>"""


def test_record():
    r = P.extract(5, PAGE.encode())
    assert (r["page_id"], r["title"], r["locale"]) == (5, "A & B", "en") and r["status"] == "PARTIAL" and r["warnings"] == ["REPEATED_PANE_ID", "SEVERAL_ENGLISH_PANES"]
    assert [(f["label"], f["value"]) for f in r["fields"]] == [("Court", "Supreme Court"), ("No", "7")]
    assert [(x["ordinal"], x["pane_id"], x["tab_label"], x["language"], x["method"], x["text"]) for x in r["panes"]] == [
        (1, "t", "English", "en", "tab_label", "One."), (2, "t", "Other", "en", "page", "Two."), (3, "v", "?", "ru", "href", "Three."),
    ]
    assert [(x["section"], x["owner"], x["provision"], x["outcome"], x["n"]) for x in r["charges"]] == [("Charges", None, "section 1", "fined", 2), ("Charges", "Bo Ek", "section 2", "acquitted", 3)]
    assert [(x["name"], x["age"]) for x in r["persons"]] == [("Ana Ólafsdóttir", 31), ("Bo Ek", 7)]
    assert [(x["kind"], x["values"]) for x in r["badges"]] == [("Related", ["x", "y"]), ("Latest", ["z"])]
    assert "hidden" not in r["text"] and r["text"].startswith("A & B\nCourt") and r["metas"] == [{"name": "og:url", "content": "https://h.example/x"}]


def test_only_what_is_asked_for():
    r = P.extract(5, PAGE.encode(), {"title"})
    assert r["title"] == "A & B" and not any(r[k] for k in ("fields", "panes", "charges", "sections", "metas", "badges"))


def test_panes_without_tabs():
    r = P.extract(1, b"<body><h2>T</h2><ul class=nav-tabs><li>English</ul><div class=tab-content><div class=tab-pane>a</div><div class=tab-pane id=q>b</div></div>")
    assert r["warnings"] == ["PANE_COUNT_MISMATCH", "UNKNOWN_PANE_LANGUAGE"] and [x["tab_label"] for x in r["panes"]] == ["English", None]


@pytest.mark.parametrize(("body", "status"), [(None, "EMPTY"), (b"", "EMPTY"), (b"%PDF-1.4", "PARTIAL"), (b"<" * 3000, "PARTIAL"), (b"<h2>x" + b"<div>" * 20_000, "FOUND")])
def test_odd_pages(body, status):
    assert P.extract(1, body)["status"] == status


def test_unreadable_page_keeps_its_row(monkeypatch):
    monkeypatch.setattr(P, "blocks", lambda root: 1 / 0)
    r = P.extract(9, b"<p>x")
    assert r["page_id"] == 9 and r["status"] == "PARSE_ERROR" and "ZeroDivisionError" in r["warnings"][0]


def test_owners():
    root, _ = parse("<body><ul id=a><li>1<ul id=b><li>2<li>3</ul><li>4</ul></body>")
    outer, inner = P.descendants(root, {"ul"})
    assert [sum(1 for _ in P.owned(x, {"li"}, {"ul"})) for x in (outer, inner)] == [2, 2] and sum(1 for _ in P.descendants(outer, {"li"})) == 4
    assert P.closest(inner, {"li"}).tag == "li" and P.closest(outer, {"table"}) is None


def test_pages_in_spark(spark):
    df = spark.createDataFrame([(1, bytearray(PAGE.encode()), "x"), (2, None, None)], "page_id long, body binary, title string")
    got = {r.page_id: r for r in P.parsed_pages(df, ("title", "panes", "text")).collect()}
    assert got[1].title == "A & B" and len(got[1].panes) == 3 and got[2].title is None and got[2].panes == []
    assert P.parsed_pages(df.limit(0), ("title",)).count() == 0


def test_title_forms(spark, tmp_path):
    spark.createDataFrame([(1, " Ａ&amp;B\u00a0 x\n"), (2, None), (3, "ﬁn №5"), (4, "")], "page_id long, document_title string").write.parquet(str(tmp_path / "page_validation.parquet"))
    assert {r.page_id: r.title for r in texts.f07_nfkc_titles(spark, str(tmp_path)).collect()} == {1: "A&B x", 2: None, 3: "fin No5", 4: ""}
