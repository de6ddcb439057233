"""Lookalikes (problem 2), pages (problem 3) and wrong decodings (problem 9)."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import lookalikes as L
from caseloom.llm import main_text as P
from caseloom.llm import mojibake as M

REWRITE = L.Rewriter(L.representatives({}))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Velmora", "Ｖеl​mоrа"), ("a b", "a b"), ("a b", "a　b"), ("é", "é"), ("é", "é"), ("ế", "ế"), ("ё", "ë"), ("g", "ɡ"), ("e​́", "é"), ("ＡＢＣ１", "ABC1"), ("Co‍op­", "Coop"), ("", "​﻿"), ("op", "օр"),
    ],
)
def test_same(a, b):
    assert REWRITE(a) == REWRITE(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a-b", "a–b"), ('"', "“"), ("Œ", "OE"), ("ﬁ", "fi"), ("m²", "m2"), ("a", "b"), ("", " "), ("l", "I"), ("ș", "ş")])
def test_different(a, b):
    assert REWRITE(a) != REWRITE(b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aаοｏé́​  ー가\t§x"), max_size=30))
def test_rewriting_is_stable(x):
    assert REWRITE(REWRITE(x)) == REWRITE(x)


def test_union_find_is_transitive():
    uf = L.UnionFind()
    for a, b in (("x", "y"), ("p", "q"), ("y", "p")):
        uf.union(a, b)
    assert len({uf.find(k) for k in "xypq"}) == 1
    of = {m: root for root, members in L.classes().items() for m in members}
    assert of["a"] == of["а"] == of["ａ"] and of["a"] != of["A"]


def test_representatives_follow_the_corpus():
    to = L.representatives({"а": 10, "a": 3})
    assert to["a"] == "а" and "а" not in to
    assert L.representatives({})["а"] == "a"


def test_normalized_rows(spark):
    rows = [(1, "Ａb", "Ab"), (2, None, "x"), (3, "", ""), (4, "x" * 200_000 + "е", "x" * 200_000 + "e"), (1, "Ａb", "Ab"), (5, "  ", "  ")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, raw string, norm string, raw_form string")
    got = sorted(((r.id, r.raw_form == r.norm_form if r.raw_form is not None else None) for r in L.normalize_columns(df, "id", ["raw", "norm"]).collect()), key=lambda r: r[0])
    assert got == [(1, True), (1, True), (2, None), (3, True), (4, True), (5, True)]
    assert L.normalize_columns(df.limit(0), "id", ["raw"]).count() == 0


def test_p2_brute_force(spark, tiny):
    import unicodedata

    import pyarrow.parquet as pq

    from caseloom.functions.charforms import fold

    want = set()
    for r in pq.read_table(f"{tiny}/human_annotation_qc_report.parquet").to_pylist():
        a, b = r["raw_value"], r["normalized_value"]
        if a is not None and b is not None and a != b and fold(a).replace("\n", "\0") == fold(b).replace("\n", "\0"):
            want.add(r["qc_id"])
    assert {r.qc_id for r in L.p2_found(spark, tiny).collect()} == want
    assert unicodedata.normalize("NFC", "é") == "é"


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Case A{0} &amp; B | Site</title></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/s">Search</a></ul></nav>
<div class="zz"><p>We use cookies.</p><button>OK</button></div>
<div class="q1"><h1>Case A{0} &amp; B</h1><dl><dt>Court<dd>Supreme Court<dt>No<dd>7{0}</dl>
<h3>Facts</h3><p>The first defendant&nbsp;was <b>fined</b> after<br>a long trial in the city court {0}.</p>
<p>The second paragraph is about the appeal that was dismissed in the same year {0}.
<div class="z9"><p>Newsletter</p><p>Once a month.</p></div>
<h3>Charges</h3><ul><li>section {0}: fined, 2<li>section 2: acquitted</ol>
<blockquote>The court said that the law was clear and applied to all the accused.</blockquote>
<ul class=c7><li>Share this page</li><li>Print</li></ul>
{1}</div>
<div class="q2">{2}</div>
<footer><p>Copyright</p></footer><p style="display:none">hidden</p></body></html>"""
BOX = """<div class="k4"><h3>Related cases</h3><h4>Other v. State {0}</h4><p>Another text about another case that is not this one at all, number {0}.</p></div>"""


def page_of(i: int) -> str:
    """A page of case i; every second one has the box of other cases within its main part, the others beside it."""
    box = BOX.format(i * 31)
    return PAGE.format(i, box if i % 2 else "", "" if i % 2 else box)


def own_of(i: int) -> list[str]:
    return [
        f"Case A{i} & B", "Court", "Supreme Court", "No", f"7{i}", "Facts", f"The first defendant was fined after a long trial in the city court {i}.", f"The second paragraph is about the appeal that was dismissed in the same year {i}.",
        "Charges", f"section {i}: fined, 2", "section 2: acquitted", "The court said that the law was clear and applied to all the accused.",
    ]


def test_page():
    g = P.Page(page_of(2).encode())
    assert g.heading == "Case A2 & B" and [t for t, boxes in g.own if not boxes or g.boxes[boxes[-1]][0] not in ("Newsletter", "Share this page")] == own_of(2)
    assert "hidden" not in g.site and {"Home", "Related cases", "Copyright"} <= set(g.site)
    assert ["Newsletter", "Once a month."] in g.boxes and ["Share this page", "Print"] in g.boxes


@pytest.mark.parametrize("body", [b"", b"%PDF-1.4 ...", b"<html><head><title>Site</title></head><body><h1>Page not found</h1></body></html>", b"\xff\xfe<<<>>", b"<" * 5000])
def test_pages_without_case(body):
    g = P.Page(body)
    assert g.heading is None and g.own == []


def test_page_encodings():
    page = page_of(2).replace("utf-8", "windows-1252").replace("city court", "città €")
    assert any("città €" in x for x, _ in P.Page(page.encode("cp1252")).own)


def test_density_prefers_text():
    root, _ = P.parse("<body><div id=a><a href=x>aaaa</a><a href=y>bbbb</a></div><div id=b><p>" + "word " * 50 + "</p></div></body>")
    P.measure(root)
    a, b = (k for k in root.kids[0].kids if not isinstance(k, str))
    assert b.d > a.d > 0 and b.sum > 0


def test_main_blocks(spark):
    """Boxes, lists and texts of the site go by what all pages together show; class names are made by a machine. Repeats of a page are equal."""
    import hashlib

    ids = [*range(2, 24), 2]
    df = spark.createDataFrame([(n, bytearray(page_of(i).encode())) for n, i in enumerate(ids)] + [(98, None), (99, bytearray(b""))], "page_id long, body binary")
    got = {(r["__page"], bytes(r["__md5"])) for r in P.main_blocks(df, "page_id", "body").collect()}
    assert got == {(n, hashlib.md5(t.encode()).digest()) for n, i in enumerate(ids) for t in own_of(i)}
    assert P.main_blocks(df.limit(0), "page_id", "body").count() == 0
    few = {bytes(r["__md5"]) for r in P.main_blocks(df.where("page_id = 0"), "page_id", "body").collect()}
    assert {hashlib.md5(t.encode()).digest() for t in [*own_of(2), "Newsletter"]} <= few


CLEAN = [
    "Le prévenu a été condamné à 3 années d’emprisonnement.", "Größere Beträge flossen über ein Konto in Äldria.", "Не было доказательств того, что договор был подписан добровольно.",
    "法院认为，受害人没有真正的选择，同意无效。", "Instanța a reținut că martorii au arătat că ușa era încuiată.", "No ÂMBITO do recurso, a DECISÃO: condenação; RESTITUIÇÃO.", "Câmara, ÂNCORA, IRMÃ, MAÇÃ", "El niño llegó a Nueva Alba. ¿Podían marcharse?", "The panel said: “no error” – § 232a, £ 30.",
]


@pytest.fixture(scope="module")
def repairer():
    n = np.zeros(M.CELLS, dtype=np.int64)
    cells, counted = M._pairs(M._points(" " + "\n".join(CLEAN * 300) + " "))
    n += np.bincount(cells[counted], minlength=M.CELLS)
    at = np.flatnonzero(n)
    return M.Repairer(M.Costs(at, n[at]))


def test_clean_stays(repairer):
    for x in CLEAN:
        assert repairer(x) == (x, [])


def misread(text, name):
    return "".join(M._one_byte(name)[1][b] for b in text.encode())


@pytest.mark.parametrize("name", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"])
def test_utf8_misread(repairer, name):
    for x in CLEAN[:5]:
        assert repairer(misread(x, name))[0] == x


def test_nested_and_partial(repairer):
    x = CLEAN[0]
    assert repairer(misread(misread(x, "cp1252"), "cp1252"))[0] == x
    mixed = CLEAN[1] + "\r\n" + misread(x, "cp1252")
    assert repairer(mixed)[0] == CLEAN[1] + "\r\n" + x


@pytest.mark.parametrize(("i", "written", "read"), [(2, "cp1251", "cp1252"), (2, "koi8-r", "cp1251"), (3, "gb18030", "latin-1"), (4, "iso8859-16", "cp1252")])
def test_legacy_misread(repairer, i, written, read):
    bad = "".join(M._one_byte(read)[1][b] for b in CLEAN[i].encode(written))
    assert repairer(bad)[0] == CLEAN[i]


@pytest.mark.parametrize(("i", "written", "read"), [(2, "cp1251", "cp1252"), (2, "cp1251", "mac_roman"), (2, "cp1251", "cp437"), (2, "koi8-r", "cp1252")])
def test_one_stretch_misread(repairer, i, written, read):
    """A correct line, in Cyrillic or Chinese, that holds one stretch decoded wrongly."""
    x = "договор был подписан добровольно"
    bad = "".join(M._one_byte(read)[1][b] for b in x.encode(written))
    for good in (CLEAN[2], CLEAN[2] + " " + CLEAN[2] + " " + CLEAN[2], CLEAN[3]):
        assert repairer(good + " " + bad + " " + good)[0] == good + " " + x + " " + good
        assert repairer(good + " " + good) == (good + " " + good, [])


def test_sentence_in_the_same_letters(repairer):
    """A sentence whose wrong form is written in the letters of the right lines around it."""
    x = "Договор был подписан добровольно, однако суд это отклонил."
    bad = "".join(M._one_byte("cp1251")[1][b] for b in x.encode("koi8-r"))
    for good in (CLEAN[2], CLEAN[2] + " " + CLEAN[2]):
        assert repairer(f"{good} {bad} {good}")[0] == f"{good} {x} {good}"


def test_references(repairer):
    """Characters that were read wrongly before they were written as character references."""
    x = "Según la investigación, los pagos se hacían"
    named = {ord(k): f"&{v};" for k, v in (("Ã", "Atilde"), ("º", "ordm"), ("³", "sup3"), ("\xad", "#173"))}
    bad = misread(x, "cp1252").translate(named)
    assert bad.isascii() and repairer(bad) == (x, ["utf-8 read as cp1252"])
    for right in ("".join(f"&#{ord(ch)};" if ch > "\x7f" else ch for ch in CLEAN[0]), "a &lt; b &bogus; &#60; & c;"):
        assert repairer(right) == (right, [])
    assert repairer(bad + "\nx &eacute; &amp; x")[0] == x + "\nx &eacute; &amp; x"


def test_many_layers(repairer):
    x = bad = CLEAN[0]
    for _ in range(8):
        bad = misread(bad, "cp1252")
    assert repairer(bad) == (x, ["utf-8 read as cp1252"] * 8)


def test_repair_rows(spark):
    rows = [(i, x) for i, x in enumerate(CLEAN * 40)] + [(1000, misread(CLEAN[0], "cp1252")), (1001, None), (1002, ""), (1003, "  "), (1004, "S�rk�ny"), (1005, "a" * 300_000 + misread("é", "cp1252")), (1006, "\x80"), (1007, "L&acirc;&euro;&trade;inspection, relev&Atilde;&copy;e")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, repaired string")
    got = {r.doc_id: r for r in M.repair(df, "doc_id", "text").collect()}
    assert {i for i, r in got.items() if r.is_garbled} == {1000, 1004, 1005, 1006, 1007}
    assert got[1000].repaired == CLEAN[0] and got[1000].is_whole and not got[1004].is_whole
    assert got[1001].repaired is None and got[1002].repaired == "" and len(got) == len(rows)
    assert M.repair(df.limit(0), "doc_id", "text").count() == 0
