"""Splitting of packed cells."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.operators.packed_values import Segmenter, known_values, split_packed

KNOWN = ["Other aim; see narrative", "Threats, violence or other pressure", "Misuse of authority/weak position", "Swindle"]
SEG = Segmenter(KNOWN)


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        (None, []), ("", []), ("  　", []), ("[]", []), ("[ ]", []), (";;|", []), ('""', []), ('["",""]', []),
        ("Swindle", ["Swindle"]),
        ("Swindle;Swindle", ["Swindle", "Swindle"]),
        ("Other aim; see narrative;Swindle ;", ["Other aim; see narrative", "Swindle"]),
        ("Threats, violence or other pressure, Swindle", ["Threats, violence or other pressure", "Swindle"]),
        ("OTHER AIM; SEE NARRATIVE, x", ["OTHER AIM; SEE NARRATIVE", "x"]),
        ('["a","b, c"]', ["a", "b, c"]), ("['a', 'b']", ["a", "b"]), ("[a, b]", ["a", "b"]),
        ("[‘a\" , “b”,\n\"c\"]", ["a", "b", "c"]),
        ('"Called ""x"" there"; y', ['Called "x" there', "y"]), ('["Called \\"x\\" there", "y"]', ['Called "x" there', "y"]),
        ("\"Driver's share\"|Swindle", ["Driver's share", "Swindle"]),
        ("a / b", ["a", "b"]), ("a/b", ["a/b"]), ("a\tb\r\nc", ["a", "b", "c"]), ("a、b，c；d • e", ["a", "b", "c", "d", "e"]),
        ("Misuse of authority/weak position / Swindle", ["Misuse of authority/weak position", "Swindle"]),
        ('"unclosed', ["unclosed"]), ("closed”", ["closed"]), ('["O​ther aim; see narrａtive"]', ["O​ther aim; see narrａtive"]),
        ("O​ther aim; see narrａtive|x", ["O​ther aim; see narrａtive", "x"]),
    ],
)
def test_cells(cell, values):
    assert SEG.split(cell) == values


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(KNOWN), st.text(alphabet="ab ,;|/\\•", min_size=1, max_size=8).map(str.strip).filter(bool)), max_size=6))
def test_json_round_trip(values):
    import json

    assert SEG.split(json.dumps(values)) == values


@pytest.mark.parametrize("cell", ['["Swindle”,  “Other aim; see narrative"\n]', '["Swindle", ‘Other aim; see narrative"]', "[“Swindle' , 'Other aim; see narrative”]"])
def test_quotes_count_alike(cell):
    """Even where a strict reader would take the cell for one long text."""
    assert SEG.split(cell) == ["Swindle", "Other aim; see narrative"]


def test_long_cell():
    assert len(SEG.split(";".join(["Swindle"] * 20_000))) == 20_000


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "a;b", "x"), (1, "a;b", "x"), (2, None, None), (3, "", "x"), (4, '"b,c",d', "x")], "id long, cell string, item_pos string"
    )
    got = sorted(tuple(r) for r in split_packed(df, ["id"], "cell", ["b,c"]).collect())
    assert got == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (4, 1, "b,c"), (4, 2, "d")]
    assert split_packed(df.limit(0), ["id"], "cell").collect() == []
    odd = df.withColumnRenamed("cell", "a.b`c")
    assert split_packed(odd, ["id"], "a.b`c").count() == 6


def test_known_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "raw_label string")
    assert known_values(df) == ["a", "b"]
    with pytest.raises(ValueError, match="at most"):
        known_values(df, limit_hint=1)
