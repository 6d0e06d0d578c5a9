"""Semantics of the language on seven rows of text, one behaviour at a time."""

import pytest

from sylvan.engine import Engine
from sylvan.lang.parser import QuerySyntaxError, parse
from sylvan.lang.printer import show
from sylvan.operators.patterns import QuantifierBoundError
from sylvan.sources import files

#: Gauges on rivers: two without a flow, one river without a name.
DOC = '''gauge,river,metres,flow
G1,Isen,412,7.5
G2,Isen,388,
G3,Lor,97,31
G4,,1204,0.25
G5,Lor,"88",40
G6,"Ola ""upper""",530,3
G7,Lor,91,
'''
CASES = [
    ("/row[-2]::gauge", ["G6"]),
    ("/row[::metres < 100]::gauge", ["G3", "G5", "G7"]),
    ("/row[::flow = 3]::gauge", ["G6"]),
    ("/row[not ::flow]::gauge", ["G2", "G7"]),
    ("/row::flow @| sum", [81.75]),
    ("/row::flow @| mean | round(2)", [16.35]),
    ("/row::flow @| median", [7.5]),
    ("/row[2] | ::flow + 1", [None]),
    ("/row @| min_by(::flow) | ::gauge", ["G4"]),
    ("/row @| sort_by(::metres) @| [..3] | ::gauge", ["G5", "G7", "G3"]),
    ("/row @| group(::river) | count | rec($.river, 'n', $_)", [{"river": "Isen", "n": 2}, {"river": "Lor", "n": 3}, {"river": 'Ola "upper"', "n": 1}]),
    ("/row::gauge @| group(::river) | bottom(1, ::metres) @| ungroup", ["G2", "G5", "G6"]),
    ("/row | ::metres @| window(-1..1) | max", ["412", "412", "1204", "1204", "1204", "530", "530"]),
    ("/row @| window(0..2) | count", [3, 3, 3, 3, 3, 2, 1]),
    ("/row | ::metres @| shift(-1, ::river)", ["388", None, "88", None, "91", None, None]),
    ("/row | [$ord mod 3 = 0] | ::gauge", ["G3", "G6"]),
    ('/row[5..6] | "${::gauge}@${::metres}"', ["G5@88", "G6@530"]),
    ("/row @| group(::river) | .wet(^/row[::river = $$.river][::flow > 5] @| count) | %.", [{"river": "Isen", "wet": 1}, {"river": "Lor", "wet": 2}, {"river": 'Ola "upper"', "wet": 0}]),
    ("/row <=>? /row[::river = $$::river and ::metres < $$::metres] | [$*1::gauge != null] | rec(::gauge, 'below', $*1::gauge)", [{"gauge": "G1", "below": "G2"}, {"gauge": "G3", "below": "G5"}, {"gauge": "G7", "below": "G5"}]),
    ("def &above($m): /row[::metres > $m]; &above(500) | ::gauge", ["G4", "G6"]),
    ("/row[::river =~ /^Ola/] | ::river", ['Ola "upper"']),
    ("= 10 - 4 * 2", [2]),
    ("= -9 idiv 4", [-2]),
    ("= 5 mod 0", [None]),
    ("= 3km + 50m | convert(m)", ["3050m"]),
    ("= '2h30min' | duration", ["PT2H30M"]),
    ("= 2023-03-01 - 2023-02-26", ["P3D"]),
    ("= '2021-01-03T00:00:00Z' | datetime | isoweek", ["2020-W53"]),
    ("/row[3]::river | base32 | decode(base32)", ["Lor"]),
    ("/row[6]::gauge | s/G(.)/$1G/", ["6G"]),
    ("/row[..3] | (::river ?= 'Lor' ? 'low' : 'high')", ["high", "high", "low"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return Engine(spark, files.delimited_text(spark, DOC))


@pytest.mark.parametrize("text,want", [c for c in CASES if c[1] is not None])
def test_rows(rows, text, want):
    assert rows.values(text) == want


def test_a_macro_with_an_odd_name_is_an_error(rows):
    with pytest.raises(QuerySyntaxError):
        rows.values("&unheard | ::gauge")


@pytest.mark.parametrize("text", ["/row | ::flow | window(0..1)", "/row @| window(3..-3)", "/row @| shift('a')", "/row | rec('k', 1, 'k', 2)", "//[", "[" * 300, "/row @|", "= 1 +", "/row{"])
def test_bad_queries_are_refused(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["//a<b||!c&&d>[::x > 1 and not /y]", "/a/*[2] | rec(::x, 'y', ::z * (2 + 1)) @| sort_by($.y)", "/a(->b)+[::k = 1]? | .n(::x) @| group(::x) | count", "/a <=>? /b[::k = $$::k] | [$*1::k = null]", "/r[..2] | \"${::a} is $_\"", "/r | (::a ? 1 : 2) | ... | upper @| join(', ')"])
def test_printing_is_a_fixpoint(text):
    once = show(parse(text))
    assert parse(once) == parse(text) and show(parse(once)) == once


def test_json_arbor(spark):
    e = Engine(spark, files.arbor_of(spark, "json", '{"shop": {"books": [{"title": "A", "price": 5}, {"title": "B", "price": 12, "tags": ["x", "y"]}]}}'))
    assert e.values("//books/*[::price > 10]::title") == ["B"]
    assert e.values("//title::") == ["A", "B"]
    assert e.values("//books/*[/tags]::title") == ["B"]
    assert e.values("//tags/* | ::") == ["x", "y"]
    assert e.values("//tags\\\\* | :::depth") == [3, 2, 1, 0]
    assert e.values("//books/1") == ["/shop/books/1"]


def test_xml_links_and_patterns(spark):
    e = Engine(spark, files.arbor_of(spark, "xml", "<g><n id='a'><to idref='b'/></n><n id='b'><to idref='c'/></n><n id='c'/></g>"))
    assert e.values("//n[::id = 'a']/to->idref::id") == ["b"]
    assert e.values("//n[::id = 'a'](/to->idref)+::id") == ["b", "c"]
    assert e.values("//n[::id = 'a'](/to->idref){2}::id") == ["c"]
    with pytest.raises(QuantifierBoundError):
        e.values("//n(/to->idref){40}")


def test_cycles_end_because_paths_are_simple(spark):
    e = Engine(spark, files.arbor_of(spark, "xml", "<g><n id='a'><to idref='b'/></n><n id='b'><to idref='a'/></n></g>"))
    assert sorted(e.values("//n[::id = 'a'](/to->idref)+::id")) == ["b"]


def test_reflection(spark):
    e = Engine(spark, files.delimited_text(spark, DOC)).reflect("/row[::flow > 3] | ::gauge")
    assert e.values("//axis::") == ["child"]
