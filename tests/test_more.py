"""Sources, models, importers, streams and rendering."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from sylvan.engine import Engine, mount, save
from sylvan.lang import importers
from sylvan.plans.state import CompileError
from sylvan.sources import connectors, derived, files
from sylvan.streaming import stream


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "h.db")
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE docks (no INTEGER PRIMARY KEY, side TEXT, depth REAL);
        CREATE TABLE boats (reg INTEGER PRIMARY KEY, kind TEXT, dock INTEGER REFERENCES docks(no), tons INTEGER);
        INSERT INTO docks VALUES (10, 'north', 4.5), (20, 'south', 7), (30, 'south', NULL);
        INSERT INTO boats VALUES (5, 'tug', 20, 61), (6, 'barge', 20, 800), (7, 'ferry', 10, 350), (8, 'tug', NULL, 58), (9, 'skiff', 10, 2);"""
    )
    con.close()
    return Engine(spark, connectors.sqlite(spark, path))


SQL = [
    "SELECT kind, tons FROM boats WHERE tons > 100 ORDER BY kind",
    "SELECT count(*) FROM docks",
    "SELECT dock, count(*) AS n FROM boats WHERE dock IS NOT NULL GROUP BY dock HAVING count(*) > 1",
    "SELECT boats.kind, docks.side AS at FROM boats JOIN docks ON docks.no = boats.dock WHERE tons < 400",
    "SELECT DISTINCT side FROM docks",
    "SELECT kind FROM boats WHERE kind LIKE 't%' OR reg IN (6, 9) ORDER BY tons DESC LIMIT 3",
    "SELECT max(depth) FROM docks",
]


@pytest.mark.parametrize("text", SQL)
def test_imported_sql_gives_the_rows_of_spark_sql(spark, harbour, text):
    want = importers.passthrough(spark, harbour.source, text).collect()
    got = harbour.query(importers.sql(text)).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


@pytest.mark.parametrize("text", ["SELECT a FROM b UNION SELECT c FROM d", "DELETE FROM docks", "SELECT a FROM b LEFT JOIN c ON a = d"])
def test_other_sql_is_refused(text):
    with pytest.raises(importers.TranslationError):
        importers.sql(text)


def test_keys_links_and_reverse_links(harbour):
    assert harbour.values("/boats/7::dock-->::side") == ["north"]
    assert harbour.values("/boats/8::dock-->::side @| count") == [0]
    assert harbour.values("/docks/20<-dock::kind") == ["tug", "barge"]
    assert harbour.values("/boats/9->dock") == ["/docks/10"]
    assert harbour.values("/*") == ["/boats", "/docks"]
    assert harbour.values("/docks/* | rec(::no, 'load', (<-dock::tons @| sum))") == [{"no": 10, "load": 352}, {"no": 20, "load": 861}, {"no": 30, "load": None}]
    assert harbour.values("/docks/10/* | :::name") == ["no", "side", "depth"]
    with pytest.raises(CompileError):
        harbour.values("/cranes/*")


def test_xpath_and_jq(spark):
    xml = Engine(spark, files.arbor_of(spark, "xml", "<a><b k='1'><c>x</c></b><b k='2'><c>y</c></b></a>"))
    assert xml.values(importers.xpath("/a/b[@k='2']/c") + "::") == ["y"]
    assert xml.values(importers.xpath("count(//c)")) == [2]
    assert xml.values(importers.xpath("/a/b[last()]/@k")) == ["2"]
    doc = Engine(spark, files.arbor_of(spark, "json", '{"i": [{"n": 1, "t": "p"}, {"n": 5, "t": "q"}]}'))
    assert doc.values(importers.jq(".i[] | select(.n > 2) | .t") + "::") == ["q"]
    assert doc.values(importers.jq(".i | length")) == [2]
    with pytest.raises(importers.TranslationError):
        importers.jq("reduce .[] as $x (0; . + $x)")


def test_trees_of_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
        z.writestr("y.txt", "bye")
    e = Engine(spark, connectors.open_source(spark, str(tmp_path / "a.zip")))
    assert e.values("//x.txt::") == ["hello"]
    (tmp_path / "t.md").write_text("# One\n\npara\n\n- a\n- b\n\n## Two\n\n> q\n")
    m = Engine(spark, files.arbor_of(spark, "markdown", (tmp_path / "t.md").read_text()))
    assert m.values("//item::") == ["a", "b"]
    assert m.values("//section<section>[::level = 2]::title") == ["Two"]
    assert m.values("/section | markdown") == ["# One\n\npara\n\n- a\n- b\n\n## Two\n\n> q"]
    (tmp_path / "r.csv").write_text("a,b\n1,\n2,x\n")
    c = Engine(spark, connectors.open_source(spark, str(tmp_path / "r.csv")))
    assert c.values("/row[::b = null]::a") == ["1"]
    assert Engine(spark, connectors.listing(spark, str(tmp_path))).values("/row @| count") == [3]
    t = Engine(spark, files.arbor_of(spark, "toml", "[a]\nb = 3\nc = [1, 2]\n"))
    assert t.values("/a::b") == ["3"] and t.values("/a/c/* @| count") == [2]


def test_rendering_round_trips(spark):
    text = '{"a": [1, {"b": null, "c": true}], "d": "x"}'
    e = Engine(spark, files.arbor_of(spark, "json", text))
    assert json.loads(e.values("/a | json")[0]) == json.loads(text)["a"]
    x = Engine(spark, files.arbor_of(spark, "xml", "<r><p k='1'>t</p><q/></r>"))
    assert x.values("/r | xml") == ['<r><p k="1">t</p><q/></r>']


def test_graphs_and_models(spark):
    people = spark.createDataFrame([(0, "Ann", "x"), (1, "Bob", "y"), (2, "Cy", "x")], "k long, name string, team string")
    knows = spark.createDataFrame([(0, 1, 5), (1, 2, 7)], "a long, b long, since long")
    g = connectors.graph({"person": (people, "k")}, {"knows": (knows, "a", "person", "b", "person")})
    e = Engine(spark, g)
    assert e.values("/person/0->knows::name") == ["Bob"]
    assert e.values("/person/2<-knows::name") == ["Bob"]
    assert sorted(e.values("/person/1--knows::name")) == ["Ann", "Cy"]
    assert e.values("/person/0->knows | $-::since") == ["5"]
    assert e.values("/person/0(->knows)+::name") == ["Bob", "Cy"]
    assert e.values("/person/*->knows | rec(::name, 'by', (@- | join(',')))") == [{"name": "Bob", "by": "knows"}, {"name": "Cy", "by": "knows"}]
    team = Engine(spark, derived.shared(g, "team", "team", F.array_contains("traits", "person")))
    assert team.values("/person/0->team::name") == ["Cy"]
    rel = Engine(spark, derived.relation(g, "before", F.array_contains("traits", "person"), F.array_contains("traits", "person"), lambda a, b: a["name"] < b["name"]))
    assert rel.values("/person/0->before::name") == ["Bob", "Cy"]


def test_triples(spark):
    rows = [("elm", "height", "30"), ("elm", "shades", "fern"), ("fern", "height", "1"), ("elm", "name", "Ulme"), ("elm", "name", "Orme"), ("elm", "shades", "moss"), ("moss", "height", "0.1")]
    e = Engine(spark, connectors.triples(spark.createDataFrame(rows, "subject string, predicate string, object string")))
    assert e.values("//elm->shades::height") == ["1", "0.1"]
    assert e.values("//elm::name") == ["Orme\nUlme"]  # two values of one predicate
    assert e.values("//elm::name | lines") == ["Orme", "Ulme"]


def test_lists_become_elements(spark):
    e = Engine(spark, files.arbor_of(spark, "json", '{"top": {"tags": ["x", {"2nd key": 1}]}}'))
    assert e.values("/top | xml") == ["<top><tags><item>x</item><item><item>1</item></item></tags></top>"]


def test_mounts_join_across_sources(spark, harbour):
    rows = files.delimited_text(spark, "at,rate\n20,high\n10,low\n")
    e = mount(spark, db=harbour.source, fees=rows)
    assert e.values("/db/docks/* <=> /fees/row[::at = $$::no] | rec(::side, 'rate', $*1::rate)") == [{"side": "north", "rate": "low"}, {"side": "south", "rate": "high"}]


def test_saving_refuses_to_overwrite(spark, harbour, tmp_path):
    target = str(tmp_path / "out")
    save(harbour.query("/boats/*::kind"), target)
    assert spark.read.json(target).count() == 5
    with pytest.raises(Exception, match="exists"):
        save(harbour.query("/boats/*::kind"), target)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:05"), (2, "b", "2024-01-01 00:00:30"), (3, "a", "2024-01-01 00:01:10")], "v long, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    read = lambda: spark.readStream.schema(rows.schema).parquet(path)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    assert run(stream.query(read(), "/row[::v > 1] | rec(::k, 'd', ::v * 2)"), "append", "s1") == [("a", 6), ("b", 4)]
    assert run(stream.query(read(), "/row @| group(::k) | count | .n | rec($.k, $.n)"), "complete", "s2") == [("a", 2), ("b", 1)]
    assert [r[2:] for r in run(stream.windows(read(), "t", "1 minute", "0 seconds", ("k",), "v"), "complete", "s3")] == [("a", 1, 1), ("b", 1, 2), ("a", 1, 3)]
    for text in ("/row @| sort_by(::v)", "/row | $ord", "/row @| window(2)", "/row @| count"):
        with pytest.raises(CompileError):
            stream.query(read(), text)
