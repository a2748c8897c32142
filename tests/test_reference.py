"""The search, graph and index operators: expected values, and every query against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from glintmine.functions import chunkers, paths, text
from glintmine.operators import brief, graph, measures, ranking
from glintmine.plans import queries

SF = "/root/testdata/sf0.001"


def plain(frame):
    def value(x):
        if x is None or x != x:
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(value(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in entry.reference.staging.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert plain(found) == plain(duck.sql(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["chunk_id", "score", "rank"]


@pytest.mark.parametrize(("name", "parts"), [("useChat", ["use", "Chat"]), ("HTMLElement", ["HTML", "Element"]), ("getXMLParser", ["get", "XML", "Parser"]), ("foo-bar_baz", ["foo", "bar", "baz"]), ("_foo_", ["foo"]), ("---", []), ("HTTP", ["HTTP"])])
def test_split(spark, name, parts):
    assert text.split_name(name) == parts
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.split_identifier(df["n"])).first()[0] == parts


@pytest.mark.parametrize(("query", "found"), [("streaming chat hooks", ["streaming", "chat", "hooks", "stream", "hook"]), ("UseAuth Component", ["useauth", "use", "auth", "component"]), ("thing setup", ["thing", "setup"])])
def test_keywords(query, found):
    assert text.keywords(query) == found


def test_hints_and_targets():
    assert text.type_hints("hooks and types for Hook") == ["hook", "type_def"]
    assert paths.parse_target("a.rs:run") == ("a.rs", "run") and paths.parse_target("a.rs:") == ("a.rs:", None) and paths.parse_target("a:b/c") == ("a:b/c", None)
    with pytest.raises(ValueError, match="project"):
        paths.check_path("../x")


def test_normalized(spark):
    df = spark.createDataFrame([("ＡＢｃ É",), ("ABC",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalized(df["t"])).collect()] == [text.normalize("ＡＢｃ É"), "abc", None]


def test_confidence():
    assert ranking.confidence(1.0) == 1.0 and ranking.confidence(0.0) == 0.4 and ranking.confidence(0.09) == 1.0


@pytest.mark.parametrize(("edges", "order"), [([("a", "b"), ("b", "c")], "cba"), ([("a", "b"), ("a", "c")], "bca"), ([("a", "b"), ("b", "a")], "abc"[:2])])
def test_topological(edges, order):
    assert brief.topological(sorted({x for e in edges for x in e}), edges) == list(order)


def test_cap(spark):
    rows = [(i, f, 1, 4, d, n) for i, (f, d, n) in enumerate([("a", 0, 10), ("b", 1, 5), ("c", 1, 2), ("d", 2, 1)])]
    df = spark.createDataFrame(rows, "chunk_id long, file_path string, start_line int, bytes long, depth int, import_count int")
    kept = lambda *budget: sorted(r["file_path"] for r in brief.cap(df, *budget).collect())
    assert kept(2, 1000) == ["a", "b"] and kept(10, 8) == ["a", "b"] and kept(10, 1000) == ["a", "b", "c", "d"]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b", None, "named"), ("b", "c", None, "named"), ("c", "a", None, "named")], "source_file string, target_file string, symbol_name string, ref_kind string")
    assert sorted(tuple(r) for r in graph.dependents(edges, "a", 10).collect()) == [("b", 2), ("c", 1)]
    assert graph.dependents(edges, "zzz", 3).count() == 0


def test_patterns():
    with pytest.raises(ValueError, match="bad"):
        measures.Pattern("bad", "(", ("x",), True)


def test_fallback_ends():
    long = "\n".join("x" * 2000 for _ in range(5))
    chunks = chunkers.fallback(long)
    assert chunks[-1].end_line == 5 and [c.start_line for c in chunks] == [1, 2, 3, 4, 5]
    assert chunkers.fallback("") == [] and chunkers.fallback("\n\n") == []


def test_markdown():
    got = [(c.chunk_type, c.name, c.start_line, c.end_line) for c in chunkers.markdown("intro\n# One ##\ntext\n```\n# no\n```\n## \nend")]
    assert got == [("other", None, 1, 1), ("md_section", "One", 2, 6), ("md_section", None, 7, 8)]


def test_script():
    source = "import React, { useState as s, type T } from 'react';\nimport './x.css';\n// About\nexport function useChat() { return 1; }\nexport const Button = () => { return '}'; };\ninterface P { a: string }\ndescribe('chat', () => {});\n"
    chunks, imports = chunkers.script(source)
    assert [(c.chunk_type, c.name) for c in chunks] == [("hook", "useChat"), ("component", "Button"), ("type_def", "P"), ("test_case", "chat")]
    assert chunks[0].start_line == 3 and chunks[0].content.startswith("// About")
    assert imports[0].specifiers == [("React", None, "default"), ("useState", "s", "named"), ("T", None, "type_only")] and imports[1].specifiers == []


def test_rust():
    source = "mod a;\nuse crate::b::{C, d::E, self};\nuse std::fmt;\n/// Doc\npub fn run(x: &'static str) -> u8 { let s = \"}\"; 1 }\nstruct S;\nimpl S { fn m(&self) {} }\n"
    chunks, imports = chunkers.rust(source)
    assert [(c.chunk_type, c.name, c.parent) for c in chunks] == [("rust_fn", "run", None), ("rust_struct", "S", None), ("rust_impl", "S", None), ("rust_fn", "m", 2)]
    assert [i.source for i in imports] == ["self::a", "crate::b", "crate::b::d"]


def test_css_and_html():
    assert [c.chunk_type for c in chunkers.css("a { b: c }\n@media x { d { e: f } }")] == ["css_rule"] * 2
    assert [c.content for c in chunkers.html("<!DOCTYPE html><p>x</p><div><p>y</p></div>")] == ["<!DOCTYPE html>", "<p>x</p>", "<div><p>y</p></div>"]
