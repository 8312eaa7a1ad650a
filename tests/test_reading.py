"""Java is read in few steps a file, and a test file meets each class of a chain once."""

from pyspark.sql import functions as F

from proofmill.functions import java, text
from proofmill.operators import focal


def test_classes_are_counted_in_the_text_itself(spark):
    codes = {
        "class A { /* class B */ String s = \"class C {\"; // class D\n}": 1,
        "class A { } class/* and */B { } x.class y; $class Z": 2,
        "\"'x \n'class Z'\nclass X { class Y { } }": 2,
        "": 0,
    }
    df = spark.createDataFrame(list(codes.items()), "code string, n int")
    assert [tuple(r) for r in df.select("n", java.class_count(F.col("code"))).collect()] == [(n, n) for n in codes.values()]


def test_tokens_that_do_not_lex(spark):
    codes = ["a + é", "a # b", "'", "x = \"a # b\" // `\n;", "été_1$ = ٣", " ", "a \x01"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(text.normalize_tokens(F.col("c"))).collect()]
    assert got == ["a + é", "a # b", "'", 'x = "a # b" ;', "été_1$ = ٣", " ", "a \x01"]


def _class(path, names, parses=True):
    return ("1_a", path, parses, [{"method_name": n, "text": t} for n, t in names])


def test_one_row_for_a_class_and_nearest_first(spark):
    rows = [
        _class("own", [("f", "f"), ("bad", "@Test @Test"), ("f", "second")]),
        _class("base", [("f", "f"), ("g", "g"), ("bad", "bad")]),
        _class("root", [("g", "g"), ("h", "h")]), _class("none", [("x", "x")], False),
    ]
    sources = spark.createDataFrame(
        rows, "project string, path string, parses boolean, methods array<struct<method_name:string,text:string>>"
    )
    firsts = {r.path: dict(zip(r.known, r.ordinals)) for r in focal.first_per_class(sources).collect()}
    assert firsts == {"own": {"f": 0}, "base": {"f": 0, "g": 1, "bad": 2}, "root": {"g": 0, "h": 1}}
    wanted = spark.createDataFrame(
        [("own", ["f", "g", "h", "bad", "no"]), ("own", ["g"]), ("base", ["f"]), ("none", ["x"]), ("root", None)],
        "source_path string, names array<string>",
    )
    ancestors = spark.createDataFrame(
        [("own", ["own", "base", "root"]), ("base", ["base", "root"]), ("root", ["root"])], "path string, ancestors array<string>"
    )
    found = {r.source_path: r.found for r in focal.resolve_in_chain(wanted, ancestors, sources).collect()}
    places = {s: {n: tuple(p) for n, p in m.items()} for s, m in found.items()}
    assert places == {
        "own": {"f": ("own", 0), "g": ("base", 1), "h": ("root", 1), "bad": ("base", 2)}, "base": {"f": ("base", 0)},
    }
