"""Reading methods, docs, calls and splits out of hand-written Java."""

from pyspark.sql import functions as F

from proofmill.functions import java
from proofmill.operators import files as FO, focal, splits

SOURCE = '''/* a class { in a comment */
package a.b;

import java.util.List;

@SuppressWarnings({"x", "y"})
public abstract class Box<T extends Comparable<T>> extends Base<T> {
  private int[] sizes = {1, 2};
  private Runnable r = new Runnable() { public void run() { go(); } };
  private String s = "http://x{"; // }
  static { init(); }

  /** old */
  /** Gets it. */
  @Override
  @Deprecated(since = "1")
  public <E> List<E> get(final int n, @Named("a(b") String x) throws java.io.IOException,
      IllegalStateException {
    char q = '{'; char e = '\\''; String t = "\\"}";
    /* { */
    if (n > 0) { return null; }
    return null;
  }

  public abstract int size();
  int a() { return 1; } int b() { return 2; }

  class Inner { void hidden() { } }

  public Box(int n) { this.n = n; }
  native void nat(int x) throws Exception;
}

class Second { void other() { } }
'''


def catalog(files, text, path="1_p/src/main/java/a/b/Box.java"):
    return FO.method_catalog(FO.read_files(files({path: text}))).orderBy("ordinal").collect()


def test_methods_of_the_first_type_constructors_first(files):
    rows = catalog(files, SOURCE)
    assert [r.method_name for r in rows] == ["Box", "get", "size", "a", "b", "nat"]
    assert [r.is_ctor for r in rows] == [True] + [False] * 5


def test_method_text_lines_and_doc(files):
    rows = {r.method_name: r for r in catalog(files, SOURCE)}
    lines = SOURCE.split("\n")
    get = rows["get"]
    assert lines[get.start_n - 1].strip().startswith("public <E> List<E> get(")
    assert get.text == "\n".join(lines[get.start_n - 1:get.end_n])
    assert get.docstring == "/** Gets it. */"
    assert rows["size"].text == "  public abstract int size();"
    assert rows["size"].docstring is None
    # A start line is taken whole, as the line is where the method stands.
    assert rows["b"].text == "  int a() { return 1; } int b() { return 2; }"
    assert rows["a"].text == "  int a() { return 1; }"
    assert rows["nat"].text == "  native void nat(int x) throws Exception;"


def test_structure_facts(files):
    row = FO.read_files(files({"1_p/src/main/java/a/b/Box.java": SOURCE})).first()
    assert (row.class_name, row.superclass, row.package, row.parses) == ("Box", "Base", "a.b", True)
    assert row.n_classes == 3


def test_unbalanced_or_empty_files_do_not_parse(files):
    rows = FO.read_files(
        files({"1_p/a": "class A { void f() { }", "1_p/b": "class A { } }", "1_p/c": "// only text"})
    ).select("path", "parses", F.size("methods").alias("n"), "class_name").orderBy("path").collect()
    assert [r.parses for r in rows] == [False, False, False]
    assert rows[2].class_name == "" and rows[2].n == 0


def test_long_literals_and_long_text_without_braces(files):
    long = 'class A { String s = "' + "\\u0001" * 50_000 + '"; void f() { } }'
    prose = "word \" " * 100_000
    rows = FO.read_files(files({"1_p/a": long, "1_p/b": prose})).orderBy("path").collect()
    assert [m.method_name for m in rows[0].methods] == ["f"] and not rows[1].parses


def test_one_line_class_starts_at_the_line_start(files):
    rows = catalog(files, "class A { int f() { return 1; } }\n")
    assert [(r.method_name, r.start_n, r.text) for r in rows] == [
        ("f", 1, "class A { int f() { return 1; }")
    ]


def test_blanking_keeps_length_and_line_ends(spark):
    df = spark.createDataFrame([('a "x{\\"" /* {\n} */ \'}\' // {\nb',)], "c string")
    got = df.select(java.blank_literals(F.col("c"))).first()[0]
    assert len(got) == len('a "x{\\"" /* {\n} */ \'}\' // {\nb')
    assert "{" not in got and "}" not in got and got.count("\n") == 2


def test_calls_in_text_order(spark):
    code = '''void test0() throws Throwable {
      Foo f = new a.b.Foo(1); List<Map<String, X>> l = new ArrayList<Map<String, X>>();
      if (f.go(f.inner())) { super.skip(); this.own(); }
      //hidden(1);
      assertEquals(1, f.size()); fail("x(y)"); verifyException("c", e);
    }'''
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(focal.calls_of(F.col("c"))).first()[0] == [
        "a", "ArrayList", "go", "inner", "own", "size"
    ]


def methods(spark, text, start=10):
    return spark.createDataFrame(
        [("p", 0, text, start)], "path string, ordinal int, text string, start_n int"
    )


def test_splits_per_assertion(spark):
    text = "void test0() {\n  a();\n\n  assertTrue(x);\n  b();\n  assertEquals(1,\n    y);\n}"
    rows = splits.split_per_assertion(methods(spark, text)).orderBy("split_no").collect()
    assert [r.split_text for r in rows] == [
        "void test0() {\n  a();\n  assertTrue(x);\n}",
        "void test0() {\n  a();\n  b();\n  assertEquals(1,\n}",
        "void test0() {\n  a();\n  b();\n    y);\n}",
    ]
    assert [list(r.line_nums) for r in rows] == [[10, 11, 13], [10, 11, 14, 15], [10, 11, 14, 16, 17]]
    assert [r.assert_n for r in rows] == [13, 15, None]


def test_first_assertion_takes_the_short_reading(spark):
    text = 'void t() {\n  int a;\n  assertEquals("x);", f()); assertTrue(b);\n}'
    row = splits.split_at_first_assertion(methods(spark, text)).first()
    assert row.assertion == 'assertEquals("x);' and row.prefix == "void t() { int a;"
    commented = "void t() {\n  //assertTrue(a);\n  assertTrue(b);\n}"
    assert splits.split_at_first_assertion(methods(spark, commented)).first().assertion == "assertTrue(a);"
    assert (
        splits.split_at_first_assertion(methods(spark, commented), skip_comments=True).first().assertion
        == "assertTrue(b);"
    )
    assert splits.split_at_first_assertion(methods(spark, "void t() {\n  fail(1);\n}")).count() == 0
