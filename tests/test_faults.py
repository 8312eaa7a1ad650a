"""Odd input and growth: what readers and resolvers must survive."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from proofmill import session
from proofmill.functions import java, text
from proofmill.operators import chain, files as FO, oracles, outcomes, splits
from proofmill.sinks import text_pairs
from proofmill.sources import notes, trees


def write(root, path, content):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(content)


def test_root_whose_name_comes_again_below(spark, tmp_path):
    root = tmp_path / "src"
    write(root, "1_a/src/main/java/A.java", "class A { }")
    write(root, "1_a/evosuite-tests/AEvoSuiteTest.java", "class AEvoSuiteTest { }")
    write(root, "1_a/mod/src/main/java/B.java", "class B { }")
    for name in (str(root), f"file://{root}", f"{root}/"):
        got = {(r.path, r.kind) for r in trees.scan_project_tree(spark, name).collect()}
        assert got == {("1_a/src/main/java/A.java", "src"), ("1_a/evosuite-tests/AEvoSuiteTest.java", "test")}


def test_ids_that_fit_no_int_and_notes_without_a_case(spark):
    files = spark.createDataFrame([("99999999999_assert.txt", "x"), ("99999999999999999999_assert.txt", "y"), ("notes.txt", "z")], "file_name string, content string")
    assert {r.project_id for r in trees.corpus_file_lines(files).collect()} == {99999999999, None}
    headless = spark.createDataFrame([("n", "no case here\nEvosuite prefix:\nint a;\n")], "path string, content string")
    assert all(r.bug_id is None for r in notes.case_sections(headless).collect())


def test_notes_are_read_whole(spark, tmp_path):
    write(tmp_path, "a.txt", "Math 1\n")
    assert [r.content for r in trees.read_notes(spark, str(tmp_path)).collect()] == ["Math 1\n"]


def test_chain_as_long_as_it_is(spark):
    rows = [("1_a", f"1_a/src/main/java/p/C{k}.java", True, f"C{k + 1}", "p") for k in range(70)]
    rows += [("1_a", "1_a/src/main/java/p/X.java", True, "Y", "p"), ("1_a", "1_a/src/main/java/p/Y.java", True, "X", "p")]
    rows += [("1_a", f"1_a/src/main/java/p/H{k}.java", True, "C69", "p") for k in range(40)]
    df = spark.createDataFrame(rows, "project string, path string, parses boolean, superclass string, package string")
    df = df.withColumn("imports", F.array().cast("array<struct<simple:string,fqn:string>>"))
    got = {r.path.rsplit("/", 1)[1][:-5]: [a.rsplit("/", 1)[1][:-5] for a in r.ancestors] for r in chain.class_ancestors(df, same_package=True).collect()}
    assert got["C0"] == [f"C{k}" for k in range(70)] and got["H7"] == ["H7", "C69"] and got["C69"] == ["C69"]
    assert got["X"] == ["X", "Y"] and got["Y"] == ["Y", "X"] and len(got) == 112
    assert all(len(r.ancestors) == 1 for r in chain.class_ancestors(df).collect())


def methods_of(spark, code):
    files = spark.createDataFrame([("1_a", "1_a/src/main/java/A.java", "src", code)], "project string, path string, kind string, content string")
    return FO.method_catalog(FO.read_files(files))


def test_reader_grows_with_the_text(spark):
    def seconds(n):
        code = "class A {\n" + "".join(f"  int m{k}(int a) {{\n    if (a > {k}) {{ return 1; }}\n    return {k};\n  }}\n" for k in range(n)) + "}\n"
        start = time.perf_counter()
        rows = methods_of(spark, code).select("method_name", "text", "start_n").collect()
        assert len(rows) == n and rows[-1].text.strip().endswith(f"return {n - 1};\n  }}") and rows[-1].start_n == 2 + 4 * (n - 1)
        return time.perf_counter() - start

    seconds(100)
    short, long = seconds(4000), seconds(8000)
    assert long < 3 * short + 1


def test_members_that_share_a_line(spark):
    code = "class A { int a() { return 1; } int b() { return 2; }\n  @X\n  int c() { return 3; }\n}\n"
    got = {r.method_name: r.text for r in methods_of(spark, code).collect()}
    assert got["a"] == "class A { int a() { return 1; }" and got["b"].endswith("int b() { return 2; }") and got["c"].strip() == "int c() { return 3; }"


def names(spark, code):
    return spark.range(1).select(java.call_names(java.blank_literals(F.lit(code))).alias("n")).first().n


def test_candidates(spark):
    body = "void t() { x = new Outer.Inner(1); y = new Map.Entry<A, B>(f(2)); Runnable r = new Task() { public void run() { go(); } void stop(int a) throws E { } }; z.call(); }"
    assert names(spark, body) == ["Outer", "Map", "f", "Task", "go", "call"]


@pytest.mark.parametrize("code, assertion, prefix", [
    ('void t() {\n  assertEquals("a // b", x);\n}', 'assertEquals("a // b", x);', "void t() {"),
    ("void t() {\n  //assertTrue(x);\n  int a; // assertTrue(y)\n  assertTrue(x);\n}", "assertTrue(x);", "void t() { //assertTrue(x); int a; // assertTrue(y)"),
])
def test_comments_are_blanked_in_place(spark, code, assertion, prefix):
    df = spark.createDataFrame([(code,)], "text string")
    assert df.select(F.length(text.line_comments_out(F.col("text"))).alias("n")).first().n == len(code)
    got = splits.split_at_first_assertion(df, skip_comments=True).first()
    assert (got.assertion, got.prefix) == (assertion, prefix)


def test_one_replacement_for_a_key(spark):
    tests = spark.createDataFrame([("p", 0, "x assertTrue(a); y", "assertTrue(a);")], "path string, ordinal int, text string, assertion string")
    given = spark.createDataFrame([("p", 0, "two"), ("p", 0, "one")], "path string, ordinal int, new_assertion string")
    assert [tuple(r) for r in outcomes.apply_oracles(tests, given, ["path", "ordinal"]).select("assertion", "text").collect()] == [("one", "x one y")]


def test_sections_that_come_twice(spark):
    rows = [("math", 1, s, k, b) for k, (s, b) in enumerate([("regression_oracle", "aa"), ("dev_assertion", "ab"), ("regression_oracle", "zz"), ("dev_assertion", "zz")])]
    got = oracles.section_distances(spark.createDataFrame(rows, "bug_project string, bug_id long, section string, seq int, body string"))
    assert sorted((r.turn, r.assertion_distance) for r in got.collect()) == [(1, 1), (2, 0)]


def test_files_sort_by_number(spark):
    names_ = ["part-00009-x.c000.txt", "part-100000-x.c000.txt", "part-99999-x.c000.txt", "part-00009-x.c1000.txt", "part-00009-x.c999.txt", "part-00010-x-c000.txt"]
    got = spark.createDataFrame([(n,) for n in names_], "n string").orderBy(text_pairs.file_order(F.col("n"))).collect()
    assert [r.n for r in got] == [names_[0], names_[4], names_[3], names_[5], names_[2], names_[1]]


def test_overall_pair_is_read_back(spark, tmp_path):
    rows = [(1, f"p{k:03}", k, f"a{k}", f"f{k}\nx") for k in range(50)]
    df = spark.createDataFrame(rows, "project_id long, path string, ordinal int, assertion string, prefix_focal string")
    text_pairs.write_pairs(df, str(tmp_path / "out"), ["path", "ordinal"], by_project=False)
    got = sorted(map(tuple, text_pairs.read_pairs(spark, str(tmp_path / "out"), by_project=False).select("line_no", "assertion", "prefix_focal").collect()))
    assert got == [(k + 1, f"a{k}", f"f{k} x") for k in range(50)]


def test_repeated_order_keys_shift_no_half(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_pairs, "LINES_PER_FILE", 9)
    rows = [(k % 3, "p", 0, f"a{k * 7 % 60:02}", f"f{k * 7 % 60:02}") for k in range(60)]
    df = spark.createDataFrame(rows, "project_id long, path string, ordinal int, assertion string, prefix_focal string").repartition(8)
    for by_project in (True, False):
        out = str(tmp_path / str(by_project))
        text_pairs.write_pairs(df, out, ["path", "ordinal"], by_project)
        got = [(r.assertion, r.prefix_focal) for r in text_pairs.read_pairs(spark, out, by_project).collect()]
        assert sorted(got) == sorted((r[3], r[4]) for r in rows)


def test_no_shared_folder_on_a_cluster():
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", applicationId="a"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_bad_prefixes_are_not_taken_to_the_driver(spark):
    tests = spark.createDataFrame([("math", 1, 0), ("math", 1, 1), ("math", None, 0), ("math", 1, 1)], "bug_project string, bug_id long, test_no int")
    bad = spark.createDataFrame([("math", 1, 1), ("math", 1, 1), ("math", None, 0)], "bug_project string, bug_id long, test_no int")
    left = outcomes.drop_bad_prefixes(tests, bad)
    assert sorted(map(str, left.collect())) == sorted(map(str, tests.filter("test_no = 0").collect()))
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
