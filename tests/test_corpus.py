"""Both extraction plans, chains, readers and writers on small trees."""

import os

from pyspark.sql import functions as F

from proofmill.operators import chain, files as FO, outcomes, pairing
from proofmill.plans import first_assertion, per_assertion
from proofmill.sinks import text_pairs
from proofmill.sources import starcode, trees

SF = "/root/testdata/sf0.001"
SRC = "{p}/src/main/java/a/{c}.java"


def cls(name, parent=None, imported=True, body=""):
    head = f"package a;\n{f'import a.{parent};' if parent and imported else ''}\n"
    return head + f"public class {name} {f'extends {parent} ' if parent else ''}{{\n{body}\n}}\n"


def test_chain_ends(files):
    tree = {
        "A": cls("A", "B"), "B": cls("B", "C"), "C": cls("C"),
        "L": cls("L", "C", imported=False), "M": cls("M", "Gone"),
        "X": cls("X", "Y"), "Y": cls("Y", "Z"), "Z": cls("Z", "X"), "S": cls("S", "S"),
        "U": cls("U", "V"), "V": cls("V") + "}",
    }
    read = FO.read_files(files({SRC.format(p="1_p", c=c): text for c, text in tree.items()}))

    def chains(**options):
        edges = chain.class_ancestors(read, **options)
        return {
            os.path.basename(r.path)[0]: "".join(os.path.basename(a)[0] for a in r.ancestors)
            for r in edges.collect()
        }

    assert chains() == {
        "A": "ABC", "B": "BC", "C": "C", "L": "L", "M": "M",
        "X": "XYZ", "Y": "YZX", "Z": "ZXY", "S": "S", "U": "U",
    }


def test_long_chain(files):
    tree = {SRC.format(p="1_p", c=f"K{i}"): cls(f"K{i}", f"K{i + 1}" if i < 40 else None) for i in range(41)}
    got = chain.class_ancestors(FO.read_files(files(tree)))
    assert got.filter("path LIKE '%/K0.java'").select(F.size("ancestors")).first()[0] == 41


TEST = '''package a;
public class ThingEvoSuiteTest {
  @Test(timeout = 4000)
  public void test0() {
    Thing t = new Thing();
    t.same();
    assertEquals(1, t.base());
    t.nothing();
  }
  public void test1() {
    try {
      new Thing();
      assertNull(null);
      fail("x");
    } catch(E e) {
    }
  }
  public void helper() { }
}
'''
TREE = {
    "2_p/evosuite-tests/a/ThingEvoSuiteTest.java": TEST,
    "2_p/src/main/java/a/Thing.java": cls("Thing", "Base", body="  Thing() { }\n  /** mine */\n  int same() { return 2; }"),
    "2_p/src/main/java/a/Base.java": cls("Base", body="  int base() { return 1; }\n  int same() { return 1; }"),
    "2_p/src/main/java/a/Aaa.java": cls("Aaa", body="  int base() { return 0; }"),
    "2_p/evosuite-tests/a/LostEvoSuiteTest.java": TEST,
    "10_q/evosuite-tests/a/NoneEvoSuiteTest.java": TEST.replace("Thing", "None"),
    "10_q/src/main/java/a/None.java": "package a;\nclass None {\n}\n",
}


def test_first_assertion_corpus(files):
    rows = {(r.project_id, r.ordinal): r for r in first_assertion.samples(files(TREE)).collect()}
    assert set(rows) == {("2", 0), ("2", 1), ("10", 0), ("10", 1)}
    # Last call first; across the project the first file in path order wins.
    assert rows["2", 0].assertion == "assertEquals ( 1 , t . base ( ) )"
    assert rows["2", 0].prefix_focal == (
        "void test0 ( ) { Thing t = new Thing ( ) ; t . same ( ) ; "
        '"<AssertPlaceHolder>" ; } "<FocalMethod>" int base ( ) { return 0 ; }'
    )
    assert rows["10", 0].prefix_focal.endswith('"<FocalMethod>" <UnknownFocalMethodText>')


def test_per_assertion_corpus(files):
    stages = per_assertion.run(files(TREE))
    rows = {
        (r.project, r.test_name[-5:]): r
        for r in per_assertion.meta(stages.splits).collect()
    }
    assert set(rows) == {("2_p", "test0"), ("2_p", "test1"), ("10_q", "test0"), ("10_q", "test1")}
    assert rows["2_p", "test0"].test_name == "a.ThingEvoSuiteTest::test0"
    inputs = {
        (r.project, r.ordinal): (r.focal_method.strip(), r.docstring)
        for r in per_assertion.inputs(stages.splits).collect()
    }
    # Along the chain the base class is reached, other classes of the project are not.
    assert inputs["2_p", 0] == ("int base() { return 1; }", None)
    # A split cut inside try does not parse and keeps no focal method.
    assert inputs["2_p", 1] == ("", "")
    assert inputs["10_q", 0] == ("", "")
    counts = {(r.stage, r.reason): r.n for r in per_assertion.reject_counts(stages).collect()}
    assert counts == {
        ("file", "cannot_find_focal_unit_file"): 1, ("method", "test_name_not_matched"): 2,
        ("split", "no_assertion"): 4, ("split", "unable_to_parse_test"): 2,
    }


def test_rejects_and_survivors_add_up(spark):
    stages = per_assertion.run(starcode.code_files(spark, SF))
    for table in (stages.test_files, stages.test_methods, stages.splits):
        n = table.count()
        assert n > 0 and n == table.filter("reason IS NULL").count() + table.filter("reason IS NOT NULL").count()
    assert stages.splits.filter("reason IS NULL").count() == per_assertion.samples(stages.splits).count()


def test_same_rows_for_any_partitioning(spark):
    def rows():
        return sorted(map(tuple, first_assertion.samples(starcode.code_files(spark, SF)).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows()
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_every_line_has_one_marker_of_each_kind(spark):
    rows = first_assertion.samples(starcode.code_files(spark, SF))
    marks = rows.filter(
        (F.regexp_count("prefix_focal", F.lit("<AssertPlaceHolder>")) != 1)
        | (F.regexp_count("prefix_focal", F.lit("<FocalMethod>")) != 1)
        | F.col("prefix_focal").contains("\n")
    )
    assert marks.count() == 0


def test_project_tree_reader(spark, tmp_path):
    for path, text in TREE.items():
        target = tmp_path / "root" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "root" / "2_p" / "build.java").write_text("class No { }")
    got = trees.scan_project_tree(spark, str(tmp_path / "root"))
    assert {(r.path, r.content) for r in got.collect()} == set(TREE.items())
    assert got.filter("kind = 'test'").count() == 3


def test_produced_corpus_reader(spark, tmp_path):
    (tmp_path / "10_assert.txt").write_text("a\nb\n")
    (tmp_path / "10_prefix_focal.txt").write_text("p\nq\n")
    (tmp_path / "2_assert.txt").write_text("only\n")
    (tmp_path / "all_assert.txt").write_text("no\n")
    got = [tuple(r) for r in trees.read_corpus(spark, str(tmp_path)).orderBy("project_id", "line_no").collect()]
    assert got == [(2, 1, "only", None), (10, 1, "a", "p"), (10, 2, "b", "q")]


def test_text_pairs_over_several_files_per_project(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_pairs, "LINES_PER_FILE", 7)
    rows = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, "1").otherwise("2").alias("project_id"),
        F.lpad(F.col("id").cast("string"), 5, "0").alias("path"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("a\n "), "id").alias("assertion"), F.concat(F.lit("p "), "id").alias("prefix_focal"),
    )
    text_pairs.write_pairs(rows, str(tmp_path / "out"), ["path", "ordinal"])
    back = text_pairs.read_pairs(spark, str(tmp_path / "out")).orderBy("project_id", "line_no").collect()
    assert len(back) == 200
    assert all(r.assertion.split()[1] == r.prefix_focal.split()[1] for r in back)
    for project in ("1", "2"):
        mine = [r for r in back if r.project_id == project]
        assert [r.line_no for r in mine] == list(range(1, len(mine) + 1))
        ids = [int(r.assertion.split()[1]) for r in mine]
        assert ids == sorted(ids)


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [('  a "q"\n\\ b,', "x", "d"), ("", "y ", "e")], "focal_method string, test_prefix string, docstring string"
    )
    text_pairs.write_inputs(rows, str(tmp_path), ["test_prefix"])
    back = text_pairs.read_csv(
        spark, f"{tmp_path}/inputs.csv", "focal_method string, test_prefix string, docstring string"
    )
    got = {tuple(c or "" for c in r) for r in back.collect()}
    assert got == {tuple(r) for r in rows.collect()}


def test_outcomes(spark):
    rows = spark.createDataFrame(
        [("b", v, t, p) for t, v, p in [
            ("t1", "buggy", False), ("t1", "fixed", True), ("t2", "buggy", True), ("t2", "fixed", False),
            ("t3", "buggy", True), ("t4", "fixed", True), ("t5", "buggy", False), ("t5", "fixed", False),
        ]], "bug string, version string, test string, passed boolean",
    )
    got = {r.test: r.outcome for r in outcomes.outcome_diff(rows).collect()}
    assert got == {
        "t1": "fails_then_passes", "t2": "passes_then_fails", "t3": "only_buggy", "t4": "only_fixed",
        "t5": "fails_both",
    }


def test_alignment(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "project string, n int")
    b = spark.createDataFrame([("p", 1), ("p", 2), ("r", 1)], "project string, n int")
    got = {tuple(r) for r in pairing.alignment_audit(a, b, "project", "n").collect()}
    assert got == {("p", 2, 2, 2, True), ("q", 1, 0, 0, False), ("r", 0, 1, 0, False)}
