"""What exports and corpora write: both CSV files, text of tests once, tokens without arrays."""

import csv

import pytest
from pyspark.sql import functions as F

from proofmill import constants as C
from proofmill.functions import text
from proofmill.operators import focal
from proofmill.plans import first_assertion, per_assertion
from proofmill.sinks import text_pairs

SOURCE = "class A {\n  int f(int a) { return a; }\n  /** G. */\n  int g() { return 1; }\n}\n"
TEST = (
    "package p;\npublic class AEvoSuiteTest {\n  @Test\n  public void test0()  {\n    A a = new A();\n    assertEquals(1, a.g());\n"
    "    assertTrue(a.f(2) > 1);\n  }\n\n  @Test\n  public void test1()  {\n    assertTrue(b);\n  }\n}\n"
)


def tree(files):
    return files({"1_a/src/main/java/p/A.java": SOURCE, "1_a/evosuite-tests/p/AEvoSuiteTest.java": TEST})


def rows_of(folder, half):
    found = []
    for part in sorted((folder / half).glob("part-*.csv")):
        with open(part, newline="") as f:
            found += list(csv.DictReader(f))
    return found


def test_inputs_come_with_their_meta(spark, tmp_path):
    made = spark.range(200).select(
        F.lit("p").alias("path"), F.lit(0).alias("ordinal"), (F.col("id") % 3).alias("split_no"),
        *(F.concat(F.lit(f"{c}\n"), F.col("id") * 7 % 200).alias(c) for c in (*C.INPUT_COLUMNS, *C.META_COLUMNS)),
    ).repartition(7)
    text_pairs.write_inputs(made, str(tmp_path), ["path", "ordinal", "split_no"])
    inputs, meta = rows_of(tmp_path, "inputs.csv"), rows_of(tmp_path, "meta.csv")
    assert len(inputs) == len(meta) == 200
    assert all(i["test_prefix"].split("\n")[1] == m["test_name"].split("\n")[1] for i, m in zip(inputs, meta, strict=True))


@pytest.mark.parametrize("plan", ["first", "per-assert"])
def test_text_of_tests_is_not_written_again(spark, files, monkeypatch, plan):
    written, keep = {}, focal.written_once
    monkeypatch.setattr(focal, "written_once", lambda df, name: written.update({name: df.columns}) or keep(df, name))
    if plan == "first":
        got = first_assertion.tests_with_focal(tree(files)).select("ordinal", F.lit(0), "focal.focal_ordinal", "focal.text")
    else:
        got = per_assertion.run(tree(files)).splits.select("ordinal", "split_no", "focal.focal_ordinal", "focal.text")
    f, g = "  int f(int a) { return a; }", "  int g() { return 1; }"
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, (
        [(0, 0, 0, f), (1, 0, None, None)] if plan == "first"
        else [(0, 0, 1, g), (0, 1, 0, f), (0, 2, None, None), (1, 0, None, None), (1, 1, None, None)]
    )))
    assert not {"text", "split_text", "methods"} & set(written["chosen"])


def test_tokens_need_no_array(spark):
    codes = ["a>>>=b<<1.5e-3f;//c", "", " ", "/* a */ x", "'a", "public  int a[]={0x1F,.5};", "a.b...c::d->e", "é=\"x//y\"", "/* open", "~`"]
    df = spark.createDataFrame([(c,) for c in codes], "c string").select("c", text.normalize_tokens(F.col("c"), True).alias("t"))
    assert [r.t for r in df.collect()] == [
        "a >>>= b << 1.5e-3f ;", "", " ", "x", "'a", "int a [ ] = { 0x1F , .5 } ;", "a . b ... c :: d -> e", "é = \"x//y\"", "/ * open", "~`",
    ]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
