"""String functions on small inputs, and properties on the given tables."""

from pyspark.sql import functions as F

from proofmill.functions import text
from proofmill.operators import oracles
from proofmill.sources import notes

SF = "/root/testdata/sf0.001"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


def test_normalize_chars(spark):
    assert one(spark, 'public  static int f(){return a>=1||"a,b";}', text.normalize_chars) == (
        'int f ( ) { return a > = 1 | | "a , b" ; }'
    )


def test_normalize_chars_is_idempotent(spark):
    once = spark.read.parquet(f"{SF}/documents.parquet").select(
        text.normalize_chars(F.col("text")).alias("x")
    )
    assert once.filter(text.normalize_chars(F.col("x")) != F.col("x")).count() == 0


def test_normalize_tokens(spark):
    code = 'public int f(List<List<A>>a){ // no\n  return a>>>=1 ? 0x1F : 1.5e-3f + ".{" + \'}\'; /* c */ }'
    assert one(spark, code, text.normalize_tokens) == (
        'public int f ( List < List < A >> a ) { return a >>>= 1 ? 0x1F : 1.5e-3f + ".{" + \'}\' ; }'
    )
    assert one(spark, code, lambda c: text.normalize_tokens(c, True)).startswith("int f (")
    assert one(spark, "a # b  c", text.normalize_tokens) == "a # b  c"
    assert one(spark, 'x "open', text.normalize_tokens) == 'x "open'
    assert one(spark, "  ", text.normalize_tokens) == "  "


def test_semicolons(spark):
    assert one(spark, "assertTrue(x);; \n", text.strip_semicolon) == "assertTrue(x)"
    assert one(spark, "assertTrue(x) ; ;", text.strip_semicolon_run) == "assertTrue(x)"


def test_package_and_imports(spark):
    code = "// package no;\n  package a.b;\nimport x.A;\nimport y.A ;\nimport static z.B.*;\n"
    assert one(spark, code, text.package_name) == "a.b"
    got = {(e.simple, e.fqn) for e in one(spark, code, text.import_entries)}
    assert got == {("A", "y.A"), ("*", "z.B.*")}


def test_exception_label_reads_raw_text(spark):
    good = 'try { f(); fail("x"); } catch(E e) { }'
    inside = "try { f(); } catch(E e) { fail(1); }"
    commented = "try { f();\n //fail(1);\n } catch(E e) { }"
    assert one(spark, good, text.exception_label) is True
    assert one(spark, inside, text.exception_label) is False
    assert one(spark, commented, text.exception_label) is True
    assert one(spark, commented, lambda c: text.exception_label(c, True)) is False


def test_retrieval_query(spark):
    code = '@Test(timeout = 4000)\npublic void t() {\n try {\n f();\n fail("x");\n } catch(E e) {\n g();\n }\n}'
    assert one(spark, code, lambda c: text.retrieval_query(c, F.lit("int f(){}"))) == (
        'void t ( ) { f ( ) ; "<AssertPlaceHolder>" ; } "<FocalMethod>" int f ( ) { }'
    )


def test_oracle_kind_and_exception(spark):
    code = 'try { a(); fail("x"); } catch(java.io.IOException e) {\n //\n // bad 1\n //\n verifyException("a.B", e); }'
    assert one(spark, code, oracles.oracle_kind) == "exception"
    assert one(spark, code + " assertTrue(x);", oracles.oracle_kind) == "both"
    got = one(spark, code, oracles.expected_exception)
    assert tuple(got) == ("java.io.IOException", "a.B", "bad 1")


def test_case_sections_with_empty_bodies_and_header_spellings(spark):
    note = (
        "\n\ntime 1 \n\nEVOSUITE PREFIX\n a\n  b\nEVOSUITE ASSERTION (REGRESSION ORACLE) \n"
        "DEV-WRITTEN PREFIX (DEFECTS4J) \n\nTRUE ASSERTION (PASSES ON FIXED) \nx\n"
        "METHOD UNDER TEST \nint f() {\n}\nNOTES \n- n\n"
    )
    df = spark.createDataFrame([("n", note)], "path string, content string")
    rows = notes.case_sections(df).orderBy("seq").collect()
    assert [(r.bug_project, r.bug_id, r.section, r.body) for r in rows] == [
        ("time", 1, "evosuite_prefix", "a\n  b"), ("time", 1, "regression_oracle", ""),
        ("time", 1, "dev_prefix", ""), ("time", 1, "true_assertion", "x"),
        ("time", 1, "method_under_test", "int f() {\n}"), ("time", 1, "notes", "- n"),
    ]


def test_bad_prefixes(spark):
    df = spark.createDataFrame([("n", "math 4 \n\ttried: 1,2, 10\nlang 7\n")], "path string, content string")
    got = sorted(map(tuple, notes.bad_prefixes(df).collect()))
    assert got == [("math", 4, 1), ("math", 4, 2), ("math", 4, 10)]
