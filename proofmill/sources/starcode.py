"""Java code tables derived from the star tables.

An order is a class under test with its own test file, a customer is the base
class its orders may extend, and thirty neighbouring customers form a project.
Every file is built from one row with plain string expressions, so the tables
grow with their inputs and need no shuffle, whatever the key distribution.

The templates below are written once and rendered to SQL text.  ``$x`` stands
for the expression named x.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators.shape import computed_once
from proofmill.session import spread

PROJECT_WORDS = (
    "Chart", "Cli", "Csv", "Gson", "Lang", "Math", "Time", "Codec", "Jsoup", "Collections",
)
CUSTOMERS_PER_PROJECT = 30

# Columns computed from k (order key), c (customer key) and st (order status).
ORDER_COLUMNS = {
    "pid": f"cast(floor(c / {CUSTOMERS_PER_PROJECT}) AS bigint) + 1",
    "q": f"c % {CUSTOMERS_PER_PROJECT}",
    "project": "concat(CASE WHEN pid % 13 = 0 THEN 'lib' ELSE '' END, pid, '_', CASE pid % 10 "
    + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(PROJECT_WORDS)) + " END)",
    "b": "k % 7",
    "g": "k % 5",
    "d": "k % 3",
    "v": "k % 97",
    # Folder below the source root, and the package each file declares.
    "folder": "CASE WHEN k % 17 = 5 THEN '' ELSE concat('org/p', b, '/') END",
    "test_package": "CASE WHEN k % 17 = 5 THEN '' WHEN k % 19 = 3 THEN concat('org.q', b)"
    " ELSE concat('org.p', b) END",
    "test_file": "CASE WHEN k % 101 = 0 THEN concat('p', k, '/EvoSuiteTest.java')"
    " ELSE concat('C', k, 'EvoSuiteTest.java') END",
    "test_path": "concat(project, '/evosuite-tests/', folder, test_file)",
    "src_path": "concat(project, '/src/main/java/', folder, 'C', k, '.java')",
    "has_source": "true",
    "test_ok": "k % 37 <> 6",
    "src_ok": "k % 41 <> 9",
    "two_classes": "k % 31 = 4",
    "extends_base": "k % 2 = 0",
    "imports_base": "k % 6 <> 4",
    "n_tests": "k % 3 + 1",
}

CUSTOMER_COLUMNS = {
    "pid": ORDER_COLUMNS["pid"],
    "q": ORDER_COLUMNS["q"],
    "project": ORDER_COLUMNS["project"],
    "p": f"c - q + cast(floor(q / 3) AS bigint)",
    "e": "c % 3",
    "u": "c % 11",
    "src_path": "concat(project, '/src/main/java/org/base/Base', c, '.java')",
    "has_source": "true",
    "extends_base": "q > 0",
    "imports_base": "q > 0 AND q % 5 <> 4",
}

# Per test j of an order: which of the five bodies it has, its name, a string.
TEST_COLUMNS = {
    "m": "(k + 2 * j + CASE st WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) % 5",
    "name": "CASE WHEN k % 23 = 7 AND j = 0 THEN 'verify0' ELSE concat('test', j) END",
    "r": "CASE WHEN k % 29 = 11 THEN '@Test @Test' ELSE 'fail(1) {' END",
}

# Columns that others are made of, or that files are picked by.  They are worked out once, after keys are dealt:
# the optimizer would repeat them wherever they occur and move the filters on them into the few tasks of the scan.
SHARED = ("pid", "project", "folder", "test_path", "src_path")

# Bodies: ten lines each, so that line numbers follow from j.
HEADER_LINES = 11
BLOCK_LINES = 12
BODIES = (
    (  # two value assertions, calls after the last one
        "  public void $name()  throws Throwable  {",
        "      C$k c0 = new C$k($c);",
        "      c0.set($j);",
        "      int int0 = c0.get$g();",
        "      assertEquals($v, int0);",
        "",
        "      assertTrue(c0.shared() > 0);",
        "      c0.describe$d();",
        "      c0.set(int0);",
        "  }",
    ),
    (  # expected exception only
        "  public void $name()  throws Throwable  {",
        "      C$k c0 = null;",
        "      try {",
        "        c0 = new C$k((-1));",
        '        fail("Expecting exception: IllegalArgumentException");',
        "      } catch(IllegalArgumentException e) {",
        "         // no message for $k {",
        '         verifyException("org.p$b.C$k", e);',
        "      }",
        "  }",
    ),
    (  # no oracle at all
        "  public void $name()  throws Throwable  {",
        "      C$k c0 = new C$k($c);",
        '      String string0 = "$r \\" // $k";',
        "      c0.set($j);",
        "",
        "      /* a block",
        "         comment } */",
        "      c0.unknown$j();",
        "      c0.set(2);",
        "  }",
    ),
    (  # value assertion inside a try with an expected exception
        "  public void $name()  throws Throwable  {",
        "      C$k c0 = new C$k($c);",
        "      try {",
        "        c0.set($c);",
        "        assertNotNull(c0);",
        '        fail("Expecting exception: NullPointerException");',
        "      } catch(NullPointerException e) {",
        '         verifyException("org.p$b.C$k", e);',
        "      }",
        "  }",
    ),
    (  # commented assertion first, then two more
        "  public void $name()  throws Throwable  {",
        "      C$k c0 = new C$k($c);",
        "      char char0 = '}';",
        "      //assertEquals($v, c0.get$g());",
        "      assertSame(c0, c0);",
        "      boolean boolean0 = c0.missing$j(c0.rank());",
        "",
        '      assertEquals("a;b", c0.describe$d());',
        "      c0.absent$j();",
        "  }",
    ),
)

TEST_HEADER = (
    "/*",
    " * This file was automatically generated { $k",
    " */",
    "$package_line",
    "",
    "import org.junit.Test;",
    "import static org.junit.Assert.*;",
    "import org.p$b.C$k;",
    "",
    "public class C$kEvoSuiteTest {",
    "",
)

SOURCE_LINES = (
    "$src_package_line",
    "",
    "import java.util.List;",
    "$import_line",
    "",
    "/** Generated class $k. */",
    "public class C$k $extends_clause{",
    "  private int value = $v;",
    "  // a brace in a comment {",
    '  private String tag = "}{";',
    "",
    "  public int get$g() {",
    "    if (value > $c) { return value; }",
    "    return $v;",
    "  }",
    "",
    "  /**",
    "   * Makes an instance for $k.",
    "   */",
    "  public C$k(int value) {",
    "    this.value = value;",
    "  }",
    "",
    "  /** Sets it. */",
    "  protected final synchronized void set(int v) {",
    "    char q = '{';",
    "    this.value = v; // done }",
    "  }",
)

BASE_LINES = (
    "package org.base;",
    "",
    "$import_line",
    "",
    "public abstract class Base$c $extends_clause{",
    "",
    "  public String describe$e() {",
    '    return "base $c";',
    "  }",
    "",
    "  /** Rank of $c. */",
    "  public abstract int rank();",
    "",
    "  public int shared() {",
    "    return $u;",
    "  }",
    "}",
)

ORDER_SLOTS = {
    "package_line": "CASE WHEN test_package = '' THEN '// default package'"
    " ELSE concat('package ', test_package, ';') END",
    "src_package_line": "CASE WHEN folder = '' THEN '// default package'"
    " ELSE concat('package org.p', b, ';') END",
    "import_line": "CASE WHEN imports_base THEN concat('import org.base.Base', c, ';')"
    " ELSE '// no import' END",
    "extends_clause": "CASE WHEN extends_base THEN concat('extends Base', c, ' ') ELSE '' END",
}
CUSTOMER_SLOTS = {
    "import_line": "CASE WHEN imports_base THEN concat('import org.base.Base', p, ';')"
    " ELSE '// no import' END",
    "extends_clause": "CASE WHEN extends_base THEN concat('extends Base', p, ' ') ELSE '' END",
}

_SLOT = re.compile(r"\$([a-z_]+?)(?=EvoSuiteTest|[^a-z_]|$)")


def literal(text: str) -> str:
    """A SQL string that both engines read alike."""
    parts = re.split(r"(['\\\n])", text)
    marks = {"'": "chr(39)", "\\": "chr(92)", "\n": "chr(10)"}
    shown = [marks.get(p, f"'{p}'") for p in parts if p]
    if not shown:
        return "''"
    return shown[0] if len(shown) == 1 else "concat(" + ", ".join(shown) + ")"


def template(text: str, slots: dict[str, str] | None = None) -> str:
    """SQL expression for a template; a slot is an expression or a column."""
    slots = slots or {}
    parts, at = [], 0
    for match in _SLOT.finditer(text):
        if match.start() > at:
            parts.append(literal(text[at:match.start()]))
        name = match.group(1)
        parts.append(f"({slots[name]})" if name in slots else name)
        at = match.end()
    if at < len(text):
        parts.append(literal(text[at:]))
    if not parts:
        return "''"
    return "concat(" + ", ".join(parts) + ", '')"


def lines_sql(lines: tuple[str, ...] | list[str], slots: dict[str, str] | None = None) -> str:
    return template("\n".join(lines), slots)


def by_body(pick) -> str:
    """CASE over the five bodies; ``pick(i, lines)`` gives each branch as SQL."""
    whens = " ".join(f"WHEN {i} THEN {pick(i, lines)}" for i, lines in enumerate(BODIES))
    return f"CASE m {whens} END"


def _test_block() -> str:
    body = by_body(lambda _, lines: lines_sql(lines))
    for name in ("m", "name", "r"):
        body = re.sub(rf"(?<![\w'$]){name}(?![\w'(])", f"({TEST_COLUMNS[name]})", body)
    return f"concat('  @Test(timeout = 4000)', chr(10), {body}, chr(10))"


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    for name, sql in columns.items():
        value = F.expr(sql)
        df = computed_once(df, name, value) if name in SHARED else df.withColumn(name, value)
    return df


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.col("o_orderstatus").alias("st"),
    )
    return _with(spread(orders), ORDER_COLUMNS)


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("c")
    )
    return _with(spread(customers), CUSTOMER_COLUMNS)


def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = f"transform(sequence(cast(0 AS bigint), n_tests - 1), j -> {_test_block()})"
    content = (
        f"concat({lines_sql(TEST_HEADER, ORDER_SLOTS)}, chr(10), array_join({blocks}, chr(10)),"
        " CASE WHEN test_ok THEN concat('}', chr(10)) ELSE '' END,"
        " CASE WHEN two_classes THEN concat("
        + lines_sql(["", "class Helper$k {", "  void helper() { }", "}", ""]) + ") ELSE '' END)"
    )
    return order_facts(spark, sf_dir).select(
        "project", F.col("test_path").alias("path"), F.lit("test").alias("kind"),
        F.expr(content).alias("content"),
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_facts(spark, sf_dir).filter("has_source").select(
        "project", F.col("src_path").alias("path"), F.lit("src").alias("kind"),
        F.expr(
            f"concat({lines_sql(SOURCE_LINES, ORDER_SLOTS)}, chr(10),"
            " CASE WHEN src_ok THEN concat('}', chr(10)) ELSE '' END)"
        ).alias("content"),
    )
    bases = customer_facts(spark, sf_dir).filter("has_source").select(
        "project", F.col("src_path").alias("path"), F.lit("src").alias("kind"),
        F.expr(f"concat({lines_sql(BASE_LINES, CUSTOMER_SLOTS)}, chr(10))").alias("content"),
    )
    return classes.unionByName(bases)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files: project, path, kind (test or src), content."""
    return test_files(spark, sf_dir).unionByName(source_files(spark, sf_dir))


# Case notes: one per order.  The body of a section is one or two short lines.
CASE_LINES = (
    "math $k",
    "",
    "EVOSUITE PREFIX ",
    "",
    "  C$k c0 = new C$k($c);",
    "    c0.set($v);",
    "",
    "EVOSUITE ASSERTION (REGRESSION ORACLE)",
    "assertEquals($v, c0.get$g());",
    "",
    "",
    "DEV-WRITTEN PREFIX (DEFECTS4J)",
    "C$k made = new C$k($v);",
    "DEV-WRITTEN ASSERTION (DEFECTS4J) ",
    "",
    "$true_header",
    "assertEquals($c, c0.get$g());",
    "NOTES/EDIT DISTANCE?",
    "- notes for $k, EVOSUITE PREFIX inside a line",
    "",
)
CASE_SLOTS = {
    "true_header": "CASE WHEN k % 2 = 0 THEN 'TRUE ASSERTION (FAILS ON BUGGY, PASSES ON FIXED)'"
    " ELSE 'TRUE ASSERTION ' END",
}

# Tried prefixes: one note per order, with up to two lists.
BAD_LINES = (
    "math $k",
    "\ttried: 0,$d",
    "",
    "time $c",
    "  tried: $g, 2 ",
    "tried: $d",
)


def case_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_facts(spark, sf_dir).select(
        F.expr("concat('math', k, '.txt')").alias("path"),
        F.expr(lines_sql(CASE_LINES, CASE_SLOTS)).alias("content"),
    )


def bad_prefix_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_facts(spark, sf_dir).select(
        F.expr("concat('bad', k, '.txt')").alias("path"),
        F.expr(lines_sql(BAD_LINES)).alias("content"),
    )
