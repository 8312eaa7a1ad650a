"""File-level operators: lines, structure, paths, test/source pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill import constants as C
from proofmill.functions import java, text
from proofmill.operators.shape import computed_once, exploded


METHODS = (
    "array<struct<method_name:string,is_ctor:boolean,start_n:int,end_n:int,text:string,"
    "docstring:string>>"
)


def any_of(column: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """True when the column contains one of the parts."""
    test = F.lit(False)
    for part in parts:
        test = test | column.contains(part)
    return test


def filter_projects(df: DataFrame, parts: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows whose project name contains one of ``parts``."""
    return df.filter(any_of(F.col("project"), parts))


def filter_sample_projects(df: DataFrame) -> DataFrame:
    return filter_projects(df, C.SAMPLE_PROJECTS)


def list_projects(files: DataFrame, numbered_only: bool = False) -> DataFrame:
    """Distinct project folders; with ``numbered_only`` those named number_name."""
    found = files.select("project").distinct()
    if numbered_only:
        found = found.filter(F.col("project").rlike(C.PROJECT_PATTERN))
    return found


def project_id(project: Column) -> Column:
    """Folder name up to the first underscore; a number for numbered projects."""
    return F.split_part(project, F.lit("_"), F.lit(1))


def test_file_rows(files: DataFrame, suffix: str = C.TEST_SUFFIX) -> DataFrame:
    return files.filter(
        text.lies_in(F.col("path"), C.TEST_DIR) & F.col("path").endswith(f"{suffix}.java")
    )


def source_file_rows(files: DataFrame) -> DataFrame:
    return files.filter(
        text.lies_in(F.col("path"), C.SOURCE_DIR) & F.col("path").endswith(".java")
    )


def numbered_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n", -1)
    return exploded(files.select("project", "path", "content"), lines, "line", "i").select(
        "project", "path", (F.col("i") + 1).alias("n"), "line"
    )


def path_parts(files: DataFrame) -> DataFrame:
    """Project and class name taken from a test path; rows that do not match go."""
    return files.filter(F.col("path").rlike(C.TEST_PATH_PATTERN)).select(
        "path",
        F.regexp_extract("path", C.TEST_PATH_PATTERN, 1).alias("project_name"),
        F.regexp_extract("path", C.TEST_PATH_PATTERN, 2).alias("class_name"),
    )


def source_path_by_name(path: Column, suffix: str = C.TEST_SUFFIX) -> Column:
    """Swap the folder and drop the test suffix."""
    swapped = F.replace(path, F.lit(C.TEST_DIR), F.lit(C.SOURCE_DIR))
    return F.replace(swapped, F.lit(suffix), F.lit(""))


def source_path_by_package(
    project: Column, path: Column, content: Column, suffix: str = C.TEST_SUFFIX
) -> Column:
    """Build the source path from the package the test declares."""
    package = text.package_name(content)
    name = F.replace(F.substring_index(path, "/", -1), F.lit(f"{suffix}.java"), F.lit(""))
    folder = F.when(
        package != "", F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit("/"))
    ).otherwise("")
    return F.concat(project, F.lit(f"/{C.SOURCE_DIR}/"), folder, name, F.lit(".java"))


def class_fqn(path: Column) -> Column:
    """Full class name from a source path."""
    inner = F.substring_index(path, f"{C.SOURCE_DIR}/", -1)
    return F.replace(F.regexp_replace(inner, r"\.java$", ""), F.lit("/"), F.lit("."))


def readable(files: DataFrame) -> DataFrame:
    """``path, parses``: whether a file can be read, without its members, imports or doc comments."""
    folded = computed_once(files.select("path", "content"), "structure", java.read_structure(F.col("content")))
    typed = computed_once(folded, "first_type", java.first_type(F.col("structure")))
    return typed.select("path", java.parses(F.col("structure"), F.col("first_type")).alias("parses"))


def read_files(files: DataFrame) -> DataFrame:
    """Read the structure of every file inside its own row; no shuffle.

    Adds class_name, superclass, n_classes, package, imports, parses and methods
    (array, constructors first).  A file that does not read stays, flagged.
    """
    folded = computed_once(files, "structure", java.read_structure(F.col("content")))
    typed = computed_once(folded, "first_type", java.first_type(F.col("structure")))
    # In catalogue order before it is stored: whoever explodes the methods asks for their number first.
    found = F.coalesce(java.members(F.col("structure"), F.col("first_type")), F.array().cast(METHODS))
    listed = computed_once(typed, "found", text.let(found, java.constructors_first))
    return listed.select(
        *files.columns,
        java.type_name(F.col("first_type")).alias("class_name"),
        java.superclass_name(F.col("first_type")).alias("superclass"),
        java.class_count(F.col("content")).alias("n_classes"),
        text.package_name(F.col("content")).alias("package"),
        text.import_entries(F.col("content")).alias("imports"),
        java.parses(F.col("structure"), F.col("first_type")).alias("parses"),
        F.col("found").alias("methods"),
    )


def method_catalog(read: DataFrame) -> DataFrame:
    """One row per method of a readable file, in catalogue order."""
    kept = [c for c in ("project", "path", "kind", "class_name") if c in read.columns]
    return (
        read.filter("parses")
        .select(*kept, F.posexplode("methods").alias("ordinal", "method"))
        .select(
            *kept, "ordinal", "method.method_name", "method.is_ctor", "method.start_n",
            "method.end_n", "method.text", "method.docstring",
        )
    )


def runaway(code: Column) -> Column:
    """True when a method text swallowed a second test."""
    return F.octet_length(F.substring_index(code, "@Test", 2)) < F.octet_length(code)


def drop_runaway_methods(methods: DataFrame) -> DataFrame:
    return methods.filter(~runaway(F.col("text")))


def imports_table(files: DataFrame) -> DataFrame:
    return exploded(files, text.import_entries(F.col("content")), "entry").select(
        "project", "path", "entry.simple", "entry.fqn"
    )


def pair_tests_with_sources(
    tests: DataFrame, sources: DataFrame, source_path: Column, how: str = "inner"
) -> DataFrame:
    """Test files joined to their source on the derived path (left_anti: those without one)."""
    keyed = tests.withColumn("source_path", source_path)
    known = sources.select(F.col("path").alias("source_path"))
    return keyed.join(known, "source_path", how)


def project_counts(files: DataFrame) -> DataFrame:
    """Test files and source files per project."""
    is_test = F.col("kind") == "test"
    return files.groupBy("project").agg(
        F.count_if(is_test).alias("n_tests"), F.count_if(~is_test).alias("n_sources")
    )
