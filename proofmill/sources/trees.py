"""Readers of folders: Java project trees and produced corpora."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill import constants as C
from proofmill.functions.text import lies_in
from proofmill.sources.lines import file_lines


def _whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).text(root, wholetext=True)
    )
    return text.select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"),
        F.regexp_replace("value", r"\r\n?", "\n").alias("content"),
    )


def _below(file: Column, root: str) -> Column:
    """Path below the root folder: the file's path less the root's, whatever comes again below."""
    plain = re.sub(r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?", "", root)
    whole = (os.path.abspath(plain) if plain == root else plain).rstrip("/") + "/"
    # A relative root of another file system: its own name, where it comes first.
    tail = "/" + plain.strip("/") + "/"
    at = F.instr(file, whole)
    return F.when(at > 0, F.substring(file, at + len(whole), F.length(file))).otherwise(
        F.substring(file, F.instr(file, tail) + len(tail), F.length(file))
    )


def _kind(path: Column, suffix: str) -> Column:
    return F.when(lies_in(path, C.TEST_DIR) & path.endswith(f"{suffix}.java"), "test").when(
        lies_in(path, C.SOURCE_DIR), "src"
    )


def list_project_tree(spark: SparkSession, root: str, suffix: str = C.TEST_SUFFIX) -> DataFrame:
    """project, path, kind, size of the test and source files below ``root``; no file is opened."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.java").load(root)
    )
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    listed = files.select(_below(path, root).alias("path"), F.col("length").alias("size"))
    return listed.select(
        F.substring_index("path", "/", 1).alias("project"), "path", _kind(F.col("path"), suffix).alias("kind"), "size"
    ).filter("kind IS NOT NULL")


def scan_project_tree(spark: SparkSession, root: str, suffix: str = C.TEST_SUFFIX) -> DataFrame:
    """project, path, kind, content of the test and source files below ``root``.

    One folder per project; tests end with the suffix and lie below the test
    folder, sources below the source folder.
    """
    files = _whole(spark, root, "*.java").withColumn("path", _below(F.col("file"), root))
    return files.select(
        F.substring_index("path", "/", 1).alias("project"), "path", _kind(F.col("path"), suffix).alias("kind"), "content"
    ).filter("kind IS NOT NULL")


def _of_corpus(files: DataFrame) -> DataFrame:
    """Add project (the digits of the file's name), project_id and half; files of other names go.

    Digits are kept as text, so ids of any length, and ids with leading zeros, stay apart. project_id is their
    number, NULL where it fits no bigint.
    """
    half = F.when(F.col("file_name").rlike(C.ASSERT_FILE_PATTERN), "assert").when(
        F.col("file_name").rlike(C.PREFIX_FOCAL_FILE_PATTERN), "prefix_focal"
    )
    project = F.split_part("file_name", F.lit("_"), F.lit(1))
    return files.withColumns(
        {"half": half, "project": project, "project_id": project.try_cast("bigint")}
    ).filter("half IS NOT NULL")


def corpus_file_lines(files: DataFrame) -> DataFrame:
    """files(file_name, content) → project, project_id, half, line_no, line.

    Files that are not named number_assert.txt or number_prefix_focal.txt are
    passed over.
    """
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n", -1)
    return (
        _of_corpus(files.filter("content <> ''"))
        .select("project", "project_id", "half", F.posexplode(lines).alias("i", "line"))
        .select("project", "project_id", "half", (F.col("i") + 1).alias("line_no"), "line")
    )


def pair_halves(lines: DataFrame) -> DataFrame:
    """project, project_id, line_no, assertion, prefix_focal; NULL where a half is missing."""
    return lines.groupBy("project", "project_id", "line_no").agg(
        F.max(F.when(F.col("half") == "assert", F.col("line"))).alias("assertion"),
        F.max(F.when(F.col("half") == "prefix_focal", F.col("line"))).alias("prefix_focal"),
    )


def read_corpus_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the number_assert.txt and number_prefix_focal.txt files in a folder; files may be of any size."""
    lines = file_lines(spark, root, "*.txt").withColumn("file_name", F.substring_index("file", "/", -1))
    return _of_corpus(lines).select("project", "project_id", "half", "line_no", "line")


def read_corpus(spark: SparkSession, root: str, digits: bool = False) -> DataFrame:
    """The same folder as paired lines; with ``digits`` project is there too, which tells ids apart that fit no bigint."""
    pairs = pair_halves(read_corpus_lines(spark, root))
    return pairs if digits else pairs.drop("project")


def combine(lines: DataFrame) -> DataFrame:
    """All projects in number order, lines in file order, duplicates kept."""
    number = F.regexp_replace("project", "^0+(?=.)", "")
    return lines.orderBy(F.length(number), number, "project", "half", "line_no")


def corpus_counts(lines: DataFrame) -> DataFrame:
    """(half, n_files, n_lines) of what goes into the combined files."""
    return lines.groupBy("half").agg(
        F.count_distinct("project").alias("n_files"), F.count("*").alias("n_lines")
    )


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the text notes in a folder."""
    return _whole(spark, root, "*.txt").select(F.col("file").alias("path"), "content")
