"""Text files of any size, read by blocks."""

import random

from pyspark.sql import functions as F

from proofmill.sources import trees
from proofmill.sources.lines import file_lines


def small_blocks(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    return before


def test_numbers_do_not_depend_on_blocks(spark, tmp_path):
    rng = random.Random(5)
    texts = {
        "a.txt": "".join(f"{k} {'x' * rng.randint(0, 90)}\n" for k in range(3000)), "b.txt": "\n\n\nlast without an end",
        "c.txt": "", "d.txt": "\n", "e b+ü.txt": "one\r\ntwo\rthree\n", "f.md": "other",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = set()
    for name, text in texts.items():
        lines = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if text and name != "f.md" else []
        want |= {(name, k, line) for k, line in enumerate(lines, 1)}
    for size in (700, 10_000, 1 << 27):
        before = small_blocks(spark, size)
        try:
            got = [tuple(r) for r in file_lines(spark, str(tmp_path), "*.txt").select(F.substring_index("file", "/", -1), "line_no", "line").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(got) == len(want) and set(got) == want


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 1_000_000
    (tmp_path / "3_assert.txt").write_text("".join(f"assert {k}\n" for k in range(n)))
    (tmp_path / "3_prefix_focal.txt").write_text("".join(f"prefix {k}\n" for k in range(n)))
    before = small_blocks(spark, 1 << 20)
    try:
        lines = trees.read_corpus_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        pairs = trees.pair_halves(lines)
        right = (F.col("assertion") == F.concat(F.lit("assert "), F.col("line_no") - 1)) & (
            F.col("prefix_focal") == F.concat(F.lit("prefix "), F.col("line_no") - 1)
        )
        assert tuple(pairs.agg(F.count("*"), F.count_if(right), F.max("line_no")).first()) == (n, n, n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_are_digits(spark, tmp_path):
    long = "1" * 20
    for name, text in ((long, "x"), (long[:-1] + "2", "y"), ("007", "z"), ("7", "w"), ("10", "v")):
        (tmp_path / f"{name}_assert.txt").write_text(text + "\n")
    got = trees.read_corpus(spark, str(tmp_path), digits=True).collect()
    assert {(r.project, r.project_id, r.assertion) for r in got} == {
        (long, None, "x"), (long[:-1] + "2", None, "y"), ("007", 7, "z"), ("7", 7, "w"), ("10", 10, "v")
    }
    combined = trees.combine(trees.read_corpus_lines(spark, str(tmp_path)))
    assert [r.line for r in combined.collect()] == ["z", "w", "v", "x", "y"]
    assert trees.corpus_counts(combined).first().n_files == 5
