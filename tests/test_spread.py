"""Hot keys are dealt over all tasks; a tree is listed without opening its files."""

import json
import statistics

from pyspark.sql import functions as F
from test_cli import lay_out
from test_corpus import TREE

from proofmill import cli
from proofmill.operators import chain, files as FO
from proofmill.operators.shape import join_spread
from proofmill.sources import trees


def test_askers_of_one_key_are_dealt(spark):
    asked = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    known = asked.select("k").distinct().select("k", (F.col("k") * 2).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = join_spread(asked, known, "k", "id", "inner")
        sizes = [r["count"] for r in joined.filter("v = k * 2").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert joined.filter("v = k * 2").count() == 200_000
        plain = [r["count"] for r in asked.join(known, "k").filter("v = k * 2").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert max(sizes) < 2 * statistics.median(sizes) and max(plain) > 5 * statistics.median(plain)


def test_many_heirs_of_one_class(spark):
    n = 30_000
    heirs = spark.range(n).select(F.concat(F.lit("H"), "id").alias("name"), F.lit("Base").alias("superclass"))
    rows = heirs.unionByName(spark.createDataFrame([("Base", "Root"), ("Root", "")], "name string, superclass string"))
    df = rows.select(
        F.lit("1_a").alias("project"), F.concat(F.lit("1_a/src/main/java/p/"), "name", F.lit(".java")).alias("path"),
        F.lit(True).alias("parses"), "superclass", F.lit("p").alias("package"),
        F.array().cast("array<struct<simple:string,fqn:string>>").alias("imports"),
    )
    got = chain.class_ancestors(df, same_package=True)
    by_size = {r["n"]: r["count"] for r in got.groupBy(F.size("ancestors").alias("n")).count().collect()}
    assert by_size == {3: n, 2: 1, 1: 1}


def test_listing_opens_no_file(spark, tmp_path):
    root = lay_out(tmp_path / "root")
    deep = tmp_path / "root" / "9_z" / "src" / "main" / "java" / "/".join("abcdefgh")
    deep.mkdir(parents=True)
    (deep / "Ü x+1.java").write_text("class X { }")
    (tmp_path / "root" / "8_empty").mkdir()
    listed = trees.list_project_tree(spark, root)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    whole = trees.scan_project_tree(spark, root)
    assert {tuple(r) for r in listed.drop("size").collect()} == {tuple(r) for r in whole.drop("content").collect()}
    assert any(r.path.endswith("a/b/c/d/e/f/g/h/Ü x+1.java") and r.size == 11 for r in listed.collect())
    assert {r.project for r in FO.list_projects(listed).collect()} == {p.split("/")[0] for p in TREE} | {"9_z"}
    cli.main(["list", root, "-o", str(tmp_path / "out")], spark)
    rows = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert {"project": "9_z", "n_tests": 0, "n_sources": 1} in rows
    (tmp_path / "none").mkdir()
    assert trees.list_project_tree(spark, str(tmp_path / "none")).collect() == []
