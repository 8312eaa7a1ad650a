"""One query per operator, over the star tables or the code derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill import constants as C
from proofmill.functions import text
from proofmill.operators import chain, files as FO, focal, oracles, outcomes, pairing, retrieval
from proofmill.operators import splits as SP
from proofmill.plans import first_assertion, per_assertion
from proofmill.session import fresh_path
from proofmill.sinks import text_pairs
from proofmill.sources import lines, notes, starcode, trees

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# --- sources -------------------------------------------------------------

def project_list(spark, d):
    return FO.list_projects(starcode.code_files(spark, d)).select(
        "project", F.col("project").rlike(C.PROJECT_PATTERN).alias("numbered"),
        FO.project_id(F.col("project")).alias("project_id"),
    )


def scan_tests(spark, d):
    return FO.test_file_rows(starcode.code_files(spark, d)).select("project", "path", "content")


def scan_sources(spark, d):
    return FO.source_file_rows(starcode.code_files(spark, d)).select("project", "path", "content")


def _document_files(spark, d):
    """Documents as the files of a produced corpus, two to a project."""
    ending = F.when(F.col("doc_id") % 2 == 0, "_assert.txt").otherwise("_prefix_focal.txt")
    return _table(spark, d, "documents", "doc_id", "text").select(
        F.concat(F.floor(F.col("doc_id") / 2).cast("string"), ending).alias("file_name"),
        F.col("text").alias("content"),
    )


def read_corpus(spark, d):
    return trees.pair_halves(trees.corpus_file_lines(_document_files(spark, d))).drop("project")


def combine_corpus(spark, d):
    return trees.combine(trees.corpus_file_lines(_document_files(spark, d))).drop("project")


def file_line_numbers(spark, d):
    """Documents as lines of text files, a thousand to a file, written and read back with their numbers."""
    out = fresh_path(spark, "line-files")
    half = F.when(F.col("doc_id") % 2 == 0, "assert").otherwise("prefix_focal")
    told = _table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.concat_ws("_", F.floor(F.col("doc_id") / 2000).cast("string"), half).alias("name"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\r\n]+", " ")).alias("value"),
    )
    told.repartition("name").sortWithinPartitions("name", "doc_id").drop("doc_id").write.partitionBy("name").text(out)
    scan = spark.read.schema("value string, name string").text(out)
    return lines.numbered(scan, "name").drop("file")


def case_sections(spark, d):
    return notes.case_sections(starcode.case_notes(spark, d))


def bad_prefix_rows(spark, d):
    return notes.bad_prefixes(starcode.bad_prefix_notes(spark, d))


# --- sinks, read back ----------------------------------------------------

def export_pairs(spark, d):
    out = fresh_path(spark, "export-pairs")
    samples = first_assertion.samples(starcode.code_files(spark, d))
    text_pairs.write_pairs(samples, out, ["path", "ordinal"])
    return text_pairs.read_pairs(spark, out)


def export_csv(spark, d):
    """Both CSV files in one order; inputs.csv is read back here, meta.csv by export_meta."""
    out = fresh_path(spark, "export-csv")
    rows = per_assertion.inputs(per_assertion.run(starcode.code_files(spark, d)).splits, with_meta=True)
    text_pairs.write_inputs(rows, out, ["path", "ordinal", "split_no"])
    back = text_pairs.read_csv(
        spark, f"{out}/inputs.csv", ", ".join(f"{c} string" for c in C.INPUT_COLUMNS)
    )
    # CSV does not tell an empty string from none.
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in C.INPUT_COLUMNS])


def export_overall(spark, d):
    out = fresh_path(spark, "export-overall")
    samples = per_assertion.samples(per_assertion.run(starcode.code_files(spark, d)).splits)
    text_pairs.write_pairs(samples, out, ["path", "ordinal", "split_no"], by_project=False)
    return text_pairs.read_pairs(spark, out, by_project=False)


def export_meta(spark, d):
    out = fresh_path(spark, "export-meta")
    rows = per_assertion.meta(per_assertion.run(starcode.code_files(spark, d)).splits)
    text_pairs.write_meta(rows, out, ["path", "ordinal", "split_no"])
    back = text_pairs.read_csv(spark, f"{out}/meta.csv", ", ".join(f"{c} string" for c in C.META_COLUMNS))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in C.META_COLUMNS])


def export_hits_json(spark, d):
    out = fresh_path(spark, "export-hits")
    text_pairs.write_hits(retrieve_nearest(spark, d), out)
    return spark.read.schema("query_id bigint, corpus_id bigint, n_common bigint, n_union bigint").json(out)


# --- filters and projections --------------------------------------------

def filter_projects(spark, d):
    return FO.filter_projects(starcode.code_files(spark, d), ["12_", "Math"]).select("project", "path")


def filter_sample_projects(spark, d):
    return FO.filter_sample_projects(starcode.code_files(spark, d)).select("project", "path")


def path_parts(spark, d):
    return FO.path_parts(starcode.test_files(spark, d))


def source_path_by_name(spark, d):
    return starcode.test_files(spark, d).select(
        "path", FO.source_path_by_name(F.col("path")).alias("source_path")
    )


def source_path_by_package(spark, d):
    return starcode.test_files(spark, d).select(
        "path",
        FO.source_path_by_package(F.col("project"), F.col("path"), F.col("content"))
        .alias("source_path"),
    )


def file_package(spark, d):
    return starcode.test_files(spark, d).select(
        "path", text.package_name(F.col("content")).alias("package")
    )


def file_imports(spark, d):
    return FO.imports_table(starcode.code_files(spark, d))


def _test_methods(spark, d):
    return FO.method_catalog(FO.read_files(starcode.test_files(spark, d)))


def full_test_name(spark, d):
    read = FO.read_files(starcode.test_files(spark, d)).filter("parses").select(
        "path", "package", "class_name", F.posexplode("methods").alias("ordinal", "m")
    )
    name = text.test_name(F.col("m.text"))
    return read.select(
        "path", "ordinal",
        F.when(name != "", F.concat("package", F.lit("."), "class_name", F.lit("::"), name))
        .alias("full_test_name"),
    )


# --- string functions ----------------------------------------------------

def _on_pages(fn):
    def query(spark, d):
        return _table(spark, d, "pages", "page_id", "html").select(
            "page_id", fn(F.col("html")).alias("text")
        )
    return query


def normalize_chars(spark, d):
    return _table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", text.normalize_chars(F.col("text")).alias("text")
    )


def normalize_tokens(spark, d):
    return _table(spark, d, "pages", "page_id", "html").select(
        "page_id", text.normalize_tokens(F.col("html")).alias("text"),
        text.normalize_tokens(F.col("html"), drop_access=True).alias("no_access"),
    )


def strip_semicolon(spark, d):
    ended = F.concat("text", F.expr("repeat('; ', cast(turn AS int))"), F.lit(";; "))
    return _table(spark, d, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", text.strip_semicolon(ended).alias("semicolons"),
        text.strip_semicolon_run(ended).alias("run"),
    )


def first_assertion_text(spark, d):
    return _test_methods(spark, d).select(
        "path", "ordinal", text.first_assertion(F.col("text")).alias("assertion"),
        text.first_assertion(F.col("text"), skip_comments=True).alias("uncommented"),
    )


def exception_label(spark, d):
    return _test_methods(spark, d).select(
        "path", "ordinal", text.exception_label(F.col("text")).alias("exception_lbl")
    )


def retrieval_query(spark, d):
    found = first_assertion.tests_with_focal(starcode.code_files(spark, d))
    return found.select(
        "path", "ordinal",
        text.retrieval_query(F.col("text"), F.coalesce("focal.text", F.lit(C.UNKNOWN_FOCAL)))
        .alias("query"),
    )


# --- row generators ------------------------------------------------------

def code_lines(spark, d):
    documents = _table(spark, d, "documents", "doc_id", "source", "text").select(
        F.col("source").alias("project"), F.col("doc_id").alias("path"),
        F.col("text").alias("content"),
    )
    return FO.numbered_lines(documents)


def method_bodies(spark, d):
    return _test_methods(spark, d).select(
        "path", "method_name", "start_n", "end_n", "text"
    )


def method_catalog(spark, d):
    return FO.method_catalog(FO.read_files(starcode.source_files(spark, d))).select(
        "project", "path", "class_name", "ordinal", "method_name", "is_ctor", "start_n", "end_n",
        "text",
    )


def method_docs(spark, d):
    return FO.method_catalog(FO.read_files(starcode.source_files(spark, d))).select(
        "path", "method_name", "docstring"
    )


def drop_runaway_methods(spark, d):
    return FO.drop_runaway_methods(_test_methods(spark, d)).select("path", "method_name")


def split_first_assert(spark, d):
    return SP.split_at_first_assertion(_test_methods(spark, d)).select(
        "path", "ordinal", "assertion", "prefix"
    )


def split_per_assert(spark, d):
    return SP.split_per_assertion(_test_methods(spark, d)).select(
        "path", "ordinal", "split_no", "split_text",
        F.array_join(F.col("line_nums").cast("array<string>"), ",").alias("line_nums"),
    )


def split_at_line(spark, d):
    wanted = starcode.order_facts(spark, d).select(
        F.col("test_path").alias("path"), F.lit(starcode.HEADER_LINES + 6).alias("assert_n")
    )
    return SP.split_at_line(_test_methods(spark, d), wanted).select(
        "path", "ordinal", "assert_n", "split_text"
    )


def call_sites(spark, d):
    return focal.call_sites(_test_methods(spark, d)).select("path", "ordinal", "rank", "name")


def call_sites_tree(spark, d):
    """Calls of chained statements, one method for each order, in tree order."""
    code = F.expr(
        "concat('void test', o_orderkey, '() { x.first', o_orderkey, '(inner', o_custkey, '(), b).next(arg', o_custkey,"
        " '(new Made(deep()))).last(); new Job(size()) { public void run() { go(); } }.start(', 'y.count()); this.own(p()).then(q()); }')"
    )
    orders = _table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        F.lit("1_chains").alias("project"), F.col("o_orderkey").alias("path"), F.lit(0).alias("ordinal"),
        F.lit("t").alias("method_name"), code.alias("text"),
    )
    return focal.call_sites(orders, tree_order=True).select(F.col("path").alias("o_orderkey"), "rank", "name")


# --- joins ---------------------------------------------------------------

def test_source_pairs(spark, d):
    code = starcode.code_files(spark, d)
    return FO.pair_tests_with_sources(
        FO.test_file_rows(code), FO.source_file_rows(code), FO.source_path_by_name(F.col("path"))
    ).select("path", "source_path")


def missing_sources(spark, d):
    code = starcode.code_files(spark, d)
    return FO.pair_tests_with_sources(
        FO.test_file_rows(code), FO.source_file_rows(code),
        FO.source_path_by_name(F.col("path")), "left_anti",
    ).select("path", "source_path")


def focal_project(spark, d):
    return first_assertion.tests_with_focal(starcode.code_files(spark, d)).select(
        "path", "ordinal", "focal.focal_path", F.col("focal.text").alias("focal_text")
    )


def focal_inherited(spark, d):
    splits = per_assertion.run(starcode.code_files(spark, d)).splits
    return splits.select(
        "path", "ordinal", "split_no", "focal.focal_path",
        F.col("focal.text").alias("focal_text"), F.col("focal.docstring").alias("docstring"),
    )


def class_chain(spark, d):
    sources = FO.read_files(starcode.source_files(spark, d))
    return chain.class_chain(chain.class_ancestors(sources))


def _turns(spark, d):
    """User turns as one half of a corpus, replies as the other; two turns share a position."""
    turns = _table(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumn(
        "line_no", F.floor(F.col("turn") / 2)
    )
    left = turns.filter(F.col("turn") % 2 == 0).select(
        "conv_id", "line_no", F.col("text").alias("assertion")
    )
    right = turns.filter(F.col("turn") % 2 == 1).select(
        "conv_id", "line_no", F.col("text").alias("prefix_focal")
    )
    return left, right


def pair_by_position(spark, d):
    return pairing.pair_by_position(*_turns(spark, d), ["conv_id", "line_no"], "full")


def alignment_audit(spark, d):
    return pairing.alignment_audit(*_turns(spark, d), "conv_id", "line_no")


def retrieve_nearest(spark, d):
    asked = _table(spark, d, "benchmark", "item_id", "text").withColumnRenamed("item_id", "query_id")
    corpus = _table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "corpus_id")
    return retrieval.retrieve_nearest(asked, corpus).select(
        "query_id", "corpus_id", "n_common", "n_union"
    )


def outcome_diff(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    test = F.floor(F.col("event_id") / 2)
    # some events are tests of their own, so these have one side only
    alone = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("Only"), F.col("event_id").cast("string")))
    rows = events.select(
        F.concat(F.lit("Math-"), (test % 106).cast("string")).alias("bug"),
        F.coalesce(alone, F.concat(F.lit("test"), test.cast("string"))).alias("test"),
        F.when(F.col("event_id") % 2 == 0, "buggy").otherwise("fixed").alias("version"),
        (F.col("event_type") != "error").alias("passed"),
    )
    return outcomes.outcome_diff(rows)


def apply_oracles(spark, d):
    tests = SP.split_at_first_assertion(_test_methods(spark, d))
    given = starcode.order_facts(spark, d).filter("k % 4 = 0").select(
        F.col("test_path").alias("path"), F.lit(0).alias("ordinal"),
        F.expr("concat('assertEquals(', k, ', int0);')").alias("new_assertion"),
    )
    return outcomes.apply_oracles(tests, given, ["path", "ordinal"])


def drop_bad_prefixes(spark, d):
    tests = starcode.order_facts(spark, d).select(
        F.lit("math").alias("bug_project"), F.col("k").alias("bug_id"),
        F.explode(F.expr("sequence(0, cast(n_tests - 1 AS int))")).alias("test_no"),
    )
    bad = notes.bad_prefixes(starcode.bad_prefix_notes(spark, d))
    return outcomes.drop_bad_prefixes(tests, bad)


# --- aggregates and whole corpora ---------------------------------------

def samples_first_assert(spark, d):
    return first_assertion.samples(starcode.code_files(spark, d))


def samples_per_assert(spark, d):
    return per_assertion.samples(per_assertion.run(starcode.code_files(spark, d)).splits)


def input_rows(spark, d):
    return per_assertion.inputs(per_assertion.run(starcode.code_files(spark, d)).splits)


def meta_rows(spark, d):
    return per_assertion.meta(per_assertion.run(starcode.code_files(spark, d)).splits)


def reject_counts(spark, d):
    return per_assertion.count_rejects(starcode.code_files(spark, d))


def input_count(spark, d):
    return per_assertion.input_count(per_assertion.run(starcode.code_files(spark, d)).splits)


def corpus_counts(spark, d):
    return trees.corpus_counts(trees.corpus_file_lines(_document_files(spark, d)))


def project_counts(spark, d):
    return FO.project_counts(starcode.code_files(spark, d))


# --- oracle analytics ----------------------------------------------------

def oracle_kind(spark, d):
    return _test_methods(spark, d).select(
        "path", "ordinal", oracles.oracle_kind(F.col("text")).alias("oracle_kind")
    )


def expected_exception(spark, d):
    return _test_methods(spark, d).select(
        "path", "ordinal", oracles.expected_exception(F.col("text")).alias("e")
    ).select("path", "ordinal", "e.*")


def oracle_edit_distance(spark, d):
    return oracles.section_distances(notes.case_sections(starcode.case_notes(spark, d)))


QUERIES: dict[str, Query] = {
    "project_list": project_list,
    "scan_tests": scan_tests,
    "scan_sources": scan_sources,
    "read_corpus": read_corpus,
    "combine_corpus": combine_corpus,
    "file_line_numbers": file_line_numbers,
    "case_sections": case_sections,
    "bad_prefix_rows": bad_prefix_rows,
    "export_pairs": export_pairs,
    "export_csv": export_csv,
    "export_overall": export_overall,
    "export_meta": export_meta,
    "export_hits_json": export_hits_json,
    "filter_projects": filter_projects,
    "filter_sample_projects": filter_sample_projects,
    "path_parts": path_parts,
    "source_path_by_name": source_path_by_name,
    "source_path_by_package": source_path_by_package,
    "file_package": file_package,
    "file_imports": file_imports,
    "full_test_name": full_test_name,
    "strip_modifiers": _on_pages(text.strip_modifiers),
    "space_symbols": _on_pages(text.space_symbols),
    "collapse_ws": _on_pages(text.collapse_whitespace),
    "normalize_chars": normalize_chars,
    "normalize_tokens": normalize_tokens,
    "strip_semicolon": strip_semicolon,
    "first_assertion": first_assertion_text,
    "exception_label": exception_label,
    "retrieval_query": retrieval_query,
    "code_lines": code_lines,
    "method_bodies": method_bodies,
    "method_catalog": method_catalog,
    "method_docs": method_docs,
    "drop_runaway_methods": drop_runaway_methods,
    "split_first_assert": split_first_assert,
    "split_per_assert": split_per_assert,
    "split_at_line": split_at_line,
    "call_sites": call_sites,
    "call_sites_tree": call_sites_tree,
    "test_source_pairs": test_source_pairs,
    "missing_sources": missing_sources,
    "focal_project": focal_project,
    "focal_inherited": focal_inherited,
    "class_chain": class_chain,
    "pair_by_position": pair_by_position,
    "alignment_audit": alignment_audit,
    "retrieve_nearest": retrieve_nearest,
    "outcome_diff": outcome_diff,
    "apply_oracles": apply_oracles,
    "drop_bad_prefixes": drop_bad_prefixes,
    "samples_first_assert": samples_first_assert,
    "samples_per_assert": samples_per_assert,
    "input_rows": input_rows,
    "meta_rows": meta_rows,
    "reject_counts": reject_counts,
    "input_count": input_count,
    "corpus_counts": corpus_counts,
    "project_counts": project_counts,
    "oracle_kind": oracle_kind,
    "expected_exception": expected_exception,
    "oracle_edit_distance": oracle_edit_distance,
}
