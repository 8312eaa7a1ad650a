"""Every query of this package: against its SQL where there is one, and of the right shape where not."""

import pytest
from check_sql import difference, open_views

from proofmill.llm.oracle_sql import ORACLE_SQL
from proofmill.llm.queries import QUERIES

BY_DOCUMENT = ["op1_language_id", "op2_toxicity", "op3_token_counts", "op12_tokenizer_alignment", "op13_sentencepiece"]
NO_SQL = [*BY_DOCUMENT, "op11_conversation_repair"]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_views(SF)


def test_sql_is_for_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == set(NO_SQL)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF, name) == ""


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_a_document(spark, name):
    got = [r["doc_id"] for r in QUERIES[name](spark, SF).collect()]
    want = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(got) == sorted(want)
