"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as contract
from gradeframe.plans.oracle import ORACLES as LIBRARY_ORACLES
from gradeframe.plans.queries import QUERIES as LIBRARY

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# The training-data queries have tests of their own.
QUERIES, ORACLES = LIBRARY, LIBRARY_ORACLES

# Keys the coverage list asks for.
WANTED = """
pair_source containment_terms containment containment_valid stopword_filter stopword_filter_ext clean_tokens
cosine_pct cosine_verdict stem_terms stemmed_tokens cosine_stemmed judge_input_rules qa_input_rules judge_prompt
judge_prompt_b judge_request judge_request_b vision_request qa_prompt qa_request parse_chat parse_responses
fence_strip judge_schema judge_scores reason_lines judge_verdict http_outcome attempt_wait model_order
resolve_attempts document_type document_text qa_parse qa_validate qa_pairs qa_totals document_source media_type
data_url judge_request_direct tool_exists tool_params tool_sequence backend_exists hallucination agent_verdict
""".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(columns, names):
    rows = zip(*[columns[n] for n in names])
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_all_keys_are_there():
    assert set(WANTED) <= set(QUERIES) and set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    assert got.num_rows > 0
    if name not in ORACLES:
        return
    wanted = duck.sql(ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(wanted.column_names)
    assert ordered(got.to_pydict(), names) == ordered(wanted.to_pydict(), names)


def test_entry(spark):
    assert contract.entry(spark).columns == ["conv_id", "turn", "containment_pct", "is_valid"]
