"""Declared inputs of the operators, and a check that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT = T.StringType()
CALLS = T.ArrayType(_struct(tool_name=_TEXT, arguments=T.MapType(_TEXT, _TEXT)))

PAIRS = _struct(pair_id=_TEXT, expected=_TEXT, actual=_TEXT)
LEXICAL_REQUEST = _struct(pair_id=_TEXT, expected=_TEXT, actual=_TEXT, threshold=T.DoubleType())
JUDGE_REQUEST = _struct(pair_id=_TEXT, expected=_TEXT, actual=_TEXT, prompt=_TEXT, threshold=T.IntegerType())
QUESTION_REQUEST = _struct(doc_id=T.LongType(), content=T.BinaryType(), query_count=T.IntegerType(), prompt=_TEXT)
CASES = _struct(test_id=_TEXT, input=_TEXT, expected_tools=T.ArrayType(_TEXT), expected_order_id=_TEXT)
RUNS = _struct(test_id=_TEXT, tool_calls=CALLS, final_answer=_TEXT)
REPLIES = _struct(
    pair_id=_TEXT, model=_TEXT, attempt_no=T.IntegerType(), http_status=T.IntegerType(), retry_after=_TEXT, body=_TEXT
)


def conform(table: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns with their declared types.

    A missing column is an error at once; a value that cannot be read becomes null,
    which the input rules turn into a reject.
    """
    missing = [f.name for f in schema.fields if f.name not in table.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    have = {f.name: f.dataType for f in table.schema.fields}
    return table.select(*[
        F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
