"""The queries with SQL against DuckDB, and the contracts' columns."""

import math
from collections import Counter

import duckdb
import pytest

pytest.importorskip("foldspark.llm")
from foldspark.llm import queries as llm  # noqa: E402

TABLES = "documents pages benchmark labels conversations".split()
COLUMNS = {
    "op2": "page_id payload_bytes payload_digest record_type refers_to",
    "op3": "page_id host path rule verdict",
    "op4": "doc_id n_shingles component_id kept",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "doc_id held_out lang_pred score",
}


def norm(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = c.sql(llm.oracle_sql()[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{x}"' for x in columns)
    other = c.sql(f"SELECT {quoted} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(map(norm, r)) for r in df.select(*columns).collect()) == Counter(tuple(map(norm, r)) for r in other)


def test_names_and_columns(spark, sf):
    names = llm.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    for name, f in names.items():
        key = name.split("_")[0]
        if key in COLUMNS and key != "op4":
            assert set(COLUMNS[key].split()) <= set(f(spark, sf).columns)
