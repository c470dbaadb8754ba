"""Every query with SQL against DuckDB, and that every other one has a test of its own."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from foldspark import queries as base
from foldspark.queries import views

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(base.queries())

#: Queries without SQL, and the tests that hold them against an independent computation.
CHECKED = {
    "adaptive_windows": "test_windows_index_regions", "di_adaptive": "test_windows_index_regions", "hmm_fit": "test_models_by_rounds", "viterbi_states": "test_bottoms_from_states",
    "bottom_domains": "test_bottoms_from_states", "single_level_domains": "test_calls_find_the_planted_blocks", "hierarchical_domains": "test_calls_find_the_planted_blocks",
    "consensus_domains": "test_consensus_of_equal_replicates", "aligned_hierarchy": "test_alignment_seen_from_both_sides", "inner_changed_pairs": "test_alignment_seen_from_both_sides",
    "aligned_all_sets": "test_all_sets_are_single_alignments", "aggregation_preference": "test_features_of_domains", "coverage": "test_features_of_domains",
    "gap_free_matrix": "test_gap_free_matrix_whole_map", "dbscan_labels": "test_dbscan_labels", "decay_fit": "test_decay_fit",
}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in NAMES if n in base.oracle_sql()])
def test_against_sql(spark, sf, duck, name):
    got = base.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(base.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = [norm(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    other = [norm(r) for r in duck.sql(f"SELECT {quoted} FROM ({base.oracle_sql()[name]})").fetchall()]
    assert Counter(rows) == Counter(other)


def test_every_query_is_checked():
    """What has no SQL is held against something else."""
    assert set(CHECKED) == {n for n in NAMES if n not in base.oracle_sql()}
    text = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert all(f"def {t}(" in text for t in CHECKED.values())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_gap_free_matrix_whole_map(spark, sf):
    """Every pixel outside the gaps, numbered by brute force."""
    px = [tuple(r) for r in views.pixels(spark, sf).collect()]
    px = [r for r in px if r[2] % 3 != 1 and r[3] % 3 != 1]
    at = {c: sorted({b for r in px if r[1] == c for b in r[2:4]}) for c in {r[1] for r in px}}
    want = Counter((d, c, at[c].index(x), at[c].index(y), norm(v)) for d, c, x, y, v in px)
    got = Counter((*tuple(r)[:4], norm(r["v"])) for r in base.queries()["gap_free_matrix"](spark, sf).collect())
    assert got == want and max(b for r in px for b in r[2:4]) >= views.BINS - 3
