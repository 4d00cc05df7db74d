"""Registered queries of the inventory against DuckDB, and the coverage of the inventory."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(name for name in entry.oracle_sql() if re.match(r"o\d+_", name))
# All take some ten minutes; SPANLOOM_ALL_ORACLES=1 runs them, else these.
SAMPLE = ["o13_token_recovery", "o24_joint_to_words", "o35_modal_tag", "o48_adjacency_entropy", "o53_occ_hit", "o59_dict_features",
          "o69_stratified_kfold", "o77_bidirectional_match", "o80_char2vec", "o83_viterbi", "o89_category_metrics", "o94_token_ids",
          "o96_mlm_mixed", "o99_negative_spans"]


def test_every_inventory_row_has_a_query():
    names = {name for name in entry.queries() if re.match(r"o\d+_", name)}
    assert {int(re.match(r"o(\d+)_", name).group(1)) for name in names} == set(range(1, 104))
    assert names == set(NAMES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES if os.environ.get("SPANLOOM_ALL_ORACLES") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(row[names.index(c)] for c in cols) for row in res.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["word", "occ", "hit", "p_g", "value"] and df.count() > 0
