"""Every registered query of the core against its SQL twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from leafmill import plans

SKIP_TYPES = ("array", "map", "struct", "decimal")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    assert not [c for c, t in df.dtypes if t.startswith(SKIP_TYPES)]
    found = df.toPandas()
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        for c in found.columns:  # the same number in int and float columns
            if pd.api.types.is_numeric_dtype(found[c]) and pd.api.types.is_numeric_dtype(want[c]) and not pd.api.types.is_bool_dtype(found[c]):
                found[c], want[c] = found[c].astype(float), want[c].astype(float)
        assert rows(found) == rows(want)


@pytest.mark.parametrize(("name", "empty"), [("f5_reorder_keypoints", True), ("f15_label_line", False)])
def test_halves_are_written_as_the_twin_writes_them(spark, tmp_path, name, empty):
    vectors = [(i, [((i + j) % 64 - 32) / 512.0 for j in range(16)], i % 10) for i in range(200)] + [(200, None, 1)] * empty
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found, want = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert len(found) == len(vectors) and rows(found) == rows(want)


def test_entry_runs_without_the_llm_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(plans.QUERIES) <= set(e.queries()) and set(plans.ORACLES) <= set(e.oracle_sql())
