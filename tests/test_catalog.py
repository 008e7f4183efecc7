"""Each query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evalguard.operators import duplicates
from evalguard.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    def one(x):
        if x is None or x != x:
            return "null"
        return str(round(float(x), 5)) if isinstance(x, float) else str(x.item() if hasattr(x, "item") else x)
    return list(df.columns), sorted(tuple(one(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"audit_findings"}))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLES[name]).df())


def test_resplit_keeps_rows_and_entities(spark):
    rows = QUERIES["resplit_by_entity"](spark, SF).toPandas()
    assert len(rows) == 1500 and rows.groupby("o_custkey")["split"].nunique().max() == 1


def test_a_whole_audit_equals_sql(spark):
    """At the size where no statistical rule finds anything: its SQL names the others."""
    c = duckdb.connect()
    c.sql("create view orders as select * from '/root/testdata/sf0.01/orders.parquet'")
    assert plain(QUERIES["audit_findings"](spark, "/root/testdata/sf0.01").toPandas()) == plain(c.sql(ORACLES["audit_findings"]).df())


@pytest.fixture(scope="module")
def odd_vectors(tmp_path_factory):
    """Copies of vectors near others, a missing one, short ones, components that are missing, not finite or zeros of both signs."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 64)).round(3)
    rows = []
    for v in base:
        for flips in (0, 0, 0, 0, 0, 3, 3, 9, 14):
            w = v.copy()
            w[rng.choice(64, flips, replace=False)] *= -1
            rows.append(w.tolist())
    zeros = [0.0, -0.0] * 32
    rows += [None, [], [1.0], [None, 1.0, 2.0], [float("nan")] * 3 + [-1.0] * 61, zeros, zeros[::-1], [-1.0] * 60 + [1.0] * 4, base[0].tolist() + [5.0]]
    ids = [int(x) for x in rng.permutation(len(rows))]
    folder = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"vec_id": pa.array([*ids, None], pa.int64()), "embedding": pa.array([*rows, base[1].tolist()], pa.list_(pa.float32())), "label": pa.array([0] * (len(rows) + 1), pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["dd004_closest", "dd004_pair_counts", "dd004_near_pairs"])
def test_near_vectors_equal_sql_on_odd_input(spark, odd_vectors, monkeypatch, name):
    monkeypatch.setattr(duplicates, "BLOCK", 16)  # several blocks
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{odd_vectors}/embeddings.parquet'")
    assert plain(QUERIES[name](spark, odd_vectors).toPandas()) == plain(c.sql(ORACLES[name]).df())
