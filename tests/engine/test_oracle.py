"""Engine queries against the same queries as SQL, over the smallest driver tables."""

from pathlib import Path

import pytest

from lattisphere.plans import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.queries()))
def test_matches_sql(spark, duck, name):
    mine = queries.queries()[name](spark, SF).toPandas()
    other = duck.execute(oracle.queries()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert len(mine) == len(other) and (order(mine) == order(other)).all(axis=None)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.queries())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_clustering_takes_all_ranks(spark):
    from lattisphere.operators.ids import clustering_ids
    from lattisphere.options import IdOptions

    ids = lambda df: {r.structure_id: r.graph_id for r in df.collect()}
    made = lambda **k: ids(clustering_ids(*queries.crystals(spark, SF), IdOptions(**k), base_cutoff=queries.REACH))
    found = ids(queries.queries()["clustering_ids"](spark, SF))
    assert found == made() != made(rank_k=2)
