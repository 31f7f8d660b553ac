import duckdb
import pandas as pd
import pytest

from rillstone import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: "" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(catalogue.SQL[name]).df())


def test_arrays_of_floats_equal_sql(spark, tmp_path):
    """Halves in single precision, lists shorter than what is taken from them, nulls inside and instead of them."""
    vectors = [[0.1, -0.2765, 0.2785, -0.1305], [0.5, 0.0005, -0.0015, 0.5], [0.25], [], None, [None, 0.1235, None, 0.1235], [0.1, 0.2, None, 0.3]]
    spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, catalogue.fn_array(spark, str(tmp_path)).collect()), key=str) == sorted(c.execute(catalogue.SQL["fn_array"]).fetchall(), key=str)
