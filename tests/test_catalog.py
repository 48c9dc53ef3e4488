import os

import duckdb
import pytest

from gradlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "supplier", "customer", "events", "embeddings")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(None if v is None else round(float(v), 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.WITH_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = duck.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(sql)


def test_few_columns_are_read(spark, capsys):
    from gradlens.operators.moments import moment_aggregates

    catalog.samples(spark, SF).agg(*moment_aggregates("g", 2)).explain("formatted")
    plan = capsys.readouterr().out
    assert "l_comment" not in plan and "PythonUDF" not in plan and "l_shipmode" not in plan


def test_entry_without_text_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2 and set(catalog.queries()) <= set(e.queries())
