"""Each registered query of the field operators against its SQL."""

import duckdb
import pytest

from gridloom import queries

from .oracle import answer, rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if name in queries.ORACLE_SQL:
        expected = answer(queries.ORACLE_SQL[name], sf_dir)
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(
    "events",
    [
        "('a', 1, 5.0), ('a', 7, NULL), ('a', 13, 9.0), ('a', 19, 2.0)",  # a masked slot is no maximum
        "('a', 1, 5.0), ('b', 1, NULL), ('b', 7, NULL), (NULL, NULL, NULL)",  # nothing but masked slots: no row
        "('a', 1, 5.0), ('a', 7, 'nan'::double), ('a', 13, 9.0), ('a', 19, 'nan'::double)",  # NaN is greatest
        "('a', NULL, 9.0), ('a', 7, 9.0), ('a', 13, 9.0), ('b', NULL, 9.0), ('b', 1, 3.0)",  # times that are not known
        "('a', 7, -0.0), ('a', 13, 0.0), ('a', 19, '-inf'::double)",
    ],
)
def test_hour_of_maximum_of_odd_rows(spark, tmp_path, events):
    with duckdb.connect() as connection:
        connection.sql(f"create table events as select event_type, timestamp '2024-01-01' + h * interval 1 hour as ts, CAST(v AS DOUBLE) AS value from (values {events}) as e(event_type, h, v)")
        connection.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
        expected = connection.sql(queries.ORACLE_SQL["hour_of_maximum"]).df()
    assert rows(queries.QUERIES["hour_of_maximum"](spark, str(tmp_path)).toPandas()) == rows(expected)
