import duckdb
import pytest

from sketchloom import catalog

from .oracle import connection, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, sf_dir, name):
    ours = catalog.QUERIES[name](spark, sf_dir).toPandas()
    theirs = connection(sf_dir).sql(catalog.ORACLE_SQL[name]).df()
    assert rows(ours) == rows(theirs)


def test_every_query_has_a_counterpart():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_removals_with_more_users_than_the_filter_is_made_for(spark, tmp_path):
    """30,000 users are added to a filter for 20,000, which alone names 34 others too."""
    spark.range(90_000).withColumnRenamed("id", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    ours = catalog.QUERIES["counting_bloom_removals"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows(ours) == rows(con.sql(catalog.ORACLE_SQL["counting_bloom_removals"]).df())
