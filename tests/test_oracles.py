"""Every query against its SQL, and against itself under other partitionings."""

import duckdb
import pytest

from quarry.plans import catalogue, catalogue_layouts, catalogue_runs, catalogue_subwords  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted(tuple("NULL" if v is None else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = sql.sql(catalogue.ORACLES[name])
    assert columns == sorted(relation.columns)
    expected = sql.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert rows_of(tuple(r) for r in df.select(*columns).collect()) == rows_of(expected)


@pytest.mark.parametrize("name", ["dedup_validation_first", "dedup_none", "split_set", "one_query_per_document", "hash_ids", "semantic_ids", "ranking_metrics", "document_repeat_shard"])
def test_results_do_not_depend_on_partitions(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows_of(tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
