"""The driver's contract."""

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_queries_have_sql():
    from revlattice import queries

    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert len(queries.QUERIES) >= 38
