"""The registered queries of the graph engine over the order graph, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .plans import All
from .plans.expr import author, description
from .sources import RevGraph, order_graph, read_table

GRAPH = """
    revs AS (SELECT CAST(o_orderkey AS BIGINT) AS rev FROM orders),
    edges AS (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS child, CAST(o_orderkey AS BIGINT) // x AS parent FROM orders, (VALUES (2), (3)) v(x) WHERE o_orderkey >= 1),
    commits AS (SELECT CAST(o_orderkey AS BIGINT) AS rev, c_name AS author_name, lower(c_name) || '@example.com' AS author_email,
        o_orderpriority || ' ' || o_orderstatus AS description FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def _with(body: str, *tables: str) -> str:
    return f"WITH RECURSIVE {', '.join([GRAPH, *tables])} {body}"


def _set(name: str, seeds: str, up: bool = False) -> str:
    """A closure as a recursive table."""
    source, target = ("parent", "child") if up else ("child", "parent")
    return f"{name} AS ({seeds} UNION SELECT {target} FROM {name} JOIN edges ON {source} = {name}.rev)"


def _steps(name: str, seeds: str, most: int, up: bool = False) -> str:
    """Walks with their lengths, up to `most`."""
    source, target = ("parent", "child") if up else ("child", "parent")
    return f"{name} AS (SELECT rev, 0 AS n FROM ({seeds}) UNION SELECT {target}, n + 1 FROM {name} JOIN edges ON {source} = {name}.rev WHERE n < {most})"


def _values(*revs: int) -> str:
    return f"SELECT CAST(rev AS BIGINT) AS rev FROM (VALUES {', '.join(f'({r})' for r in revs)}) s(rev)"


TOP = "SELECT max(rev) AS rev FROM revs"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    """Registers a function of a graph under its name."""

    def register(f: Callable[[RevGraph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(order_graph(spark, folder))
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table_query(sql: str):
    """The same for a function of a session and a folder."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _top(g: RevGraph) -> DataFrame:
    return g.revs.agg(F.max("rev").alias("rev"))


@_query(_values(2, 3, 5))
def constant_set(g):
    return ops.constant(g.spark, [5, 2, 3, 3])


@_query(_with("SELECT rev FROM revs"))
def all_revs(g):
    return g.query("all()")


@_query(_with("SELECT rev FROM revs WHERE rev BETWEEN 100 AND 250"))
def scan_range(g):
    return ops.scan(g.revs, "rev", 100, 250)


@_query(_with("SELECT child, parent FROM edges WHERE child BETWEEN 10 AND 500"))
def edge_scan_range(g):
    return ops.constrain(g.edges, "child", ops.ValueRange(10, 500))


@_query(_with("SELECT parent, child FROM edges WHERE parent >= 40 ORDER BY parent, child"))
def index_scan(g):
    backwards = ops.index(g.edges.select("parent", "child"), "parent", "child")
    return ops.constrain(backwards, "parent", ops.ValueRange(40, 90).intersect(ops.ValueRange(40).open_above()).open_above())


@_table_query(f"WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderkey > o_custkey), c AS ({_values(1, 2)} UNION SELECT CAST(b AS BIGINT) FROM c JOIN l ON l.a = c.rev) SELECT rev FROM c")
def closure_custom_edges(spark, folder):
    """Over a relation that is no revision graph: customers lead to their later orders."""
    orders = read_table(spark, folder, "orders").where("o_orderkey > o_custkey").select(F.col("o_custkey").cast("long").alias("a"), F.col("o_orderkey").cast("long").alias("b"))
    return ops.closure(ops.constant(spark, [1, 2]), orders, "a", "b")


@_query(_with("SELECT rev FROM a", _set("a", TOP)))
def ancestors(g):
    return ops.ancestors(_top(g), g.edges)


@_query(_with("SELECT rev FROM d", _set("d", _values(5), up=True)))
def descendants(g):
    return ops.descendants(ops.constant(g.spark, [5]), g.edges)


@_query(_with("SELECT rev FROM a", _set("a", "SELECT rev FROM revs WHERE rev % 10 = 7")))
def ancestors_many(g):
    return ops.ancestors(ops.keep(g.revs, "rev % 10 = 7"), g.edges)


@_query(_with("SELECT rev FROM d", _set("d", _values(5), up=True)))
def descendants_rounds(g):
    """The distributed rounds, whatever the number of edges."""
    return ops.closure(ops.constant(g.spark, [5]), g.edges, "parent", "child", local=False)


@_query(_with("SELECT DISTINCT rev FROM a WHERE n = 1", _steps("a", "SELECT rev FROM revs WHERE rev % 3 = 1", 1)))
def ancestors_gen_1_1(g):
    return ops.ancestors(ops.keep(g.revs, "rev % 3 = 1"), g.edges, 1, 1)


@_query(_with("SELECT DISTINCT rev FROM d WHERE n >= 2", _steps("d", _values(5, 7), 3, up=True)))
def descendants_gen_2_3(g):
    return ops.descendants(ops.constant(g.spark, [5, 7]), g.edges, 2, 3)


@_query(_with("SELECT rev FROM a", _steps("s", TOP, 2), _set("a", "SELECT DISTINCT rev FROM s WHERE n = 2")))
def ancestors_gen_2_open(g):
    return ops.ancestors(_top(g), g.edges, 2)


@_query(_with("SELECT DISTINCT rev FROM d WHERE n >= 1", _steps("d", _values(5), 4, up=True)))
def descendants_lazy_plan(g):
    """A bounded walk as one lazy plan, whatever the number of edges."""
    return ops.descendants(ops.constant(g.spark, [5]), g.edges, 1, 4, None)


@_query(_with("SELECT rev FROM d JOIN a USING (rev)", _set("d", _values(5), up=True), _set("a", TOP)))
def dag_range(g):
    return ops.dag_range(ops.constant(g.spark, [5]), _top(g), g.edges)


@_query(_with("SELECT rev FROM d JOIN a USING (rev)", _set("d", _values(3, 5, 11), up=True), _set("a", "SELECT rev FROM revs WHERE rev % 100 = 99")))
def dag_range_multi(g):
    return ops.dag_range(ops.constant(g.spark, [3, 5, 11]), ops.keep(g.revs, "rev % 100 = 99"), g.edges)


@_query(_with("SELECT rev FROM revs WHERE rev NOT IN (SELECT parent FROM edges)"))
def heads(g):
    return ops.heads(g.revs, g.edges)


@_query(_with("SELECT rev FROM x WHERE rev NOT IN (SELECT child FROM edges WHERE parent IN (SELECT rev FROM x))", "x AS (SELECT rev FROM revs WHERE rev BETWEEN 20 AND 300)"))
def roots(g):
    return ops.roots(ops.scan(g.revs, "rev", 20, 300), g.edges)


@_query(_with("SELECT rev FROM x WHERE rev NOT IN (SELECT rev FROM s)", "x AS (SELECT rev FROM revs WHERE rev % 4 = 1)", _set("s", "SELECT DISTINCT parent AS rev FROM edges WHERE child IN (SELECT rev FROM x)")))
def heads_transitive(g):
    return ops.heads(ops.keep(g.revs, "rev % 4 = 1"), g.edges, transitive=True)


@_query(_with("SELECT rev, parent FROM revs JOIN edges ON rev = child WHERE rev BETWEEN 50 AND 90"))
def parents_of(g):
    return ops.parents_of(ops.scan(g.revs, "rev", 50, 90), g.edges)


@_query(_with("SELECT rev FROM revs WHERE rev % 5 = 0 UNION SELECT rev FROM revs WHERE rev % 7 = 0 UNION SELECT rev FROM revs WHERE rev < 20"))
def union_n(g):
    return ops.union(ops.keep(g.revs, "rev % 5 = 0"), ops.keep(g.revs, "rev % 7 = 0"), ops.scan(g.revs, "rev", None, 19))


@_query(_with("SELECT rev FROM revs WHERE rev % 2 = 0 AND rev % 3 = 0 AND rev > 30"))
def intersection_n(g):
    return ops.intersection(ops.keep(g.revs, "rev % 2 = 0"), ops.keep(g.revs, "rev % 3 = 0"), ops.scan(g.revs, "rev", 31))


@_query(_with("SELECT rev FROM revs WHERE rev % 2 = 0 AND rev % 3 <> 0"))
def difference(g):
    return ops.difference(ops.keep(g.revs, "rev % 2 = 0"), ops.keep(g.revs, "rev % 3 = 0"))


@_table_query("SELECT CAST(o_orderkey AS BIGINT) AS key, o_orderstatus AS lv, CAST(l_linenumber AS BIGINT) AS rv FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def merge_join(spark, folder):
    left = read_table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_orderstatus").alias("lv"))
    right = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_linenumber").cast("long").alias("rv"))
    return ops.merge_join(left, right)


@_query(_with("SELECT rev // 10 AS rev FROM revs"))
def map_project(g):
    return ops.project(g.revs, F.floor(F.col("rev") / 10).cast("long").alias("rev"))


@_query(_with("SELECT rev FROM revs WHERE rev % 2 = 0"))
def filter_even(g):
    return ops.keep(g.revs, "rev % 2 = 0")


@_query(_with("SELECT rev FROM revs WHERE rev <= 500 ORDER BY rev"))
def reverse_order(g):
    return ops.reverse(ops.scan(g.revs, "rev", None, 500))


@_query(_with("SELECT rev FROM commits WHERE contains(author_name, '7') OR contains(author_email, '7')"))
def filter_author(g):
    return g.evaluate(All().filter([author("7")]))


@_query(_with("SELECT rev FROM commits WHERE lower(description) = '1-urgent o'"))
def filter_description(g):
    return g.evaluate(All().filter([description("1-urgent O", "exact-i")]))


@_query(_with("SELECT rev FROM commits WHERE (contains(author_name, '3') OR contains(author_email, '3')) AND contains(description, 'HIGH')"))
def filter_conjunction(g):
    return g.evaluate(All().filter([author("3"), description("HIGH")]))


@_query(_with("SELECT rev FROM d JOIN a USING (rev)", _set("d", _values(5), up=True), _set("a", _values(1499))))
def revset_range(g):
    return g.query("5:: & ::1499")


@_query(_with("SELECT rev FROM a", _set("a", _values(700, 901))))
def revset_joined_ancestors(g):
    return g.query("::700 | ::901")


@_query(_with("SELECT rev FROM a JOIN commits USING (rev) WHERE contains(author_name, '1') OR contains(author_email, '1')", _set("a", _values(1234))))
def revset_author(g):
    return g.query('::1234 & author("1")')


@_query(_with("SELECT rev FROM d WHERE rev NOT IN (SELECT parent FROM edges WHERE child IN (SELECT rev FROM d))", _set("d", _values(100), up=True)))
def revset_heads(g):
    return g.query("heads(100::)")


@_query(_with("SELECT rev FROM a WHERE rev NOT IN (SELECT rev FROM b)", _set("a", _values(1400)), _set("b", _values(700))))
def revset_difference(g):
    return g.query("::1400 ~ ::700")


@_query(_with("SELECT DISTINCT rev FROM a WHERE n = 2", _steps("a", "SELECT rev FROM revs WHERE rev IN (900, 901)", 2)))
def revset_grandparents(g):
    return g.query("(900 | 901)--")


@_query(_with("SELECT DISTINCT rev FROM a", _steps("a", _values(1000), 3)))
def revset_generations(g):
    return g.query("ancestors(1000, 4)")


@_query(_with("SELECT rev FROM commits WHERE rev NOT IN (SELECT rev FROM d) AND description LIKE '%LOW F%'", _set("d", _values(6), up=True)))
def revset_description_difference(g):
    return g.query('description(substring:"LOW F") ~ 6::')


@_query(_with("SELECT rev FROM revs WHERE false"))
def revset_none(g):
    return g.query("none()")


@_query(_with("SELECT rev FROM revs WHERE rev NOT IN (SELECT rev FROM d)", _set("d", _values(3), up=True)))
def revset_complement(g):
    return g.query("~(3::)")


@_query(_with("SELECT DISTINCT child AS rev FROM edges WHERE parent IN (40, 41)"))
def revset_next(g):
    return g.query("(40 | 41)+")


@_query(_with("SELECT DISTINCT child AS rev FROM edges WHERE parent BETWEEN 200 AND 202"))
def revset_children(g):
    return g.query("children(200 | 201 | 202)")


@_query(_with("SELECT DISTINCT rev FROM s WHERE n BETWEEN 2 AND 3", _steps("s", _values(9), 3, up=True)))
def revset_up(g):
    return g.query("up(9, 2, 3)")


@_query(_with("SELECT DISTINCT rev FROM s WHERE n BETWEEN 1 AND 4", _steps("s", _values(1300, 1301), 4)))
def revset_down(g):
    return g.query("down(1300 | 1301, 1, 4)")


@_query(_with("SELECT rev FROM commits WHERE contains(author_name, '00000012')"))
def revset_author_name(g):
    return g.query('author_name("00000012")')


@_query(_with("SELECT rev FROM commits WHERE contains(lower(author_email), '7@example')"))
def revset_author_email(g):
    return g.query('author_email(substring-i:"7@EXAMPLE")')


@_query(_with("SELECT rev FROM commits WHERE description = '2-HIGH O'"))
def revset_description_exact(g):
    return g.query('description(exact:"2-HIGH O")')
