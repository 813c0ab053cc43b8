"""The registered queries of the library, each with the SQL that gives the same rows.

Every query runs over its whole tables. Sums of doubles are rounded, as their last digits depend on the order.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import examples
from .functions.algebra import MAX, MIN, NULL_SUM, SUM, Ext, Map, Plus, Times, binned, keep_where, only
from .operators import graph, linalg, merge, ranges
from .plans.nodes import Data, Empty, Frame, Node, reset_to_defaults
from .plans.plantext import Compiler
from .plans.rewrite import discard_defaults
from .plans.schema import DOUBLE, INT, LONG, NDOUBLE, STRING, Key, Schema, Val
from .sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str, keys: dict, vals: dict) -> Node:
    """A node over a table; vals: name to (type, default)."""
    schema = Schema([Key(k, t) for k, t in keys.items()], [Val(v, *t) if isinstance(t, tuple) else Val(v, t) for v, t in vals.items()])
    return Frame(_read(spark, sf_dir, name), schema)


def _sensors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two sensors out of events: even and odd users; t in milliseconds, c the event type."""
    events = _read(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("c"), F.col("value").alias("v"), F.col("user_id").alias("u"))
    return {name: events.where(F.col("u") % 2 == odd).select("t", "c", "v") for odd, name in enumerate(("sensorA", "sensorB"))}


def _rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (row, col, val): row vec_id, col the dimension."""
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val")).select("row", "col", F.col("val").cast("double").alias("val"))


_MATRIX_SQL = "m AS (SELECT vec_id AS row, unnest(range(0, len(embedding)))::INT AS col, unnest(embedding)::DOUBLE AS val FROM embeddings)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.lit(1).cast("long").alias("val"))


# --- core algebra


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
def map_replace(spark, sf_dir):
    t = _table(spark, sf_dir, "documents", {"doc_id": LONG}, {"text": STRING})
    return t.map(Map("replace", t.schema.vals, lambda row: {"text": F.replace(row["text"], F.lit("the"), F.lit("THE"))})).frame()


@query("SELECT word, count(*)::INT AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def word_count(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text")
    return examples.word_count().bind({"documents": docs}).frame()


@query("SELECT l_orderkey, l_linenumber, k AS part, CASE k WHEN 0 THEN l_quantity ELSE l_tax END AS x FROM lineitem, (SELECT unnest([0, 1]) AS k)")
def ext_two_rows(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem", {"l_orderkey": LONG, "l_linenumber": INT}, {"l_quantity": DOUBLE, "l_tax": DOUBLE})
    return t.ext(Ext("parts", Schema([Key("part", INT)], [Val("x", DOUBLE)]), lambda row: [{"part": F.lit(0), "x": row["l_quantity"]}, {"part": F.lit(1), "x": row["l_tax"]}])).frame()


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer")
def filter_as_default(spark, sf_dir):
    t = _table(spark, sf_dir, "customer", {"c_custkey": LONG}, {"c_acctbal": DOUBLE})
    return t.map(keep_where("positive", t.schema.vals, lambda row: row["c_acctbal"] > 0)).frame()


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def filter_as_default_then_sum(spark, sf_dir):
    t = _table(spark, sf_dir, "customer", {"c_nationkey": INT, "c_custkey": LONG}, {"c_acctbal": (NDOUBLE, None)})
    plan = t.map(keep_where("positive", t.schema.vals, lambda row: row["c_acctbal"] > 0)).agg(["c_nationkey"], {"c_acctbal": NULL_SUM})
    return _rounded(discard_defaults(plan).frame(), 2, "c_acctbal")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, max(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL")
def agg_sum_max_min(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem", {"l_returnflag": STRING, "l_linestatus": STRING}, {"l_quantity": (DOUBLE, 0.0), "l_extendedprice": NDOUBLE, "l_discount": NDOUBLE})
    return _rounded(t.agg(["l_returnflag", "l_linestatus"], {"l_quantity": Plus("+", 0.0, SUM.aggregate), "l_extendedprice": MAX, "l_discount": MIN}).frame(), 2, "l_quantity")


@query("SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1 UNION ALL SELECT o_custkey, '*' FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def agg_user_defined_plus(spark, sf_dir):
    """A user's own commutative addition: equal values stay, different ones become "*"."""
    t = _table(spark, sf_dir, "orders", {"o_custkey": LONG, "o_orderkey": LONG}, {"o_orderpriority": STRING})
    same = Plus.of("same", "", lambda a, b: F.when((a == "") | (a == b), b).when(b == "", a).otherwise(F.lit("*")))
    return t.agg(["o_custkey"], {"o_orderpriority": same}).frame()


@query("SELECT k, max(v) AS v FROM (SELECT o_orderkey AS k, o_custkey AS v FROM orders UNION ALL SELECT l_orderkey, 0 FROM lineitem) GROUP BY k")
def agg_error_plus(spark, sf_dir):
    """At most one value other than the default for a key: an order's customer, beside the defaults of its lines; a second one would fail the query."""
    both = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(-1).alias("line"), F.col("o_custkey").alias("v"))
    both = both.union(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0)))
    return Frame(both, Schema([Key("k", LONG), Key("line", INT)], [Val("v", LONG, 0)])).agg(["k"], {"v": only(0)}).frame()


@query("SELECT c_nationkey, coalesce(min(CASE WHEN c_acctbal <> 0 THEN c_acctbal END), 0.0)::DOUBLE AS c_acctbal FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer) GROUP BY c_nationkey")
def agg_with_other_identity(spark, sf_dir):
    """The smallest balance above 5000 by nation, with 0 as the neutral value of min."""
    t = _table(spark, sf_dir, "customer", {"c_nationkey": INT, "c_custkey": LONG}, {"c_acctbal": DOUBLE})
    kept = t.map(keep_where("rich", t.schema.vals, lambda row: row["c_acctbal"] > 5000))
    return kept.agg(["c_nationkey"], {"c_acctbal": MIN.with_identity(0.0)}).frame()


@query("SELECT k, v FROM (VALUES ('a', 3::BIGINT), ('b', 5)) t(k, v)")
def rows_in_memory(spark, sf_dir):
    """Rows given as dicts and tuples, equal keys summed."""
    schema = Schema([Key("k", STRING)], [Val("v", LONG)])
    return Data(schema, ({"k": "a", "v": 1}, ("a", 2))).union(Data(schema, (("b", 5),)), {"v": SUM}).frame()


@query("SELECT sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem HAVING count(*) > 0")
def agg_global(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem", {"l_orderkey": LONG}, {"l_linenumber": (LONG, 0)}).agg([], {"l_linenumber": SUM}).frame()


@query("SELECT sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem WHERE false HAVING count(*) > 0")
def agg_global_of_empty(spark, sf_dir):
    return Empty(Schema([Key("k", LONG)], [Val("l_linenumber", LONG)])).agg([], {"l_linenumber": SUM}).frame()


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
def mean_in_two_steps(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem", {"l_returnflag": STRING, "l_orderkey": LONG}, {"l_quantity": NDOUBLE}).rename({"l_quantity": "v"})
    return _rounded(t.map(examples.COUNTED).agg(["l_returnflag"], {"v": NULL_SUM, "cnt": SUM}).map(examples.MEAN).frame(), 6, "v")


@query("SELECT k, round(sum(v), 2) AS v, sum(n)::INT AS n FROM (SELECT c_nationkey AS k, c_acctbal AS v, 1 AS n FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 0 FROM supplier) GROUP BY k")
def union_with_padding(spark, sf_dir):
    """Customers' and suppliers' balances by nation; only the left side has n."""
    c = Frame(_read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).alias("n")), Schema([Key("k", INT)], [Val("v", NDOUBLE), Val("n", INT)]))
    s = Frame(_read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")), Schema([Key("k", INT)], [Val("v", NDOUBLE)]))
    return _rounded(c.union(s, {"v": NULL_SUM, "n": SUM}).frame(), 2, "v")


@query("SELECT custkey, round(sum(v), 2) AS v FROM (SELECT o_custkey AS custkey, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer) GROUP BY custkey")
def union_on_key_prefix(spark, sf_dir):
    o = Frame(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("v")), Schema([Key("custkey", LONG), Key("orderkey", LONG)], [Val("v", NDOUBLE)]))
    c = Frame(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("v")), Schema([Key("custkey", LONG)], [Val("v", NDOUBLE)]))
    return _rounded(o.union(c, {"v": NULL_SUM}, strict=True).frame(), 2, "v")


@query("SELECT c_nationkey AS nation, c_custkey AS c, s_suppkey AS s, c_acctbal * s_acctbal AS v FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_shared_values(spark, sf_dir):
    c = _table(spark, sf_dir, "customer", {"c_nationkey": INT, "c_custkey": LONG}, {"c_acctbal": NDOUBLE}).rename({"c_nationkey": "nation", "c_custkey": "c", "c_acctbal": "v"})
    s = _table(spark, sf_dir, "supplier", {"s_nationkey": INT, "s_suppkey": LONG}, {"s_acctbal": NDOUBLE}).rename({"s_nationkey": "nation", "s_suppkey": "s", "s_acctbal": "v"})
    return c.join(s, {"v": examples.MULTIPLY}).frame()


@query("SELECT r_regionkey, n_nationkey, greatest(length(r_name), length(n_name))::BIGINT AS v FROM region, nation")
def join_cartesian(spark, sf_dir):
    length = lambda name, key: Frame(_read(spark, sf_dir, name).select(key, F.length(f"{name[0]}_name").cast("long").alias("v")), Schema([Key(key, INT)], [Val("v", LONG)]))
    longer = Times.annihilating("max", 0, 0, LONG, F.greatest, 0)
    return length("region", "r_regionkey").join(length("nation", "n_nationkey"), {"v": longer}).frame()


@query("SELECT l_orderkey AS orderkey, l_linenumber AS line, c_custkey AS custkey, c_mktsegment AS segment, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def join_three_tables(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    return merge.merge([merge.merge([l, o], ["orderkey"]), c], ["custkey"]).select("orderkey", "line", "custkey", "segment", "quantity")


@query("SELECT c_custkey AS custkey, c_acctbal AS acctbal, o_orderkey AS orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_emit_no_matches(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return merge.merge([c, o], ["custkey"], [0])


@query("SELECT k, a, b, c FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) USING (k) FULL JOIN (SELECT n_nationkey AS k, n_name AS c FROM nation) USING (k)")
def align_three_tables(spark, sf_dir):
    a = _read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    c = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("c"))
    return merge.merge([a, b, c], ["k"], [0, 1, 2])


@query("SELECT l_suppkey AS l_partkey, l_partkey AS l_suppkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL")
def rename_swap_and_sort(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem", {"l_partkey": LONG, "l_suppkey": LONG, "l_orderkey": LONG}, {"l_quantity": (LONG, 0)})
    swapped = t.rename({"l_partkey": "l_suppkey", "l_suppkey": "l_partkey", "l_quantity": "q"})
    return swapped.sort(["l_partkey", "l_suppkey", "l_orderkey"]).agg(["l_partkey", "l_suppkey"], {"q": SUM}).frame()


@query("SELECT s_suppkey, 0.0::DOUBLE AS s_acctbal FROM supplier")
def values_to_defaults(spark, sf_dir):
    t = _table(spark, sf_dir, "supplier", {"s_suppkey": LONG}, {"s_acctbal": DOUBLE})
    return t.map(reset_to_defaults(t.schema)).frame()


@query("SELECT DISTINCT o_custkey FROM orders")
def dedup_keys(spark, sf_dir):
    """One row for each of the keys, of which most come with many orders."""
    return _table(spark, sf_dir, "orders", {"o_custkey": LONG}, {"o_orderkey": LONG}).dedup_keys().frame().select("o_custkey")


# --- bins, covariance, matrices


@query("SELECT t, t - t % 60000 + CASE WHEN t % 60000 >= 30000 THEN 60000 ELSE 0 END AS bin_60, t - t % 120000 + CASE WHEN t % 120000 >= 60000 THEN 120000 ELSE 0 END AS bin_120 FROM (SELECT (epoch_us(ts) // 1000) AS t FROM events)")
def time_bins(spark, sf_dir):
    t = _read(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return t.select("t", binned(F.col("t"), 60_000).alias("bin_60"), binned(F.col("t"), 120_000).alias("bin_120"))


def _covariance_sql(size: int, upper: bool, names: tuple[str, str, str], digits: int = 3) -> str:
    a, b, v = names
    return f"""
WITH e AS (SELECT (epoch_us(ts) // 1000) AS t0, event_type AS c, value AS v, user_id % 2 AS s FROM events),
b AS (SELECT t0 - t0 % {size} + CASE WHEN t0 % {size} >= {size // 2} THEN {size} ELSE 0 END AS t, c, s, avg(v) AS v FROM e GROUP BY ALL),
x AS (SELECT l.t, l.c, l.v - r.v AS v FROM b l JOIN b r ON l.t = r.t AND l.c = r.c AND l.s = 0 AND r.s = 1),
u AS (SELECT t, c, v - avg(v) OVER (PARTITION BY c) AS v FROM x),
n AS (SELECT count(DISTINCT t) AS n FROM x)
SELECT l.c AS "{a}", r.c AS "{b}", round(sum(l.v * r.v) / (max(n.n) - 1), {digits}) AS "{v}" FROM u l JOIN u r ON l.t = r.t {"AND l.c <= r.c" if upper else ""}, n GROUP BY 1, 2"""


@query(_covariance_sql(120_000, False, ("c", "c'", "v")))
def covariance_api(spark, sf_dir):
    """The flagship: covariances of event types' differences between even and odd users, as one plan of the algebra."""
    return _rounded(examples.covariance().bind(_sensors(spark, sf_dir)).frame(), 3, "v")


@query(_covariance_sql(120_000, True, ("c", "c'", "v")))
def covariance_api_symmetric(spark, sf_dir):
    return _rounded(examples.covariance(symmetric=True).bind(_sensors(spark, sf_dir)).frame(), 3, "v")


@query(_covariance_sql(60_000, False, ("row", "col", "val")))
def covariance_kernels(spark, sf_dir):
    s = _sensors(spark, sf_dir)
    return _rounded(linalg.covariance(s["sensorA"], s["sensorB"], "D"), 3, "val")


@query(_covariance_sql(60_000, True, ("row", "col", "val")))
def covariance_kernels_all_switches(spark, sf_dir):
    s = _sensors(spark, sf_dir)
    return _rounded(linalg.covariance(s["sensorA"], s["sensorB"], "ADEFMPRSZ"), 3, "val")


@query(_covariance_sql(60_000, False, ("row", "col", "val")))
def covariance_kernels_zeros_dropped(spark, sf_dir):
    """Switches R and Z alone: no covariance of these sensors is zero, so that all stay."""
    s = _sensors(spark, sf_dir)
    return _rounded(linalg.covariance(s["sensorA"], s["sensorB"], "RZ"), 3, "val")


@query(f"WITH {_MATRIX_SQL} SELECT a.col AS row, b.col AS col, round(sum(a.val * b.val), 4) AS val FROM m a JOIN m b ON a.row = b.row GROUP BY ALL")
def matrix_product(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _rounded(linalg.table_mult(m, m), 4, "val")


@query(f"WITH {_MATRIX_SQL} SELECT a.row, a.col, a.val - b.val AS val FROM m a JOIN m b ON a.row + 1 = b.row AND a.col = b.col")
def matrix_ewise(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return linalg.ewise(m, m.withColumn("row", F.col("row") - 1), lambda a, b: a - b)


@query(f"WITH {_MATRIX_SQL} SELECT col::BIGINT AS row, row AS col, val FROM m")
def matrix_transpose(spark, sf_dir):
    return linalg.transpose(_matrix(spark, sf_dir)).withColumn("row", F.col("row").cast("long"))


@query(f"WITH {_MATRIX_SQL} SELECT row, max(val) AS val FROM m GROUP BY row")
def matrix_reduce_rows(spark, sf_dir):
    return linalg.reduce_rows(_matrix(spark, sf_dir), F.max)


@query(f"WITH {_MATRIX_SQL} SELECT count(DISTINCT row)::BIGINT AS n FROM m WHERE val > 0.3 HAVING count(*) > 0")
def matrix_count_rows(spark, sf_dir):
    return linalg.count_rows(_matrix(spark, sf_dir).where("val > 0.3"))


@query("SELECT o_orderkey AS row, l_linenumber AS col_a, l_suppkey AS col_b, l_quantity * o_totalprice AS val FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def row_cartesian(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem")
    a = l.select(F.col("l_orderkey").alias("row"), F.struct("l_linenumber", "l_suppkey").alias("col"), F.col("l_quantity").alias("val"))
    b = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.lit(0).alias("col"), F.col("o_totalprice").alias("val"))
    out = linalg.row_cartesian(a, b, lambda x, y: x * y)
    return out.select("row", F.col("col_a.l_linenumber").alias("col_a"), F.col("col_a.l_suppkey").alias("col_b"), "val")


@query("SELECT event_id AS row, user_id AS col, value - 1 AS val FROM events WHERE value - 1 <> 0")
def zero_discard(spark, sf_dir):
    m = _read(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.col("user_id").alias("col"), (F.col("value") - 1).alias("val"))
    return linalg.discard_zeros(m)


# --- ranges


@query("SELECT o_orderkey FROM orders WHERE o_orderkey::VARCHAR <= '1' OR o_orderkey::VARCHAR = '3' OR o_orderkey::VARCHAR BETWEEN '5' AND '7' OR o_orderkey::VARCHAR >= '9'")
def range_string(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return ranges.range_filter(o, "k", ":,1,3,5,:,7,9,:,").drop("k")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey::VARCHAR <= '1' OR o_orderkey::VARCHAR BETWEEN '5' AND '7')")
def range_string_negated(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return ranges.range_filter(o, "k", ":,1,5,:,7,", negate=True).drop("k")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'M%' OR c_mktsegment >= 'AU' AND c_mktsegment < 'B'")
def range_string_prepended(spark, sf_dir):
    """All rows of one prefix and an open range of another."""
    wanted = ranges.RangeSet([*ranges.prepend("M", ":,").intervals, *ranges.prepend("A", "U,:,").intervals])
    return _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").where(wanted.column(F.col("c_mktsegment")))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'M%'")
def range_string_prefixes(spark, sf_dir):
    return ranges.range_filter(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "A,M,", prefixes=True)


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 2 AND 5")
def min_max_filter(spark, sf_dir):
    return ranges.min_max_filter(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", 2, 5)


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey > 10 OR l_orderkey = 10 AND l_linenumber > 2) AND l_orderkey <= 500")
def seek_key_range(spark, sf_dir):
    """A range over two key columns, pushed through a rename and an aggregation to the scan."""
    t = _table(spark, sf_dir, "lineitem", {"l_orderkey": LONG, "l_linenumber": INT}, {})
    wanted = ranges.Interval((10, 2), (500,), lo_open=True)
    return t.rename({"l_orderkey": "k"}).agg(["k", "l_linenumber"], {}).where(lambda row: wanted.column(row["k"], row["l_linenumber"])).rename({"k": "l_orderkey"}).frame()


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def column_filter(spark, sf_dir):
    return ranges.column_filter(_read(spark, sf_dir, "events"), "event_type", "click,view,").groupBy("event_type").agg(F.count("*").alias("n"))


# --- graphs


@query("SELECT l_partkey AS row, l_suppkey AS col, count(*) AS val FROM lineitem GROUP BY ALL")
def adjacency_base(spark, sf_dir):
    return graph.adjacency(_edges(spark, sf_dir))["base"]


@query("SELECT l_partkey AS row, 'out' AS col, count(*) AS val FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'in', count(*) FROM lineitem GROUP BY 1")
def adjacency_degree(spark, sf_dir):
    return graph.adjacency(_edges(spark, sf_dir))["degree"]


@query("""SELECT rpad(reverse((l_orderkey * 10 + l_linenumber)::VARCHAR), 12, '0') AS row, s || n AS col, 1::BIGINT AS val
FROM (SELECT l_orderkey, l_linenumber, unnest(['out|', 'in|']) AS s, unnest([l_partkey, l_suppkey])::VARCHAR AS n FROM lineitem)""")
def incidence_edges(spark, sf_dir):
    e = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.lit(1).cast("long").alias("val"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    return graph.incidence(e.select("row", "col", "val", "i"), F.col("i"), 12)["edge"]


@query("SELECT l_partkey AS row, 'out' AS col, count(*) AS val FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'in', count(*) FROM lineitem GROUP BY 1")
def incidence_degree(spark, sf_dir):
    return graph.incidence(_edges(spark, sf_dir))["degree"]


@query("SELECT 'out|' || l_partkey AS row, rpad(reverse((l_orderkey * 10 + l_linenumber)::VARCHAR), (SELECT max(length((l_orderkey * 10 + l_linenumber)::VARCHAR)) FROM lineitem)::INT, '0') AS col, 1::BIGINT AS val FROM lineitem UNION ALL SELECT 'in|' || l_suppkey, rpad(reverse((l_orderkey * 10 + l_linenumber)::VARCHAR), (SELECT max(length((l_orderkey * 10 + l_linenumber)::VARCHAR)) FROM lineitem)::INT, '0'), 1 FROM lineitem")
def incidence_transposed(spark, sf_dir):
    """Ids as wide as the largest number."""
    e = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.lit(1).cast("long").alias("val"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    return graph.incidence(e, F.col("i"))["transposed"]


@query("""SELECT row, col, sum(val)::BIGINT AS val FROM (
SELECT l_partkey::VARCHAR AS row, 'deg' AS col, 1 AS val FROM lineitem UNION ALL SELECT l_suppkey::VARCHAR, 'deg', 1 FROM lineitem
UNION ALL SELECT l_partkey || '|' || l_suppkey, '', 1 FROM lineitem UNION ALL SELECT l_suppkey || '|' || l_partkey, '', 1 FROM lineitem) GROUP BY ALL""")
def single_table_graph(spark, sf_dir):
    return graph.single_table(_edges(spark, sf_dir))


_CELLS_SQL = """c AS (SELECT 'order|' || o_orderkey AS row, unnest(['status|' || o_orderstatus, 'priority|' || o_orderpriority]) AS col, o_custkey AS val, unnest([o_orderkey * 2, o_orderkey * 2 + 1]) AS n FROM orders),
i AS (SELECT rpad(reverse(n::VARCHAR), (SELECT max(length(n::VARCHAR)) FROM c)::INT, '0') AS id, * FROM c)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (row, col, val, i): row "order|key", cols "status|..." and "priority|...", i a number for each."""
    cols = F.array(F.concat(F.lit("status|"), F.col("o_orderstatus")), F.concat(F.lit("priority|"), F.col("o_orderpriority")))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("val"), F.posexplode(cols).alias("p", "col"))
    return o.select(F.concat(F.lit("order|"), F.col("o_orderkey").cast("string")).alias("row"), "col", "val", (F.col("o_orderkey") * 2 + F.col("p")).alias("i"))


def _named(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables in one, with their names."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("name"), "row", "col", F.col("val").cast("long").alias("val")) for name, df in tables.items()])


@query(f"""WITH {_CELLS_SQL} SELECT 'base' AS name, row, col, sum(val)::BIGINT AS val FROM c GROUP BY row, col UNION ALL SELECT 'T', col, row, sum(val) FROM c GROUP BY row, col
UNION ALL SELECT 'Deg', row, 'deg', count(*) FROM c GROUP BY row UNION ALL SELECT 'DegT', col, 'deg', count(*) FROM c GROUP BY col
UNION ALL SELECT 'Field', split_part(row, '|', 1), 'deg', count(*) FROM c GROUP BY 2 UNION ALL SELECT 'FieldT', split_part(col, '|', 1), 'deg', count(*) FROM c GROUP BY 2
UNION ALL SELECT 'Edge', id, unnest(['deg|' || row, 'deg|' || col]), val FROM i UNION ALL SELECT 'EdgeT', unnest(['deg|' || row, 'deg|' || col]), id, val FROM i
UNION ALL SELECT 'EdgeDegT', x, 'deg', count(*) FROM (SELECT unnest([row, col]) AS x FROM c) GROUP BY x""")
def associative_nine_tables(spark, sf_dir):
    return _named(graph.associative_tables(_cells(spark, sf_dir), sum_base=True, sum_transposed=True, number=F.col("i")))


@query(f"""WITH {_CELLS_SQL} SELECT 'Deg' AS name, row, 'out' AS col, sum(val)::BIGINT AS val FROM c GROUP BY row UNION ALL SELECT 'DegT', col, 'in', sum(val) FROM c GROUP BY col
UNION ALL SELECT 'Field', split_part(row, '|', 1), 'out', sum(val) FROM c GROUP BY 2 UNION ALL SELECT 'FieldT', split_part(col, '|', 1), 'in', sum(val) FROM c GROUP BY 2
UNION ALL SELECT 'EdgeDegT', row, 'out', sum(val) FROM c GROUP BY row UNION ALL SELECT 'EdgeDegT', col, 'in', sum(val) FROM c GROUP BY col""")
def associative_tables_by_value(spark, sf_dir):
    return _named(graph.associative_tables(_cells(spark, sf_dir), ("Deg", "DegT", "Field", "FieldT", "EdgeDegT"), degree_of_values=True, out="out", into="in"))


def _triple_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Edges from customers to their orders' priorities as two sets of files, an item a line, in the order of the orders."""
    base = _scratch(spark, "triples")
    edges = _read(spark, sf_dir, "orders").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")
    edges.select(F.col("o_custkey").cast("string")).write.text(f"{base}-row")
    edges.select("o_orderpriority").write.text(f"{base}-col")
    return f"{base}-row", f"{base}-col"


@query("SELECT o_custkey::VARCHAR AS row, o_orderpriority AS col, count(*) AS val FROM orders GROUP BY ALL")
def triple_files_adjacency(spark, sf_dir):
    return graph.adjacency(files.read_triples(spark, *_triple_files(spark, sf_dir)))["base"]


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY o_orderkey)::VARCHAR AS n, o_custkey::VARCHAR AS r, o_orderpriority AS c FROM orders),
i AS (SELECT rpad(reverse(n), (SELECT max(length(n)) FROM e)::INT, '0') AS id, r, c FROM e) SELECT id AS row, unnest(['out|' || r, 'in|' || c]) AS col, 1::BIGINT AS val FROM i""")
def triple_files_incidence(spark, sf_dir):
    """Edges numbered as their lines, all files taken together."""
    return graph.incidence(files.read_triples(spark, *_triple_files(spark, sf_dir), numbered=True), F.col("n"))["edge"]


@query("""SELECT row, col, sum(val)::BIGINT AS val FROM (
SELECT unnest([o_custkey::VARCHAR, o_orderpriority]) AS row, 'deg' AS col, 1 AS val FROM orders UNION ALL SELECT unnest([o_custkey || '|' || o_orderpriority, o_orderpriority || '|' || o_custkey]), '', 1 FROM orders) GROUP BY ALL""")
def triple_files_single_table(spark, sf_dir):
    return graph.single_table(files.read_triples(spark, *_triple_files(spark, sf_dir)))


@query("WITH b AS (SELECT l_partkey AS r, l_suppkey AS c, count(*) AS v FROM lineitem GROUP BY ALL) SELECT rpad(reverse((r * 100000 + c)::VARCHAR), 16, '0') AS row, unnest(['out|' || r, 'in|' || c]) AS col, v AS val FROM b")
def incidence_of_adjacency(spark, sf_dir):
    """The incidence tables of an adjacency table, whose edges are summed already."""
    return graph.incidence(graph.adjacency(_edges(spark, sf_dir))["base"], F.col("row") * 100_000 + F.col("col"), 16)["edge"]


# --- alignment


def _cell_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three tables of cells (row, family, qualifier, value) over suppliers."""
    l = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("row"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("qualifier"), "l_linenumber")
    return [l.where(F.col("l_linenumber") == k).groupBy("row", "family", "qualifier").agg(F.count("*").alias("value")) for k in (1, 2, 3)]


def _align_sql(*keys: str) -> str:
    rest = [c for c in ("family", "qualifier") if c not in keys]
    table = lambda k: f"(SELECT {', '.join([*keys, *(f'{c} AS {c}_{k}' for c in rest)])}, value AS value_{k} FROM c WHERE l = {k + 1})"
    cells = "c AS (SELECT l_suppkey::VARCHAR AS row, l_returnflag AS family, l_linestatus AS qualifier, l_linenumber AS l, count(*) AS value FROM lineitem GROUP BY ALL)"
    return f"WITH {cells} SELECT * FROM {table(0)} JOIN {table(1)} USING ({', '.join(keys)}) JOIN {table(2)} USING ({', '.join(keys)})"


@query(_align_sql("row"))
def align_on_rows(spark, sf_dir):
    return merge.align(_cell_tables(spark, sf_dir), "row")


@query(_align_sql("row", "qualifier"))
def align_on_rows_and_qualifiers(spark, sf_dir):
    return merge.align(_cell_tables(spark, sf_dir), "row+qualifier")


@query(_align_sql("row", "family", "qualifier") + " WHERE row >= '3' AND family IN ('A', 'R')")
def align_on_all_in_a_range(spark, sf_dir):
    return merge.align(_cell_tables(spark, sf_dir), "all", ranges.Interval.at_least("3"), ["A", "R"])


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def merge_without_keys(spark, sf_dir):
    """The Cartesian product, of two tables of a few rows."""
    return merge.merge([_read(spark, sf_dir, "region").select("r_regionkey"), _read(spark, sf_dir, "nation").select("n_nationkey")], [])


# --- plan text, sources, sinks


@query("SELECT l_quantity / l_tax / 1000.0 AS rate, l_orderkey + l_partkey AS both, l_returnflag || l_linestatus AS flags, l_orderkey // 7 AS seventh, l_orderkey FROM lineitem WHERE l_orderkey > 250.5 AND l_tax > 0")
def plan_text_apply_select(spark, sf_dir):
    """A textual plan: selection over a scan, then computed columns."""
    compiler = Compiler(spark, {"public_adhoc_lineitem": _read(spark, sf_dir, "lineitem").where("l_tax > 0")})
    ref = lambda n: f"NamedAttributeRef('{n}')"
    return compiler.run(f"""Dump(Apply([('rate', DIVIDE(DIVIDE({ref('l_quantity')}, {ref('l_tax')}), NumericLiteral(1000.0))), ('both', PLUS({ref('l_orderkey')}, {ref('l_partkey')})),
        ('flags', PLUS({ref('l_returnflag')}, {ref('l_linestatus')})), ('seventh', DIVIDE({ref('l_orderkey')}, NumericLiteral(7))), ('l_orderkey', UnnamedAttributeRef(0, None))],
        Select(GT(UnnamedAttributeRef(0, None), NumericLiteral(250.5)), Scan(RelationKey('public','adhoc','lineitem'),
        Scheme([('l_orderkey', 'LONG_TYPE'), ('l_partkey', 'LONG_TYPE'), (u'l_quantity', 'DOUBLE_TYPE'), ('l_tax', 'DOUBLE_TYPE'), ('l_returnflag', 'STRING_TYPE'), ('l_linestatus', 'STRING_TYPE')]),
        (<catalog object at 0x7f>, 7), RepresentationProperties(frozenset([UnnamedAttributeRef(0, None)]), None, None)))))""").select("rate", "both", "flags", "seventh", "l_orderkey")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    """Written as delimited text with a header and read back by strict rules."""
    path = _scratch(spark, "csv")
    sinks.write_delimited(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    s = _read(spark, sf_dir, "supplier").schema
    return files.read_delimited(spark, path, [(n, s[n].dataType) for n in ("s_suppkey", "s_name", "s_acctbal")], skip=1)


@query("SELECT l_suppkey AS row, l_partkey AS col, count(*) AS val FROM lineitem GROUP BY ALL")
def transposed_write(spark, sf_dir):
    base = _scratch(spark, "base")
    sinks.write_with_reduction(graph.adjacency(_edges(spark, sf_dir))["base"], base, {"total": F.sum("val")}, base + "-T")
    return spark.read.parquet(base + "-T")


@query("SELECT p_partkey, p_size FROM part")
def table_round_trip(spark, sf_dir):
    """A table with its schema in the files."""
    path = _scratch(spark, "table")
    sinks.write_table(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), path, Schema([Key("p_partkey", LONG)], [Val("p_size", INT, 0)]))
    df, schema = sinks.read_table(spark, path)
    return Frame(df, schema).frame()


_NETFLOW = ["StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport", "State", "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes", "Label"]
_NETFLOW_TYPES = {"Dur": "DOUBLE_TYPE", "sTos": "LONG_TYPE", "dTos": "LONG_TYPE", "TotPkts": "LONG_TYPE", "TotBytes": "LONG_TYPE", "SrcBytes": "LONG_TYPE"}


def _netflow_scheme(names: list[str]) -> str:
    return "Scheme([" + ", ".join(f"('{n}', '{_NETFLOW_TYPES.get(n, 'STRING_TYPE')}')" for n in names) + "])"


def _netflow(spark: SparkSession, sf_dir: str, then) -> DataFrame:
    """Lineitems as a file of network flows, which one plan reads, extends and stores; then(compiler, relation, scan) carries on."""
    path, name = _scratch(spark, "netflow"), f"netflow_{uuid.uuid4().hex}"
    l = _read(spark, sf_dir, "lineitem")
    made = {
        "StartTime": F.lit("2011/08/18 10:19:13.328709"), "Dur": F.col("l_discount") + 1, "Proto": F.col("l_returnflag"), "SrcAddr": F.concat(F.lit("10.0.0."), F.col("l_suppkey")), "Sport": F.col("l_linenumber"),
        "Dir": F.lit("  <->"), "DstAddr": F.concat(F.lit("10.1.0."), F.col("l_partkey")), "Dport": F.lit("80"), "State": F.col("l_linestatus"), "sTos": F.lit(0), "dTos": F.lit(0), "TotPkts": F.col("l_linenumber"),
        "TotBytes": F.col("l_orderkey"), "SrcBytes": F.col("l_orderkey"), "Label": F.lit("flow=Background"),
    }
    sinks.write_delimited(l.select(*[made[n].cast("string").alias(n) for n in _NETFLOW]), path)
    compiler, ref = Compiler(spark), lambda n: f"NamedAttributeRef('{n}')"
    kept = ["SrcAddr", "DstAddr", "RATE", "Dur", "Dir", "Proto", "Sport", "Dport", "State", "sTos", "dTos", "TotPkts", "SrcBytes", "Label"]
    rate = f"DIVIDE(DIVIDE({ref('TotBytes')}, {ref('Dur')}), NumericLiteral(1000.0))"
    emitted = ", ".join(f"('{n}', {rate if n == 'RATE' else ref(n)})" for n in kept)
    compiler.run(f"""Store(RelationKey('public','adhoc','{name}'), Apply([('TotBytes', {ref('TotBytes')}), ('StartTime', {ref('StartTime')}), ('$__DAP__', NumericLiteral(0)), ('$__LAP__', NumericLiteral(0)), {emitted}],
        FileScan('{path}', 'CSV', {_netflow_scheme(_NETFLOW)}, {{'skip': 1}})))""")
    scheme = _netflow_scheme(["TotBytes", "StartTime", *kept]).replace("('RATE', 'STRING_TYPE')", "('RATE', 'DOUBLE_TYPE')")
    scan = f"Scan(RelationKey('public','adhoc','{name}'), {scheme}, (<catalog object at 0x7f>, 7), RepresentationProperties(frozenset([UnnamedAttributeRef(0, None), UnnamedAttributeRef(1, None)]), None, None))"
    return then(compiler, f"public_adhoc_{name}", scan)


@query("SELECT l_orderkey AS TotBytes, '10.0.0.' || l_suppkey AS SrcAddr, '10.1.0.' || l_partkey AS DstAddr, round(l_orderkey / (l_discount + 1) / 1000.0, 6) AS RATE, l_linenumber AS TotPkts, l_linenumber::VARCHAR AS Sport FROM lineitem")
def netflow_stored(spark, sf_dir):
    """The first plan of a pair: a file scan, a computed rate, a stored table."""
    stored = _netflow(spark, sf_dir, lambda compiler, name, scan: spark.table(name))
    return _rounded(stored.select("TotBytes", "SrcAddr", "DstAddr", "RATE", F.col("TotPkts").cast("int").alias("TotPkts"), "Sport"), 6, "RATE")


@query("SELECT '10.0.0.' || l_suppkey AS src_ip, '10.1.0.' || l_partkey AS dst_ip, 1.0::DOUBLE AS value FROM lineitem WHERE l_orderkey > 100")
def netflow_file_stored(spark, sf_dir):
    """The second plan of the pair: a scan of the stored table, a selection, a file; the file is read back."""

    def second(compiler: Compiler, name: str, scan: str) -> DataFrame:
        path = _scratch(spark, "flows")
        compiler.run(f"""FileStore('{path}', 'CSV', {{'single': 'false'}}, Apply([('src_ip', NamedAttributeRef('SrcAddr')), ('dst_ip', NamedAttributeRef('DstAddr')), ('value', NumericLiteral(1.0))],
            Select(GT(UnnamedAttributeRef(0, None), NumericLiteral(100)), {scan})))""")
        sinks.drop_table(spark, name)
        return files.read_delimited(spark, path, [("src_ip", STRING.spark), ("dst_ip", STRING.spark), ("value", DOUBLE.spark)], skip=1)

    return _netflow(spark, sf_dir, second)


@query("SELECT s_suppkey, s_acctbal AS v, 'public' AS v__VIS, 42::BIGINT AS v__TS FROM supplier")
def plan_text_visibility_and_time(spark, sf_dir):
    """Values with a visibility and a time stamp of their own."""
    compiler = Compiler(spark, {"public_adhoc_supplier": _read(spark, sf_dir, "supplier")})
    return compiler.run("""Dump(Apply([('s_suppkey', NamedAttributeRef('s_suppkey')), ('v', NamedAttributeRef('s_acctbal')), ('v__VIS', StringLiteral('public')), ('v__TS', NumericLiteral(42))],
        Scan(RelationKey('public','adhoc','supplier'), Scheme([('s_suppkey', 'LONG_TYPE'), ('$__DAP__', 'STRING_TYPE'), ('s_acctbal', 'DOUBLE_TYPE')]), 1, RepresentationProperties(frozenset([]), None, None))))""").select("s_suppkey", "v", "v__VIS", F.col("v__TS").cast("long").alias("v__TS"))


#: Four logs by the quarter of an event's number; the names hold type and date.
_LOGS = [f"bee-{kind}-v2dec-2017-0{m}-01.txt" for m, kind in ((4, "uw"), (1, "denver"), (3, "uw"), (2, "denver"))]


def _sensor_logs(spark: SparkSession, sf_dir: str) -> list[str]:
    """Events as sensor logs, with lines that readers leave out."""
    base = _scratch(spark, "logs")
    e = _read(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat_ws(";", stamp, F.lit("node:1"), F.lit("class"), F.col("event_type"), F.col("value").cast("string"), F.lit("U"))
    bad = F.array(line, F.lit("2017-01-01 00:00:00;n;Chemsense ID;mac_address;12;U"), F.lit("2017-01-01 00:00:00;n;x;y;none;U"), F.lit("2017-01-01;x"))
    for k, name in enumerate(_LOGS):
        e.where(F.col("event_id") % 4 == k).select(F.explode(bad).alias("value")).write.text(f"{base}/{name}")
    return [f"{base}/{name}" for name in _LOGS]


@query("SELECT epoch_us(ts) // 1000 AS t, 'class;' || event_type AS c, value AS v, ['2017-04-01', '2017-01-01', '2017-03-01', '2017-02-01'][(event_id % 4 + 1)::INT] AS file_date FROM events")
def sensor_logs(spark, sf_dir):
    return reduce(lambda a, b: a.union(b), [files.read_sensor(spark, path) for path in _sensor_logs(spark, sf_dir)])


@query("SELECT ['uw', 'denver', 'uw', 'denver'][(event_id % 4 + 1)::INT] AS kind, ['2017-04-01', '2017-01-01', '2017-03-01', '2017-02-01'][(event_id % 4 + 1)::INT] AS date, CASE WHEN event_id % 4 IN (1, 3) THEN 0 ELSE 1 END AS part, count(*) AS n FROM events GROUP BY ALL")
def sensor_file_list(spark, sf_dir):
    """A list of logs by the dates in their names, and the parts of the table that its split points make."""
    listed = files.sensor_files(_sensor_logs(spark, sf_dir), r"bee-(\w+)-v2dec-(\d{4}-\d{2}-\d{2})")
    points = files.split_points([date for _, _, date in listed])
    part = lambda date: sum(p <= date for p in points)
    logs = [files.read_sensor(spark, path).select(F.lit(kind).alias("kind"), F.lit(date).alias("date"), F.lit(part(date)).alias("part")) for path, kind, date in listed]
    return reduce(lambda a, b: a.union(b), logs).groupBy("kind", "date", "part").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS entries, count(*) FILTER (l_linenumber > 6) AS rejected, sum(l_suppkey)::BIGINT AS total FROM lineitem WHERE l_linenumber > 6 OR true")
def write_reduced(spark, sf_dir):
    """Counts and a sum of what is written, taken in the pass that writes; entries is that of both writes."""
    lines = _read(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey")
    seen = sinks.write_with_reduction(lines, _scratch(spark, "reduced"), {"total": F.sum("l_suppkey")}, rejects=F.col("l_linenumber") > 6)
    return spark.createDataFrame([(seen["entries"] + seen["rejected"], seen["rejected"], seen["total"])], "entries long, rejected long, total long")


@query("SELECT DISTINCT n_nationkey, n_regionkey FROM nation")
def keys_only(spark, sf_dir):
    return _table(spark, sf_dir, "nation", {"n_nationkey": INT, "n_regionkey": INT}, {"n_name": STRING}).agg(["n_nationkey", "n_regionkey"]).frame().select("n_nationkey", "n_regionkey")


def _scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one where that is unset and all run in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/tessella/{tag}-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix=f"tessella-{tag}-") + "/data"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
