"""Graph schemas from edge triples (row, col, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _summed(m: DataFrame) -> DataFrame:
    return m.groupBy("row", "col").agg(F.sum("val").alias("val"))


def adjacency(edges: DataFrame) -> dict[str, DataFrame]:
    """base, transposed (equal edges summed) and degree (row: node, col: "out" or "in")."""
    base = _summed(edges)
    turned = base.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    ends = edges.select(F.explode(F.array(F.struct(F.col("row").alias("row"), F.lit("out").alias("col")), F.struct(F.col("col").alias("row"), F.lit("in").alias("col")))).alias("e"), "val")
    return {"base": base, "transposed": turned, "degree": _summed(ends.select("e.row", "e.col", "val"))}


def edge_ids(number: Column, width: int | Column) -> Column:
    """The decimal digits of an edge's number in reverse, padded with zeros to width, so that neighbours spread out; a longer number is an error."""
    digits = number.cast("string")
    width = F.lit(width) if isinstance(width, int) else width
    padded = F.rpad(F.reverse(digits), width, F.lit("0"))
    return F.when(F.length(digits) > width, F.raise_error(F.concat(F.lit("no room for the digits of edge "), digits)).cast("string")).otherwise(padded)


def numbered_edges(edges: DataFrame) -> DataFrame:
    """edges with n, numbers from 1 without gaps in the order of partitions and rows.

    A first pass counts the rows of each partition, so that the rows must come to the same partitions when it is
    repeated; a table read from files does that.
    """
    here = edges.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = here.groupBy("__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("__part", (before - F.col("__first") + 1).alias("__offset"))
    return here.join(F.broadcast(offsets), "__part").withColumn("n", F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


def incidence(edges: DataFrame, number: Column | None = None, width: int | None = None) -> dict[str, DataFrame]:
    """edge (row: edge id, col: "out|node" or "in|node", val), its transpose, and the degree (row: node, col: "out" or "in").

    number: of each edge; None: numbered_edges. width: digits of an edge id; None: those of the largest number.
    """
    numbered = numbered_edges(edges.select("row", "col", "val")) if number is None else edges.withColumn("n", number)
    if width is None:
        width = numbered.agg(F.coalesce(F.max(F.length(F.col("n").cast("string"))), F.lit(1)).alias("w")).first()["w"]
    ids = numbered.select(edge_ids(F.col("n"), width).alias("id"), "row", "col", "val")
    ends = F.array(F.concat(F.lit("out|"), F.col("row").cast("string")), F.concat(F.lit("in|"), F.col("col").cast("string")))
    edge = ids.select(F.col("id").alias("row"), F.explode(ends).alias("col"), "val")
    turned = edge.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return {"edge": edge, "transposed": turned, "degree": adjacency(edges)["degree"]}


def single_table(edges: DataFrame, separator: str = "|", count_values: bool = False) -> DataFrame:
    """An undirected graph in one table: (node, "deg", degree), and "u|v" and "v|u" with an empty col for each edge, summed."""
    one = F.col("val") if count_values else F.lit(1).cast("long")
    u, v = F.col("row").cast("string"), F.col("col").cast("string")
    rows = F.array(
        F.struct(u.alias("row"), F.lit("deg").alias("col"), one.alias("val")),
        F.struct(v.alias("row"), F.lit("deg").alias("col"), one.alias("val")),
        F.struct(F.concat(u, F.lit(separator), v).alias("row"), F.lit("").alias("col"), F.col("val").alias("val")),
        F.struct(F.concat(v, F.lit(separator), u).alias("row"), F.lit("").alias("col"), F.col("val").alias("val")),
    )
    return _summed(edges.select(F.inline(rows)))


#: The tables of associative_tables, with T for a transpose.
TABLES = ("base", "T", "Deg", "DegT", "Field", "FieldT", "Edge", "EdgeT", "EdgeDegT")


def associative_tables(
    edges: DataFrame, wanted: tuple[str, ...] = TABLES, sum_base: bool = False, sum_transposed: bool = False, degree_of_values: bool = False,
    separator: str = "|", out: str = "deg", into: str = "deg", number: Column | None = None,
) -> dict[str, DataFrame]:
    """Up to nine tables from the same triples.

    base and T as they are unless summed; Deg and DegT: degree of each row and col, under the cols out and into; Field
    and FieldT: degree of the fields of rows and cols, what they have before the separator (without one, they are left
    out); Edge, EdgeT: incidence of numbered triples; EdgeDegT: Deg and DegT in one table.
    """
    weight = F.col("val").cast("long") if degree_of_values else F.lit(1).cast("long")
    turn = lambda m: m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    counted = lambda name, under: edges.where(F.col(name).isNotNull()).select(F.col(name).alias("row"), F.lit(under).alias("col"), weight.alias("val"))
    fields = lambda name, under: counted(name, under).where(F.instr("row", separator) > 0).withColumn("row", F.substring_index("row", separator, 1))
    parts = incidence(edges, number) if {"Edge", "EdgeT"} & set(wanted) else {}
    relabel = lambda c: F.concat(F.when(F.startswith(c, F.lit("out|")), F.lit(out)).otherwise(F.lit(into)), F.substr(c, F.instr(c, "|")))
    made = {
        "base": lambda: _summed(edges) if sum_base else edges.select("row", "col", "val"),
        "T": lambda: _summed(turn(edges)) if sum_transposed else turn(edges),
        "Deg": lambda: _summed(counted("row", out)),
        "DegT": lambda: _summed(counted("col", into)),
        "Field": lambda: _summed(fields("row", out)),
        "FieldT": lambda: _summed(fields("col", into)),
        "Edge": lambda: parts["edge"].withColumn("col", relabel(F.col("col"))),
        "EdgeT": lambda: parts["transposed"].withColumn("row", relabel(F.col("row"))),
        "EdgeDegT": lambda: _summed(counted("row", out).union(counted("col", into))),
    }
    return {name: made[name]() for name in wanted}
