"""Core algebra: golden results, laws, schema checks."""

import math

import pytest
from pyspark.sql import functions as F

from tessella import examples
from tessella.functions.algebra import ANY, MAX, NULL_SUM, SUM, Ext, Map, Plus, Times, keep_where, reduced
from tessella.plans import nodes as N
from tessella.plans.lower import ordered
from tessella.plans.rewrite import discard_defaults
from tessella.plans.schema import DOUBLE, INT, KINDS, LONG, NDOUBLE, STRING, UINT, Key, Schema, SchemaError, Val, nullable

KV = Schema([Key("k", STRING)], [Val("v", LONG)])


def table(rows, schema=KV):
    return N.Data(schema, tuple(rows))


def rows(plan):
    return [tuple(r) for r in ordered(plan).collect()]


def test_word_count(spark):
    docs = table(
        [("doc1", "she sells sea shells by the sea shore"), ("doc2", "the shells she sells are surely seashells"), ("doc3", "so if she sells shells on the seashore"), ("doc4", "i'm sure she sells seashore shells")],
        examples.WORDS,
    )
    expected = {"are": 1, "by": 1, "i'm": 1, "if": 1, "on": 1, "sea": 2, "seashells": 1, "seashore": 2, "sells": 4, "she": 4, "shells": 4, "shore": 1, "so": 1, "sure": 1, "surely": 1, "the": 3}
    assert rows(examples.word_count().bind({"documents": docs})) == sorted(expected.items())


def test_replace(spark):
    got = rows(examples.replaced("Rainy", "Sunny").bind({"messages": table([("msg1", "Hello World!"), ("msg2", "Hello Glorious World!"), ("msg3", "Hello Rainy World!")], examples.MESSAGES)}))
    assert got == [("msg1", "Hello World!"), ("msg2", "Hello Glorious World!"), ("msg3", "Hello Sunny World!")]


def test_union_is_commutative_and_associative(spark):
    a, b, c = table([("x", 1), ("y", 2)]), table([("y", 3), ("y", 4)]), table([("z", 5), ("x", -1)])
    plus = {"v": SUM}
    assert rows(a.union(b, plus)) == rows(b.union(a, plus)) == [("x", 1), ("y", 9)]
    assert rows(a.union(b, plus).union(c, plus)) == rows(a.union(b.union(c, plus), plus)) == [("x", 0), ("y", 9), ("z", 5)]


def test_union_pads_and_keeps_common_keys(spark):
    a = table([("x", 1, 10, 5)], Schema([Key("k", STRING), Key("i", LONG)], [Val("v", LONG), Val("w", LONG)]))
    assert rows(a.union(table([("x", 3), ("y", 4)]), {"v": SUM, "w": SUM})) == [("x", 13, 5), ("y", 4, 0)]


def test_strict_union_rejects_shared_keys_outside_the_prefix():
    a = table([], Schema([Key("i", LONG), Key("k", STRING)], []))
    b = table([], Schema([Key("k", STRING)], []))
    with pytest.raises(SchemaError):
        a.union(b, strict=True)
    assert a.union(b).schema.key_names == ["k"]


def test_join_distributes_over_union(spark):
    a, b, c = table([("x", 2), ("y", 3)]), table([("x", 5), ("y", 1)]), table([("x", 7)])
    times = {"v": Times.annihilating("*", 0, 0, LONG, lambda x, y: x * y, 0)}
    left = a.join(b.union(c, {"v": SUM}), times).agg(["k"], {"v": SUM})
    right = a.join(b, times).union(a.join(c, times), {"v": SUM})
    assert rows(left) == rows(right) == [("x", 24), ("y", 3)]


def test_join_keeps_shared_values_only_and_can_be_cartesian(spark):
    a = table([("x", 2, 9)], Schema([Key("k", STRING)], [Val("v", LONG), Val("w", LONG)]))
    times = {"v": Times.annihilating("*", 0, 0, LONG, lambda x, y: x * y, 0)}
    assert a.join(table([("x", 4)]), times).schema.val_names == ["v"]
    assert rows(a.join(table([("p", 4), ("q", 5)], Schema([Key("j", STRING)], [Val("v", LONG)])), times)) == [("x", "p", 8), ("x", "q", 10)]


def test_null_keys_join(spark):
    s = Schema([Key("k", NDOUBLE)], [Val("v", LONG)])
    times = {"v": Times.annihilating("*", 0, 0, LONG, lambda x, y: x * y, 0)}
    assert rows(table([(None, 2), (1.0, 3)], s).join(table([(None, 5)], s), times)) == [(None, 10)]


def test_aggregations(spark):
    t = table([("x", 0), ("x", 5), ("y", 0)])
    assert rows(t.agg([], {"v": SUM})) == [(5,)]
    assert rows(N.Empty(KV).agg([], {"v": SUM})) == []
    assert rows(t.agg(["k"], {"v": ANY})) == [("x", 1), ("y", 0)]
    assert rows(t.agg(["k"])) == [("x", 5), ("y", 0)]  # one value other than the default
    with pytest.raises(Exception, match="several values"):
        rows(table([("x", 1), ("x", 2)]).agg(["k"]))
    n = Schema([Key("k", STRING)], [Val("v", NDOUBLE)])
    assert rows(table([("x", None), ("x", 2.0), ("y", None)], n).agg(["k"], {"v": NULL_SUM})) == [("x", 2.0), ("y", None)]
    assert rows(table([("x", None), ("x", 2.0)], n).agg(["k"], {"v": MAX})) == [("x", 2.0)]


def test_user_defined_additions(spark):
    t = table([("x", 3), ("x", 5), ("y", 2)])
    both = Plus.of("or", 0, lambda a, b: a.bitwiseOR(b))
    assert rows(t.agg(["k"], {"v": both})) == [("x", 7), ("y", 2)]
    assert rows(t.agg(["k"], {"v": Plus.python("or", 0, lambda a, b: int(a) | int(b), "long")})) == [("x", 7), ("y", 2)]
    least = Plus("least", None, F.min).with_identity(0)
    assert rows(table([("x", 0), ("x", 4), ("y", 0)]).agg(["k"], {"v": least})) == [("x", 4), ("y", 0)]


def test_ext_of_many_rows_and_python(spark):
    two = Ext("two", Schema([Key("j", INT)], [Val("w", LONG)]), lambda row: [{"j": F.lit(0), "w": row["v"]}, {"j": F.lit(1), "w": -row["v"]}])
    assert rows(table([("x", 3)]).ext(two)) == [("x", 0, 3), ("x", 1, -3)]
    python = Ext.of_python("letters", Schema([Key("j", INT)], [Val("c", STRING)]), lambda row: [{"j": i, "c": c} for i, c in enumerate(row["k"])])
    assert rows(table([("ab", 3), ("", 4)]).ext(python)) == [("ab", 0, "a"), ("ab", 1, "b")]
    with pytest.raises(SchemaError):
        table([]).ext(Ext("bad", Schema([Key("k", STRING)], []), lambda row: []))


def test_map_fusion(spark):
    t = table([("x", 3), ("y", 0)])
    twice, add = Map("2*", KV.vals, lambda r: {"v": r["v"] * 2}), Map("+1", KV.vals, lambda r: {"v": r["v"] + 1})
    assert rows(t.map(twice).map(add)) == rows(t.map(Map("both", KV.vals, lambda r: {"v": r["v"] * 2 + 1})))


def test_aggregation_after_aggregation(spark):
    t = table([("x", 1, 3), ("x", 2, 4), ("y", 1, 5)], Schema([Key("k", STRING), Key("i", LONG)], [Val("v", LONG)]))
    assert rows(t.agg(["k", "i"], {"v": SUM}).agg(["k"], {"v": SUM})) == rows(t.agg(["k"], {"v": SUM})) == [("x", 7), ("y", 5)]


def test_rename_swaps_and_sort_permutes(spark):
    s = Schema([Key("a", LONG), Key("b", LONG)], [])
    t = table([(1, 2)], s).rename({"a": "b", "b": "a"})
    assert t.schema.key_names == ["b", "a"] and t.frame().first().asDict() == {"b": 1, "a": 2}
    assert t.sort(["a", "b"]).frame().columns == ["a", "b"]
    with pytest.raises(SchemaError):
        t.sort(["a"])


def test_filters_and_discarding_defaults(spark):
    s = Schema([Key("k", STRING), Key("i", LONG)], [Val("v", NDOUBLE)])
    t = table([("x", 1, 3.0), ("x", 2, 9.0), ("y", 1, 1.0)], s)
    plan = t.map(keep_where("big", s.vals, lambda r: r["v"] > 2)).agg(["k"], {"v": NULL_SUM})
    assert rows(plan) == [("x", 12.0), ("y", None)]
    assert rows(discard_defaults(plan)) == [("x", 12.0)]


def test_covariance_of_a_small_case(spark):
    a = spark.createDataFrame([(0, "p", 1.0), (1000, "p", 3.0), (120000, "p", 5.0), (0, "q", 1.0), (120000, "q", None)], "t long, c string, v double")
    b = spark.createDataFrame([(0, "p", 0.0), (120000, "p", 0.0), (0, "q", 0.0)], "t long, c string, v double")
    got = {(r[0], r[1]): r[2] for r in examples.covariance().bind({"sensorA": a, "sensorB": b}).frame().collect()}
    assert got == {("p", "p"): 4.5, ("p", "q"): 0.0, ("q", "p"): 0.0, ("q", "q"): 0.0}
    upper = {(r[0], r[1]): r[2] for r in examples.covariance(symmetric=True).bind({"sensorA": a, "sensorB": b}).frame().collect()}
    assert upper == {k: v for k, v in got.items() if k[0] <= k[1]}


def test_covariance_of_one_bin_is_no_number(spark):
    a = spark.createDataFrame([(0, "p", 1.0)], "t long, c string, v double")
    assert math.isnan(examples.covariance().bind({"sensorA": a, "sensorB": a}).frame().first()["v"])


def test_schema_checks():
    with pytest.raises(SchemaError):
        Schema([Key("a", LONG)], [Val("a", LONG)])
    with pytest.raises(SchemaError):
        table([]).agg(["nope"])
    with pytest.raises(SchemaError):
        table([]).agg(["k"], {"v": Plus("+", 1, F.sum)})
    with pytest.raises(SchemaError):
        table([]).join(table([]), {})
    with pytest.raises(SchemaError):
        table([]).store("a").store("b")
    with pytest.raises(SchemaError):
        N.Load("unbound", KV).frame()
    s = Schema([Key("k", nullable(LONG)), Key("d", DOUBLE)], [Val("n", UINT, 0), Val("x", NDOUBLE)])
    assert Schema.from_spark(s.spark()) == s
    assert KINDS["DOUBLE"].least == -math.inf and Val("n", UINT).default == 0


def test_plan_tools(spark, tmp_path):
    plan = N.Load("a", KV).union(N.Load("b", KV), {"v": SUM})
    assert plan.base_tables() == {"a", "b"} and plan.store("out").written_tables() == {"out"}
    assert plan.fold(lambda n, _: n + 1, 0) == 3 and plan.fold(lambda n, _: n + 1, 0, lambda x: True) == 1
    assert plan.transform(lambda n: n) is plan
    assert plan.to_dot().count("->") == 2
    stored = plan.bind({"a": table([("x", 1)]), "b": table([("x", 2)])}).store("stored_sums")
    assert rows(stored) == [("x", 3)] and not spark.catalog.tableExists("stored_sums")  # only run() writes
    assert [tuple(r) for r in stored.run().collect()] == [("x", 3)] and spark.table("stored_sums").count() == 1
    spark.sql("DROP TABLE stored_sums")


def test_walks_that_rewrite():
    plan = N.Load("a", KV).union(N.Load("b", KV), {"v": SUM}).agg([], {"v": SUM})
    seen = []

    def count(given, node, position, results):
        seen.append((type(node).__name__, position))
        return (1 + sum(results), False) if position == len(node.inputs) else (given, False)

    found, same = plan.transform_fold(0, count)
    assert found == 4 and same is plan and seen == [("Aggregate", 0), ("Union", 0), ("Load", 0), ("Union", 1), ("Load", 0), ("Union", 2), ("Aggregate", 1)]
    found, _ = plan.transform_fold(0, lambda given, node, position, results: (7, isinstance(node, N.Union)))
    assert found == 7
    renamed = lambda node, results: N.Load(node.table * 2, KV) if isinstance(node, N.Load) else node
    assert plan.transform_fold(0, count, renamed)[1].base_tables() == {"aa", "bb"} and plan.base_tables() == {"a", "b"}


def test_verification(spark):
    SUM.verify_identity(LONG, [1, -5])
    MAX.verify_identity(NDOUBLE, [1.0])
    with pytest.raises(SchemaError, match="is no identity"):
        Plus("max", 0, F.max).verify_identity(LONG, [3, -5])
    product = Times.annihilating("*", 0, 0, LONG, lambda a, b: a * b, 0)
    product.verify_annihilator(LONG, LONG, [3], [4])
    with pytest.raises(SchemaError, match="not 0"):
        Times("+", 0, 0, LONG, lambda a, b: a + b, 0).verify_annihilator(LONG, LONG, [3], [])


def test_gathering_additions_in_parts(spark):
    from tessella.plans import lower

    same = Plus.of("xor", 0, lambda a, b: a.bitwiseXOR(b))
    many = N.Frame(spark.range(30_000).select(F.lit("hot").alias("k"), F.col("id").alias("v")), KV)
    assert 1 << lower.PART_BITS < 30_000 and rows(many.agg(["k"], {"v": same})) == [("hot", __import__("functools").reduce(lambda a, b: a ^ b, range(30_000)))]


def test_one_value_of_an_array(spark):
    df = spark.createDataFrame([([1, 2],), ([5],), ([],)], "x array<long>")
    assert [r.y for r in df.select(reduced(F.col("x"), 0, lambda a, b: a + b).alias("y")).collect()] == [3, 5, 0]
    for default, plus in ((None, lambda a, b: a + b), (0, None)):
        with pytest.raises(Exception, match="a value is missing|one value was expected"):
            df.select(reduced(F.col("x"), default, plus)).collect()


def test_dedup(spark):
    assert rows(table([("x", 1), ("x", 1)]).dedup_keys()) == [("x", 1)]


def test_groups_of_actions(spark):
    from tessella.plans.schedule import run_groups

    done = []
    act = lambda x: lambda: done.append(x) or spark.range(x).count()
    assert run_groups(spark, [[act(1), act(2)], [act(3)]]) == [[1, 2], [3]] and done[-1] == 3
    with pytest.raises(ZeroDivisionError):
        run_groups(spark, [[lambda: 1 / 0], [act(9)]])
    assert 9 not in done
