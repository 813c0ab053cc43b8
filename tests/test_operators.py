"""Ranges, kernels, merges, graphs, codecs, plan text, sources, sinks, streams, and every registered query."""

import gzip
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import codecs
from tessella.operators import graph, linalg, merge
from tessella.operators.ranges import Interval, RangeSet, count_points, parse_range_string, contains_empty, pad, points_string, prefix_interval, prepend, range_filter
from tessella.plans import plantext as P
from tessella.sources import files, sinks
from tessella.streaming import running


def test_intervals():
    assert Interval.at_least(3).contains(3) and not Interval.greater_than(3).contains(3)
    assert Interval(3, 3, True).is_empty() and not Interval(3, 4, True, True).is_empty()
    assert Interval(1, 5).intersection(Interval(3, None)) == Interval(3, 5)
    assert Interval(1, 5).span(Interval(None, 2)) == Interval(None, 5) and Interval(1, 2).span(Interval(4, 6, False, True)) == Interval(1, 6, False, True)
    assert Interval(1, 5).encloses(Interval(2, 5)) and not Interval(1, 5, False, True).encloses(Interval(2, 5))
    assert Interval(1, 5).contains_all([1, 5]) and not Interval(1, 5).contains_all([1, 6])
    assert Interval.around([3, 1, 2]) == Interval(1, 3) and Interval(1, 2).transform(lambda x: 10 * x) == Interval(10, 20)


def test_lexicographic_ranges(spark):
    cells = list(itertools.product(range(4), range(4)))
    df = spark.createDataFrame(cells, "a int, b int")
    for i in (Interval((1, 2), (3,)), Interval((1, 2), (3, 1), True, True), Interval((2,), None, True), Interval(None, (2, 2))):
        got = sorted(tuple(r) for r in df.where(i.column(F.col("a"), F.col("b"))).collect())
        low = lambda c: i.lo is None or (c[: len(i.lo)] > i.lo or c[: len(i.lo)] == i.lo and not i.lo_open)  # noqa: B023,E731
        high = lambda c: i.hi is None or (c[: len(i.hi)] < i.hi or c[: len(i.hi)] == i.hi and not i.hi_open)  # noqa: B023,E731
        assert got == [c for c in cells if low(c) and high(c)]


def test_range_strings(spark):
    r = parse_range_string(":,r1,r3,r5,:,r7,r9,:,")
    assert [r.contains(x) for x in ("a", "r1", "r2", "r3", "r6", "r8", "r9", "z")] == [True, True, False, True, True, False, True, True]
    assert r.to_string() == ":,r1,r3,r5,:,r7,r9,:," and parse_range_string(":,").contains("x")
    assert count_points("a,b,") == 2 and count_points("a,:,b,") == -1 and points_string(["a", "b"]) == "a,b,"
    assert prefix_interval("ab") == Interval("ab", "ac", hi_open=True)
    assert prepend("p|", "a,b,:,c,").to_string() == "p|a,p|b,:,p|c,"
    opened = prepend("a", ":,")
    assert opened.contains("a") and opened.contains("azz") and not opened.contains("b") and not prepend("a", "m,:,").contains("b")
    assert not prepend("a", ":,m,").contains("an") and prepend("", ":,").contains("z") and prepend("x", "").intervals == []
    assert pad("a,b,:,v,:,", "pre|", "X") == "pre|aX,pre|bX,:,pre|vX,:," and pad("a,", "", "") == "a,"
    assert contains_empty("a,,") and contains_empty(",") and not contains_empty("a,")
    assert prefix_interval("a\ud7ff").hi == "a\ue000" and prefix_interval("\U0010ffff").hi is None
    assert len(RangeSet([Interval("a", "c"), Interval("b", "d"), Interval("x", "a")]).intervals) == 1
    assert RangeSet([Interval("a", "c")]).intersection(Interval("b", "z")).to_string() == "b,:,c,"
    df = spark.createDataFrame([("r1",), ("r2",), (None,)], "k string")
    assert [x.k for x in range_filter(df, "k", "r1,").collect()] == ["r1"]
    assert {x.k for x in range_filter(df, "k", "r1,", negate=True).collect()} == {"r2", None}


def matrix(spark, rows):
    return spark.createDataFrame(rows, "row string, col string, val double")


def cells(df):
    return sorted(tuple(r) for r in df.collect())


def test_kernels(spark):
    a = matrix(spark, [("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 3.0)])
    assert cells(linalg.table_mult(a, a)) == [("p", "p", 10.0), ("p", "q", 2.0), ("q", "p", 2.0), ("q", "q", 4.0)]
    upper = linalg.table_mult(a, a, upper_triangle=True)
    assert cells(linalg.mirror(upper)) == cells(linalg.table_mult(a, a))
    assert cells(linalg.sum_products(linalg.table_mult(a, a, keep_row=True))) == cells(linalg.table_mult(a, a))
    assert cells(linalg.ewise(a, a, lambda x, y: x - y, keep_zero=False)) == []
    assert cells(linalg.transpose(linalg.transpose(a))) == cells(a)
    assert cells(linalg.reduce_rows(a)) == [("x", 3.0), ("y", 3.0)]
    assert linalg.count_rows(a).first().n == 2 and linalg.count_rows(a.where("false")).count() == 0
    assert cells(linalg.divide(a.limit(1), 0)) == [("x", "p", None)]
    assert linalg.dense(a, ["p", "q"]).orderBy("row").collect()[1].q is None
    with pytest.raises(ValueError):
        linalg.parse_switches("Q")


def test_switches_agree(spark):
    rng = random.Random(3)
    make = lambda: spark.createDataFrame([(rng.randrange(600_000), rng.choice("pqr"), rng.random()) for _ in range(200)], "t long, c string, v double").cache()
    a, b = make(), make()
    round_ = lambda df: {(r.row, r.col): round(r.val, 9) for r in df.collect()}
    full = round_(linalg.covariance(a, b))
    assert len(full) == 9
    for s in "ADEFMPR":
        assert round_(linalg.covariance(a, b, s)) == full
    upper = {k: v for k, v in full.items() if k[0] <= k[1]}
    assert round_(linalg.covariance(a, b, "S")) == upper
    assert round_(linalg.covariance(a, b, "ADEFMPRSZ")) == {k: v for k, v in upper.items() if v}


@pytest.mark.parametrize(("left", "right"), [(["a1"], ["b1"]), (["a1"], ["a1"]), (["a1", "a1"], ["a1"]), ([], ["a1"]), (["a1"], []), (["a1", "a1"], ["a1", "a1", "a1"]), (["a1", "b2"], ["b2", "c3", "a1"])])
@pytest.mark.parametrize("alone", [(), (0,), (1,), (0, 1)])
def test_merge(spark, left, right, alone):
    l = spark.createDataFrame([(k, i) for i, k in enumerate(left)], "k string, x int")
    r = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "k string, y int")
    expected = [(k, i, j) for i, k in enumerate(left) for j, m in enumerate(right) if k == m]
    expected += [(k, i, None) for i, k in enumerate(left) if 0 in alone and k not in right] + [(k, None, j) for j, k in enumerate(right) if 1 in alone and k not in left]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((tuple(x) for x in merge.merge([l, r], ["k"], alone).collect()), key=key) == sorted(expected, key=key)


def test_merge_of_three_with_some_alone(spark):
    t = [spark.createDataFrame([(k, k) for k in ks], f"k string, v{i} string") for i, ks in enumerate(("ab", "bc", "bd"))]
    got = sorted(r.k for r in merge.merge(t, ["k"], [0]).collect())
    assert got == ["a", "b"]
    assert merge.merge(t, []).count() == 8


def test_align(spark):
    t = spark.createDataFrame([("r1", "f", "q", "v"), ("r2", "g", "q", "w")], "row string, family string, qualifier string, value string")
    assert merge.align([t, t], "all").count() == 2
    assert merge.align([t, t], "row", families=["f"]).count() == 1
    assert merge.align([t, t], "row+qualifier", ranges=Interval.at_least("r2")).first().value_0 == "w"


def test_graphs(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("b", "c", 1)], "row string, col string, val long")
    g = graph.adjacency(e)
    assert cells(g["base"]) == [("a", "b", 2), ("b", "c", 1)] and cells(g["transposed"]) == [("b", "a", 2), ("c", "b", 1)]
    assert cells(g["degree"]) == [("a", "out", 2), ("b", "in", 2), ("b", "out", 1), ("c", "in", 1)]
    single = cells(graph.single_table(e))
    assert ("a", "deg", 2) in single and ("b", "deg", 3) in single and ("a|b", "", 2) in single and ("c|b", "", 1) in single
    i = graph.incidence(e, F.lit(12).cast("long"), 4)
    assert i["edge"].first().row == "2100" and cells(i["degree"]) == cells(g["degree"])
    with pytest.raises(Exception, match="no room for the digits"):
        graph.incidence(e, F.lit(12345).cast("long"), 4)["edge"].collect()
    large = spark.createDataFrame([("a", "b", 1, 1), ("c", "d", 1, 10**12 + 1)], "row string, col string, val long, n long")
    assert {r.row for r in graph.incidence(large, F.col("n"))["edge"].collect()} == {"1000000000000", "1000000000001"}
    many = spark.range(1000).select(F.col("id").cast("string").alias("row"), F.lit("x").alias("col"), F.lit(1).cast("long").alias("val")).repartition(7)
    path = str(tmp_path / "edges")
    many.write.parquet(path)
    many = spark.read.parquet(path)
    assert sorted(r.n for r in graph.numbered_edges(many).collect()) == list(range(1, 1001))
    tables = graph.incidence(many)
    own = {(r.row, r.col) for r in tables["edge"].collect()}
    assert len({r for r, _ in own}) == 1000 and all(len(r) == 4 for r, _ in own) and own == {(r.col, r.row) for r in tables["transposed"].collect()}
    t = graph.associative_tables(spark.createDataFrame([("k|r", "f|1", 2), ("k|r", "g|2", 3), ("s", "h", 1)], "row string, col string, val long"))
    assert set(t) == set(graph.TABLES) and cells(t["Deg"]) == [("k|r", "deg", 2), ("s", "deg", 1)]
    assert cells(t["Field"]) == [("k", "deg", 2)] and cells(t["FieldT"]) == [("f", "deg", 1), ("g", "deg", 1)]


def test_codecs_keep_order():
    raw = [bytes(p) for n in range(4) for p in itertools.product((0, 1, 2, 255), repeat=n)]
    assert all(codecs.unescape(codecs.escape(x)) == x and 0 not in codecs.escape(x) for x in raw)
    pairs = [(a, b) for a in raw[:30] for b in raw[:30]]
    assert sorted(pairs) == sorted(pairs, key=lambda p: codecs.join(p))
    assert all(codecs.split(codecs.join(p)) == list(p) for p in pairs)
    for kind, values in {"LONG": [None, -5, -1, 0, 7, 2**40], "INT": [-9, 0, 3], "DOUBLE": [None, float("-inf"), -2.5, -0.0, 1e-9, 3.0], "FLOAT": [-1.5, 0.0, 2.0], "STRING": [None, "", "a", "é"], "BOOLEAN": [False, True]}.items():
        coded = [codecs.ordered_bytes(v, kind) for v in values]
        assert coded == sorted(coded) and [codecs.from_ordered_bytes(c, kind) for c in coded] == values


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("'hello world '", "hello world "), ("u'hello'", "hello"), ("  42    ", 42), (" -000765", -765), (" -00.0765e2", -7.65), ('  [ " hi ", 27 , 32 ]', [" hi ", 27, 32]),
        ("[ 'a', (27, 'ok') ]", ["a", (27, "ok")]), ("[[(27, 'ok')]]", [[(27, "ok")]]), ("[{'x' : 99}, {'l': [32]}, {}]", [{"x": 99}, {"l": [32]}, {}]), ("Dump()", P.Call("Dump")),
        ("S('hey', Dump(), T(42))", P.Call("S", ("hey", P.Call("Dump"), P.Call("T", (42,))))), ("None", None), ("frozenset(None)", P.Call("frozenset", (None,))), ("frozenset([])", P.Call("frozenset", ([],))),
        ("(<an object at 0x1>, 7)", (P.Opaque("an object at 0x1"), 7)),
    ],
)
def test_plan_text_parser(text, expected):
    assert P.parse(text) == expected


@pytest.mark.parametrize("text", ["", "[1", "(1, 2, 3)", "Dump(1) x", "'open", "@"])
def test_plan_text_errors(text):
    with pytest.raises(P.PlanTextError):
        P.parse(text)


def test_plan_text_checks(spark):
    for text in ("Nope(1)", "Dump(1, 2)", "Apply([('x', Minus(1))], Dump(1))"):
        with pytest.raises(P.PlanTextError):
            P.check(P.parse(text))


SMALL = "Scan(RelationKey('public','adhoc','smallGraph'), Scheme([('src', 'LONG_TYPE'), {mark}('dst', 'LONG_TYPE')]), 10000, RepresentationProperties(frozenset([]), None, None))"


@pytest.mark.parametrize("ref", ["NamedAttributeRef('dst')", "UnnamedAttributeRef(1, None)"])
@pytest.mark.parametrize("mark", ["", "('$__DAP__', 'STRING_TYPE'), "])
@pytest.mark.parametrize("more", ["", ", ('dst__TS', NumericLiteral(42))", ", ('dst__TS', NumericLiteral(42)), ('dst__VIS', StringLiteral(''))"])
def test_plans_store(spark, ref, mark, more):
    g = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    out = P.Compiler(spark, {"public_adhoc_smallGraph": g}).run(f"Store(RelationKey('public','adhoc','newtable'), Apply([('dst', {ref}){more}], {SMALL.format(mark=mark)}))")
    assert sorted(r.dst for r in out.collect()) == [2, 4]
    spark.sql("DROP TABLE public_adhoc_newtable")


def test_plan_expressions(spark):
    t = spark.createDataFrame([(7, 2, 0.5, 0.0, "a", True)], "i long, j long, x double, z double, s string, b boolean")
    c = P.Compiler(spark, {"u_p_t": t})
    scan = "Scan(RelationKey('u','p','t'), Scheme([('i','LONG_TYPE'),('j','LONG_TYPE'),('x','DOUBLE_TYPE'),('z','DOUBLE_TYPE'),('s','STRING_TYPE'),('b','BOOLEAN_TYPE')]), 1, RepresentationProperties(None, None, None))"
    ref = lambda n: f"NamedAttributeRef('{n}')"
    one = lambda e: c.run(f"Dump(Apply([('o', {e})], {scan}))").first().o
    assert one(f"DIVIDE({ref('i')}, {ref('j')})") == 3 and one(f"DIVIDE({ref('i')}, {ref('x')})") == 14.0
    assert one(f"DIVIDE({ref('x')}, {ref('z')})") == float("inf") and one(f"PLUS({ref('s')}, StringLiteral('b'))") == "ab"
    assert one(f"PLUS({ref('b')}, {ref('b')})") is True and one(f"GT({ref('i')}, NumericLiteral(6.5))") is True
    for bad in (f"PLUS({ref('i')}, {ref('s')})", f"DIVIDE({ref('s')}, {ref('s')})", f"GT({ref('s')}, {ref('i')})", ref("nope")):
        with pytest.raises(P.PlanTextError):
            one(bad)
    placed = c.compile(P.parse(f"Apply([('i', {ref('i')}), ('k', PLUS({ref('i')}, {ref('j')})), ('one', NumericLiteral(1))], {scan})"))
    assert (placed.distributed, placed.local, placed.values) == (["i", "k"], [], ["one"])


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,n,x\n"a,b",1,2.5\nc,,3\nd, 5,1\ne,7,z\nf,8,\ng,9,1e3\n')
    columns = [("k", T.StringType()), ("n", T.LongType()), ("x", T.DoubleType())]
    got = files.read_delimited(spark, str(tmp_path / "a.csv"), columns, skip=1)
    assert sorted(tuple(r) for r in got.collect()) == [("a,b", 1, 2.5), ("g", 9, 1000.0)]
    assert files.read_delimited(spark, str(tmp_path / "a.csv"), columns, 1, with_dropped=True).where("dropped").count() == 4
    assert files.read_delimited(spark, str(tmp_path / "a.csv"), [("k", T.StringType()), ("n", None), ("x", T.DoubleType())], 1).columns == ["k", "x"]
    (tmp_path / "b.csv").write_text("a,1\n")
    with pytest.raises(Exception, match="does not have 3 fields"):
        files.read_delimited(spark, str(tmp_path / "b.csv"), columns).collect()


def test_sensor_files(spark, tmp_path):
    (tmp_path / "log-2017-02-06-x.txt").write_text(
        "2017-02-06 11:27:44.976000;n:3;TSYS01;temperature;8.22;NO_UNIT\n2017-02-06 11:27:44;n:3;Chemsense ID;mac_address;12;U\n2017-02-06 11:27:44;n:3;X;y;abc;U\n2017-02-06 11:27:44;n;X;y\n"
    )
    r = files.read_sensor(spark, str(tmp_path)).collect()
    assert [(x.t, x.c, x.v, x.file_date) for x in r] == [(1486380464976, "TSYS01;temperature", 8.22, "2017-02-06")]
    assert files.read_sensor(spark, str(tmp_path), legacy_millis=True).first().t == 1486381440000


def test_triples(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a,b,c,")
    (tmp_path / "c.txt").write_text("x,y,z,")
    (tmp_path / "v.txt").write_text("1,2,3,")
    assert cells(files.read_triples(spark, *(str(tmp_path / f"{n}.txt") for n in "rcv"))) == [("a", "x", 1), ("b", "y", 2), ("c", "z", 3)]


def test_triples_of_many_splits(spark, tmp_path):
    """Files that Spark splits differently are paired by true position, over several files, some gzipped."""
    n = 20_000
    for name, width in (("r", 3), ("c", 17)):
        (tmp_path / name).mkdir()
        items = [f"{name}{'-' * (i % width)}{i}" for i in range(n)]
        (tmp_path / name / "1.txt").write_text("\n".join(items[: n // 2]) + "\n")
        with gzip.open(tmp_path / name / "2.txt.gz", "wt") as f:
            f.write("\n".join(items[n // 2 :]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_triples(spark, str(tmp_path / "r"), str(tmp_path / "c"), numbered=True)
        assert got.count() == n
        assert got.where(F.regexp_extract("row", r"(\d+)$", 1) != F.regexp_extract("col", r"(\d+)$", 1)).count() == 0
        assert got.where(F.regexp_extract("row", r"(\d+)$", 1).cast("long") + 1 != F.col("n")).count() == 0
        assert files.numbered_lines(spark, str(tmp_path / "r"), each_file=True).agg(F.max("n")).first()[0] == n // 2 - 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "short.txt").write_text("a,b\n")
    (tmp_path / "long.txt").write_text("a,b,c\n")
    with pytest.raises(Exception, match="same number of items"):
        files.read_triples(spark, str(tmp_path / "short.txt"), str(tmp_path / "long.txt")).collect()


def test_sensor_file_lists():
    names = [f"/x/bee-{t}-v2dec-2017-0{m}-01.txt" for m, t in ((2, "uw"), (1, "denver"))]
    assert [f[1:] for f in files.sensor_files(names, r"bee-(\w+)-v2dec-(\d{4}-\d{2}-\d{2})")] == [("denver", "2017-01-01"), ("uw", "2017-02-01")]
    assert files.split_points(["5", "1", "2", "3", "4", "6"]) == ["3", "6"]
    with pytest.raises(ValueError, match="same name"):
        files.check_distinct_names(["/a/x.txt", "/b/x.txt"])
    with pytest.raises(ValueError, match="no type and date"):
        files.sensor_files(["/a/x.txt"])


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", "b", 2), ("c", "d", 3)], "row string, col string, val long")
    seen = sinks.write_with_reduction(m, str(tmp_path / "m"), {"total": F.sum("val")}, str(tmp_path / "t"))
    assert seen == {"entries": 2, "total": 5} and cells(spark.read.parquet(str(tmp_path / "t"))) == [("b", "a", 2), ("d", "c", 3)]
    rejected = sinks.write_with_reduction(m, str(tmp_path / "some"), rejects=F.col("val") > 2, most_rejected=1)
    assert rejected == {"entries": 1, "rejected": 1} and cells(spark.read.parquet(str(tmp_path / "some"))) == [("a", "b", 2)]
    with pytest.raises(ValueError, match="1 rows rejected"):
        sinks.write_with_reduction(m, str(tmp_path / "none"), rejects=F.col("val") > 2, most_rejected=0)
    sinks.write_delimited(spark.createDataFrame([("a", None)], "k string, v string"), str(tmp_path / "csv"), single=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "k,v\na,\n"
    assert sinks.table_name("a", "b:c", "d") == "a_b_c_d"
    m.write.mode("overwrite").saveAsTable("to_clone")
    sinks.clone_table(spark, "to_clone", "cloned")
    assert spark.table("cloned").count() == 2
    sinks.drop_table(spark, "cloned")
    sinks.drop_table(spark, "to_clone")


def test_running_sums(spark, tmp_path):
    one = spark.createDataFrame([("a", "x", 1)], "row string, col string, val long")
    one.write.parquet(str(tmp_path / "in"))
    one.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    q = running.write_running(running.running_sums(stream, ["row", "col"]), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert cells(spark.read.parquet(str(tmp_path / "out"))) == [("a", "x", 2)]


def test_every_query_runs(spark, sf_dir):
    import duckdb

    from tessella import queries

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert set(queries.queries()) == set(queries.oracle_sql())
    for name, f in queries.queries().items():
        got, expected = f(spark, sf_dir), con.sql(queries.oracle_sql()[name])
        assert sorted(got.columns) == sorted(expected.columns), name
        assert got.count() == len(expected.fetchall()), name
