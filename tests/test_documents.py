import pytest
from pyspark.sql import functions as F

from loomdoc.functions import values as V
from loomdoc.functions.paths import Path, PathError, query, root
from loomdoc.functions.values import Value, literal
from loomdoc.operators import arrays, collection, leaves, patches, pointers, reshape
from loomdoc.plans import limits
from loomdoc.sources import documents
from loomdoc.streaming import subscriptions

DDL = "id int, d struct<a:int, s:string, b:boolean, xs:array<int>, m:map<string,int>, o:struct<k:string>>"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, (5, "x", False, [1, 2, 3, 4, 5], {"p": 1, "q/r": 2}, ("v",))), (2, (None, "", None, [], {}, None)), (3, None)], DDL)


def ask(df, col):
    return [r.v for r in df.orderBy("id").select(col.alias("v")).collect()]


def test_absent_null_and_type_rules(df):
    d = root(df, "d")
    assert ask(df, d["a"] == 5) == [True, False, False]
    assert ask(df, d["a"] != 5) == [False, True, True]
    assert ask(df, d["a"] == d["zz"]) == [False, True, True]
    assert ask(df, d["zz"] <= d["yy"]) == [True] * 3
    assert ask(df, d["a"] < "9") == [False] * 3
    assert ask(df, d["b"] < True) == [False] * 3
    assert ask(df, d["b"].exists()) == [True, False, False]
    assert ask(df, (d["a"] / 0 == d["zz"])) == [True] * 3


@pytest.mark.parametrize("s", [(None, None, 1), (-2, None, 1), (None, None, 2), (None, None, -1), (4, 1, -1), (0, 9, 0), (1, 99, 1), (-99, 2, 1), (3, 1, 1), (None, -3, -1), (None, -2, 1), (-2, -4, -1)])
def test_slices_like_python(df, s):
    want = [1, 2, 3, 4, 5][slice(*s)] if s[2] else []
    assert ask(df, Path().name("xs").slice(*s).array(root(df, "d")).col)[0] == want


def test_pointers_of_nodes(df):
    rows = query(df, Path().name("m").each(), "d", ("id",)).collect()
    assert {(r.pointer, r.value) for r in rows} == {("/m/p", 1), ("/m/q~1r", 2)}
    assert [r.pointer for r in query(df, Path().name("xs").index(-1), "d").collect()] == ["/xs/4"]
    with pytest.raises(PathError):
        Path().name("xs").each().one(root(df, "d"))


def found(df, path):
    return [(r.id, r.pointer, r.value) for r in query(df, path, "d", ("id",)).collect()]


def test_parents_and_keys(df):
    assert found(df, Path().name("xs").slice(0, 2).parent()) == [(1, "/xs", [1, 2, 3, 4, 5])] * 2
    assert found(df, Path().name("o").name("k").parent().parent().name("a")) == [(1, "/a", 5)]
    assert not found(df, Path().name("zz").parent()) + found(df, Path().parent()) + found(df, Path().key())
    assert found(df, Path().name("m").each().key()) == [(1, "/m/p", "p"), (1, "/m/q~1r", "q/r")]
    assert found(df, Path().name("xs").index(-1).key()) == [(1, "/xs/4", 4)]
    everything = [(i, p, str(v)) for i, p, v in found(df, Path().descend())]
    assert ("/o/k", '"v"') in [e[1:] for e in everything] and (2, "/m", "{}") in everything and len(everything) == 17


def test_deep_equality(df):
    d = root(df, "d")
    assert ask(df, d["xs"] == [1.0, 2, 3, 4, 5]) == [True, False, False]
    assert ask(df, d["m"] == {"q/r": 2, "p": 1}) == [True, False, False]
    assert ask(df, d["o"] != {"k": "v", "j": 1}) == [True] * 3
    assert ask(df, d["m"] == d["m"]) == [True] * 3 and ask(df, d == d) == [True] * 3


def test_patterns_are_checked():
    assert V._regex("a.c") == "a[^\\n\\r]c" and V._regex("[.]") == "[.]"
    assert V._regex("(?:x)") is None and V._regex(r"\d") is None


def test_functions(df):
    d = root(df, "d")
    assert ask(df, V.match(d["s"], "(?=x)")) == [False] * 3
    assert ask(df, V.length(d["s"]).col) == [1, 0, None]
    assert ask(df, V.average(d["xs"]).col) == [3.0, None, None]
    assert ask(df, V.round_half_up(literal(-2.5)).col)[0] == -2.0
    assert ask(df, V.to_number(literal("0x1f")).col)[0] == 31.0 and ask(df, V.to_number(literal("x")).col)[0] is None
    assert ask(df, V.split(literal("a.b"), ".").col)[0] == ["a", "b"] and ask(df, V.split(literal("abc"), "").col)[0] == ["a", "b", "c"]
    assert ask(df, V.flatten(Value(F.array(F.array(F.lit(1)), F.array(F.lit(2))), df.select(F.array(F.array(F.lit(1))).alias("x")).schema["x"].dataType)).col)[0] == [1, 2]


@pytest.mark.parametrize("bad", ["[a", "*a", "a{2,1}", "(a", "a)", "[b-a]", "a**", "a*?", "a{,3}", "a}", "[a[b]]", "\\\\q", "\\\\p{Xx}", "(?:a)"])
def test_malformed_patterns_match_nothing(df, bad):
    bad = bad.replace("\\\\", "\\")
    assert V._regex(bad) is None
    assert ask(df, V.match(root(df, "d")["s"], bad)) == [False] * 3


def test_diff_of_maps_nulls_and_structs(spark):
    t = "id int, a struct<m:map<string,int>,xs:array<int>,o:struct<p:int,q:string>>, b struct<m:map<string,int>,xs:array<int>,o:struct<p:int,q:string>>"
    rows = [(1, ({"k": 1, "l/m": 2, "n": 3}, [1, None, 3], (1, "x")), ({"k": 1, "l/m": 5, "z": None}, [1, 2, None], None)), (2, None, ({}, [], (None, None))), (3, None, None)]
    d = spark.createDataFrame(rows, t)
    got = {r.id: [(x.op, x.pointer, x.value) for x in r.d] for r in d.select("id", patches.diff(root(d, "a"), root(d, "b")).alias("d")).collect()}
    assert got[1][:2] == [("remove", "/o", None), ("remove", "/m/n", None)] and got[1][4:] == [("replace", "/xs/1", "2"), ("replace", "/xs/2", "null")]
    assert set(got[1][2:4]) == {("replace", "/m/l~1m", "5"), ("add", "/m/z", "null")}
    assert got[2] == [("replace", "", '{"m":{},"xs":[],"o":{}}')] and got[3] == []


def test_secure_query_refuses(df):
    with pytest.raises(PathError):
        limits.secure_query(df, Path().descend("x"), "d")
    assert limits.secure_query(df, Path().name("xs").each(), "d").count() == 5
    for over in ({"max_results": 4}, {"max_depth": 1}, {"max_nodes": 0}):
        with pytest.raises(Exception, match="limits"):
            limits.secure_query(df, Path().name("xs").each(), "d", **over).collect()


def test_builder_conditions_hold_once():
    ops = patches.PatchBuilder().when(False).add("/a", 1).add("/b", 2).if_exists("/c").remove("/c").remove("/d").ops
    assert [(o["op"], o["path"], "when" in o) for o in ops] == [("add", "/b", False), ("remove", "/c", True), ("remove", "/d", False)]
    assert patches.is_valid_merge_patch({"a": None}) and not patches.is_valid_merge_patch({"a": {1, 2}}) and not patches.is_valid_merge_patch(float("nan"))


def test_pointer_algebra():
    assert pointers.relative_to("/a/b/c", "/a/x") == "2/x" and pointers.relative_to("/a", "/a") == "0" and pointers.concat("/a", "", "/b~1c") == "/a/b~1c"
    assert pointers.is_valid("/a") and not pointers.is_valid("a") and pointers.normalize("#/a%20b") == "/a b" and pointers.normalize(["a/b", 0]) == "/a~1b/0"
    assert pointers.tokens("/a~1b/~0c/0") == ["a/b", "~c", "0"] and pointers.tokens("#/a%20b") == ["a b"]
    assert pointers.relative("/a/b", "0/c") == "/a/b/c" and pointers.relative("/a/b", "1#") == "a" and pointers.relative("/a/b/c", "2/x/y") == "/a/x/y"
    for bad in ("a", "/~2"):
        with pytest.raises(pointers.PointerError):
            pointers.tokens(bad)
    with pytest.raises(pointers.PointerError):
        pointers.relative("/a", "2")


def test_patches(df):
    one = df.where("id = 1")
    got = patches.apply_patch(one, "d", [{"op": "add", "path": "/xs/1", "value": 9}, {"op": "remove", "path": "/o"}, {"op": "add", "path": "/m/z", "value": 3}, {"op": "test", "path": "/s", "value": "x"}]).first().d
    assert got.xs == [1, 9, 2, 3, 4, 5] and "o" not in got and got.m["z"] == 3
    ops = [{"op": "replace", "path": "/a", "value": 1}, {"op": "add", "path": "/xs/0", "value": 0}]
    undo = patches.inverse(one, "d", ops)
    assert [o["op"] for o in undo] == ["remove", "replace"]
    for bad in ({"op": "remove", "path": "/xs/9"}, {"op": "test", "path": "/a", "value": 6}):
        with pytest.raises(Exception):  # noqa: B017
            patches.apply_patch(one, "d", [bad]).collect()
    with pytest.raises(patches.PatchError):
        patches.validate([{"op": "add", "path": "/a"}])


def test_patch_errors(df):
    ops = [{"op": "test", "path": "/a", "value": 5}, {"op": "remove", "path": "/o/k"}, {"op": "add", "path": "/xs/1", "value": 9}, {"op": "move", "from": "/s", "path": "/t"}]
    one, two, none = patches.patch_with_errors(df, "d", ops).orderBy("id").collect()
    assert one.d.xs == [1, 9, 2, 3, 4, 5] and one.d.t == "x" and one.d.s is None and one.d.o.k is None and not one.errors
    assert [e["index"] for e in two.errors] == [0, 1, 2] and two.d.xs == [] and two.d.t == ""
    assert none.d is None and len(none.errors) == 4
    whole = patches.patch_with_errors(df, "d", ops, atomic=True).orderBy("id").collect()
    assert whole[0].d.t == "x" and whole[1].d.s == "" and whole[1].d.t is None
    with pytest.raises(patches.PatchError):
        patches.patch_with_errors(df, "d", [{"op": "move", "from": "/o", "path": "/o/k"}])


def test_patch_conversions(df):
    merge = {"a": {"b": 1, "c": None}, "d": [1]}
    assert patches.merge_of(patches.patch_of(merge)) == merge
    assert [o["op"] for o in patches.PatchBuilder().add("/a", 1).when(False).remove("/b").copy("/a", "/c").ops] == ["add", "copy"]
    both = df.select("d", df.d.withField("a", df.d.a + 1).withField("z", F.lit('q"')).dropFields("b").alias("e"))
    text = [r[0] for r in both.select(patches.create_merge_patch(root(both, "d"), root(both, "e"))).collect()]
    assert text == ['{"a":6,"b":null,"z":"q\\""}', '{"z":"q\\""}', "{}"]
    assert pointers.from_path(r"$['a'][0]['it\'s']") == "/a/0/it's" and pointers.to_path("/a/0/it's") == r"$['a'][0]['it\'s']"
    with pytest.raises(pointers.PointerError):
        pointers.from_path("$.a")


def test_created_containers(df):
    d = root(df, "d")
    assert [r and r.x for r in ask(df, pointers.set_at(d, "/n/x/0", F.lit(1), create=True)["n"])] == [[1], [1], None]
    assert [r and r.k for r in ask(df, pointers.set_at(d, "/o/k", F.lit("z"), create=True)["o"])] == ["z", "z", None]


def test_leaves_round_trip(df):
    rows = leaves.shred(df, "d", "id")
    got = leaves.materialise(rows, "id", df.schema["d"].dataType, name="d")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("d is not null").collect()))
    assert [r.xs for r in leaves.materialise(rows, "id", df.schema["d"].dataType["xs"].dataType, "/xs", "xs").orderBy("id").collect()] == [[1, 2, 3, 4, 5], []]
    assert leaves.replace_subtree(rows, "/xs", rows.limit(0)).where("pointer like '/xs%'").count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_leaves_are_rebuilt_where_they_are(df):
    dtype, rows, kept = df.schema["d"].dataType, leaves.shred(df, "d", "id"), leaves.packed(df, "d", "id")
    got = leaves.materialise(kept, "id", dtype, name="d")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("d is not null").collect()))
    assert not any(x in _plan(got) for x in ("Aggregate", "Sort", "Repartition"))
    for at, t in (("/xs", dtype["xs"].dataType), ("/m", dtype["m"].dataType), ("/s", dtype["s"].dataType), ("/no", dtype["s"].dataType)):
        assert sorted(map(str, leaves.materialise(kept, "id", t, at).collect())) == sorted(map(str, leaves.materialise(rows, "id", t, at).collect()))


def test_order_of_leaves_with_absent_scalars(spark):
    docs = spark.sql("""SELECT 1 AS id, struct(1 AS a, array(struct(null AS x, array(7, null) AS y, 'q' AS z), null) AS b, cast(null AS int) AS c, map('k', 2, 'l', null) AS m, 'e' AS e) AS d
        UNION ALL SELECT 2, null""")
    got = [(r.pointer, r.value, r.size) for r in leaves.shred(docs, "d", "id").collect()]
    assert got == [("", None, 4), ("/a", "1", None), ("/b", None, 2), ("/b/0", None, 2), ("/b/0/y", None, 2), ("/b/0/y/0", "7", None), ("/b/0/z", "q", None), ("/m", None, 2), ("/m/k", "2", None), ("/e", "e", None)]


def test_subtree_replaced_in_one_pass(df):
    rows = leaves.shred(df, "d", "id")
    want = leaves.replace_subtree(rows, "/xs", rows.where("pointer = '/xs'").withColumn("size", F.lit(0)))
    got = leaves.replace_subtree(rows, "/xs", {"size": F.lit(0)})
    assert got.schema.names == want.schema.names and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Union" in _plan(want) and "Union" not in _plan(got)


def test_variant_descent(spark):
    texts = [(1, '{"a":{"k":1,"x":[{"k":2},3]},"k":{"k":4},"q/r":{"k":null}}'), (2, "5"), (3, None), (4, "bad{")]
    v = spark.createDataFrame(texts, "id int, t string").select("id", documents.parsed(F.col("t")).alias("v"))
    got = [(r.pointer, str(r.value)) for r in documents.descend(v, "v", "k", ("id",), depth=4).collect()]
    assert got == [("/a/k", "1"), ("/a/x/0/k", "2"), ("/k", '{"k":4}'), ("/k/k", "4"), ("/q~1r/k", "null")]
    assert documents.descendants(v, "v", depth=4).count() == 12
    with pytest.raises(Exception, match="deeper"):
        documents.descendants(v, "v", depth=3).collect()


def test_ancestors(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 1)], "k int, p int")
    want = [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 3), (4, 2, 2), (4, 3, 1), (5, 1, 1)]
    assert sorted(map(tuple, collection.ancestors(tree, "k", "p", 4).collect())) == want
    with pytest.raises(Exception, match="ancestors"):
        collection.ancestors(tree, "k", "p", 2).collect()


def test_shred_and_diff(df):
    rows = leaves.shred(df, "d", "id")
    assert {(r.pointer, r.value, r.size) for r in rows.where("id = 2").collect()} == {("", None, 3), ("/s", "", None), ("/xs", None, 0), ("/m", None, 0)}
    new = df.select("id", reshape.transform(root(df, "d"), Path().name("xs"), lambda x: arrays.push(x.col, F.lit(7))).alias("d"))
    ops = patches.diff_frames(df, new, "id", "d").where("id < 3").collect()
    assert {(r.id, r.op, r.pointer, r.value) for r in ops} == {(1, "replace", "/xs", "[1,2,3,4,5,7]"), (2, "replace", "/xs", "[7]")}


def test_products_are_small(spark):
    assert collection.cross(spark.range(3), spark.range(4).withColumnRenamed("id", "b")).count() == 12
    with pytest.raises(ValueError):
        collection.cross(spark.range(3), spark.range(4).withColumnRenamed("id", "b"), most=11)


def test_written_documents_come_back(spark, df, tmp_path):
    documents.write(df, str(tmp_path / "json"), "json")
    back = documents.read(spark, str(tmp_path / "json"), "json", DDL)
    assert sorted(map(str, back.select("id", "d.xs", "d.o").collect())) == sorted(map(str, df.select("id", "d.xs", "d.o").collect()))
    documents.write(df, str(tmp_path / "parts"), partition_by=("id",))
    assert documents.read(spark, str(tmp_path / "parts")).where("id = 1").count() == 1


def test_given_rows_from_either_end(spark):
    df = spark.createDataFrame([("x", i, f"a{i}") for i in range(3)] + [("y", 0, "b0")], "g string, pos long, v string")
    rows = spark.createDataFrame([("x", 0, "n0"), ("x", 1, "n1"), ("z", 0, "c0")], "g string, pos long, v string")
    order = lambda d: [(r.g, r.v) for r in d.orderBy("g", "pos").collect()]
    assert order(collection.give(df, rows, 1, by=("g",))) == [("x", "a0"), ("x", "n0"), ("x", "n1"), ("x", "a1"), ("x", "a2"), ("y", "b0"), ("z", "c0")]
    assert order(collection.give(df, rows, 1, by=("g",), right=True))[:5] == [("x", "a0"), ("x", "a1"), ("x", "n0"), ("x", "n1"), ("x", "a2")]


def test_limits(spark):
    with pytest.raises(PathError):
        limits.check(Path().descend("x"), descend=False)
    assert limits.at_most(spark.range(3), 3).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        limits.at_most(spark.range(4), 3).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"/u/{i % 3}/n", str(i)) for i in range(30)]
    src = spark.createDataFrame(rows, "seq long, pointer string, value string")
    src.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    on = subscriptions.on_pattern(stream, Path().name("u").index(1).name("n"))
    q = subscriptions.attach(on, lambda b: seen.extend(r.seq for r in b.collect()), str(tmp_path / "ck"), before=lambda b: b.where("seq > 3"))
    q.awaitTermination(120)
    assert sorted(seen) == [i for i in range(4, 30) if i % 3 == 1]


def test_group_lists_are_bounded_and_whole(spark):
    rows = [(i, i % 7, "hot" if i % 10 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "id int, pos int, g string").repartition(5)
    got = collection.group_lists(df, F.col("g"), "id", size=64).collect()
    assert max(len(r.rows) for r in got) <= 64
    for g in ("hot", None):
        ids = [x.id for r in sorted((r for r in got if r.key == g), key=lambda r: r.chunk) for x in r.rows]
        assert ids == [i for i, _, _ in sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))]
