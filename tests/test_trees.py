"""Time bases, nested slices, writes by role, views, backends and plugins on small fixtures."""

import pytest
from pyspark.sql import functions as F

from chronolith.functions import convert, paths, strings, values
from chronolith.functions.plugins import GET_ONLY, PUT_ONLY, Plugin, PluginError, Plugins, with_provenance
from chronolith.operators import bases, catalog, nested, tasks, timeops, trees, views
from chronolith.sources import backends, store
from chronolith.streaming import append

LEAF = "path string, time_idx int, t double, value double"
STEP = "path string, t double, value double"


def steps(rows):
    return sorted((r["path"], r["time_idx"], r["t"], r["value"]) for r in rows.select("path", "time_idx", "t", "value").collect())


def test_appended_times_share_steps(spark, tmp_path):
    e = store.Entry(spark, str(tmp_path / "e"), "create")
    add = lambda *rows: e.put_slice(spark.createDataFrame(rows, STEP), "tree")
    add(("a", 1.0, 10.0))
    add(("b", 1.0, 20.0))
    add(("a", 2.0, 11.0))
    assert steps(e.get("tree")) == [("a", 0, 1.0, 10.0), ("a", 1, 2.0, 11.0), ("b", 0, 1.0, 20.0)]
    add(("c", 2.0, 31.0), ("a", 3.0, 12.0))  # c is new and begins where its time lies, b has skipped two steps
    add(("b", 3.0, 22.0))
    assert [(p, k) for p, k, _, _ in steps(e.get("tree")) if p in "bc"] == [("b", 0), ("b", 2), ("c", 1)]


def test_next_step_of_new_and_continuing_signals(spark):
    df = spark.createDataFrame([(0, 5, 1), (2, 5, 1), (5, 5, 1), (4, 5, 2)], "s int, b int, n int")
    assert [r[0] for r in df.select(bases.next_step(F.col("s"), F.col("b"), F.col("n"))).collect()] == [0, 4, 5, 4]


def test_writes_by_role(spark, tmp_path):
    e = store.Entry(spark, str(tmp_path / "e"), "create")
    one = lambda v, kind: spark.createDataFrame([(v,)], f"value {kind}")
    e.put_node(one([0.0, 1.0, 2.0], "array<double>"), "t", "time", "bulk")
    e.put_node(one([5.0, 6.0, 7.0], "array<double>"), "t", "sig", "bulk")
    e.put_node(one(3.5, "double"), "t", "name", "static")
    assert steps(e.get("t").where("path = 'sig'")) == [("sig", k, None, 5.0 + k) for k in range(3)]
    got = {r["path"]: (r["value"], r["rank"]) for r in e.get_slice("t", 0.5, "linear").collect()}
    assert got == {"sig": (5.5, 1), "name": (3.5, 0)}
    assert sorted(r["value"] for r in e.get_range("t", 0.5, 2.5).where("time_idx is not null").collect()) == [6.0, 7.0]
    assert sorted((r["t"], r["value"]) for r in e.get_sample("t", "linear", 0.0, 1.0, 0.5).where("rank = 1").collect()) == [(0.0, 5.0), (0.5, 5.5), (1.0, 6.0)]
    for wrong in (lambda: e.get_slice("t", 0.5, "nearest"), lambda: e.get_range("t", 1, 0), lambda: e.get_sample("t", "linear", 0.0, 1.0)):
        with pytest.raises(store.StoreError):
            wrong()
    with pytest.raises(store.BadWrite):
        e.put_node(one(1.0, "double"), "t", "x", "sometimes")


def test_bases_from_the_inside_out(spark):
    rows = [("flux/0/flux/data", 0, None, 1.0), ("flux/0/flux/time", 0, None, 10.0), ("flux/1/flux/data", 0, None, 2.0), ("flux/1/time", 0, None, 20.0), ("lone", 0, None, 3.0), ("time", 0, None, 30.0), ("lifetime", 0, None, 4.0)]
    leaves = spark.createDataFrame(rows, LEAF)
    assert dict(map(tuple, bases.resolve(leaves).collect())) == {"flux/0/flux/data": "flux/0/flux/time", "flux/1/flux/data": "flux/1/time", "lone": "time", "lifetime": "time"}
    assert {r["path"]: r["t"] for r in bases.with_times(leaves).collect()} == {"flux/0/flux/data": 10.0, "flux/1/flux/data": 20.0, "lone": 30.0, "lifetime": 30.0}
    assert {r["base"] for r in bases.resolve(leaves, homogeneous=True).collect()} == {"time"}
    none = bases.get_slice(leaves.where("path not like '%time'"), 1.0, "closest")  # no base: not available, no error
    assert none.count() == 0
    assert bases.base_name("channel/beam&time") == "time"


NESTED = "a array<struct<s: double, d: struct<time: array<double>, data: array<double>>, e: array<struct<time: double, n: int, v: double, w: array<double>, c: string>>>>"


def tree(spark):
    steps = [(0.1 * k, k, 100.0 + k, [float(k)] * (1 + (k == 3)), "x" if k < 2 else "y") for k in range(1, 6)]
    return spark.createDataFrame([([(500.0, ([1.0, 2.0, 3.0], [10.0, 20.0, 30.0]), steps), (501.0, ([], []), [])],)], NESTED)


def test_slices_of_trees(spark):
    df = tree(spark)
    kind = df.schema["a"].dataType
    cut = lambda t, mode, **k: df.select(trees.slice_tree(F.col("a"), kind, t, mode, **k).alias("a")).first()["a"]
    got = cut(0.26, "linear")
    assert [x["s"] for x in got] == [500.0, 501.0] and got[0]["d"]["data"] == [10.0] and got[0]["d"]["time"] == [0.26] and got[1]["e"] == [] and got[1]["d"]["data"] == []
    e = got[0]["e"][0]
    assert e["time"] == pytest.approx(0.26) and e["n"] == 3 and e["v"] == pytest.approx(102.6) and e["w"] == [] and e["c"] == "y"  # sizes 1 and 2 don't blend
    e = cut(0.15, "linear", profile="truncate")[0]["e"][0]
    assert (e["n"], e["c"]) == (1, "x") and cut(0.15, "linear")[0]["e"][0]["c"] == ""
    assert cut(0.26, "previous")[0]["e"][0]["n"] == 2 and cut(0.26, "closest")[0]["e"][0]["n"] == 3 and cut(9.0, "linear")[0]["e"][0]["n"] == 5
    assert cut(2.5, "linear")[0]["d"]["data"] == [25.0]
    inside = df.select(trees.range_tree(F.col("a"), kind, 0.15, 2.0).alias("a")).first()["a"]
    assert [x["n"] for x in inside[0]["e"]] == [2, 3, 4, 5] and inside[0]["d"]["data"] == [10.0, 20.0]
    some = df.select(trees.sample_tree(F.col("a"), kind, [0.15, 0.55], "linear").alias("a")).first()["a"]
    assert [(x["time"], x["v"]) for x in some[0]["e"]] == [(0.15, pytest.approx(101.5)), (0.55, 105.0)] and some[0]["d"]["data"] == [10.0, 10.0] and some[1]["e"] == []
    with pytest.raises(ValueError):
        trees.range_tree(F.col("a"), kind, 1.0, 0.0)
    assert trees.depth(kind) == 2 and df.select(trees.greatest_size(F.col("a"), kind)).first()[0] == 5
    assert trees.compatible(kind, kind) and not trees.compatible(kind, kind.elementType["e"].dataType)
    put = df.select(trees.put_element_field(F.col("a"), 1, "s", F.lit(7.0)).alias("a")).select(trees.element_field(F.col("a"), 1, "s"), trees.element_field(F.col("a"), 5, "s")).first()
    assert tuple(put) == (7.0, None)


def test_samples_of_nested_arrays_end_within_rounding(spark):
    grid = timeops.step_grid(0.55, 0.95, 0.2)
    rows = spark.createDataFrame([([(0.1 * k, 2000 + 0.1 * k) for k in range(20)],)], "d array<struct<time: double, v: double>>")
    got = rows.select(trees.sample_array(F.col("d"), rows.schema["d"].dataType.elementType, grid, "linear").alias("d")).first()["d"]
    assert [x["time"] for x in got] == grid and [x["v"] for x in got] == pytest.approx([2000.55, 2000.75, 2000.95])


def test_view_folds_arrays_and_time(spark):
    rows = [("a/b", [i, j], [10.0 * i + j]) for i in range(2) for j in range(2)] + [("c", [0], [1.0, 2.0, 3.0, 4.0, 5.0]), ("r", [0], [1.0] * 3), ("r", [1], [2.0] * 5), ("d", [0], [1.0]), ("d", [3], [4.0])]
    df = spark.createDataFrame(rows, "schema_path string, index array<int>, value array<double>")
    got = {(r["schema_path"], r["cell"]): r for r in views.publish(df).collect()}
    assert got["a/b", 3]["value"] == [11.0] and got["a/b", 0]["outer"] == [2, 2] and got["c", 0]["value"] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert got["r", 0]["value"] == [1.0] * 3 + [values.EMPTY_DOUBLE] * 2 and [got["d", k]["value"] for k in range(4)] == [[1.0], [values.EMPTY_DOUBLE], [values.EMPTY_DOUBLE], [4.0]]
    known = {r["name"]: (list(r["dims"]), r["n_holes"]) for r in views.names(df, flat=True).collect()}
    assert known == {"a:b": ([2, 2, 1], 0), "c": ([1, 5], 0), "r": ([2, 5], 2), "d": ([4, 1], 2)}
    assert tuple(views.statistics(df).first()) == (4, 9, 4, 4, 1)
    capped = views.publish(df, most_cells=3).where("schema_path = 'd'").collect()
    assert len(capped) == 1 and capped[0]["capped"]


def test_view_is_written_again(spark, tmp_path):
    view = views.publish(spark.createDataFrame([("a/b", [0], [1.0])], "schema_path string, index array<int>, value array<double>"))
    for _ in range(2):
        views.write(view, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("signal = 'a:b'").count() == 1


def test_paths_of_open_arrays():
    assert paths.chain([("core/source", 1), ("core/source/ion/state", 0)]) == [("core&source", 1), ("ion&state", 0)]
    assert paths.sanitize("core/source/global/value", ["core/source"]) == "core&source/global&value"
    assert [paths.sanitize(p, ["x"]) for p in ("", "/time", "time", "a/b", "/a//b")] == ["", "time", "time", "a/b", "/a/b"]


def test_dictionary_listing_marks(spark):
    leaves = spark.createDataFrame([("a/0/x", 0, 3), ("a/1/x", 5, 4), ("s", None, 1), ("v", None, 9)], "path string, time_idx int, size int")
    assert dict(map(tuple, catalog.tree_lines(leaves).collect())) == {"a[]/x": "Dataset {4/Inf}", "s": "Dataset {SCALAR}", "v": "Dataset {9}"}
    one = spark.createDataFrame([("a", 0, 1)], "path string, time_idx int, size int")
    assert nested.nodes(one).first()["dynamic"] and catalog.dynamic_flags(one).first()["dynamic"]  # a single step is a step
    order = catalog.natural_order(spark.createDataFrame([(f"a/{k}/b",) for k in (10, 9, 2)], "path string"))
    assert [r["path"] for r in order.orderBy("place").collect()] == ["a/2/b", "a/9/b", "a/10/b"]


def test_sorted_files_are_skipped(spark, tmp_path):
    catalog.write_sorted(spark.range(1000).select((F.col("id") * 1.0).alias("t")), str(tmp_path / "s"), partitions=4)
    spans = sorted(spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).agg(F.min("t").alias("a"), F.max("t").alias("b")).select("a", "b").collect())
    assert len(spans) > 1 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_texts(spark):
    df = spark.createDataFrame([(["ab", None, "abcd"], "x" * 1025, [])], "l array<string>, t string, none array<string>")
    r = df.select(strings.to_padded(F.col("l")), strings.from_padded(strings.to_padded(F.col("l"))), F.size(strings.to_slots(F.col("t"), 512)), strings.to_padded(F.col("none")), F.size(strings.to_slots(F.lit(""), 4))).first()
    assert r[0] == ["ab   ", "     ", "abcd "] and r[1] == ["ab", "", "abcd"] and r[2] == 3 and r[3] == [] and r[4] == 1


def test_constants_and_ranks():
    assert convert.name_of(52, convert.TYPES) == "double" and convert.name_of(99, convert.TYPES) == "" and convert.same_minor("1.2.3", "1.2.9") and not convert.same_minor("1.2", "1.3")
    assert convert.checked_rank(2, 2) == 2
    with pytest.raises(convert.RankError):
        convert.checked_rank(1, 2)


def test_addresses():
    parse = store.parse_uri
    assert [backends.backend(parse(f"x:{p}")) for p in ("parquet?path=/a", "memory", "text")] == ["parquet", "memory", "text"] and backends.backend(parse("x://host/any")) == "remote"
    for bad in ("x:hdf5?path=/a", "x:nothing"):
        with pytest.raises(store.StoreError):
            backends.backend(parse(bad))
    q = dict(user="/root", database="db", version="3", pulse="7", run="1")
    assert backends.legacy_path(q, lambda _: None) == "/root/db/3/7/1"
    assert backends.legacy_path(q | {"user": "me"}, lambda u: f"/home/{u}") == "/home/me/public/db/db/3/7/1"
    assert backends.legacy_path({**q, "user": "public"}, lambda _: None, public="/all") == "/all/shared/db/db/3/7/1"
    for bad in (q | {"shot": "7"}, q | {"run": ""}, q | {"user": "public"}, q | {"user": "nobody"}):
        with pytest.raises(store.StoreError):
            backends.legacy_path(bad, lambda _: None)
    there = parse("x://here:80/remote?backend=parquet&path=/a")
    assert backends.without_host(there, ["here"]).path == "parquet" and backends.without_host(there, []) == there


def test_reading_by_name(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    rows = spark.createDataFrame([("a/x", 0, 0.0, 1.0), ("b", None, None, 2.0)], LEAF)
    store.Entry(spark, one, "create").put(rows, "tree")
    store.Entry(spark, two, "create").put(rows.withColumn("value", F.col("value") + 10), "tree", 1)
    links = spark.createDataFrame([("tree", 1, two)], "tree string, occurrence int, file string")
    value = lambda name: sorted(r["value"] for r in backends.read(spark, links, one, name).collect())
    assert value("tree") == [1.0, 2.0] and value("tree:1/a") == [11.0] and value("tree/none") == []
    assert backends.open_leaves(spark, f"x:parquet?path={one}").count() == 2 and backends.open_leaves(spark, "x:null").count() == 0
    assert backends.describe(spark, f"x:parquet?path={one}")["version"] == store.FORMAT_VERSION
    store.write_text(rows.select("*", F.lit("t").alias("tree"), F.lit(0).alias("occurrence")), str(tmp_path / "txt"))
    assert backends.open_leaves(spark, f"x:text?path={tmp_path}/txt").count() == 2


def test_other_minor_versions_are_not_written(spark, tmp_path):
    path = str(tmp_path / "e")
    e, rows = store.Entry(spark, path, "create"), spark.createDataFrame([("a", 0, 0.0, 1.0)], LEAF)
    e.put(rows, "tree")
    spark.createDataFrame([("9.9",)], "value string").write.mode("overwrite").text(f"{path}/_version")
    with pytest.raises(store.VersionMismatch):
        e.put(rows, "tree")


def test_broken_replacement_is_ended(spark, tmp_path):
    path = str(tmp_path / "e")
    e = store.Entry(spark, path, "create")
    e.put(spark.createDataFrame([("a", 0, 0.0, 1.0)], LEAF), "tree")
    fs, old = store._fs(spark, f"{path}/tree=tree/occurrence=0")  # as after a crash between both renamings
    aside = store._fs(spark, f"{path}-old/tree=tree/occurrence=0")[1]
    fs.mkdirs(aside.getParent())
    fs.rename(old, aside)
    assert store.Entry(spark, path).get("tree").count() == 1 and not store.exists(spark, f"{path}-old")


def test_memory_store(spark):
    m, rows = backends.Memory(spark), spark.createDataFrame([("a", 0, 1.0, 1.0)], LEAF)
    m.put("e", rows, "tree")
    m.put("e", rows, "tree")
    m.put_slice("e", spark.createDataFrame([("b", 1.0, 5.0), ("a", 2.0, 6.0)], STEP), "tree")
    assert steps(backends.open_leaves(spark, "x:memory?path=e", memory=m)) == [("a", 0, 1.0, 1.0), ("a", 1, 2.0, 6.0), ("b", 0, 1.0, 5.0)] and m.leaves("none").count() == 0


def test_remote_source_sends_batches(spark):
    def fetch(requests):
        for r in requests:
            yield r, float(len(requests))

    spark.dataSource.register(backends.remote_source("far", fetch, "request string, value double"))
    df = spark.read.format("far").option("requests", "\n".join(f"get(path=p{k})" for k in range(7))).option("batch", "3").load()
    assert sorted(map(tuple, df.collect())) == [(f"get(path=p{k})", 3.0 if k < 6 else 1.0) for k in range(7)]
    assert spark.read.format("far").load().count() == 0


def test_fetched_file(spark, tmp_path):
    (tmp_path / "far.txt").write_text("x")
    assert open(backends.fetch_file(spark, str(tmp_path / "far.txt"))).read() == "x"


class Doubling(Plugin):
    version = "2.0"

    def __init__(self):
        self.seen = []

    def begin(self, action, path):
        self.seen.append(("begin", action, path))

    def end(self, action, path):
        self.seen.append(("end", action, path))

    def begin_array(self, path, rows):
        return rows.limit(1)

    def write_data(self, rows, given):
        return rows.withColumn("value", F.col("value") * 2)

    def read_data(self, rows, given):
        return rows.withColumn("value", F.col("value") / 2)


class Reading(Doubling):
    operation = GET_ONLY


def test_plugin_hooks_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("plugins/get_operation/0/name", 9.0)], "path string, value double")
    assert Plugins().without_reserved(df).count() == 4 and Plugins().of("a") == []
    p, d = Plugins(enabled=True), Doubling()
    p.register("d", d), p.register("r", Reading())
    p.bind("a", "d")
    with p.action("slice", "a"):
        pass
    assert d.seen == [("begin", "slice", "a"), ("end", "slice", "a")] and p.begin_array("a", df).count() == 1 and p.begin_array("b", df).count() == 4
    assert sorted(r["value"] for r in p.write(df, "a").collect()) == [2.0, 6.0] and p.without_reserved(df).count() == 3
    p.bind("b", "r")
    assert p.write(df, "b").first()["value"] == 2.0 and p.read(df, "b").first()["value"] == 1.0  # for reading alone
    p.bind("a", "r")
    with pytest.raises(PluginError):
        p.begin_array("a", df)
    p.write_provenance(spark, str(tmp_path / "p"))
    recorded = spark.read.parquet(str(tmp_path / "p"))
    assert {tuple(r) for r in recorded.collect()} == {("a", "d", PUT_ONLY, "2.0"), ("b", "r", GET_ONLY, "2.0")}
    again = Plugins(enabled=True)
    again.register("d", Doubling())
    assert again.bind_readback(recorded) == [("a", "d")] and sorted(r["value"] for r in again.read(p.write(df, "a"), "a").collect()) == [1.0, 3.0]
    assert {r["path"]: list(r["plugins"]) for r in with_provenance(df.select("path").distinct(), recorded).collect()}["a"] == ["d"]


def test_plugins_are_off_unless_set(spark):
    spark.conf.set("chronolith.plugins.enabled", "true")
    assert Plugins(spark=spark).enabled
    spark.conf.unset("chronolith.plugins.enabled")
    assert not Plugins(spark=spark).enabled


def test_streamed_steps_are_on_the_base(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "entry")
    for rows in ([("a", 1.0, 10.0), ("b", 1.0, 20.0)], [("a", 2.0, 11.0)], [("b", 2.0, 21.0), ("a", 3.0, 12.0)]):
        spark.createDataFrame(rows, STEP).coalesce(1).write.mode("append").parquet(src)
        append.append_steps(spark.readStream.schema(STEP).parquet(src), out, "tree", str(tmp_path / "cp")).awaitTermination()
    assert steps(store.Entry(spark, out).get("tree")) == [("a", 0, 1.0, 10.0), ("a", 1, 2.0, 11.0), ("a", 2, 3.0, 12.0), ("b", 0, 1.0, 20.0), ("b", 1, 2.0, 21.0)]


def test_sliding_and_session_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 03:00:00", 4.0), ("2024-01-03 00:00:00", 0.0)]
    spark.createDataFrame(rows, "ts string, value double").selectExpr("timestamp(ts) as ts", "'a' as k", "value").write.parquet(src)
    for how, want in (({"slide": "30 minutes"}, 5), ({"gap": "1 hour"}, 2)):
        name = "w" + str(want)
        stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(src)
        append.windowed(stream, ["k"], "1 hour", **how).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / (name + "cp"))).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / name)).where("total > 0")
        assert got.count() == want


def test_views_of_tensors(spark):
    from chronolith.operators import tensor

    df = spark.createDataFrame([([100 * i + 10 * j + k for i in range(2) for j in range(3) for k in range(4)],)], "x array<int>")
    got, kept = tensor.view(F.col("x"), [2, 3, 4], [("at", 1), ("from", 1), ("between", 1, 3)])
    assert kept == [2, 2] and df.select(got).first()[0] == [111, 112, 121, 122]
    got, kept = tensor.view(F.col("x"), [2, 3, 4], [tensor.ALL, ("to", 1), ("at", 3)])
    assert kept == [2, 1] and df.select(got).first()[0] == [3, 103]
    for bad in ([("at", 2), tensor.ALL, tensor.ALL], [tensor.ALL], [("between", 1, 5), tensor.ALL, tensor.ALL]):
        with pytest.raises(IndexError):
            tensor.view(F.col("x"), [2, 3, 4], bad)


def test_cached_base(spark):
    rows, base = spark.range(3).select("id", (F.col("id") % 2).alias("k")), spark.createDataFrame([(0, 1.0), (1, 2.0)], "k long, t double")
    assert sorted(r["t"] for r in bases.on_cached_base(rows, base, ["k"]).collect()) == [1.0, 1.0, 2.0]


def test_selections_of_flat_rows(spark):
    from chronolith.plans import selection

    df = spark.createDataFrame([(0.5, 0), (1.5, 1), (2.5, 2)], "t double, i int")
    n = lambda p: df.where(selection.condition(p, F.col("t"), F.col("i"))).count()
    assert [n(p) for p in ("a[time=1:2]/x", "a[1]/x", "a[1:]/x", "a[:2]/x", "a[time=1]/x", "a/x")] == [1, 1, 2, 2, 3, 3]


def test_shapes_take_tasks_as_rows_ask(spark, monkeypatch):
    monkeypatch.setattr(tasks, "TASK_ROWS", 40)
    rows = [(f"a/{k}", t, [k, t, n], n) for k in range(20) for t in range(5) for n in range(4)]
    got = catalog.shapes(spark.createDataFrame(rows, "path string, time_idx int, shape array<int>, seq int"))
    assert {(r["path"], r["time_idx"]): r["shape"] for r in got.collect()} == {(f"a/{k}", t): [k, t, 3] for k in range(20) for t in range(5)}
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4  # the session's shuffle partitions
