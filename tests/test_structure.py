"""Paths, tensors, arrays of structs, plugins, store and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import paths
from chronolith.functions.plugins import PluginError, Plugins
from chronolith.operators import nested, tensor
from chronolith.plans import selection
from chronolith.sources import store
from chronolith.streaming import append


@pytest.mark.parametrize("path", ["node1/node2/leaf", "parent[3]/child", "array[:]/data", "time[10:20]", "signal[:50]", "data[100:]/value", "A[0]/B[10:20]/C[:]/D[5:]", "a[time=1.5:4.5]/x", "a[time=2.5,interp=linear]/x"])
def test_paths_that_parse(path):
    assert selection.parse(path)


@pytest.mark.parametrize("path", ["A[3]B/C", "A[10:a]", "a[time=x]", "a[time=1,interp=cubic]", "a//b", "a[1"])
def test_paths_that_dont(path):
    with pytest.raises(selection.PathError):
        selection.parse(path)


def test_selection(spark):
    kind = "profiles array<struct<time:double,sig:double,ion:array<struct<z:double>>>>"
    row = [{"time": float(t), "sig": 10.0 * t, "ion": [{"z": 100.0 + t + i} for i in range(3)]} for t in range(1, 6)]
    df, arrays = spark.createDataFrame([(row,)], kind), {"profiles", "ion"}
    get = lambda p: df.select(selection.column(p, arrays).alias("x")).first()["x"]
    assert get("profiles[1:3]/ion/z") == [[102.0, 103.0, 104.0], [103.0, 104.0, 105.0]]
    assert get("profiles[time=1.5:3.5]/sig") == [20.0, 30.0]
    assert get("profiles[time=2.7]/sig") == [30.0] and get("profiles[time=2.5]/sig") == [30.0]
    assert get("profiles[time=2.5,interp=linear]/sig") == [25.0]
    assert get(selection.bind("profiles[]/ion[]/z", [0, 2])) == [[103.0]]
    assert get("profiles[3:99]/sig") == [40.0, 50.0] and get("profiles[9]/sig") == []


def test_strides_and_slabs(spark):
    x = np.array([[[100 * i + 10 * j + k for k in range(4)] for j in range(3)] for i in range(2)])
    df = spark.createDataFrame([(x.ravel().tolist(),)], "v array<int>")
    get = lambda *a: df.select(tensor.hyperslab(F.col("v"), [2, 3, 4], *a).alias("x")).first()["x"]
    assert get([0, 0, 0], [2, 2, 2]) == x[:2, :2, :2].ravel().tolist()
    assert get([0, 0, 0], [-1, -1, -1], [1, 2, 2]) == x[:, ::2, ::2].ravel().tolist()
    assert df.select(tensor.time_last(F.col("v"), [2, 12]).alias("x")).first()["x"] == x.reshape(2, 12).T.ravel().tolist()
    with pytest.raises(ValueError):
        tensor.places([2], [0], [2], [0])
    with pytest.raises(IndexError):
        tensor.places([2], [1], [2])


def test_nest_round_trip(spark):
    rows = [(k, i, float(k * i)) for k in range(3) for i in range(k + 1)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    packed = nested.nest(df, ["k"], "i", ["i", "v"], "e")
    back = nested.unnest(packed, "e").select("k", "i", "v").collect()
    assert sorted(map(tuple, back)) == rows
    again = packed.select("k", nested.inflate(nested.deflate(F.col("e"), ["i", "v"]), ["i", "v"]).alias("e"))
    assert sorted(map(tuple, nested.unnest(again, "e").select("k", "i", "v").collect())) == rows


def test_padded(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)], "k string, i int, v double")
    assert sorted(map(tuple, nested.padded(df, ["k"], "i", "v", -1.0).collect())) == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, -1.0), ("b", 0, -1.0), ("b", 1, -1.0), ("b", 2, 3.0)]
    assert nested.holes(df, ["k"], "i").first()["n_holes"] == 3


def test_path_functions(spark):
    df = spark.createDataFrame([("/a/0/b/12/c1",), ("x:2/y/z",), ("plain",)], "p string")
    p = F.col("p")
    got = df.select(paths.strip_indices(p), paths.flat_name(p), paths.last_segment(p), paths.split_name(p)).collect()
    assert got[0][0] == "a/b/c1" and got[0][1] == "a&0&b&12&c1" and got[0][2] == "c1"
    assert tuple(got[1][3]) == ("x", 2, "y/z") and tuple(got[2][3]) == ("plain", 0, "")


def test_plugins(spark):
    df, p = spark.createDataFrame([("a/b", 1.0), ("c", 2.0)], "path string, value double"), Plugins(enabled=True)
    p.register("double", lambda rows, given: rows.withColumn("value", F.col("value") * given.get("by", 2)))
    p.bind("a/*", "double")
    assert p.read(df, "a/b").first()["value"] == 2.0 and p.read(df, "c").first()["value"] == 2.0
    assert p.provenance(spark).count() == 1
    for wrong in (lambda: p.register("double", None), lambda: p.bind("x", "none"), lambda: p.bind("a/*", "double"), lambda: p.unbind("c", "double"), lambda: p.unregister("none")):
        with pytest.raises(PluginError):
            wrong()
    p.enabled = False
    assert p.read(df, "a/b").first()["value"] == 1.0


def test_store(spark, tmp_path):
    path = str(tmp_path / "entry")
    with pytest.raises(store.NotThere):
        store.Entry(spark, path)
    e = store.Entry(spark, path, "create")
    assert e.leaves().count() == 0
    rows = spark.createDataFrame([("a/x", 0, 0.0, 1.0), ("a/y", 0, 0.0, None), ("s", None, None, 5.0)], "path string, time_idx int, t double, value double")
    e.put(rows, "tree")
    e.put(rows, "other", 1)
    assert e.get("tree").count() == 2 and e.leaves().count() == 4
    e.put_slice(spark.createDataFrame([("a/x", 0.1, 2.0), ("a/x", 0.2, 3.0), ("a/y", 0.2, 9.0)], "path string, t double, value double"), "tree")
    assert sorted((r["path"], r["time_idx"], r["value"]) for r in e.get("tree").where("t > 0").collect()) == [("a/x", 1, 2.0), ("a/x", 2, 3.0), ("a/y", 2, 9.0)]
    e.replace_last(spark.createDataFrame([("a/x", 7.0)], "path string, value double"), "tree")
    assert [r["value"] for r in e.get("tree").where("time_idx = 2").collect()] == [7.0]
    with pytest.raises(store.BadWrite):
        e.put_slice(rows, "tree")
    e.delete("tree", "a")
    assert [r["path"] for r in e.get("tree").collect()] == ["s"]
    e.delete("tree")
    assert e.get("tree").count() == 0 and e.get("other", 1).count() == 2
    with pytest.raises(store.AlreadyThere):
        store.Entry(spark, path, "create")
    assert store.Entry(spark, path, "force_create").leaves().count() == 0


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.1, 1 / 3, "t", 0), ("b", None, None, -2.5e-300, "t", 1)], store.SCHEMA)
    want = sorted(map(repr, df.collect()))
    assert sorted(map(repr, store.deserialize(store.serialize(df)).select(*df.columns).collect())) == want
    store.write_text(df, str(tmp_path / "t"))
    assert sorted(map(repr, store.read_text(spark, str(tmp_path / "t")).collect())) == want


def test_uri():
    u = store.parse_uri("x://host:99/y?path=/a/b;user=me#ids:1/z")
    assert (u.scheme, u.host, u.port, u.path, u.query, u.fragment) == ("x", "host", 99, "y", {"path": "/a/b", "user": "me"}, "ids:1/z")
    for bad in ("nothing", "x://h:p/y"):
        with pytest.raises(store.StoreError):
            store.parse_uri(bad)


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, t double, value double"
    for k in range(3):
        spark.createDataFrame([("a", float(k), k * 1.5)], schema).write.mode("append").parquet(src)
        append.append_stream(spark, src, schema, out, str(tmp_path / "cp"), 1).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, spark.read.parquet(src).collect()))


def test_stream_windows(spark, tmp_path):
    """Append mode: a window comes out when the watermark passes it, and what is later than that is dropped."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("2024-01-01 01:00:00", 1.0), ("2024-01-01 02:00:00", 2.0)], [("2024-01-03 12:00:00", 4.0)], [("2024-01-01 03:00:00", 99.0), ("2024-01-05 12:00:00", 5.0)], [("2024-01-09 00:00:00", 6.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, value double").selectExpr("timestamp(ts) as ts", "'a' as k", "value").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(src)
        append.latest_values(stream, ["k"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r["window_start"])[:10], r["last_value"], r["n_values"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 2.0, 2), ("2024-01-03", 4.0, 1), ("2024-01-05", 5.0, 1)]
