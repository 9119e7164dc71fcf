"""Interpolation against the plain rules, with gaps and without."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import tasks, timeops


def plain(base, samples, t, mode):
    """The rules in Python: samples maps time to value (a gap where the base has a time that samples lacks)."""
    if not samples:
        return None
    at = sorted(samples)
    lo, hi = [x for x in at if x <= t], [x for x in at if x >= t]
    if mode == "previous":
        return samples[lo[-1]] if lo else samples[hi[0]]
    if mode == "linear":
        if not lo or not hi:
            return samples[(lo or hi)[-1 if lo else 0]]
        a, b = lo[-1], hi[0]
        return samples[a] if a == b else samples[a] + (samples[b] - samples[a]) * ((t - a) / (b - a))
    step = min(base, key=lambda x: (abs(t - x), -x))
    if step in samples:
        return samples[step]
    lo, hi = [x for x in at if x <= step], [x for x in at if x >= step]
    if not lo or not hi:
        return samples[(lo or hi)[-1 if lo else 0]]
    return samples[hi[0]] if abs(hi[0] - t) < abs(t - lo[-1]) else samples[lo[-1]]


@pytest.mark.parametrize("bucket", [None, 0.25])
@pytest.mark.parametrize("mode", ["previous", "linear"])
def test_random_bases(spark, mode, bucket):
    rng = random.Random(3)
    rows, want, asked = [], {}, []
    for k in range(12):
        base = [i / 8 for i in sorted(rng.sample(range(24), 8))]
        have = {t: float(rng.randrange(100)) for t in base if rng.random() < 0.6}
        rows += [(k, t, v) for t, v in have.items()]
        for t in [x / 16 - 0.5 for x in range(0, 64, 5)]:
            asked.append((k, t))
            want[k, t] = plain(base, have, t, mode)
    got = timeops.get_slice(spark.createDataFrame(rows, "k int, t double, v double"), spark.createDataFrame(asked, "k int, t double"), ["k"], mode, bucket=bucket)
    assert {(r["k"], r["t"]): r["v"] for r in got.collect()} == want


def test_closest_with_gaps(spark):
    rng = random.Random(5)
    base_rows, rows, asked, want = [], [], [], {}
    for k in range(12):
        base = [i / 8 for i in sorted(rng.sample(range(24), 8))]
        have = {t: float(rng.randrange(100)) for t in base if rng.random() < 0.6}
        base_rows += [(k, t) for t in base]
        rows += [(k, "a", t, v) for t, v in have.items()]
        for t in [x / 16 for x in range(0, 56, 3)]:
            asked.append((k, "a", t))
            want[k, t] = plain(base, have, t, "closest")
    got = timeops.get_slice_gaps(
        spark.createDataFrame(base_rows, "k int, t double"), spark.createDataFrame(rows, "k int, s string, t double, v double"),
        spark.createDataFrame(asked, "k int, s string, t double"), ["k"], ["s"],
    )
    assert {(r["k"], r["t"]): r["v"] for r in got.collect()} == want


@pytest.mark.parametrize(("mode", "t", "want"), [("closest", 0.2, 101.0), ("previous", 0.2, 101.0), ("linear", 0.2, 102.0), ("linear", 9.0, 104.0), ("previous", -1.0, 100.0)])
def test_gap_fixture(spark, mode, t, want):
    s = spark.createDataFrame([(1, "a", 0.0, 100.0), (1, "a", 0.1, 101.0), (1, "a", 0.2, None), (1, "a", 0.1 * 3, 103.0), (1, "a", 0.4, 104.0)], "k int, s string, t double, v double")
    r = spark.createDataFrame([(1, "a", t)], "k int, s string, t double")
    got = timeops.get_slice_gaps(s, s, r, ["k"], ["s"]) if mode == "closest" else timeops.get_slice(s, r, ["k", "s"], mode)
    assert got.first()["v"] == pytest.approx(want)


def test_kinds(spark):
    two = lambda kind, a, b, t=0.5: timeops.get_slice(spark.createDataFrame([(1, 0.0, a), (1, 1.0, b)], f"k int, t double, v {kind[1]}"), spark.createDataFrame([(1, t)], "k int, t double"), ["k"], "linear", kind[0]).first()["v"]
    assert two(("int", "int"), 2, 3) == 3 and two(("int", "int"), -2, -3) == -3
    assert two(("string", "string"), "a", "b") == "" and two(("string", "string"), "a", "a") == "a"
    assert two(("array", "array<double>"), [1.0, 2.0], [3.0, 4.0]) == [2.0, 3.0] and two(("array", "array<double>"), [1.0], [3.0, 4.0]) is None


def test_grid_and_range(spark):
    assert timeops.step_grid(0.55, 0.95, 0.2) == pytest.approx([0.55, 0.75, 0.95])
    assert timeops.step_grid(0, 1, 0) == []
    s = spark.createDataFrame([(k, 0.1 * k, 100 + k) for k in range(1, 11)], "k int, t double, v int")
    assert timeops.get_range(s, 0.3, 0.8).count() == 6
    with pytest.raises(ValueError):
        timeops.get_range(s, 1, 0)
    with pytest.raises(ValueError):
        timeops.resolve(timeops.bracket(s, s.select("k", "t"), ["k"]), "cubic")


def test_empty(spark):
    none = spark.createDataFrame([], "k int, t double, v double")
    asked = spark.createDataFrame([(1, 0.5)], "k int, t double")
    assert timeops.get_slice(none, asked, ["k"], "linear").first()["v"] is None
    assert timeops.whole_signal(none, ["k"]).count() == 0


def test_range_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, 1.0)], "k int, t double, v double").write.parquet(str(tmp_path / "x"))
    plan = timeops.get_range(spark.read.parquet(str(tmp_path / "x")), 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,0.0)" in plan


@pytest.mark.parametrize("bucket", [None, 0.25])
def test_gaps_take_tasks_as_rows_ask(spark, monkeypatch, bucket):
    monkeypatch.setattr(tasks, "TASK_ROWS", 40)
    rng = random.Random(7)
    base_rows, rows, asked, want = [], [], [], {}
    for k in range(12):
        base = [i / 8 for i in sorted(rng.sample(range(24), 8))]
        have = {t: float(rng.randrange(100)) for t in base if rng.random() < 0.6}
        base_rows += [(k, t) for t in base]
        rows += [(k, "a", t, v) for t, v in have.items()]
        for t in [x / 16 for x in range(0, 96, 5)]:
            asked.append((k, "a", t))
            want[k, t] = plain(base, have, t, "closest")
    got = timeops.get_slice_gaps(
        spark.createDataFrame(base_rows, "k int, t double"), spark.createDataFrame(rows, "k int, s string, t double, v double"),
        spark.createDataFrame(asked, "k int, s string, t double"), ["k"], ["s"], bucket,
    )
    assert {(r["k"], r["t"]): r["v"] for r in got.collect()} == want
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4  # the session's shuffle partitions
