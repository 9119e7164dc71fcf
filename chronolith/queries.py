"""The queries of the library over the driver's tables, and their SQL.

Events are signals: the element is the user, the signal the event's type, and all times of a user are its base, on
which each signal has gaps. Orders with their lines are arrays of structs, vectors are tensors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import paths, values
from chronolith.functions.plugins import Plugins
from chronolith.operators import nested, tensor, timeops
from chronolith.plans import selection
from chronolith.sources import store

FLAGSHIP = "t1_slice_previous"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = ["user_id", "event_type"]
T0, STEP, N = 1704000000.0, 65000.0, 40
TIMES = [T0 + i * STEP for i in range(N)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(*KEYS, timeops.seconds(F.col("ts")).alias("t"), F.col("value").alias("v"), "event_id")


_S = "s AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t, value AS v, event_id FROM events)"
_R = f"{_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT user_id, event_type, {T0}::DOUBLE + i * {STEP}::DOUBLE AS t FROM k, range({N}) g(i))"


def _b(s: str = "s", r: str = "r") -> str:
    return f"""b AS (SELECT {r}.*, lo.t AS lt, lo.v AS lv, hi.t AS ht, hi.v AS hv FROM {r}
ASOF LEFT JOIN {s} lo ON {r}.user_id = lo.user_id AND {r}.event_type = lo.event_type AND {r}.t >= lo.t
ASOF LEFT JOIN {s} hi ON {r}.user_id = hi.user_id AND {r}.event_type = hi.event_type AND {r}.t <= hi.t)"""


_LINEAR = "CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv WHEN lt = ht THEN lv ELSE lv + (hv - lv) * ((t - lt) / (ht - lt)) END"
_CLOSEST = "CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv WHEN ht - t <= t - lt THEN hv ELSE lv END"
_OUT = "SELECT user_id, event_type, t, {} AS v FROM b"


@query(f"WITH {_R}, {_b()} {_OUT.format('coalesce(lv, hv)')}")
def t1_slice_previous(spark, d):
    return timeops.resample(samples(spark, d), KEYS, TIMES, "previous", order="event_id")


@query(f"WITH {_R}, {_b()} {_OUT.format(_CLOSEST)}")
def t1_slice_closest(spark, d):
    return timeops.resample(samples(spark, d), KEYS, TIMES, "closest", order="event_id")


@query(f"WITH {_R}, {_b()} {_OUT.format(_LINEAR)}")
def t5_slice_linear(spark, d):
    return timeops.resample(samples(spark, d), KEYS, TIMES, "linear", order="event_id")


@query(f"WITH {_R}, {_b()} {_OUT.format(_LINEAR)}")
def t8_slice_linear_bucketed(spark, d):
    return timeops.resample(samples(spark, d), KEYS, TIMES, "linear", order="event_id", bucket=3 * 86400.0)


@query(f"WITH {_R}, si AS (SELECT user_id, event_type, t, floor(v)::INTEGER - 200 AS v FROM s), {_b('si')} SELECT user_id, event_type, t, CAST(CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv WHEN lt = ht THEN lv ELSE sign(lv::DOUBLE + (hv::DOUBLE - lv::DOUBLE) * ((t - lt) / (ht - lt))) * floor(abs(lv::DOUBLE + (hv::DOUBLE - lv::DOUBLE) * ((t - lt) / (ht - lt))) + 0.5::DOUBLE) END AS INTEGER) AS v FROM b")
def t5_linear_int(spark, d):
    s = samples(spark, d).withColumn("v", F.floor("v").cast("int") - 200)
    return timeops.resample(s, KEYS, TIMES, "linear", "int", order="event_id")


@query(f"WITH {_R}, ss AS (SELECT user_id, event_type, t, CASE WHEN v < 245 THEN 'low' ELSE 'high' END AS v FROM s), {_b('ss')} SELECT user_id, event_type, t, CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv WHEN lt = ht OR lv = hv THEN lv ELSE '' END AS v FROM b")
def t5_linear_string(spark, d):
    s = samples(spark, d).withColumn("v", F.when(F.col("v") < 245, "low").otherwise("high"))
    return timeops.resample(s, KEYS, TIMES, "linear", "string", order="event_id")


@query(f"WITH {_R}, {_b()}, c AS ({_OUT.format(_LINEAR)}) SELECT user_id, event_type, t, round(v, 6) AS re, round(-2 * v, 6) AS im FROM c")
def t5_linear_complex(spark, d):
    s = samples(spark, d).withColumn("v", values.complex_of(F.col("v"), -2 * F.col("v")))
    out = timeops.resample(s, KEYS, TIMES, "linear", "complex", order="event_id")
    return out.select(*KEYS, "t", F.round("v.re", 6).alias("re"), F.round("v.im", 6).alias("im"))


@query(f"WITH {_S} SELECT user_id, event_type, t, v FROM s WHERE t BETWEEN 1704500000.25 AND 1705500000.5")
def t2_time_range(spark, d):
    return timeops.get_range(samples(spark, d), 1704500000.25, 1705500000.5).select(*KEYS, "t", "v")


@query(f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT user_id, event_type, 1704400000.5::DOUBLE + i * 86400.25::DOUBLE AS t FROM k, range(12) g(i)), {_b()} {_OUT.format(_LINEAR)}")
def t6_resample_step(spark, d):
    return timeops.resample(samples(spark, d), KEYS, timeops.step_grid(1704400000.5, 1704400000.5 + 11 * 86400.25, 86400.25), "linear", order="event_id")


@query(f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT user_id, event_type, t FROM k, (SELECT unnest([0.0::DOUBLE, 1704412345.5::DOUBLE, 1704999999.0::DOUBLE, 1705555555.25::DOUBLE, 9999999999.0::DOUBLE]) AS t) x), {_b()} {_OUT.format(_LINEAR)}")
def t4_resample_vector(spark, d):
    return timeops.resample(samples(spark, d), KEYS, [0.0, 1704412345.5, 1704999999.0, 1705555555.25, 9999999999.0], "linear", order="event_id")


_GAPS = f"""WITH {_R}, base AS (SELECT DISTINCT user_id, t FROM s),
q AS (SELECT DISTINCT user_id, t AS asked FROM r),
bb AS (SELECT q.*, lo.t AS lt, hi.t AS ht FROM q ASOF LEFT JOIN base lo ON q.user_id = lo.user_id AND q.asked >= lo.t ASOF LEFT JOIN base hi ON q.user_id = hi.user_id AND q.asked <= hi.t),
tb AS (SELECT user_id, asked, CASE WHEN lt IS NULL THEN ht WHEN ht IS NULL THEN lt WHEN ht - asked <= asked - lt THEN ht ELSE lt END AS t FROM bb),
r2 AS (SELECT r.user_id, r.event_type, r.t AS asked, tb.t AS t FROM r JOIN tb ON r.user_id = tb.user_id AND r.t = tb.asked), {_b('s', 'r2')}
SELECT user_id, event_type, asked AS t, CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR lt = t THEN lv WHEN abs(ht - asked) < abs(asked - lt) THEN hv ELSE lv END AS v FROM b"""


@query(_GAPS)
def t7_gap_fill_closest(spark, d):
    s = samples(spark, d)
    asked = timeops.with_times(s.select(*KEYS).distinct(), TIMES)
    return timeops.get_slice_gaps(s, s, asked, ["user_id"], ["event_type"])


@query(f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT k.user_id, k.event_type, x.t FROM k JOIN (SELECT DISTINCT user_id, t FROM s WHERE t BETWEEN 1705000000 AND 1705300000) x ON k.user_id = x.user_id), {_b()} {_OUT.format('coalesce(lv, hv)')}")
def t11_range_filled(spark, d):
    s = samples(spark, d)
    return timeops.get_range_filled(s, s, ["user_id"], ["event_type"], 1705000000.0, 1705300000.0, "previous")


@query(f"WITH {_S} SELECT user_id, event_type, count(*) AS n_steps FROM s WHERE t BETWEEN 1704500000 AND 1705500000 GROUP BY ALL")
def t12_range_size(spark, d):
    return timeops.get_range(samples(spark, d), 1704500000.0, 1705500000.0).groupBy(*KEYS).agg(F.count("*").alias("n_steps"))


@query(f"WITH {_S} SELECT user_id, event_type, len(list(v)) AS n, array_to_string(list(round(v, 2) ORDER BY t), ',') AS body FROM s GROUP BY ALL")
def t14_whole_signal(spark, d):
    w = timeops.whole_signal(samples(spark, d), KEYS)
    return w.select(*KEYS, F.size("values").cast("long").alias("n"), F.array_join(F.transform("values", lambda x: F.round(x, 2).cast("string")), ",").alias("body"))


LINES = ["l_linenumber", "l_partkey", "l_quantity"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", *LINES)
    return nested.nest(lines, ["l_orderkey"], "l_linenumber", LINES, "lines")


_ROWN = "x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem)"


@query(f"WITH {_ROWN} SELECT l_orderkey, CAST(i AS INTEGER) AS index, l_linenumber, l_partkey, l_quantity FROM x")
def c2_iterate_elements(spark, d):
    return nested.unnest(orders(spark, d), "lines")


@query("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS size FROM lineitem GROUP BY 1")
def c1_array_size(spark, d):
    return orders(spark, d).select("l_orderkey", F.size("lines").alias("size"))


@query(f"WITH {_ROWN} SELECT l_orderkey, l_partkey FROM x WHERE i = 1")
def p3_index_selection(spark, d):
    return orders(spark, d).select("l_orderkey", F.explode(selection.column("lines[1]/l_partkey", {"lines"})).alias("l_partkey"))


@query(f"WITH {_ROWN} SELECT l_orderkey, l_partkey FROM x WHERE i >= 1 AND i < 3")
def p4_index_range(spark, d):
    return orders(spark, d).select("l_orderkey", F.explode(selection.column("lines[1:3]/l_partkey", {"lines"})).alias("l_partkey"))


def timed(spark: SparkSession, d: str, path: str = "steps") -> DataFrame:
    """Signals as arrays of steps, of which only those are nested that path can select."""
    s = samples(spark, d).select(*KEYS, F.col("t").alias("time"), "v").where(selection.condition(path, F.col("time")))
    return nested.nest(s, KEYS, "time", ["v"], "steps")


@query(f"WITH {_S} SELECT user_id, event_type, v FROM s WHERE t BETWEEN 1704500000 AND 1705000000")
def p5_time_selection(spark, d):
    path = "steps[time=1704500000:1705000000]/v"
    return timed(spark, d, path).select(*KEYS, F.explode(selection.column(path, {"steps"})).alias("v"))


_ONE = f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT user_id, event_type, 1704700000::DOUBLE AS t FROM k), {_b()} SELECT user_id, event_type, {{}} AS v FROM b"


@query(_ONE.format(_CLOSEST))
def p6_time_point_closest(spark, d):
    return timed(spark, d).select(*KEYS, F.explode(selection.column("steps[time=1704700000]/v", {"steps"})).alias("v"))


@query(_ONE.format(_LINEAR))
def p6_time_point_linear(spark, d):
    return timed(spark, d).select(*KEYS, F.explode(selection.column("steps[time=1704700000,interp=linear]/v", {"steps"})).alias("v"))


_X = "x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"


@query(f"WITH {_X} SELECT vec_id, v FROM x WHERE k // 16 IN (1, 2) AND (k // 4) % 4 IN (0, 1) AND k % 4 = 3")
def p9_hyperslab(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode(tensor.hyperslab(F.col("embedding"), [4, 4, 4], [1, 0, 3], [2, 2, 1])).alias("v"))


@query(f"WITH {_X} SELECT vec_id, v FROM x WHERE (k // 16) % 1 = 0 AND (k // 4) % 4 % 2 = 0 AND k % 4 % 3 = 0")
def p10_strides(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode(tensor.hyperslab(F.col("embedding"), [4, 4, 4], [0, 0, 0], [-1, -1, -1], [1, 2, 3])).alias("v"))


@query(f"WITH {_X} SELECT vec_id, CAST((k % 16) * 4 + k // 16 AS INTEGER) AS place, v FROM x")
def p8_time_last_layout(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(tensor.time_last(F.col("embedding"), [4, 16])).alias("place", "v"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a tree of leaves, one per line and field: path with indices, time step, size."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    field = F.explode(F.array(F.lit("quantity"), F.lit("flag"))).alias("field")
    out = lines.select("*", field)
    path = F.concat(F.lit("order/"), F.pmod("l_orderkey", F.lit(7)).cast("string"), F.lit("/line/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("field"))
    return out.select(
        path.alias("path"), F.when(F.col("field") == "quantity", (F.col("l_linenumber") - 1).cast("int")).alias("time_idx"),
        F.when(F.col("field") == "flag", F.length("l_returnflag")).otherwise(F.col("l_quantity").cast("int")).alias("size"),
        F.lit("orders").alias("tree"), F.pmod("l_orderkey", F.lit(3)).cast("int").alias("occurrence"),
    )


@query("""SELECT 'order/line/quantity' AS schema_path, count(*) AS n_rows, CAST(max(l_linenumber) AS INTEGER) AS coverage, max(CAST(l_quantity AS INTEGER)) AS max_size, true AS dynamic FROM lineitem
UNION ALL SELECT 'order/line/flag', count(*), NULL, CAST(max(length(l_returnflag)) AS INTEGER), false FROM lineitem""")
def a3_node_listing(spark, d):
    return nested.nodes(leaves(spark, d))


@query("SELECT DISTINCT 'orders' AS tree, CAST(l_orderkey % 3 AS INTEGER) AS occurrence FROM lineitem")
def a4_occurrences(spark, d):
    return nested.occurrences(leaves(spark, d))


@query("SELECT DISTINCT unnest(['order/line/quantity', 'order/line/flag']) AS schema_path")
def a5_filled_paths(spark, d):
    return nested.filled_paths(leaves(spark, d))


@query("SELECT l_orderkey, max(l_linenumber) + 1 AS size FROM lineitem GROUP BY 1")
def a1_array_size(spark, d):
    return nested.sizes(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("SELECT count(*) AS n_rows, max(w) AS width, CAST(sum(n) AS BIGINT) AS n_elements, CAST(count(*) * max(w) - sum(n) AS BIGINT) AS n_holes FROM (SELECT l_orderkey, max(l_linenumber) AS w, count(*) AS n FROM lineitem GROUP BY 1)")
def a7_holes(spark, d):
    return nested.holes(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i")), ["l_orderkey"], "i")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def a10_last_write(spark, d):
    return nested.last_write(table(spark, d, "events").select(*KEYS, "value", "event_id"), KEYS, "value", "event_id")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_elements, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes FROM embeddings")
def a12_tensor_totals(spark, d):
    e = table(spark, d, "embeddings")
    n = tensor.extent(F.array(F.lit(4).cast("long"), F.lit(4).cast("long"), (F.size("embedding") / 16).cast("long")))
    return e.select("vec_id", n.alias("n_elements"), (n * 4).alias("n_bytes"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def o5_first_n(spark, d):
    return nested.first_n(table(spark, d, "events").select(*KEYS, "ts", "event_id"), KEYS, ["ts", "event_id"], 3).select(*KEYS, "event_id")


@query("WITH x AS (SELECT l_orderkey, CAST(l_linenumber - 1 AS INTEGER) AS i, CAST(max(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL), w AS (SELECT max(i) AS w FROM x), g AS (SELECT o.l_orderkey, CAST(i AS INTEGER) AS i FROM (SELECT DISTINCT l_orderkey FROM x) o, (SELECT unnest(range(0, w + 1)) AS i FROM w)) SELECT g.l_orderkey, g.i, coalesce(x.q, CAST(-9e40 AS DOUBLE)) AS q FROM g LEFT JOIN x ON g.l_orderkey = x.l_orderkey AND g.i = x.i")
def v1_padded_view(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") - 1).cast("int").alias("i")).agg(F.max(F.col("l_quantity").cast("double")).alias("q"))
    return nested.padded(rows, ["l_orderkey"], "i", "q", values.EMPTY_DOUBLE)


@query("SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity), ',') AS parts, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1")
def r1_deflate(spark, d):
    s = orders(spark, d).select("l_orderkey", nested.deflate(F.col("lines"), LINES).alias("s"))
    return s.select("l_orderkey", F.array_join(F.transform("s.l_partkey", lambda x: x.cast("string")), ",").alias("parts"), F.size("s.l_quantity").alias("n"))


@query(f"WITH {_ROWN} SELECT l_orderkey, CAST(i AS INTEGER) AS index, l_linenumber, l_partkey, l_quantity FROM x")
def r2_inflate(spark, d):
    s = orders(spark, d).select("l_orderkey", nested.deflate(F.col("lines"), LINES).alias("s"))
    return nested.unnest(s.select("l_orderkey", nested.inflate(F.col("s"), LINES).alias("lines")), "lines")


_TREE = "p AS (SELECT '/' || r_name || '/' || CAST(n_nationkey AS VARCHAR) || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("/"), "r_name", F.lit("/"), F.col("n_nationkey").cast("string"), F.lit("/"), "n_name").alias("path"))


@query(f"""WITH {_TREE} SELECT path, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), '/') AS schema_path,
replace(substr(path, 2), '/', '&') AS flat, regexp_extract(path, '[^/&]*$') AS last, replace(path, '/', ':') AS colon, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM p""")
def f1_path_functions(spark, d):
    p = F.col("path")
    return tree_paths(spark, d).select(
        p, paths.strip_indices(p).alias("schema_path"), paths.flat_name(p).alias("flat"), paths.last_segment(p).alias("last"), paths.colon_name(p).alias("colon"), paths.parent(p).alias("parent")
    )


@query("SELECT vec_id, CAST((vec_id % 4) * 20 + (vec_id % 5) * 4 + vec_id % 3 AS BIGINT) AS flat, CAST(vec_id % 60 // 20 AS BIGINT) AS i, CAST(vec_id % 60 // 4 % 5 AS BIGINT) AS j, CAST(vec_id % 4 AS BIGINT) AS k FROM embeddings")
def f11_index_arithmetic(spark, d):
    v = F.col("vec_id")
    flat = values.flat_index([F.pmod(v, F.lit(4)), F.pmod(v, F.lit(5)), F.pmod(v, F.lit(3))], [F.lit(4), F.lit(5), F.lit(4)])
    i, j, k = values.multi_index(F.pmod(v, F.lit(60)), [3, 5, 4])
    return table(spark, d, "embeddings").select("vec_id", flat.cast("long").alias("flat"), i.cast("long").alias("i"), j.cast("long").alias("j"), k.cast("long").alias("k"))


@query("SELECT event_id, value FROM events WHERE value >= 100")
def k8_empty_values_dropped(spark, d):
    v = F.when(F.col("value") < 100, F.lit(values.EMPTY_DOUBLE)).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", values.to_null(v, values.EMPTY_DOUBLE).alias("value")).where("value is not null")


@query("SELECT 'events' AS tree, event_type AS path, count(*) AS n_values, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def k14_serialized_round_trip(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("path"), F.lit(0).alias("time_idx"), timeops.seconds(F.col("ts")).alias("t"), "value", F.lit("events").alias("tree"), F.lit(0).alias("occurrence"))
    back = store.deserialize(store.serialize(e))
    return back.groupBy("tree", "path").agg(F.count("value").alias("n_values"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type AS path, round(2.5 * sum(value), 4) AS total FROM events WHERE event_type = 'click' GROUP BY 1")
def u3_plugin_read(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("path"), "value")
    p = Plugins(enabled=True)
    p.register("scale", lambda rows, given: rows.withColumn("value", F.col("value") * given["by"]))
    p.bind("click", "scale")
    p.set("scale", "by", 2.5)
    return p.read(e, "click").groupBy("path").agg(F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {_S}, d AS (SELECT user_id, event_type, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS gap FROM s) SELECT user_id, event_type, max(gap) AS longest_gap FROM d GROUP BY ALL")
def t7_longest_gap(spark, d):
    w = Window.partitionBy(*KEYS).orderBy("t", "event_id")
    return samples(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy(*KEYS).agg(F.max("gap").alias("longest_gap"))


from chronolith import tree_queries  # noqa: E402, F401  registers its queries
