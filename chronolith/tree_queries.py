"""Queries of trees of leaves: time bases, nested slices, catalog, views, texts and addresses, beside their SQL.

Events are signals with three kinds of base, by the remainder of the user: beside the signal, of the user, and at the
root, where the step is the day. Orders with their lines are leaves with indices in their paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import convert, paths, plugins, strings, values
from chronolith.operators import bases, catalog, nested, tensor, timeops, trees, views
from chronolith.plans import selection
from chronolith.queries import _GAPS, _LINEAR, _S, _b, KEYS, TIMES, leaves, orders, query, samples, table, timed
from chronolith.sources import backends

DAY0, DAY, AT = 1704067200.0, 86400.0, 1704700000.5


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Leaves (path, time_idx, t null, value) of the users' signals and bases, and a static name per user."""
    s = samples(spark, d).withColumn("c", F.pmod("user_id", F.lit(3)))
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    signal = F.concat(user, F.lit("/"), "event_type")
    own = s.where("c = 0").withColumn("time_idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("t", "event_id")) - 1)
    element = s.where("c = 1").withColumn("time_idx", F.dense_rank().over(Window.partitionBy("user_id").orderBy("t")) - 1)
    daily = s.where("c = 2").withColumn("time_idx", F.floor((F.col("t") - DAY0) / DAY).cast("int"))
    last = daily.groupBy(*KEYS, "time_idx").agg(F.max_by("v", "event_id").alias("v"))
    row = lambda path, value: [path.alias("path"), F.col("time_idx").cast("int").alias("time_idx"), F.lit(None).cast("double").alias("t"), value.cast("double").alias("value")]
    parts = [
        *[x.select(*row(F.concat(signal, F.lit("/value")), F.col("v"))) for x in (own, element, last)],
        own.select(*row(F.concat(signal, F.lit("/time")), F.col("t"))), element.select(*row(F.concat(user, F.lit("/time")), F.col("t"))).distinct(),
        daily.select(*row(F.lit("time"), DAY0 + DAY * F.col("time_idx"))).distinct(),
        s.select(F.concat(user, F.lit("/name")).alias("path"), F.lit(None).cast("int").alias("time_idx"), F.lit(None).cast("double").alias("t"), F.col("user_id").cast("double").alias("value")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_D = f"""{_S}, d AS (SELECT user_id, event_type, CAST(floor((t - {DAY0}) / {DAY}) AS INTEGER) AS k, arg_max(v, event_id) AS v FROM s WHERE user_id % 3 = 2 GROUP BY ALL),
g AS (SELECT 'user/' || user_id || '/' || event_type || '/value' AS path, t, v FROM s WHERE user_id % 3 < 2 UNION ALL SELECT 'user/' || user_id || '/' || event_type || '/value', {DAY0} + {DAY} * k, v FROM d)"""


def _near(times: str) -> str:
    return f"""p AS (SELECT DISTINCT path FROM g), r AS (SELECT path, t FROM p, (SELECT unnest({times}) AS t) x),
b AS (SELECT r.path, r.t, lo.t AS lt, lo.v AS lv, hi.t AS ht, hi.v AS hv FROM r ASOF LEFT JOIN g lo ON r.path = lo.path AND r.t >= lo.t ASOF LEFT JOIN g hi ON r.path = hi.path AND r.t <= hi.t)"""


_STATIC = "SELECT DISTINCT 'user/' || user_id || '/name', NULL::DOUBLE, user_id::DOUBLE, 0 FROM events"


@query("""SELECT DISTINCT 'user/' || user_id || '/' || event_type || '/value' AS path, CASE user_id % 3 WHEN 0 THEN 'user/' || user_id || '/' || event_type || '/time' WHEN 1 THEN 'user/' || user_id || '/time' ELSE 'time' END AS base FROM events
UNION SELECT DISTINCT 'user/' || user_id || '/name', CASE user_id % 3 WHEN 1 THEN 'user/' || user_id || '/time' ELSE 'time' END FROM events""")
def t13_time_base(spark, d):
    return bases.resolve(signals(spark, d))


@query(f"WITH {_D}, {_near(f'[{AT}::DOUBLE]')} SELECT path, t, {_LINEAR} AS value, 1 AS rank FROM b UNION ALL {_STATIC}")
def t9_slice_of_tree(spark, d):
    return bases.get_slice(signals(spark, d), AT, "linear")


_FIVE = [DAY0, 1704500000.25, AT, 1705555555.5, 1.8e9]


@query(f"WITH {_D}, {_near('[' + ', '.join(f'{t}::DOUBLE' for t in _FIVE) + ']')} SELECT path, t, CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv WHEN ht - t <= t - lt THEN hv ELSE lv END AS value, 1 AS rank FROM b UNION ALL {_STATIC}")
def t23_samples_of_tree(spark, d):
    return bases.get_sample(signals(spark, d), _FIVE, "closest")


@query(f"""WITH {_S}, g AS (SELECT DISTINCT 'user/' || user_id || '/time' AS path, t, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INTEGER) AS v FROM s WHERE user_id % 3 = 1), {_near(f'[{AT}::DOUBLE]')}
SELECT path AS base, t, coalesce(lv, hv) AS time_idx FROM b""")
def t15_index_on_base(spark, d):
    tree = signals(spark, d).where(F.col("path").rlike("^user/[0-9]+/time$"))
    asked = tree.select(F.col("path").alias("base")).distinct().withColumn("t", F.lit(AT))
    return bases.time_index(tree, asked, "previous")


@query(f"WITH {_S}, b AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS k FROM (SELECT DISTINCT user_id, t FROM s)) SELECT s.user_id, event_type, CAST(k AS INTEGER) AS time_idx, v FROM s JOIN b ON s.user_id = b.user_id AND s.t = b.t WHERE k = 7")
def t16_rows_for_time(spark, d):
    s = samples(spark, d)
    return bases.rows_at(timeops.time_base(s, ["user_id"]), 7).join(s, ["user_id", "t"]).select(*KEYS, "time_idx", "v")


@query("SELECT 'supplier/' || l_suppkey AS path, count(DISTINCT l_linenumber % 3) AS n_shapes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) > 1")
def t17_shape_conflicts(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("path"), F.array(F.pmod("l_linenumber", F.lit(3))).alias("shape"))
    return bases.shape_conflicts(rows)


@query(f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), b AS (SELECT DISTINCT user_id, t FROM s) SELECT b.user_id, k.event_type, b.t, s.v FROM b JOIN k ON b.user_id = k.user_id LEFT JOIN s ON s.user_id = b.user_id AND s.event_type = k.event_type AND s.t = b.t")
def j3_signal_on_base(spark, d):
    s = samples(spark, d)
    return bases.on_base(s.select("user_id", "t").distinct(), s.select(*KEYS).distinct(), s, ["user_id"], ["event_type"])


@query("""WITH c AS (SELECT DISTINCT 'nation/' || c_nationkey AS base FROM customer WHERE c_acctbal > 9500 UNION SELECT 'region/' || r_regionkey FROM region WHERE r_regionkey <> 2)
SELECT s_suppkey, coalesce(a.base, b.base) AS base FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN c a ON a.base = 'nation/' || s_nationkey LEFT JOIN c b ON b.base = 'region/' || n_regionkey WHERE coalesce(a.base, b.base) IS NOT NULL""")
def j8_first_found(spark, d):
    there = table(spark, d, "customer").where("c_acctbal > 9500").select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("base"))
    there = there.union(table(spark, d, "region").where("r_regionkey <> 2").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string"))))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    one = lambda depth, name, key: F.struct(F.lit(depth).alias("depth"), F.concat(F.lit(name), F.col(key).cast("string")).alias("base"))
    return bases.first_found(rows, "s_suppkey", F.array(one(1, "nation/", "s_nationkey"), one(0, "region/", "n_regionkey")), there, "base")


_CUT = 1705300000.0


@query(f"""WITH {_S}, a AS (SELECT user_id, event_type, count(*) FILTER (t < {_CUT}) AS next_signal, count(*) FILTER (t >= {_CUT}) AS n FROM s GROUP BY ALL), b AS (SELECT user_id, count(*) AS next_base FROM s GROUP BY 1)
SELECT a.user_id, event_type, CASE WHEN next_signal > 0 THEN greatest(next_signal, next_base - n) ELSE 0 END AS step FROM a JOIN b ON a.user_id = b.user_id""")
def k6_gap_alignment(spark, d):
    s = samples(spark, d)
    a = s.groupBy(*KEYS).agg(F.count(F.when(F.col("t") < _CUT, 1)).alias("next_signal"), F.count(F.when(F.col("t") >= _CUT, 1)).alias("n"))
    b = s.groupBy("user_id").agg(F.count("*").alias("next_base"))
    return a.join(b, "user_id").select(*KEYS, bases.next_step(F.col("next_signal"), F.col("next_base"), F.col("n")).alias("step"))


_BY = f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT user_id, event_type, {AT}::DOUBLE AS t FROM k), {_b()}"


@query(f"{_BY} SELECT user_id, event_type, CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL THEN lv WHEN ht - t <= t - lt THEN hv ELSE lv END AS v, 1 AS n FROM b")
def t10_slice_of_array(spark, d):
    rows = timed(spark, d)
    cut = rows.withColumn("steps", trees.slice_array(F.col("steps"), rows.schema["steps"].dataType.elementType, AT, "closest"))
    return cut.select(*KEYS, F.col("steps")[0]["v"].alias("v"), F.size("steps").alias("n"))


def _mixed(spark, d):
    s = samples(spark, d).select(*KEYS, F.col("t").alias("time"), "v", F.floor("v").cast("int").alias("n"), F.when(F.col("v") < 245, "low").otherwise("high").alias("s"), F.array("v", -F.col("v")).alias("pair"))
    return nested.nest(s, KEYS, "time", ["v", "n", "s", "pair"], "steps")


_MID = "(t - lt) / (ht - lt)"
_FIX = "CASE WHEN lt IS NULL THEN {h} WHEN ht IS NULL OR lt = ht THEN {l} ELSE {m} END"


def _blended(n: str, s: str) -> str:
    h, low = ("CASE WHEN hv < 245 THEN 'low' ELSE 'high' END", "CASE WHEN lv < 245 THEN 'low' ELSE 'high' END")
    return f"""{_BY} SELECT user_id, event_type, {_LINEAR} AS v, CAST({_FIX.format(h='floor(hv)', l='floor(lv)', m=n)} AS INTEGER) AS n, {_FIX.format(h=h, l=low, m=s.format(h=h, l=low))} AS s, -({_LINEAR}) AS w FROM b"""


def _slice_of_mixed(spark, d, profile):
    rows = _mixed(spark, d)
    cut = rows.select(*KEYS, trees.slice_array(F.col("steps"), rows.schema["steps"].dataType.elementType, AT, "linear", profile)[0].alias("x"))
    return cut.select(*KEYS, "x.v", "x.n", "x.s", F.col("x.pair")[1].alias("w"))


@query(_blended(f"floor(abs(floor(lv) + (floor(hv) - floor(lv)) * ({_MID})) + 0.5)", "CASE WHEN ({l}) = ({h}) THEN ({l}) ELSE '' END"))
def t19_fieldwise_blend(spark, d):
    return _slice_of_mixed(spark, d, "round")


@query(_blended(f"trunc(floor(lv) + ({_MID}) * (floor(hv) - floor(lv)))", "({l})"))
def t18_truncating_profile(spark, d):
    return _slice_of_mixed(spark, d, "truncate")


def _users(spark, d):
    """Per user an array of signals, each with an array of steps: static around dynamic."""
    return timed(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "steps"))).alias("signals"))


@query(f"{_BY} SELECT user_id, event_type, coalesce(lv, hv) AS v FROM b")
def t20_slice_of_nested(spark, d):
    rows = _users(spark, d)
    cut = rows.select("user_id", F.explode(trees.slice_tree(F.col("signals"), rows.schema["signals"].dataType, AT, "previous")).alias("s"))
    return cut.select("user_id", "s.event_type", F.col("s.steps")[0]["v"].alias("v"))


@query(f"WITH {_S} SELECT user_id, event_type, CAST(count(*) FILTER (t BETWEEN 1704500000 AND 1705500000) AS INTEGER) AS size FROM s GROUP BY ALL")
def t12_range_of_nested(spark, d):
    rows = _users(spark, d)
    cut = rows.select("user_id", F.explode(trees.range_tree(F.col("signals"), rows.schema["signals"].dataType, 1704500000.0, 1705500000.0)).alias("s"))
    return cut.select("user_id", "s.event_type", F.size("s.steps").alias("size"))


@query(f"WITH {_S}, k AS (SELECT DISTINCT user_id, event_type FROM s), r AS (SELECT user_id, event_type, t FROM k, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _FIVE)}]) AS t) x), {_b()} SELECT user_id, event_type, t, {_LINEAR} AS v FROM b")
def t11_samples_of_nested(spark, d):
    rows = _users(spark, d)
    cut = rows.select("user_id", F.explode(trees.sample_tree(F.col("signals"), rows.schema["signals"].dataType, _FIVE, "linear")).alias("s"))
    return cut.select("user_id", "s.event_type", F.explode("s.steps").alias("x")).select("user_id", "event_type", F.col("x.time").alias("t"), "x.v")


@query(f"{_BY} SELECT user_id, event_type, {_LINEAR} AS v, 1 AS n FROM b")
def r9_signal_in_element(spark, d):
    own = F.struct(F.col("steps.time").alias("time"), F.col("steps.v").alias("data")).alias("flux")
    rows = timed(spark, d).select(*KEYS, own)
    cut = rows.select(*KEYS, trees.slice_tree(F.col("flux"), rows.schema["flux"].dataType, AT, "linear").alias("x"))
    return cut.select(*KEYS, F.col("x.data")[0].alias("v"), F.size("x.time").alias("n"))


@query("SELECT l_orderkey, 1 AS depth, CAST(count(*) AS INTEGER) AS size FROM lineitem GROUP BY 1")
def r3_array_depth(spark, d):
    rows = orders(spark, d)
    kind = rows.schema["lines"].dataType
    return rows.select("l_orderkey", F.lit(trees.depth(kind)).alias("depth"), trees.greatest_size(F.col("lines"), kind).alias("size"))


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem) SELECT l_orderkey, l_partkey, CAST(sum(CASE WHEN i = 2 THEN 0 ELSE l_quantity END) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS total FROM x QUALIFY i = 2")
def r10_element_field(spark, d):
    rows = orders(spark, d).withColumn("new", trees.put_element_field(F.col("lines"), 1, "l_quantity", F.lit(0)))
    total = F.aggregate("new", F.lit(0.0), lambda a, x: a + x["l_quantity"].cast("double"))
    return rows.where(F.size("lines") > 1).select("l_orderkey", trees.element_field(F.col("lines"), 1, "l_partkey").alias("l_partkey"), total.alias("total"))


_L = "l AS (SELECT 'order/' || l_orderkey % 7 || '/line/' || l_linenumber || '/' || f AS path, l_orderkey % 7 AS k, l_linenumber AS i, f, CASE WHEN f = 'quantity' THEN l_linenumber - 1 END AS time_idx, CASE WHEN f = 'flag' THEN length(l_returnflag) ELSE CAST(l_quantity AS INTEGER) END AS size, l_orderkey FROM lineitem, (SELECT unnest(['quantity', 'flag']) AS f) x)"


@query(f"WITH {_L} SELECT 'order/line/' || f AS schema_path, path, CAST(row_number() OVER (PARTITION BY f ORDER BY k, i) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT path, f, k, i FROM l)")
def p11_natural_order(spark, d):
    return catalog.natural_order(leaves(spark, d))


@query(f"WITH {_L} SELECT path, count(*) AS n FROM l WHERE k = 3 GROUP BY 1")
def p12_sub_path(spark, d):
    return catalog.under(leaves(spark, d), "order/3").groupBy("path").agg(F.count("*").alias("n"))


def _order_paths(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"), F.lit("/c"), F.col("o_custkey").cast("string")).alias("path"))


def _wanted(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("order/c"), F.col("c_custkey").cast("string")).alias("schema_path"))


@query("SELECT 'order/c' || c_custkey AS schema_path FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def p13_existence(spark, d):
    return catalog.existing(_wanted(spark, d), _order_paths(spark, d))


@query("SELECT 'order/c' || c_custkey AS schema_path FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j6_absence(spark, d):
    return catalog.existing(_wanted(spark, d), _order_paths(spark, d), absent=True)


@query("SELECT unnest(['order/line/quantity', 'order/line/flag']) AS schema_path, unnest([true, false]) AS dynamic")
def p14_dynamic(spark, d):
    return catalog.dynamic_flags(leaves(spark, d))


_NAMES = ["time", "lifetime", "time_step", "data"]


@query("SELECT p_partkey, p_partkey % 4 = 0 AS is_base FROM part")
def p15_own_base(spark, d):
    name = F.get(F.array(*[F.lit(x) for x in _NAMES]), F.pmod("p_partkey", F.lit(4)).cast("int"))
    return table(spark, d, "part").select("p_partkey", bases.is_base(F.concat(F.lit("signal/"), "p_brand", F.lit("/"), name)).alias("is_base"))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS INTEGER) AS as_int, ascii(l_returnflag) AS code, chr(CAST(65 + l_linenumber AS INTEGER)) AS letter, CAST(l_linenumber AS DOUBLE) AS re, NULL::INTEGER AS over, {values.EMPTY_INT} AS none FROM lineitem""")
def p16_conversion(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", convert.convert(F.col("l_extendedprice").cast("double"), "double", "int").cast("int").alias("as_int"), convert.convert(F.col("l_returnflag"), "char", "int").alias("code"),
        convert.convert(F.col("l_linenumber") + 65, "int", "char").alias("letter"), convert.convert(F.col("l_linenumber"), "int", "complex")["re"].alias("re"),
        convert.convert(F.lit(1e300), "double", "int").cast("int").alias("over"), convert.convert(values.complex_of(F.lit(1.0), F.lit(2.0)), "complex", "int").alias("none"),
    )


@query(f"WITH {_L} SELECT size, count(*) AS n FROM l WHERE k = 3 AND i = 2 AND f = 'quantity' GROUP BY 1")
def p18_index_scan(spark, d):
    return catalog.at_index(leaves(spark, d), "order/line/quantity", [3, 2]).groupBy("size").agg(F.count("*").alias("n"))


@query(f"WITH {_L} SELECT path, parent, declared, count(*) AS n FROM (SELECT path, 'order/' || k || '/line' AS parent, CASE WHEN k <> 5 THEN 10 + k END AS declared FROM l) GROUP BY ALL")
def j5_parent(spark, d):
    arrays = spark.range(7).where("id <> 5").select(F.concat(F.lit("order/"), F.col("id").cast("string"), F.lit("/line")).alias("path"), (F.col("id") + 10).alias("declared"))
    return catalog.with_parents(leaves(spark, d), arrays).groupBy("path", "parent", "declared").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS tree, CAST(c_nationkey AS INTEGER) AS occurrence, CASE WHEN c_nationkey < 10 THEN 'file-' || n_name END AS file, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j7_links(spark, d):
    names = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("tree"), F.col("c_nationkey").cast("int").alias("occurrence")).agg(F.count("*").alias("n"))
    n = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("int").alias("occurrence"), F.concat(F.lit("file-"), "n_name").alias("file"))
    links = names.select("tree").distinct().join(n.withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).drop("one")
    return catalog.linked(names, links)


@query(f"WITH {_L} SELECT 'order/' || k || '/line' AS \"array\", max(time_idx) + 2 AS size FROM l GROUP BY 1")
def a2_dynamic_sizes(spark, d):
    return catalog.dynamic_sizes(leaves(spark, d).withColumn("n_steps", F.lit(2).cast("long"))).withColumn("size", F.col("size").cast("long"))


@query("SELECT event_type, CAST(max(user_id % 7) AS BIGINT) AS d0, CAST(max(CASE WHEN user_id % 2 = 0 THEN event_id % 11 END) AS BIGINT) AS d1 FROM events GROUP BY 1")
def a6_ragged_shape(spark, d):
    long = F.array(F.pmod("user_id", F.lit(7)), F.pmod("event_id", F.lit(11)))
    e = table(spark, d, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, long).otherwise(F.slice(long, 1, 1)).alias("shape"))
    return catalog.ragged_shape(e, ["event_type"]).select("event_type", F.col("shape")[0].alias("d0"), F.col("shape")[1].alias("d1"))


def _cells(spark, d):
    """Per order flag and line number, over seven orders, an array of as many quantities as lines have this number."""
    x = table(spark, d, "lineitem").groupBy("l_returnflag", F.pmod("l_orderkey", F.lit(7)).cast("int").alias("k"), (F.col("l_linenumber") - 1).cast("int").alias("i")).agg(F.count("*").alias("n"), F.max(F.col("l_quantity").cast("double")).alias("q"))
    return x.select(F.concat(F.lit("order/"), "l_returnflag").alias("schema_path"), F.array("k", "i").alias("index"), F.array_repeat("q", F.pmod("n", F.lit(5)).cast("int")).alias("value"))


_C = "x AS (SELECT 'order/' || l_returnflag AS p, l_orderkey % 7 AS k, l_linenumber - 1 AS i, count(*) % 5 AS m, max(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY ALL), w AS (SELECT p, max(k) + 1 AS a, max(i) + 1 AS b, max(m) AS c FROM x GROUP BY 1)"


@query(f"""WITH {_C}, g AS (SELECT p, a, b, c, cell FROM w, range(0, 1000) r(cell) WHERE cell < a * b)
SELECT g.p AS schema_path, CAST(cell AS BIGINT) AS cell, CAST(c AS INTEGER) AS width, CAST(coalesce(m, 0) AS INTEGER) AS filled, coalesce(m, 0) * coalesce(q, 0) AS total FROM g LEFT JOIN x ON g.p = x.p AND g.cell = k * b + i""")
def v1_published_view(spark, d):
    v = views.publish(_cells(spark, d))
    here = F.filter("value", lambda x: x != values.EMPTY_DOUBLE)
    return v.select("schema_path", "cell", F.size("value").alias("width"), F.size(here).alias("filled"), F.aggregate(here, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_C} SELECT count(*) AS n_datasets, CAST(sum(n) AS BIGINT) AS n_mappings, max(n) AS max_mappings, CAST(sum(a * b * c - m) AS BIGINT) AS n_fill_holes, 1 AS n_groups FROM (SELECT x.p, count(*) AS n, sum(m) AS m, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM x JOIN w ON x.p = w.p GROUP BY 1)")
def a8_publish_counters(spark, d):
    return views.statistics(_cells(spark, d))


@query(f"WITH {_C} SELECT x.p AS schema_path, replace(x.p, '/', ':') AS name, any_value(a) || ',' || any_value(b) || ',' || any_value(c) AS dims, CAST(any_value(a * b * c) - sum(m) AS BIGINT) AS n_holes FROM x JOIN w ON x.p = w.p GROUP BY 1, 2")
def v2_view_names(spark, d):
    return views.names(_cells(spark, d), flat=True).select("schema_path", "name", F.array_join(F.transform("dims", lambda x: x.cast("string")), ",").alias("dims"), "n_holes")


@query(f"WITH {_C}, g AS (SELECT p, a, b, c, cell FROM w, range(0, 1000) r(cell) WHERE cell < b) SELECT g.p AS schema_path, CAST(cell AS BIGINT) AS cell, CAST(c - coalesce(m, 0) AS INTEGER) AS n_fill, true AS capped FROM g LEFT JOIN x ON g.p = x.p AND g.cell = k * b + i")
def v3_int_fill_capped(spark, d):
    ints = _cells(spark, d).withColumn("value", F.transform("value", lambda x: x.cast("int")))
    v = views.publish(ints, "int", most_cells=5)
    return v.select("schema_path", "cell", F.size(F.filter("value", lambda x: x == values.VIEW_INT)).alias("n_fill"), "capped")


@query(f"WITH {_L} SELECT DISTINCT 'order[' || k || ']/line[' || i || ']/' || f AS name FROM l")
def v2_expanded_names(spark, d):
    return views.expanded(leaves(spark, d).withColumn("value", F.col("size"))).select("name").distinct()


@query("SELECT lang, max(length(text)) + 1 AS width FROM documents GROUP BY 1")
def a11_string_width(spark, d):
    return catalog.string_width(table(spark, d, "documents"), ["lang"], "text")


@query("SELECT lang, CAST(sum(ceil(n_chars / 4096.0)) AS BIGINT) AS n_chunks, CAST(sum(n_chars) AS BIGINT) AS n_bytes, max(n_chars) AS largest FROM documents GROUP BY 1")
def a13_chunk_statistics(spark, d):
    return catalog.chunk_statistics(table(spark, d, "documents"), ["lang"], "n_chars", 4096)


@query("SELECT unnest(['order/line/flag', 'order/line/quantity']) AS path")
def o3_sorted_listing(spark, d):
    return catalog.listing(leaves(spark, d))


@query("SELECT DISTINCT r_name AS path FROM region JOIN nation ON r_regionkey = n_regionkey")
def o4_top_level(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return catalog.listing(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", "r_name", F.col("n_nationkey").cast("string"), "n_name").alias("path")), recursive=False)


@query("SELECT unnest(['order[]/line[]/flag', 'order[]/line[]/quantity']) AS line, unnest(['Dataset {SCALAR}', 'Dataset {50/Inf}']) AS kind")
def c6_tree_lines(spark, d):
    return catalog.tree_lines(leaves(spark, d))


@query(f"WITH {_L} SELECT path, CAST(time_idx AS INTEGER) AS time_idx FROM l WHERE path LIKE '%/line/3/%' AND f = 'quantity' ORDER BY path, time_idx LIMIT 25")
def c7_index_dump(spark, d):
    rows = leaves(spark, d).withColumn("kind", F.when(F.col("time_idx").isNull(), "static").otherwise("step"))
    return catalog.index_dump(rows, match="/line/3/", kinds=["step"], limit=25).select("path", "time_idx")


@query(f"WITH {_L} SELECT DISTINCT path, CAST(k AS VARCHAR) AS index, '/line/' || i || '/' || f AS rest, 'order/9/line/' || i || '/' || f AS moved FROM l")
def f5_split_path(spark, d):
    p = F.col("path")
    parts = paths.split_at(p, "order")
    return leaves(spark, d).select("path").distinct().select("path", parts["index"].alias("index"), parts["rest"].alias("rest"), paths.substitute(p, "order", F.lit(9)).alias("moved"))


@query("SELECT o_custkey, CAST(max(length(o_orderpriority)) + 1 AS INTEGER) AS width, array_to_string(list(rpad(o_orderpriority, CAST((SELECT max(length(o_orderpriority)) + 1 FROM orders i WHERE i.o_custkey = o.o_custkey) AS INTEGER), ' ') ORDER BY o_orderkey), '|') AS padded, array_to_string(list(o_orderpriority ORDER BY o_orderkey), '|') AS back FROM orders o GROUP BY 1")
def f8_padded_texts(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("t"))
    p = strings.to_padded(F.col("t"))
    return x.select("o_custkey", F.length(p[0]).alias("width"), F.array_join(p, "|").alias("padded"), F.array_join(strings.from_padded(p), "|").alias("back"))


@query("SELECT doc_id, CAST(greatest(ceil(length(text) / 512.0), 1) AS INTEGER) AS n_slots, md5(text) AS body FROM documents")
def f9_slots(spark, d):
    x = table(spark, d, "documents").select("doc_id", strings.to_slots(F.col("text"), 512).alias("slots"))
    return x.select("doc_id", F.size("slots").alias("n_slots"), F.md5(strings.join_slots(F.col("slots"))).alias("body"))


@query("SELECT doc_id, substr(text, 1, 8) || '|' || substr(text, 9, 4) AS parts FROM documents WHERE length(text) >= 12")
def f9_spans(spark, d):
    slots = strings.to_slots(F.substring("text", 1, 12), 4)
    spans = F.array(F.struct(F.lit(0).alias("slot_offset"), F.lit(2).alias("slot_span")), F.struct(F.lit(2).alias("slot_offset"), F.lit(1).alias("slot_span")))
    return table(spark, d, "documents").where(F.length("text") >= 12).select("doc_id", F.array_join(strings.join_spans(slots, spans), "|").alias("parts"))


@query("SELECT p_partkey, p_size % 3 = p_partkey % 3 AS same, greatest(p_size % 3, p_partkey % 3) AS greater FROM part")
def f12_shapes(spark, d):
    a, b = F.array(F.lit(2).cast("long"), F.pmod("p_size", F.lit(3)).cast("long")), F.array(F.lit(2).cast("long"), F.pmod("p_partkey", F.lit(3)).cast("long"))
    return table(spark, d, "part").select("p_partkey", convert.same_shape(a, b).alias("same"), convert.greater_shape(a, b)[1].alias("greater"))


@query("SELECT p_partkey, CASE WHEN p_size < 4 THEN -1 WHEN p_size > 4 THEN 1 WHEN p_partkey % 20 < 2 THEN -1 WHEN p_partkey % 20 > 2 THEN 1 ELSE 0 END AS compared, p_size > 4 OR (p_size = 4 AND p_partkey % 20 > 2) AS able FROM part")
def f14_versions(spark, d):
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), F.pmod("p_partkey", F.lit(20)).cast("string"), F.lit("-dev"))
    return table(spark, d, "part").select("p_partkey", convert.compare_versions(v, F.lit("1.4.2")).alias("compared"), (convert.compare_versions(v, F.lit("1.4.2")) > 0).alias("able"))


@query("SELECT p_partkey, CASE WHEN p_size > 4 OR (p_size = 4 AND p_partkey % 20 > 0) THEN true ELSE false END AS able FROM part")
def r15_server_ability(spark, d):
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), F.pmod("p_partkey", F.lit(20)).cast("string"))
    return table(spark, d, "part").select("p_partkey", convert.server_interpolates(v).alias("able"))


@query("SELECT p_partkey, 'm' || p_size AS units, NULL::VARCHAR AS lacking FROM part")
def f15_xml_attributes(spark, d):
    xml = F.concat(F.lit("<ids><field name='a' units='m"), F.col("p_size").cast("string"), F.lit("'/><field name='b' units='s'/></ids>"))
    return table(spark, d, "part").select("p_partkey", strings.attribute(xml, "/ids/field[@name='a']", "units").alias("units"), strings.attribute(xml, "/ids/field[@name='c']", "units").alias("lacking"))


@query(f"WITH {_L} SELECT path, CAST(time_idx AS INTEGER) AS time_idx, count(*) AS n FROM l WHERE time_idx BETWEEN 1 AND 3 GROUP BY ALL")
def r7_steps_around(spark, d):
    return bases.around(leaves(spark, d), 2, 1).groupBy("path", "time_idx").agg(F.count("*").alias("n"))


@query("SELECT 'part/' || l_partkey AS path, CAST(l_linenumber AS INTEGER) AS time_idx, CAST(arg_max(l_suppkey, l_orderkey) AS BIGINT) AS d0 FROM (SELECT l_partkey, l_linenumber, l_orderkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY ALL")
def r12_shape_of_step(spark, d):
    x = table(spark, d, "lineitem")
    seq = F.when(F.col("l_orderkey").isNotNull(), F.struct("l_orderkey", "l_suppkey")).alias("seq")
    rows = x.select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_linenumber").cast("int").alias("time_idx"), F.array("l_suppkey").alias("shape"), seq)
    return catalog.shapes(rows).select("path", "time_idx", F.col("shape")[0].alias("d0"))


@query("SELECT s_suppkey, 'a' AS name, CAST(s_suppkey AS INTEGER) AS b, CAST(CASE s_suppkey % 3 WHEN 0 THEN s_suppkey + 1 ELSE s_suppkey + 6 END AS INTEGER) AS e, CASE s_suppkey % 3 WHEN 2 THEN 2 ELSE 1 END AS stride FROM supplier")
def r14_remote_index(spark, d):
    k = F.col("s_suppkey")
    t = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    name = F.when(k % 3 == 0, t("a[", k.cast("string"), "]")).when(k % 3 == 1, t("a(", k.cast("string"), ":", (k + 5).cast("string"), ")")).otherwise(t("a[", k.cast("string"), ":", (k + 5).cast("string"), ":2]"))
    return table(spark, d, "supplier").select("s_suppkey", paths.parse_index(name).alias("p")).select("s_suppkey", "p.name", F.col("p.begin").alias("b"), F.col("p.end").alias("e"), "p.stride")


@query(f"WITH {_L} SELECT DISTINCT path, 'order[' || k || ']/line[' || i || ']/' || f AS shown FROM l")
def r16_context_path(spark, d):
    return leaves(spark, d).select("path", paths.bracket_path(F.col("path")).alias("shown")).distinct()


@query(f"WITH {_L} SELECT path, CAST(coalesce(max(time_idx) + 1, 0) AS INTEGER) AS next_step FROM l GROUP BY 1")
def r17_counters(spark, d):
    return catalog.counters(leaves(spark, d))


@query("SELECT 'customer/' || c_custkey || '/' || f AS path, CASE f WHEN 'c_acctbal' THEN CAST(c_acctbal AS DOUBLE) ELSE CAST(c_nationkey AS DOUBLE) END AS value FROM customer, (SELECT unnest(['c_acctbal', 'c_nationkey']) AS f) x")
def r18_flat_table_to_leaves(spark, d):
    return catalog.to_leaves(table(spark, d, "customer"), ["c_custkey"], ["c_acctbal", "c_nationkey"], "customer")


@query("SELECT c_custkey, '/data/db/' || c_mktsegment || '/3/' || c_custkey || '/' || c_nationkey AS path FROM customer")
def s4_legacy_paths(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("database"), F.lit("3").alias("version"), F.col("c_custkey").alias("pulse"), F.col("c_nationkey").alias("run"))
    return c.select("c_custkey", backends.legacy_paths("/data/db").alias("path"))


@query("SELECT 'part/' || p_partkey AS path, 'get(uri=db, path=part/' || p_partkey || CASE WHEN p_size > 20 THEN ', range=1.5:2.5' || CASE WHEN p_size > 40 THEN ', interp=linear' ELSE '' END || ', dtime=0.5' ELSE '' END || ')' AS request FROM part")
def s13_leaf_requests(spark, d):
    nodes = table(spark, d, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") > 20).alias("dynamic"), F.when(F.col("p_size") > 40, "linear").alias("mode"),
        F.lit(1.5).alias("tmin"), F.lit(2.5).alias("tmax"), F.lit(0.5).alias("dt"),
    )
    return backends.leaf_requests(nodes, "db")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS meta, max(event_id) AS event_id FROM events GROUP BY ALL")
def k11_metadata_once(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("meta"), "event_id")
    return catalog.metadata_once(e, ["event_type", "meta"], "event_id", "event_id")


@query("SELECT event_type AS path, count(*) AS n, CASE WHEN event_type < 'p' THEN 'scale,shift' ELSE '' END AS plugins FROM events GROUP BY ALL")
def u9_provenance(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    used = rows.where("path < 'p'").select("path", F.explode(F.array(F.lit("shift"), F.lit("scale"), F.lit("scale"))).alias("plugin"))
    return plugins.with_provenance(rows, used).select("path", "n", F.array_join("plugins", ",").alias("plugins"))


@query(f"""WITH {_S}, d AS (SELECT user_id, event_type, t, v FROM s) SELECT user_id, event_type, CAST(floor(t / 432000.0) AS BIGINT) AS page, len(list(v)) AS n, array_to_string(list(round(v, 2) ORDER BY t), ',') AS body FROM d GROUP BY ALL""")
def t14_signal_in_pages(spark, d):
    w = timeops.whole_signal(samples(spark, d), KEYS, bucket=432000.0)
    return w.select(*KEYS, "page", F.size("values").cast("long").alias("n"), F.array_join(F.transform("values", lambda x: F.round(x, 2).cast("string")), ",").alias("body"))


@query(_GAPS)
def t7_gap_fill_bucketed(spark, d):
    s = samples(spark, d)
    asked = timeops.with_times(s.select(*KEYS).distinct(), TIMES)
    return timeops.get_slice_gaps(s, s, asked, ["user_id"], ["event_type"], bucket=3 * 86400.0)


@query(f"WITH {_S} SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS INTEGER) AS time_idx FROM (SELECT DISTINCT user_id, t FROM s)")
def t13_numbered_times(spark, d):
    return timeops.time_base(samples(spark, d), ["user_id"], bucket=3 * 86400.0)


@query("SELECT r_name || '/' || n_nationkey || '/' || n_name AS path, r_name || '/' || n_name AS schema_path, CASE WHEN n_regionkey <> 1 THEN 'unit-' || n_name END AS units FROM nation JOIN region ON n_regionkey = r_regionkey")
def j4_metadata(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    tree = both.select(F.concat_ws("/", "r_name", F.col("n_nationkey").cast("string"), "n_name").alias("path"))
    known = both.where("n_regionkey <> 1").select(F.concat_ws("/", "r_name", "n_name").alias("schema_path"), F.concat(F.lit("unit-"), "n_name").alias("units"))
    return catalog.with_metadata(tree, known).select("path", "schema_path", "units")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, count(*) || 'x' || max(n) AS dims, CAST(sum(n) AS INTEGER) AS n, CAST(sum(q) AS DOUBLE) AS total FROM o GROUP BY 1""")
def p2_tensor_of_leaf(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    both = o.join(orders(spark, d), "l_orderkey")
    nested_rows = nested.nest(both, ["o_custkey"], "l_orderkey", ["lines"], "orders")
    x = nested_rows.select("o_custkey", selection.tensor("orders/lines/l_quantity", {"orders", "lines"}).alias("x"))
    total = F.aggregate("x.data", F.lit(0.0), lambda a, y: a + y.cast("double"))
    return x.select("o_custkey", F.array_join(F.transform("x.dims", lambda y: y.cast("string")), "x").alias("dims"), F.size("x.data").alias("n"), total.alias("total"))


@query("WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT vec_id, v FROM x WHERE k // 16 = 2 AND (k // 4) % 4 >= 1 AND k % 4 IN (1, 2)")
def p8_view_slicing(spark, d):
    part, _ = tensor.view(F.col("embedding"), [4, 4, 4], [("at", 2), ("from", 1), ("between", 1, 3)])
    return table(spark, d, "embeddings").select("vec_id", F.explode(part).alias("v"))


@query("SELECT user_id, event_id, n > 60 AS more FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i <= 60")
def o5_first_n_flagged(spark, d):
    return nested.first_n(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 60, flag="more").select("user_id", "event_id", "more")


@query("SELECT p_partkey, p_brand || '/' || (p_size % 5) || '/x' AS plain FROM part")
def f6_tensor_names(spark, d):
    name = F.concat("p_brand", F.lit("&"), F.pmod("p_size", F.lit(5)).cast("string"), F.lit("&x"))
    return table(spark, d, "part").select("p_partkey", paths.untensor(name).alias("plain"))
