"""Entries as folders of Parquet: opening, whole rewrites, appended steps, deletion.

An entry's leaves are rows (tree, occurrence, path, time_idx, t, value), partitioned by tree and occurrence, so a
rewrite touches one tree's folder and a read prunes to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import convert
from chronolith.operators import bases, timeops

SCHEMA = "path string, time_idx int, t double, value double, tree string, occurrence int"
FORMAT_VERSION = "1.0"


class StoreError(Exception):
    """Of the store; the subclasses say what went wrong."""


class NotThere(StoreError):
    pass


class AlreadyThere(StoreError):
    pass


class BadWrite(StoreError):
    pass


@dataclass(frozen=True)
class Uri:
    scheme: str
    host: str | None
    port: int | None
    path: str
    query: dict[str, str] = field(default_factory=dict)
    fragment: str | None = None


def parse_uri(text: str) -> Uri:
    """scheme:[//host[:port]/]path[?key=value...][#fragment], query parts divided by & ; or ?."""
    scheme, colon, rest = text.partition(":")
    if not colon or not scheme:
        raise StoreError(f"no scheme in {text!r}")
    rest, hash_, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host = port = None
    if rest.startswith("//"):
        authority, _, rest = rest[2:].partition("/")
        host, _, number = authority.partition(":")
        if number and not number.isdigit():
            raise StoreError(f"bad port {number!r}")
        host, port = host or None, int(number) if number else None
    pairs = [p for part in query.split("&") for q in part.split(";") for p in q.split("?") if p]
    return Uri(scheme, host, port, rest, {k: unquote(v) for k, _, v in (p.partition("=") for p in pairs)}, fragment if hash_ else None)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def erase(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()


class VersionMismatch(StoreError):
    pass


def version_of(spark: SparkSession, path: str) -> str | None:
    """The version of the store at path; null where there is none, or nothing says."""
    mark = f"{path.rstrip('/')}/_version"
    return spark.read.text(mark).first()["value"] if exists(spark, mark) else None


def on_steps(own: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (path, t, value) with time_idx on the base of own, the tree's rows: a time that it has keeps its step, new
    times follow its last in order; a signal that skipped steps has gaps, one that is new begins where its times lie.

    The new times of one append are few and put in order in one task.
    """
    known = own.where("t is not null").groupBy("t").agg(F.min("time_idx").alias("_known"))
    last = own.agg((F.coalesce(F.max("time_idx"), F.lit(-1)) + 1).alias("_next"))  # one row
    asked = rows.select("t").distinct().join(known, "t", "left")
    new = asked.where("_known is null").withColumn("_k", F.row_number().over(Window.orderBy("t")) - 1)
    placed = new.join(F.broadcast(last)).select("t", (F.col("_k") + F.col("_next")).cast("int").alias("time_idx"))
    steps = placed.union(asked.where("_known is not null").select("t", F.col("_known").cast("int")))
    return rows.select("path", "t", "value").join(steps, "t").select("path", "time_idx", "t", "value")


class Entry:
    """mode: open (must be there), force_open (made if absent), create (must be absent), force_create (erased first)."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "open"):
        there = exists(spark, path)
        if mode == "open" and not there:
            raise NotThere(path)
        if mode == "create" and there:
            raise AlreadyThere(path)
        if mode not in ("open", "force_open", "create", "force_create"):
            raise StoreError(f"unknown mode {mode!r}")
        if mode == "force_create" and there:
            erase(spark, path)
        self.spark, self.path = spark, path.rstrip("/")
        self._recover()

    def _recover(self) -> None:
        """Ends a replacement that was broken off: the old folder goes if the new one is there, and comes back if not."""
        fs, root = _fs(self.spark, self.path)
        aside = root.suffix("-old")
        if fs.exists(aside):
            for tree in fs.listStatus(aside):
                for old in fs.listStatus(tree.getPath()):
                    place = f"{self.path}/{tree.getPath().getName()}/{old.getPath().getName()}"
                    if not exists(self.spark, place):
                        at = _fs(self.spark, place)[1]
                        fs.mkdirs(at.getParent())
                        fs.rename(old.getPath(), at)
            fs.delete(aside, True)

    def check_version(self) -> None:
        """A store of another minor version isn't written."""
        found = version_of(self.spark, self.path)
        if found is None:
            self.spark.createDataFrame([(FORMAT_VERSION,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_version")
        elif not convert.same_minor(found, FORMAT_VERSION):
            raise VersionMismatch(f"the store has version {found}, this is {FORMAT_VERSION}")

    def leaves(self) -> DataFrame:
        """All rows; an entry without any has none. Also the null source: no data of the right schema."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def get(self, tree: str, occurrence: int = 0) -> DataFrame:
        return self.leaves().where((F.col("tree") == tree) & (F.col("occurrence") == occurrence))

    def _write(self, rows: DataFrame, mode: str) -> None:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kept = rows.where("value is not null").select(*names)  # empty values aren't written
        self.check_version()
        kept.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tree", "occurrence").parquet(self.path)

    def put(self, rows: DataFrame, tree: str, occurrence: int = 0) -> None:
        """Rewrites one tree."""
        self._write(rows.withColumn("tree", F.lit(tree)).withColumn("occurrence", F.lit(occurrence)), "overwrite")

    def put_slice(self, rows: DataFrame, tree: str, occurrence: int = 0) -> None:
        """Appends steps (path, t, value), or puts them where the tree is new; rows without a time are refused."""
        if rows.where("t is null").take(1):
            raise BadWrite("static data can't be appended")
        new = on_steps(self.get(tree, occurrence), rows)
        self._write(new.withColumn("tree", F.lit(tree)).withColumn("occurrence", F.lit(occurrence)), "append")

    def put_node(self, rows: DataFrame, tree: str, path: str, role: str, occurrence: int = 0, t: float | None = None) -> None:
        """Writes one node by its role in time. rows: one row with value.

        bulk: value is an array whose last dimension is time, and becomes a row per step; slice: one step of a dynamic
        array, at t; static: one row without a step.
        """
        if role == "bulk":
            new = rows.select(F.posexplode("value").alias("time_idx", "value")).select(F.lit(path).alias("path"), F.col("time_idx").cast("int"), F.lit(None).cast("double").alias("t"), F.col("value").cast("double"))
        elif role == "slice":
            self.put_slice(rows.select(F.lit(path).alias("path"), F.lit(float(t)).alias("t"), F.col("value").cast("double").alias("value")), tree, occurrence)
            return
        elif role == "static":
            new = rows.select(F.lit(path).alias("path"), F.lit(None).cast("int").alias("time_idx"), F.lit(None).cast("double").alias("t"), F.col("value").cast("double"))
        else:
            raise BadWrite(f"no role {role!r}")
        self._write(new.withColumn("tree", F.lit(tree)).withColumn("occurrence", F.lit(occurrence)), "append")

    def get_slice(self, tree: str, t: float, mode: str, occurrence: int = 0, kind: str = "double", homogeneous: bool = False) -> DataFrame:
        """(path, t, value, rank) of every path at one time, see bases.get_slice()."""
        if mode not in timeops.MODES:
            raise StoreError(f"a slice needs one of the modes {timeops.MODES}")
        return bases.get_slice(self.get(tree, occurrence), t, mode, kind, homogeneous)

    def get_range(self, tree: str, tmin: float, tmax: float, occurrence: int = 0) -> DataFrame:
        """The rows of a range of times; static ones stay. Rows with their own time are pruned in the scan."""
        if tmin > tmax:
            raise StoreError("tmin is after tmax")
        rows = self.get(tree, occurrence)
        based = bases.with_times(rows.where(F.col("time_idx").isNull() | F.col("t").isNull())).where(F.col("t").between(tmin, tmax))
        own = rows.where(F.col("t").between(tmin, tmax) & ~bases.is_base(F.col("path")))
        names = ["path", "time_idx", "t", "value"]
        return own.select(*names).unionByName(based.select(*names)).unionByName(rows.where("time_idx is null").select(*names))

    def get_sample(self, tree: str, mode: str, tmin: float | None = None, tmax: float | None = None, dt: float | None = None, times: list[float] | None = None, occurrence: int = 0, kind: str = "double", homogeneous: bool = False) -> DataFrame:
        """Every path at chosen times, or on the grid from tmin to tmax by dt."""
        if mode not in timeops.MODES:
            raise StoreError(f"samples need one of the modes {timeops.MODES}")
        if times is None:
            if tmin is None or tmax is None or not dt or tmin > tmax:
                raise StoreError("samples need times, or tmin <= tmax and dt")
            times = timeops.step_grid(tmin, tmax, dt)
        return bases.get_sample(self.get(tree, occurrence), times, mode, kind, homogeneous)

    def replace_last(self, rows: DataFrame, tree: str, occurrence: int = 0) -> None:
        """The tree's last step becomes rows (path, value)."""
        old = self.get(tree, occurrence)
        at = old.agg(F.max("time_idx").alias("k"), F.max_by("t", "time_idx").alias("at"))
        kept = old.join(F.broadcast(at)).where("time_idx is null or time_idx < k").select("path", "time_idx", "t", "value")
        new = rows.join(F.broadcast(at)).select("path", F.col("k").alias("time_idx"), F.col("at").alias("t"), "value")
        self._rewrite(kept.unionByName(new), tree, occurrence)

    def delete(self, tree: str, prefix: str = "", occurrence: int = 0) -> None:
        """A tree, or what lies at and under a path of it."""
        if not prefix:
            erase(self.spark, f"{self.path}/tree={tree}/occurrence={occurrence}")
            return
        inside = (F.col("path") == prefix) | F.col("path").startswith(prefix + "/")
        self._rewrite(self.get(tree, occurrence).where(~inside).select("path", "time_idx", "t", "value"), tree, occurrence)

    def _rewrite(self, rows: DataFrame, tree: str, occurrence: int) -> None:
        """Writes the new folder beside the entry, then puts it in the old one's place by renaming: at any time one of
        both is whole, and _recover() ends what was broken off."""
        part = f"tree={tree}/occurrence={occurrence}"
        aside = f"{self.path}-new"
        names = ["path", "time_idx", "t", "value"]
        rows.where("value is not null").select(*names, F.lit(tree).alias("tree"), F.lit(occurrence).alias("occurrence")).write.mode("overwrite").partitionBy("tree", "occurrence").parquet(aside)
        fs, old = _fs(self.spark, f"{self.path}/{part}")
        backup, new = _fs(self.spark, f"{self.path}-old/{part}")[1], _fs(self.spark, f"{aside}/{part}")[1]
        if fs.exists(old):
            fs.mkdirs(backup.getParent())
            fs.rename(old, backup)
        if fs.exists(new):
            fs.mkdirs(old.getParent())
            fs.rename(new, old)
        erase(self.spark, f"{self.path}-old")
        erase(self.spark, aside)


def serialize(leaves: DataFrame) -> DataFrame:
    """(tree, occurrence, body): one JSON object per row."""
    return leaves.select("tree", "occurrence", F.to_json(F.struct("path", "time_idx", "t", "value")).alias("body"))


def deserialize(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "path string, time_idx int, t double, value double")
    return rows.select(body.alias("b"), "tree", "occurrence").select("b.*", "tree", "occurrence")


def write_text(leaves: DataFrame, path: str) -> None:
    """Lines of tab-divided fields, values with 17 digits."""
    exact = F.format_string("%.16e", "value")
    leaves.select(F.concat_ws("\t", "tree", "occurrence", "path", F.coalesce(F.col("time_idx").cast("string"), F.lit("")), F.coalesce(F.format_string("%.16e", "t"), F.lit("")), exact)).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    part = lambda k: F.get(F.split("value", "\t"), F.lit(k))
    return spark.read.text(path).select(
        part(2).alias("path"), part(3).try_cast("int").alias("time_idx"), part(4).try_cast("double").alias("t"), part(5).cast("double").alias("value"),
        part(0).alias("tree"), part(1).cast("int").alias("occurrence"),
    )
