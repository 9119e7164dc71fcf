"""Which backend an address means, addresses of older forms, stores in memory, and remote reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronolith.sources import store
from chronolith.sources.store import StoreError, Uri

#: Backends by the path of an address. Formats that need libraries of other systems have a name, but no reader.
BACKENDS = {"parquet": "parquet", "text": "text", "json": "json", "memory": "memory", "null": "null", "remote": "remote"}
FOREIGN = ("mdsplus", "hdf5")


def backend(uri: Uri) -> str:
    """The backend of an address: by its path, or remote where it names a host."""
    name = uri.path.strip("/").partition("/")[0]
    if name in BACKENDS:
        return BACKENDS[name]
    if name in FOREIGN:
        raise StoreError(f"{name} needs libraries that aren't here")
    if uri.host:
        return "remote"
    raise StoreError(f"no backend is named by {uri.path!r}")


def legacy_path(query: dict[str, str], home: Callable[[str], str | None], public: str | None = None, folder: str = "public/db") -> str:
    """The folder that user, database, version, pulse (or shot) and run stand for.

    A user that begins with / is a folder itself; public is shared; of others home says where they live.
    """
    for key in ("user", "database", "version", "run"):
        if not query.get(key):
            raise StoreError(f"{key} must be given where path isn't")
    if query.get("pulse") and query.get("shot"):
        raise StoreError("pulse and shot are the same; only one may be given")
    pulse = query.get("pulse") or query.get("shot")
    if not pulse:
        raise StoreError("pulse must be given where path isn't")
    user = query["user"]
    if user == "public":
        if not public:
            raise StoreError("no shared folder is set")
        root = f"{public}/shared/{folder.rpartition('/')[2]}"
    elif user.startswith("/"):
        root = user
    else:
        if not (at := home(user)):
            raise StoreError(f"can't find the data of {user}")
        root = f"{at}/{folder}"
    return f"{root}/{query['database']}/{query['version']}/{pulse}/{query['run']}"


def legacy_paths(root: Column | str = "") -> Column:
    """legacy_path() as a column, for tables with columns database, version, pulse and run below one root."""
    return F.concat_ws("/", F.lit(root) if isinstance(root, str) else root, "database", "version", F.col("pulse").cast("string"), F.col("run").cast("string"))


def without_host(uri: Uri, local: list[str]) -> Uri:
    """A remote address whose host is this one becomes that of the backend it names; others stay."""
    if uri.path.strip("/") != "remote" or uri.host not in local or "backend" not in uri.query:
        return uri
    rest = {k: v for k, v in uri.query.items() if k != "backend"}
    return replace(uri, host=None, port=None, path=uri.query["backend"], query=rest)


def open_leaves(spark: SparkSession, text: str, local: list[str] = (), memory: "Memory | None" = None) -> DataFrame:
    """The leaves that an address means."""
    uri = without_host(store.parse_uri(text), list(local))
    kind, path = backend(uri), uri.query.get("path", "")
    if kind == "null":
        return spark.createDataFrame([], store.SCHEMA)
    if kind == "memory":
        return (memory or Memory(spark)).leaves(path)
    if kind == "text":
        return store.read_text(spark, path)
    if kind == "json":
        return spark.read.schema(store.SCHEMA).json(path)
    if kind == "parquet":
        return store.Entry(spark, path).leaves()
    raise StoreError("a remote source must be registered, see remote_source()")


def read(spark: SparkSession, links: DataFrame | None, source: str, name: str) -> DataFrame:
    """read(entry, "tree[:occurrence][/path]"): a tree, or what lies at and below a path of it.

    links (tree, occurrence, file), if there are any, say which entry holds a tree; a tree without link is in source.
    """
    tree, _, path = name.partition("/")
    tree, _, occurrence = tree.partition(":")
    k = int(occurrence or 0)
    if links is not None:
        found = links.where((F.col("tree") == tree) & (F.col("occurrence") == k)).select("file").take(1)
        source = found[0]["file"] if found else source
    rows = store.Entry(spark, source).get(tree, k)
    return rows.where((F.col("path") == path) | F.col("path").startswith(path + "/")) if path else rows


class Memory:
    """Entries as cached tables under names; they end with the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def leaves(self, name: str) -> DataFrame:
        return self.held.get(name, self.spark.createDataFrame([], store.SCHEMA))

    def _keep(self, name: str, rows: DataFrame) -> None:
        old = self.held.get(name)
        self.held[name] = rows.persist()
        rows.count()
        if old is not None:
            old.unpersist()

    def put(self, name: str, rows: DataFrame, tree: str, occurrence: int = 0) -> None:
        named = rows.withColumn("tree", F.lit(tree)).withColumn("occurrence", F.lit(occurrence))
        rest = self.leaves(name).where(~((F.col("tree") == tree) & (F.col("occurrence") == occurrence)))
        self._keep(name, rest.unionByName(named.select(*rest.columns)))

    def put_slice(self, name: str, rows: DataFrame, tree: str, occurrence: int = 0) -> None:
        """Merges steps in, on the tree's base."""
        now = self.leaves(name)
        own = now.where((F.col("tree") == tree) & (F.col("occurrence") == occurrence))
        new = store.on_steps(own, rows).withColumn("tree", F.lit(tree)).withColumn("occurrence", F.lit(occurrence))
        self._keep(name, now.unionByName(new.select(*now.columns)))


def leaf_requests(nodes: DataFrame, uri: str) -> DataFrame:
    """(path, request): what is asked of a remote source for each leaf of a dictionary (path, dynamic, mode, tmin, tmax, dt).

    Static leaves aren't asked for a time.
    """
    part = lambda name, c: F.when(F.col("dynamic") & F.col(c).isNotNull(), F.concat(F.lit(f", {name}="), F.col(c).cast("string"))).otherwise(F.lit(""))
    span = F.when(F.col("dynamic") & F.col("tmin").isNotNull(), F.concat(F.lit(", range="), F.col("tmin").cast("string"), F.lit(":"), F.col("tmax").cast("string"))).otherwise(F.lit(""))
    return nodes.select("path", F.concat(F.lit(f"get(uri={uri}, path="), "path", span, part("interp", "mode"), part("dtime", "dt"), F.lit(")")).alias("request"))


class _Batch(InputPartition):
    def __init__(self, requests: list[str]):
        self.requests = requests


def remote_source(name: str, fetch: Callable[[list[str]], Iterator[tuple]], schema: str, batch: int = 20) -> type[DataSource]:
    """A data source that sends its requests (option requests: one per line) in batches, each in a task of its own.

    fetch answers a list of requests with rows of schema; it runs on the executors.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.requests = [r for r in options.get("requests", "").split("\n") if r]
            self.size = int(options.get("batch", batch))

        def partitions(self):
            return [_Batch(self.requests[k : k + self.size]) for k in range(0, len(self.requests), self.size)] or [_Batch([])]

        def read(self, partition):
            if partition.requests:
                yield from fetch(partition.requests)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Source


def fetch_file(spark: SparkSession, address: str) -> str:
    """A copy of a remote file on every node; its path here."""
    spark.sparkContext.addFile(address)
    return SparkFiles.get(address.rstrip("/").rpartition("/")[2])


def describe(spark: SparkSession, text: str) -> dict[str, str]:
    """What is known of an address: its backend, path, and the version of the store there."""
    uri = store.parse_uri(text)
    kind = backend(uri)
    path = uri.query.get("path", "")
    return {"uri": text, "backend": kind, "path": path, "version": store.version_of(spark, path) or "" if kind == "parquet" and path else ""}

