"""Functions bound to paths: what is bound runs instead of the default read or write, in order of registration."""

from __future__ import annotations

from abc import ABC
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column of provenance that users don't write while plugins are enabled.
RESERVED = "get_operation"
SETTING = "chronolith.plugins.enabled"
PUT_ONLY, GET_ONLY, PUT_AND_GET = "put", "get", "put and get"


class PluginError(Exception):
    pass


class Plugin(ABC):
    """What a plugin may do; it overrides what it needs."""

    operation = PUT_AND_GET
    name, version, description = "", "", ""

    def begin(self, action: str, path: str) -> None:
        """Before a global, slice or range action."""

    def begin_array(self, path: str, rows: DataFrame) -> DataFrame | None:
        """The elements of an array, or None where the plugin doesn't make them."""
        return None

    def end(self, action: str, path: str) -> None:
        """After the action."""

    def read_data(self, rows: DataFrame, given: dict) -> DataFrame:
        return rows

    def write_data(self, rows: DataFrame, given: dict) -> DataFrame:
        return rows


class _Reader(Plugin):
    operation = GET_ONLY

    def __init__(self, function: Callable[[DataFrame, dict], DataFrame]):
        self.read_data = function


class Plugins:
    """Plugins, or functions (rows, parameters) -> rows for reading, by name, and the paths they are bound to (a path, or
    prefix/*). Off unless asked for: here, or by the setting chronolith.plugins.enabled."""

    def __init__(self, enabled: bool = False, spark: SparkSession | None = None):
        self.enabled = enabled or bool(spark) and spark.conf.get(SETTING, "false").lower() == "true"
        self.known: dict[str, Plugin] = {}
        self.bound: list[tuple[str, str]] = []
        self.parameters: dict[str, dict] = {}
        self.log: list[tuple[str, str, str, str]] = []

    def register(self, name: str, plugin: Plugin | Callable[[DataFrame, dict], DataFrame]) -> None:
        if name in self.known:
            raise PluginError(f"{name} is registered already")
        self.known[name] = plugin if isinstance(plugin, Plugin) else _Reader(plugin)

    def unregister(self, name: str) -> None:
        if self.known.pop(name, None) is None:
            raise PluginError(f"{name} isn't registered")
        self.bound = [b for b in self.bound if b[1] != name]

    def bind(self, pattern: str, name: str) -> None:
        if name not in self.known:
            raise PluginError(f"{name} isn't registered")
        if (pattern, name) in self.bound:
            raise PluginError(f"{name} is bound to {pattern} already")
        self.bound.append((pattern, name))

    def unbind(self, pattern: str, name: str) -> None:
        if (pattern, name) not in self.bound:
            raise PluginError(f"{name} isn't bound to {pattern}")
        self.bound.remove((pattern, name))

    def set(self, name: str, key: str, value) -> None:
        self.parameters.setdefault(name, {})[key] = value

    def of(self, path: str, operation: str | None = None) -> list[str]:
        hit = lambda p: p == path or (p.endswith("/*") and path.startswith(p[:-1]))
        fits = lambda n: operation is None or self.known[n].operation in (operation, PUT_AND_GET)
        return [n for n in self.known if fits(n) and any(hit(p) and n == m for p, m in self.bound)] if self.enabled else []

    def begin(self, action: str, path: str) -> None:
        for n in self.of(path):
            self.known[n].begin(action, path)

    def end(self, action: str, path: str) -> None:
        for n in self.of(path):
            self.known[n].end(action, path)

    @contextmanager
    def action(self, kind: str, path: str):
        """A global, slice or range action on a path, with what its plugins do before and after, also when it fails."""
        self.begin(kind, path)
        try:
            yield self
        finally:
            self.end(kind, path)

    def begin_array(self, path: str, rows: DataFrame) -> DataFrame:
        """The elements of an array as its plugin makes them, or rows; two plugins can't both make them."""
        made = [(n, x) for n in self.of(path) if (x := self.known[n].begin_array(path, rows)) is not None]
        if len(made) > 1:
            raise PluginError(f"{made[0][0]} and {made[1][0]} both make the array {path}")
        return made[0][1] if made else rows

    def _run(self, rows: DataFrame, path: str, operation: str, default: Callable[[DataFrame], DataFrame]) -> DataFrame:
        some = rows.where(F.col("path") == path)
        names = self.of(path, operation)
        if not names:
            return default(some)
        for n in names:
            p = self.known[n]
            some = (p.read_data if operation == GET_ONLY else p.write_data)(some, self.parameters.get(n, {}))
            self.log.append((path, n, operation, p.version))
        return some

    def read(self, rows: DataFrame, path: str, default: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """rows of path by its plugins, or by default where none is bound."""
        return self._run(rows, path, GET_ONLY, default)

    def write(self, rows: DataFrame, path: str, default: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """What is to be written of path: rows as its plugins change them; see also without_reserved()."""
        return self._run(rows, path, PUT_ONLY, default)

    def without_reserved(self, rows: DataFrame) -> DataFrame:
        """rows without those of the reserved node, while plugins are enabled: users don't write provenance."""
        inside = F.array_contains(F.split("path", "/"), RESERVED)
        return rows.where(~inside) if self.enabled else rows

    def provenance(self, spark: SparkSession) -> DataFrame:
        """(path, plugin, operation, version) of what has run."""
        return spark.createDataFrame(self.log, "path string, plugin string, operation string, version string")

    def write_provenance(self, spark: SparkSession, path: str) -> None:
        """Appends it to a table."""
        self.provenance(spark).distinct().write.mode("append").parquet(path)

    def bind_readback(self, recorded: DataFrame) -> list[tuple[str, str]]:
        """Binds what the provenance table says was used at put, as far as it is registered; one row per path and plugin.

        Gives the bindings made, for unbinding after the read.
        """
        made = []
        for r in recorded.where(F.col("operation") == PUT_ONLY).select("path", "plugin").distinct().orderBy("path", "plugin").toLocalIterator():
            if r["plugin"] in self.known and (r["path"], r["plugin"]) not in self.bound:
                self.bind(r["path"], r["plugin"])
                made.append((r["path"], r["plugin"]))
        return made


def with_provenance(rows: DataFrame, recorded: DataFrame) -> DataFrame:
    """rows with the plugins that made their path (array, empty where none did)."""
    per = recorded.groupBy("path").agg(F.sort_array(F.collect_set("plugin")).alias("plugins"))
    return rows.join(per, "path", "left").withColumn("plugins", F.coalesce("plugins", F.array().cast("array<string>")))
