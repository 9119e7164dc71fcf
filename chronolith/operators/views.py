"""Published views: the elements of arrays and the steps of time as leading dimensions of one padded tensor per signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import paths, values
from chronolith.operators import catalog


def fill_of(kind: str) -> Column:
    """What a hole holds in a view, by the type of the values."""
    return {"int": F.lit(values.VIEW_INT), "double": F.lit(values.EMPTY_DOUBLE), "string": F.lit("")}[kind]


def _product(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x)


def _flat(index: Column, dims: Column) -> Column:
    return F.aggregate(F.arrays_zip(index.alias("i"), dims.alias("d")), F.lit(0).cast("long"), lambda a, x: a * x["d"] + x["i"])


def shapes(rows: DataFrame) -> DataFrame:
    """(schema_path, outer, inner): dimensions of the cells and of the arrays in them, the greatest over all rows."""
    plus = rows.select("schema_path", F.transform("index", lambda x: x + 1).alias("outer"), F.array(F.size("value")).alias("inner"))
    outer = catalog.ragged_shape(plus, ["schema_path"], "outer")
    return outer.join(catalog.ragged_shape(plus, ["schema_path"], "inner"), "schema_path")


def publish(rows: DataFrame, kind: str = "double", most_cells: int | None = None) -> DataFrame:
    """(schema_path, outer, inner, cell, value, capped): every cell of every signal, row-major.

    rows: schema_path, index (array<int>: elements and steps from the outside in), value (array). A cell's array is
    padded to the longest, a cell without row is all fill. A signal of more than most_cells cells is reduced to the
    cells of its first outermost index, and marked so. Cells are rows, so no signal must fit a task.
    """
    known = shapes(rows)
    cells = _product(F.col("outer"))
    over = cells > most_cells if most_cells else F.lit(False)
    known = known.withColumn("capped", over).withColumn("n", F.when(over, cells / F.element_at("outer", 1)).otherwise(cells).cast("long"))
    grid = known.where("n > 0").select("schema_path", "outer", "inner", "capped", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("cell"))
    placed = rows.join(known.select("schema_path", "outer"), "schema_path").select("schema_path", _flat(F.col("index"), F.col("outer")).alias("cell"), "value")
    full = grid.join(placed, ["schema_path", "cell"], "left")
    width, fill = F.element_at("inner", 1), fill_of(kind)
    value = F.transform(F.sequence(F.lit(1), width), lambda k: F.coalesce(F.try_element_at(F.col("value"), k), fill))
    return full.select("schema_path", "outer", "inner", "cell", F.when(width > 0, value).otherwise(F.col("value")).alias("value"), "capped")


def statistics(rows: DataFrame) -> DataFrame:
    """One row: signals, arrays of structs, mappings in all and of the largest signal, holes of the padded views."""
    per = rows.groupBy("schema_path").agg(F.count("*").alias("n"), F.sum(F.size("value")).alias("elements"))
    both = per.join(shapes(rows), "schema_path").withColumn("room", _product(F.col("outer")) * F.element_at("inner", 1))
    groups = rows.select("schema_path").distinct().where(F.col("schema_path").contains("/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("schema_path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("schema_path", "/"), F.lit(1), k), "/"))).alias("g")).distinct().agg(F.count("*").alias("n_groups"))
    out = both.agg(F.count("*").alias("n_datasets"), F.sum("n").alias("n_mappings"), F.max("n").alias("max_mappings"), F.sum(F.col("room") - F.col("elements")).alias("n_fill_holes"))
    return out.join(F.broadcast(groups))  # one row each


def names(rows: DataFrame, flat: bool = False) -> DataFrame:
    """(schema_path, name, dims, n_holes): how a view lists its signals; flat: with : instead of /."""
    per = rows.groupBy("schema_path").agg(F.sum(F.size("value")).alias("elements"))
    both = per.join(shapes(rows), "schema_path")
    dims = F.concat("outer", "inner")
    name = paths.colon_name(F.col("schema_path")) if flat else F.col("schema_path")
    return both.select("schema_path", name.alias("name"), dims.alias("dims"), (_product(dims) - F.col("elements")).alias("n_holes"))


def expanded(leaves: DataFrame) -> DataFrame:
    """(name, value): the view that isn't collapsed, one entry per path with its indices in brackets."""
    return leaves.select(F.regexp_replace("path", "/([0-9]+)(?=/|$)", "[$1]").alias("name"), "value")


def write(view: DataFrame, path: str) -> None:
    """Stores a view, one folder per signal; writing it again replaces it."""
    view.withColumn("signal", paths.colon_name(F.col("schema_path"))).write.mode("overwrite").partitionBy("signal").parquet(path)
