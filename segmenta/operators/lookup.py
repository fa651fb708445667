"""Lookups, predicates and neighbours over units."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit(units: DataFrame, unit_id: str) -> DataFrame:
    return units.where(F.col("unit_id") == unit_id)


def units_by_id(units: DataFrame, ids: DataFrame) -> DataFrame:
    """The units whose unit_id is in ``ids``; one join for any number of lookups."""
    return units.join(ids.select("unit_id").distinct(), "unit_id", "left_semi")


def in_order(units: DataFrame) -> DataFrame:
    return units.orderBy("doc_id", "ordinal")


def ids(units: DataFrame) -> DataFrame:
    return in_order(units).select("unit_id")


def filtered(units: DataFrame, predicate: Column | Callable[[dict], bool]) -> DataFrame:
    """Units that a Column holds for, or a Python callable of the unit as a dict (Arrow batches)."""
    if isinstance(predicate, Column):
        return units.where(predicate)

    @F.pandas_udf(T.BooleanType())  # type: ignore[call-overload]
    def holds(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(predicate(r)) for r in rows.to_dict("records")], dtype="bool")

    return units.where(holds(F.struct("*")))


def _leaf(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(kind, T.StructType | T.MapType | T.ArrayType):
        raise ValueError("a path must end at a plain value")
    return value.cast("string")


def _holds(value: Column, kind: T.DataType, path: list[str], wanted: str) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: _holds(x, kind.elementType, path, wanted)), F.lit(False))
    if not path:
        return F.coalesce(_leaf(value, kind) == F.lit(wanted), F.lit(False))
    if isinstance(kind, T.StructType):
        if path[0] not in kind.names:
            return F.lit(False)
        return _holds(value[path[0]], kind[path[0]].dataType, path[1:], wanted)
    if isinstance(kind, T.MapType):
        return _holds(F.try_element_at(value, F.lit(path[0])), kind.valueType, path[1:], wanted)
    return F.lit(False)


def where(units: DataFrame, path: str, value: object) -> DataFrame:
    """Units that have ``value`` at a dotted path through structs, maps and arrays.

    An array holds if one of its members does; values are compared by their spelling
    (True, False for booleans).  A path that leads nowhere holds for no unit, and None
    for none.  The predicate is one expression, so it is pushed down like any other.
    """
    if value is None:
        return units.where(F.lit(False))
    parts = path.split(".")
    if parts[0] not in units.columns:
        return units.where(F.lit(False))
    return units.where(_holds(F.col(f"`{parts[0]}`"), units.schema[parts[0]].dataType, parts[1:], str(value)))


def plurals(units: DataFrame) -> DataFrame:
    return units.where("plural IS NOT NULL")


def with_neighbours(units: DataFrame, part: str | None = None) -> DataFrame:
    """``previous_id`` and ``next_id`` in a document, within runs of the same ``part`` if given."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    prev, following = F.lag("unit_id").over(w), F.lead("unit_id").over(w)
    if part is not None:
        prev = F.when(F.lag(part).over(w).eqNullSafe(F.col(part)), prev)
        following = F.when(F.lead(part).over(w).eqNullSafe(F.col(part)), following)
    return units.withColumn("previous_id", prev).withColumn("next_id", following)


def generated_ids(units: DataFrame, prefix: str = "auto_") -> DataFrame:
    """Ids for units without one, numbered in a document among themselves."""
    missing = F.col("unit_id").isNull() | (F.col("unit_id") == "")
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(missing.cast("int")).over(w) - 1
    return units.withColumn("unit_id", F.when(missing, F.concat(F.lit(prefix), n.cast("string"))).otherwise(F.col("unit_id")))


def suffixed_keys(rows: DataFrame, key: str, order: str, by: str = "doc_id") -> DataFrame:
    """Repeated keys of a document get the next free of #2, #3, ... in order.

    A key that already ends in such a suffix may take the place of another, so keys that
    differ only in suffixes are numbered together, one after the other; all others are
    numbered by a window.
    """
    family = F.regexp_replace(F.col(key), r"(#\d+)+$", "")
    marked = rows.withColumn("_family", family)
    marked = marked.withColumn("_mixed", F.max(F.col(key) != F.col("_family")).over(Window.partitionBy(by, "_family")))
    n = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    plain = marked.where(~F.coalesce("_mixed", F.lit(False))).withColumn("unique_key", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), n.cast("string"))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        used: set[str] = set()
        following: dict[str, int] = {}
        made = []
        for k in frame[key]:
            name, i = k, following.get(k, 2)
            while name in used:
                name, i = f"{k}#{i}", i + 1
            used.add(name)
            following[k] = i
            made.append(name)
        return frame.assign(unique_key=made)

    schema = T.StructType([*marked.schema.fields, T.StructField("unique_key", T.StringType())])
    mixed = marked.where("_mixed").groupBy(by, "_family").applyInPandas(run, schema)
    return plain.unionByName(mixed).drop("_family", "_mixed")


def resource_groups(units: DataFrame, resource: str) -> DataFrame:
    """``group``: the number of the run of neighbouring units with the same resource, from 0."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    new = (~F.lag(resource).over(w).eqNullSafe(F.col(resource)) & (F.row_number().over(w) > 1)).cast("int")
    return units.withColumn("_new", new).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
