"""Per-locale targets of units: selection, splitting and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions.text import merged_map


def _sole() -> Column:
    return F.when(F.size("targets") == 1, F.get(F.map_values("targets"), 0))


def selected(locale: str | Column | None = None) -> Column:
    """The target of a locale; without one, the only target, or null."""
    if locale is None:
        return _sole()
    return F.try_element_at("targets", F.lit(locale) if isinstance(locale, str) else locale)


def target_text(locale: str | Column | None = None) -> Column:
    return F.coalesce(selected(locale)["text"], F.col("target"))


def target_status(locale: str | Column | None = None) -> Column:
    return F.coalesce(selected(locale)["status"], F.col("status"))


def with_selected(units: DataFrame, locale: str | Column | None = None, name: str = "selected") -> DataFrame:
    """Units with the target of a locale as a struct; without one, the only target, else the unit's own text and status."""
    kind = units.schema["targets"].dataType.valueType  # type: ignore[union-attr]
    own = {"text": "target", "status": "status"}
    single = F.struct(*[(F.col(own[f.name]) if own.get(f.name) in units.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    one = selected(locale)
    return units.withColumn(name, one if locale is not None else F.coalesce(one, F.when(F.col("target").isNotNull(), single)))


def select_target(units: DataFrame, locale: str | Column) -> DataFrame:
    """Units with one target, that of ``locale``; its own fields stand before the unit's, its extensions win."""
    one = selected(locale)
    out = units.withColumn("_t", one).where("_t IS NOT NULL")
    fields = units.schema["targets"].dataType.valueType.names  # type: ignore[union-attr]
    if "extensions" in fields and "extensions" in units.columns:
        out = out.withColumn("extensions", merged_map(F.col("extensions"), F.col("_t.extensions")))
    for name in ("status", "plural", "meta", "comments"):
        if name in fields and name in units.columns:
            out = out.withColumn(name, F.coalesce(F.col(f"_t.{name}"), F.col(name)))
    return out.withColumn("target", F.col("_t.text")).withColumn("target_locale", F.lit(locale) if isinstance(locale, str) else locale).drop("_t", "targets")


def split_targets(units: DataFrame) -> DataFrame:
    """One row for each target of each unit, as ``select_target`` makes them."""
    each = units.withColumn("_locale", F.explode(F.map_keys("targets")))
    return select_target(each, F.col("_locale")).drop("_locale")


def locales_in_order(units: DataFrame) -> DataFrame:
    """(doc_id, locale, place): target locales of a document as they come up first; of equal places by name."""
    seen = units.select("doc_id", "ordinal", F.posexplode(F.array_sort(F.map_keys("targets"))).alias("i", "locale"))
    first = seen.groupBy("doc_id", "locale").agg(F.min(F.struct("ordinal", "i")).alias("first"))
    return first.select("doc_id", "locale", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "locale")) - 1).alias("place"))


def first_status() -> Column:
    """The first status other than unknown, in the order of target_locales, else the unit's."""
    known = F.filter(F.transform("target_locales", lambda k: F.try_element_at("targets", k)["status"]), lambda s: s.isNotNull() & (s != "unknown"))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.col("status"))


def gathered(rows: DataFrame) -> DataFrame:
    """Rows of (unit_key, target_locale, target, ...) as units with a map of targets."""
    entry = F.struct("target_locale", F.struct(F.col("target").alias("text"), F.col("status").alias("status")).alias("value"))
    return rows.groupBy("unit_key").agg(F.min("source").alias("source"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("targets"))


def _folded(column: str, kind: str) -> Column:
    """The maps of a group in order of ordinal, as one; entries of later ones win."""
    rows = F.collect_list(F.struct(F.coalesce("ordinal", F.lit(-1)).alias("o"), F.map_keys(column).alias("k"), F.map_values(column).alias("v")))
    maps = F.transform(F.array_sort(rows, lambda x, y: F.signum(x["o"] - y["o"]).cast("int")), lambda x: F.map_from_arrays(x["k"], x["v"]))
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.aggregate(maps, F.create_map().cast(kind), over)


def _said(units: DataFrame, column: str) -> Column:
    """Where a column of an earlier unit gives way to a later one: no source, no comments, no target or tags."""
    if column == "source":
        return F.col(column) != ""
    return F.size(column) > 0 if units.schema[column].dataType.typeName() == "array" else F.col(column).isNotNull()


def merge_by_id(units: DataFrame, by: tuple[str, ...] = ("doc_id", "unit_id")) -> DataFrame:
    """One unit for each id of a document.

    Source, target, tags and comments are the first that say something; targets and
    extensions are merged, later ones win; all else is the first unit's.  With
    ``by`` = (doc_id, target_locale, unit_id), rows of several locales are merged each
    in their own.  Units without an ordinal come first, in no order of their own.
    """
    order = F.coalesce("ordinal", F.lit(-1))
    made = []
    for c in units.columns:
        if c in by:
            continue
        if c == "ordinal":
            made.append(F.min(c).alias(c))
        elif units.schema[c].dataType.typeName() == "map":
            made.append(_folded(c, units.schema[c].dataType.simpleString()).alias(c))
        elif c in ("source", "target", "tags", "comments"):
            made.append(F.coalesce(F.min_by(c, F.when(_said(units, c), order)), F.min_by(c, order)).alias(c))
        else:
            made.append(F.min_by(c, order).alias(c))
    return units.groupBy(*by).agg(*made).select(*units.columns)
