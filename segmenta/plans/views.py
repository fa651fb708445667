"""The driver's tables as translation units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions import text as fx
from segmenta.schema import unit_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_units(df: DataFrame) -> DataFrame:
    """Any frame with some of the columns of units, as units; missing maps and lists are empty, fields of structs go by name."""
    empty = {"targets": F.create_map(), "target_locales": F.array(), "comments": F.array(), "extensions": F.create_map()}

    def cast(value: Column, have: T.DataType, want: T.DataType) -> Column:
        if isinstance(have, T.MapType):
            return F.transform_values(value, lambda _, x: cast(x, have.valueType, want.valueType)).cast(want)
        if isinstance(have, T.ArrayType):
            return F.transform(value, lambda x: cast(x, have.elementType, want.elementType)).cast(want)
        if isinstance(have, T.StructType):
            fields = [(cast(value[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value.cast(want)

    made = []
    for f in unit_type().fields:
        value = cast(F.col(f.name), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        made.append((F.coalesce(value, empty[f.name].cast(f.dataType)) if f.name in empty else value).alias(f.name))
    return df.select(*made)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit for each line of a document that isn't blank."""
    return _lines(table(spark, sf_dir, "documents"))


def _lines(documents: DataFrame, *others: str) -> DataFrame:
    docs = documents.select("doc_id", F.col("lang").alias("source_locale"), F.col("source").alias("project"), *others, F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return docs.select("doc_id", "ordinal", F.concat_ws(":", "doc_id", "ordinal").alias("unit_id"), F.trim("line").alias("source"), "source_locale", "project", *others).where("source <> ''")


UNITS_SQL = """
    SELECT doc_id, ordinal, doc_id || ':' || ordinal AS unit_id, trim(line) AS source, source_locale, project
    FROM (SELECT doc_id, lang AS source_locale, source AS project, CAST(unnest(range(0, len(x))) AS INTEGER) AS ordinal, unnest(x) AS line
          FROM (SELECT *, string_split(text, chr(10)) AS x FROM documents))
    WHERE trim(line) <> ''"""


def in_context(u: DataFrame) -> DataFrame:
    """Units with their neighbours' sources."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return u.withColumn("previous_source", F.lag("source").over(w)).withColumn("next_source", F.lead("source").over(w))


CONTEXT_SQL = f"""
    SELECT *, lag(source) OVER w AS previous_source, lead(source) OVER w AS next_source
    FROM ({UNITS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)"""


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in context with hashes; those of labelled documents have a target and a status.

    Labels are joined to whole documents, so that texts are shuffled once, and not by line; a document's
    labels stay together until its lines have their neighbours.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.collect_list(F.struct("quality")).alias("_labels"))
    u = in_context(_lines(table(spark, sf_dir, "documents").join(labels, "doc_id", "left"), "_labels"))
    u = u.select("*", F.inline_outer("_labels"))
    return u.select(
        "doc_id", "ordinal", "unit_id", "source", "source_locale", F.lit("xx").alias("target_locale"), "project", "previous_source", "next_source",
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("["), "source", F.lit("]"))).alias("target"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("new").alias("status"),
        fx.source_hash(F.col("source")).alias("source_hash"),
        fx.context_hash(F.col("source"), F.col("previous_source"), F.col("next_source")).alias("context_hash"),
    )


TRANSLATED_SQL = f"""
    SELECT c.*, 'xx' AS target_locale, CASE WHEN quality IS NOT NULL THEN '[' || c.source || ']' END AS target,
           CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'new' END AS status, md5(lower(c.source)) AS source_hash,
           md5(lower(c.source) || '|' || lower(coalesce(previous_source, '')) || '|' || lower(coalesce(next_source, ''))) AS context_hash
    FROM ({CONTEXT_SQL}) c LEFT JOIN labels USING (doc_id)"""


def memory(t: DataFrame) -> DataFrame:
    """Translation-memory rows: the translated units, one for each key, with its number of uses."""
    key = ["source_hash", "context_hash", "source_locale", "target_locale", "target"]
    first = F.min_by(F.struct("unit_id", "source", "previous_source", "next_source", "status"), F.struct("doc_id", "ordinal"))
    return t.where("target IS NOT NULL").groupBy(*key).agg(F.count("*").alias("usage_count"), first.alias("x")).select(*key, "usage_count", "x.*")


MEMORY_SQL = f"""
    SELECT source_hash, context_hash, source_locale, target_locale, target, usage_count, x.unit_id, x.source, x.previous_source, x.next_source, x.status FROM (
      SELECT source_hash, context_hash, source_locale, target_locale, target, count(*) AS usage_count,
             arg_min({{'unit_id': unit_id, 'source': source, 'previous_source': previous_source, 'next_source': next_source, 'status': status}}, {{'d': doc_id, 'o': ordinal}}) AS x
      FROM ({TRANSLATED_SQL}) WHERE target IS NOT NULL GROUP BY ALL)"""
