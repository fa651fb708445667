"""The translation memory: loading, upserting and reading back, over Parquet by source locale.

A memory is a folder with ``units`` (partitioned by source_locale) and ``meta.json``.
Parquet has no MERGE, so an upsert joins old and new by key and writes the partitions
that it touches: first beside the table, then over it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.functions import text as fx
from segmenta.schema import COMMENT, CONTEXT, META, TAGS, UNIT_COLUMNS, unit_type

#: Version 2 holds whole tags, comments, metadata and neighbours.
VERSION = 2
KEY = ["source_hash", "context_hash", "source_locale", "target_locale", "target"]
_TYPES = {
    "id": "string", "unit_key": "string", "source": "string", "target": "string", "source_locale": "string", "target_locale": "string", "status": "string",
    "previous_source": "string", "next_source": "string", "project": "string", "domain": "string", "usage_count": "int",
    "plural_variant": "string", "plural_count": "int", "plural_category": "string", "plural_extensions": "map<string,string>",
    "signature": "array<struct<type:string,pair_id:string>>", "tags": TAGS, "comments": f"array<{COMMENT}>", "meta": META, "previous_context": CONTEXT, "next_context": CONTEXT,
    "extensions": "map<string,string>", "source_hash": "string", "context_hash": "string", "updated_at": "timestamp",
}
COLUMNS = ", ".join(f"{k} {v}" for k, v in _TYPES.items())
NAMES = list(_TYPES)


def as_rows(df: DataFrame, **values: Column) -> DataFrame:
    """Any frame as memory rows: columns by name, ``values`` in their stead, null for the rest."""
    return df.select(*[values.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()])


def exploded(units: DataFrame, project: str | None = None, domain: str | None = None) -> DataFrame:
    """Memory rows of units: one for each target, or one without; a target's own fields stand first."""
    t = units.select("*", F.explode_outer(F.map_entries("targets")).alias("_e")).select("*", F.col("_e.key").alias("_locale"), F.col("_e.value").alias("_t"))
    ext = fx.merged_map(F.col("extensions"), F.col("_t.extensions"))
    firstc = F.filter(F.transform("comments", lambda c: c["origin"]["project"]), lambda p: p.isNotNull() & (p != ""))
    source, prev, following = F.col("source"), F.coalesce(F.col("previous_context.source"), F.lit("")), F.coalesce(F.col("next_context.source"), F.lit(""))
    sig = fx.tag_signature(F.col("tags.source_ties"))
    own = F.col("_t.tags")
    tags = F.when(F.col("tags").isNotNull() | own.isNotNull(), F.struct(F.col("tags.source_ties").alias("source_ties"), F.coalesce(own["ties"], F.col("tags.target_ties")).alias("target_ties"), F.col("tags.source_parts").alias("source_parts"), F.coalesce(own["parts"], F.col("tags.target_parts")).alias("target_parts")))
    out = t.select(
        F.col("unit_id").alias("unit_key"),
        source.alias("source"),
        F.coalesce("_t.text", "target").alias("target"),
        F.coalesce("source_locale", F.lit("")).alias("source_locale"),
        F.coalesce("_locale", "target_locale", F.lit("")).alias("target_locale"),
        F.coalesce("_t.status", "status").alias("status"),
        prev.alias("previous_source"),
        following.alias("next_source"),
        F.coalesce(F.lit(project), F.try_element_at(firstc, F.lit(1))).alias("project"),
        F.coalesce(F.lit(domain), F.try_element_at(ext, F.lit("domain"))).alias("domain"),
        F.coalesce("_t.meta.usage_count", "meta.usage_count", F.lit(0)).alias("usage_count"),
        F.coalesce("_t.plural.variant", "plural.variant").alias("plural_variant"),
        F.coalesce("_t.plural.count", "plural.count").alias("plural_count"),
        F.coalesce("_t.plural.category", "plural.category").alias("plural_category"),
        F.coalesce("_t.plural.extensions", "plural.extensions").alias("plural_extensions"),
        sig.alias("signature"),
        tags.alias("tags"),
        F.coalesce("_t.comments", "comments").alias("comments"),
        F.coalesce("_t.meta", "meta").alias("meta"),
        "previous_context",
        "next_context",
        ext.alias("extensions"),
        fx.source_hash(source).alias("source_hash"),
        fx.context_hash(source, prev, following).alias("context_hash"),
        "doc_id",
        "ordinal",
    )
    return out


#: Bytes of files that a partition gets, which are several times as many in memory.
PARTITION_BYTES = 1 << 20


def partitions_for(*sides: DataFrame) -> int:
    """How many partitions keep a sort of any of these frames small, by the tables that they read.

    Adaptive plans would join small compressed partitions to ones that are large in memory.
    """
    def size(df: DataFrame) -> int:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        return sum(x for x in sizes if x < 1 << 60)  # rows that are no table have no size: the greatest number stands for it

    least = int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(20_000, -(-max(map(size, sides)) // PARTITION_BYTES)))


def first_of_key(rows: DataFrame) -> DataFrame:
    """The first row (by doc_id, ordinal, unit_key) of equal source, target, locales and neighbours, whatever the case of the sources."""
    keys = [F.lower("source"), F.col("target"), F.col("source_locale"), F.col("target_locale"), F.lower("previous_source"), F.lower("next_source")]
    w = Window.partitionBy(*keys).orderBy("doc_id", "ordinal", "unit_key")
    return rows.repartition(partitions_for(rows), *keys).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def row_id() -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in KEY], F.when(F.col("target").isNull(), F.col("unit_key")).otherwise(F.lit(""))), 256)


def upserted(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The memory after ``new`` rows were loaded into ``old``, in one join by key.

    A row meets the old one of its key (an untranslated row, one with its unit_key and
    hashes that has no target either) and takes its place: usage_count is the greater of
    both plus one, extensions are merged, the new ones win.  Of several new rows of a key
    the first by unit_key counts.  Old rows that nothing meets stay as they are.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("id", row_id())

    parts = partitions_for(old, new)
    fresh = keyed(new).repartition(parts, "id").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("unit_key"))).where("_r = 1")
    o, n = old.repartition(parts, "id").alias("o"), fresh.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    met, added = F.col("n.id").isNotNull(), F.col("o.id").isNull()
    made = []
    for name in NAMES:
        if name == "usage_count":
            c = F.when(~met, F.col("o.usage_count")).when(added, F.col("n.usage_count")).otherwise(F.greatest(F.coalesce("o.usage_count", F.lit(0)), F.coalesce("n.usage_count", F.lit(0))) + 1)
        elif name == "extensions":
            c = F.when(~met, F.col("o.extensions")).otherwise(fx.merged_map(F.col("o.extensions"), F.col("n.extensions")))
        elif name == "updated_at":
            c = F.when(met, now).otherwise(F.col("o.updated_at"))
        else:
            c = F.when(met, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        made.append(c.alias(name))
    return both.select(*made)


def replaced_children(children: DataFrame, new: DataFrame, touched: DataFrame, by: list[str]) -> DataFrame:
    """Children of the parents in ``touched`` give way to the ``new`` ones of those parents; all others stay."""
    parts = partitions_for(children, new)
    parents = touched.select(*by).distinct().repartition(parts, *by).hint("merge")
    return children.repartition(parts, *by).join(parents, by, "left_anti").unionByName(new.repartition(parts, *by).join(parents, by, "left_semi"))


def units_of(rows: DataFrame) -> DataFrame:
    """Memory rows as units: one with one target for each row, in the order of keys in a pair of locales."""
    plural = F.struct(F.col("plural_variant").alias("variant"), F.col("plural_count").alias("count"), F.col("plural_category").alias("category"), F.col("plural_extensions").alias("extensions"))
    none = F.col("plural_variant").isNull() & F.col("plural_count").isNull() & F.col("plural_category").isNull()

    def neighbour(side: str) -> Column:
        c, text = F.col(f"{side}_context"), F.when(F.col(f"{side}_source") != "", F.col(f"{side}_source"))
        return F.when(c.isNotNull() | text.isNotNull(), F.struct(c["unit_id"].alias("unit_id"), F.coalesce(c["source"], text).alias("source"), c["target"].alias("target"), c["extensions"].alias("extensions")))

    w = Window.partitionBy("source_locale", "target_locale").orderBy("unit_key", "id")
    meta = F.struct(F.col("usage_count").alias("usage_count"), *[F.col(f"meta.{f.name}").alias(f.name) for f in unit_type()["meta"].dataType.fields if f.name != "usage_count"])
    have = {
        "doc_id": F.concat_ws(">", "source_locale", "target_locale"), "ordinal": F.row_number().over(w) - 1, "unit_id": F.col("unit_key"), "plural": F.when(~none, plural),
        "meta": meta, "previous_context": neighbour("previous"), "next_context": neighbour("next"),
    }
    types = {f.name: f.dataType for f in unit_type().fields}
    empty = {"targets": F.create_map(), "target_locales": F.array(), "comments": F.array(), "extensions": F.create_map()}
    made = []
    for c in UNIT_COLUMNS:
        value = have.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(types[c])
        made.append((F.coalesce(value, empty[c].cast(types[c])) if c in empty else value).alias(c))
    return rows.select(*made)


class TranslationMemory:
    """A memory in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        if not folder:
            raise ValueError("a memory needs a folder")
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _meta(self) -> dict | None:
        fs, path = self._path("meta.json")
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/meta.json").collect())) if fs.exists(path) else None

    def setup(self, partitioned: bool = True) -> None:
        """Make the folder; a newer layout or another partitioning is refused."""
        meta = self._meta()
        if meta is not None:
            if meta["version"] > VERSION:
                raise ValueError("the memory was made by a newer version")
            if meta["partitioned"] != partitioned:
                raise ValueError("the memory is partitioned otherwise")
            return
        fs, path = self._path("meta.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"version": VERSION, "partitioned": partitioned}).encode()))
        out.close()

    def rows(self) -> DataFrame:
        fs, path = self._path("units")
        if not fs.exists(path):
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(f"{self.folder}/units").select(*NAMES)

    def load(self, units: DataFrame, project: str | None = None, domain: str | None = None, now: Column | None = None) -> dict[str, int]:
        """Load units; returns how many rows were read and written.

        New rows are made once, as a table beside the memory, and counted there; the merged
        partitions are written beside it too before they replace those in place.
        """
        meta = self._meta()
        if meta is None:
            raise ValueError("call setup first")
        stamp = now if now is not None else F.current_timestamp()
        name = uuid.uuid4().hex
        read = exploded(units, project, domain)
        read.write.parquet(f"{self.folder}/read-{name}")
        read = self.spark.read.schema(read.schema).parquet(f"{self.folder}/read-{name}")
        first = first_of_key(read).withColumn("updated_at", stamp)
        first.write.parquet(f"{self.folder}/new-{name}")
        new = self.spark.read.schema(first.schema).parquet(f"{self.folder}/new-{name}")
        locales = [r[0] for r in new.select("source_locale").distinct().collect()]
        old = self.rows()
        touched = old.where(F.col("source_locale").isin(locales)) if meta["partitioned"] else old
        merged = upserted(touched, new, stamp)
        merged.write.parquet(f"{self.folder}/staged-{name}")
        writer = self.spark.read.schema(merged.schema).parquet(f"{self.folder}/staged-{name}").write.mode("overwrite")
        if meta["partitioned"]:
            writer = writer.partitionBy("source_locale").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{self.folder}/units")
        stats = {"read": read.count(), "written": new.count()}
        for part in ("read", "new", "staged"):
            fs, path = self._path(f"{part}-{name}")
            fs.delete(path, True)
        return stats

    def units(self, source_locale: str, target_locale: str) -> DataFrame:
        """The rows of a pair of locales as units."""
        return units_of(self.rows().where((F.col("source_locale") == source_locale) & (F.col("target_locale") == target_locale)))

    def unit(self, unit_key: str, source_locale: str = "", target_locale: str = "") -> DataFrame:
        """The newest row of a key; an empty locale stands for any."""
        out = self.rows().where(F.col("unit_key") == unit_key)
        for name, value in (("source_locale", source_locale), ("target_locale", target_locale)):
            if value:
                out = out.where(F.col(name) == value)
        return out.orderBy(F.desc("updated_at"), "id").limit(1)

    def to_document(self, source_locale: str, target_locale: str) -> DataFrame:
        """Rows of a pair of locales in the order of their keys."""
        return self.rows().where((F.col("source_locale") == source_locale) & (F.col("target_locale") == target_locale)).orderBy("unit_key", "id")

    def to_multilingual_document(self, source_locale: str) -> DataFrame:
        """(unit_key, source, targets): all locales of a source locale side by side; the newest row of each counts."""
        w = Window.partitionBy("unit_key", "target_locale").orderBy(F.desc("updated_at"), "id")
        newest = self.rows().where(F.col("source_locale") == source_locale).withColumn("_r", F.row_number().over(w)).where("_r = 1 AND target IS NOT NULL")
        entry = F.struct("target_locale", F.struct(F.col("target").alias("text"), F.col("status").alias("status")).alias("value"))
        return newest.groupBy("unit_key").agg(F.min("source").alias("source"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("targets"))

    def stream(self, source_locale: str, target_locale: str):  # noqa: ANN201
        """The rows of ``to_document`` one by one, fetched by partition."""
        return self.to_document(source_locale, target_locale).toLocalIterator(prefetchPartitions=True)

    def match(self, queries: DataFrame, limit: int = 5, threshold: float = 0.7, require_context: bool | None = None, require_tags: bool | None = None) -> DataFrame:
        """Matches of any number of queries in one distributed join, classified and cut to ``limit`` each.

        Neighbours are required of the queries that have any, unless ``require_context`` says
        otherwise; tags, where queries have a column ``signature``.
        """
        from segmenta.operators import matching

        if limit < 1 or not 0 <= threshold <= 1:
            raise ValueError("limit must be 1 at least and threshold between 0 and 1")
        memory = self.rows().withColumn("unit_id", F.col("id"))
        found = matching.match_tiers(queries, memory, limit, max(threshold, 1e-6))
        return matching.classify(found, queries, memory, require_context, limit, require_tags)
