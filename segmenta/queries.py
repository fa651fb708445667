"""Queries of the reference's operators over the driver's whole tables, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.functions import message as msg
from segmenta.functions import plural as pl
from segmenta.functions import text as fx
from segmenta.operators import lookup, matching, memory, targets
from segmenta.plans import views as v
from segmenta.plans.shared import scratch
from segmenta.plans.views import table
from segmenta.sinks import files, regen
from segmenta.sources import html, json_i18n, po

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import segmenta.file_queries  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import segmenta.file_queries  # noqa: F401

    return dict(SQL)


# --- scans, lookups, predicates -----------------------------------------------------------


@query(v.UNITS_SQL)
def units_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.units(spark, sf_dir)


@query(f"SELECT * FROM ({v.UNITS_SQL}) WHERE unit_id IN (SELECT doc_id || ':0' FROM labels)")
def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unit of each labelled document, by id."""
    wanted = table(spark, sf_dir, "labels").select(F.concat_ws(":", "doc_id", F.lit(0)).alias("unit_id"))
    return lookup.units_by_id(v.units(spark, sf_dir), wanted)


@query(f"SELECT unit_id FROM ({v.UNITS_SQL}) ORDER BY doc_id, ordinal")
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.ids(v.units(spark, sf_dir))


@query(f"SELECT unit_id, length(source) AS n FROM ({v.UNITS_SQL}) WHERE source LIKE '%.' AND source_locale <> 'en'")
def filter_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.filtered(v.units(spark, sf_dir), F.col("source").endswith(".") & (F.col("source_locale") != "en")).select("unit_id", F.length("source").alias("n"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units with a struct, a map and an array of structs inside."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        "doc_id",
        F.struct(F.col("n_chars").alias("max_length"), F.col("quality").alias("usage_count")).alias("meta"),
        F.create_map(F.lit("project"), F.col("source"), F.lit("lang"), F.col("lang")).alias("extensions"),
        F.array(F.struct(F.struct(F.col("source").alias("project")).alias("origin")), F.struct(F.struct(F.col("lang").alias("project")).alias("origin"))).alias("comments"),
        (F.col("toxic") == 1).alias("plural"),
    )


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def where_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.where(_nested(spark, sf_dir), "extensions.project", "src3").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'fr' OR lang = 'fr'")
def where_array_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.where(_nested(spark, sf_dir), "comments.origin.project", "fr").select("doc_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def where_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.where(_nested(spark, sf_dir), "meta.usage_count", 1).select("doc_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def where_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.where(_nested(spark, sf_dir), "plural", True).select("doc_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def plural_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.plurals(_nested(spark, sf_dir)).select("doc_id")


@query("SELECT conv_id, turn, coalesce(text, '') || CASE WHEN role = 'user' THEN '?' ELSE '!' END AS plain, true AS agrees FROM conversations WHERE text IS NOT NULL")
def plain_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    end = F.when(F.col("role") == "user", "?").otherwise("!")
    parts = F.array(part("text", F.col("text")), part("code", F.lit("b1")), part("text", end))
    return c.select("conv_id", "turn", fx.plain_text(parts).alias("plain"), fx.parts_match(parts, F.concat("text", end)).alias("agrees"))


# --- order and neighbours -----------------------------------------------------------------


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat_ws(":", "conv_id", "turn").alias("unit_id"), "role", "text")


CHAT_SQL = "SELECT conv_id AS doc_id, turn AS ordinal, conv_id || ':' || turn AS unit_id, role, text FROM conversations"


@query(f"SELECT unit_id, lag(unit_id) OVER w AS previous_id, lead(unit_id) OVER w AS next_id FROM ({v.UNITS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_neighbours(v.units(spark, sf_dir)).select("unit_id", "previous_id", "next_id")


@query(f"""SELECT unit_id, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN lag(unit_id) OVER w END AS previous_id,
       CASE WHEN lead(role) OVER w IS NOT DISTINCT FROM role THEN lead(unit_id) OVER w END AS next_id FROM ({CHAT_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
def prev_next_same_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_neighbours(_chat(spark, sf_dir), "role").select("unit_id", "previous_id", "next_id")


@query(f"""SELECT doc_id, ordinal, CASE WHEN role = 'assistant' THEN 'auto_' || (sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ordinal) - 1)::BIGINT ELSE unit_id END AS unit_id FROM ({CHAT_SQL})""")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chat(spark, sf_dir).withColumn("unit_id", F.when(F.col("role") != "assistant", F.col("unit_id")))
    return lookup.generated_ids(c).select("doc_id", "ordinal", "unit_id")


@query(f"""SELECT doc_id, ordinal, CASE WHEN n = 1 THEN role ELSE role || '#' || n END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY ordinal) AS n FROM ({CHAT_SQL}))""")
def dup_key_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.suffixed_keys(_chat(spark, sf_dir), "role", "ordinal").select("doc_id", "ordinal", "unique_key")


@query(f"""SELECT doc_id, ordinal, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS "group" FROM (
       SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM ({CHAT_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))""")
def resource_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resource_groups(_chat(spark, sf_dir), "role").select("doc_id", "ordinal", "group")


# --- targets --------------------------------------------------------------------------------


def _multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a target in 'xx' where they are labelled and one in 'yy' always."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    value = lambda text, status: F.struct(text.alias("text"), status.alias("status"), F.create_map(F.lit("from"), F.col("source")).alias("extensions"))
    xx = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("xx"), value(F.upper("lang"), F.when(F.col("quality") == 1, "approved").otherwise("unknown")))).otherwise(F.create_map().cast("map<string,struct<text:string,status:string,extensions:map<string,string>>>"))
    return d.select(
        "doc_id",
        F.col("n_chars").alias("ordinal"),
        F.col("doc_id").cast("string").alias("unit_id"),
        F.col("lang").alias("source"),
        F.lit("legacy").alias("target"),
        F.lit("draft").alias("status"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("from"), F.lit("unit")).alias("extensions"),
        F.map_concat(xx, F.create_map(F.lit("yy"), value(F.reverse("lang"), F.lit("translated")))).alias("targets"),
        F.array(F.lit("xx"), F.lit("yy")).alias("target_locales"),
    )


_MULTI = "(SELECT d.*, quality FROM documents d LEFT JOIN labels USING (doc_id))"


@query(f"SELECT doc_id, upper(lang) AS target, CASE WHEN quality = 1 THEN 'approved' ELSE 'unknown' END AS status, source AS origin, lang FROM {_MULTI} WHERE quality IS NOT NULL")
def select_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = targets.select_target(_multilingual(spark, sf_dir), "xx")
    return out.select("doc_id", "target", "status", F.col("extensions")["from"].alias("origin"), F.col("extensions")["lang"].alias("lang"))


@query(f"""SELECT doc_id, 'xx' AS target_locale, upper(lang) AS target FROM {_MULTI} WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'yy', reverse(lang) FROM {_MULTI}""")
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.split_targets(_multilingual(spark, sf_dir)).select("doc_id", "target_locale", "target")


@query(f"""SELECT doc_id, CASE WHEN quality IS NULL THEN reverse(lang) ELSE 'legacy' END AS sole_text, CASE WHEN quality IS NULL THEN 'translated' ELSE 'draft' END AS sole_status,
       CASE WHEN quality IS NULL THEN 'legacy' ELSE upper(lang) END AS xx_text FROM {_MULTI}""")
def target_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multilingual(spark, sf_dir).select("doc_id", targets.target_text().alias("sole_text"), targets.target_status().alias("sole_status"), targets.target_text("xx").alias("xx_text"))


@query(f"SELECT doc_id, CASE WHEN quality = 1 THEN 'approved' ELSE 'translated' END AS status FROM {_MULTI}")
def first_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multilingual(spark, sf_dir).select("doc_id", targets.first_status().alias("status"))


@query(f"""SELECT source AS doc_id, locale, row_number() OVER (PARTITION BY source ORDER BY o, i) - 1 AS place FROM (
       SELECT source, locale, min(o) AS o, arg_min(i, o) AS i FROM (SELECT source, 'xx' AS locale, n_chars AS o, 0 AS i FROM {_MULTI} WHERE quality IS NOT NULL
         UNION ALL SELECT source, 'yy', n_chars, CASE WHEN quality IS NULL THEN 0 ELSE 1 END FROM {_MULTI}) GROUP BY ALL)""")
def distinct_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _multilingual(spark, sf_dir).withColumn("doc_id", F.col("extensions")["lang"])
    u = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.col("source").alias("_s")).join(u, "unit_id").withColumn("doc_id", F.col("_s"))
    return targets.locales_in_order(u)


@query(f"""SELECT unit_key, source, xx, yy FROM (SELECT doc_id AS unit_key, lang AS source, CASE WHEN quality IS NOT NULL THEN upper(lang) END AS xx, reverse(lang) AS yy FROM {_MULTI})""")
def multilingual_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = targets.split_targets(_multilingual(spark, sf_dir)).select(F.col("doc_id").alias("unit_key"), "source", "target_locale", "target", "status")
    out = targets.gathered(rows)
    return out.select("unit_key", "source", F.try_element_at("targets", F.lit("xx"))["text"].alias("xx"), F.try_element_at("targets", F.lit("yy"))["text"].alias("yy"))


@query("SELECT p_partkey AS id, p_name AS source, upper(p_brand) AS target_xx, lower(p_type) AS target_yy, CASE WHEN p_size > 25 THEN 'approved' ELSE '' END AS status, p_brand || '; ' || p_type AS comments FROM part")
def csv_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular units as records: one column for each target, unknown status blank, comments joined."""
    p = table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") > 25, "approved").otherwise("unknown")
    entry = lambda text: F.struct(text.alias("text"), status.alias("status"))
    t = F.create_map(F.lit("xx"), entry(F.upper("p_brand")), F.lit("yy"), entry(F.lower("p_type")))
    note = lambda c: F.struct(F.col(c).alias("context"))
    none = F.lit(None).cast("string")
    u = p.select(F.lit("part").alias("doc_id"), F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("source"), none.alias("target"), none.alias("target_locale"), t.alias("targets"), status.alias("status"), F.array(note("p_brand"), note("p_type")).alias("comments"))
    return files.csv_table(u.withColumn("unit_id", F.col("unit_id").cast("string")), ["xx", "yy"]).drop("doc_id", "ordinal").withColumn("id", F.col("id").cast("bigint"))


# --- keys and maps --------------------------------------------------------------------------


@query(f"SELECT unit_id, source_hash FROM ({v.TRANSLATED_SQL})")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.translated(spark, sf_dir).select("unit_id", "source_hash")


@query(f"SELECT unit_id, context_hash FROM ({v.TRANSLATED_SQL})")
def context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.translated(spark, sf_dir).select("unit_id", "context_hash")


@query("SELECT c_custkey, lang || '-' || upper(country) AS canonical, lang AS base FROM (SELECT c_custkey, lower(left(c_mktsegment, 2)) AS lang, lower(right(c_mktsegment, 2)) AS country FROM customer)")
def canonical_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales made of letters of a column, in the wrong case and with an underscore."""
    raw = F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), F.lit("_"), F.lower(F.expr("right(c_mktsegment, 2)")))
    return table(spark, sf_dir, "customer").select("c_custkey", fx.canonical_locale(raw).alias("canonical"), fx.base_language(raw).alias("base"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey < 26 THEN '' WHEN s_suppkey < 702 THEN chr((65 + s_suppkey // 26 - 1)::INT) ELSE chr((65 + (s_suppkey // 26 - 1) // 26 - 1)::INT) || chr((65 + (s_suppkey // 26 - 1) % 26)::INT) END || chr((65 + s_suppkey % 26)::INT) AS letters FROM supplier")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", fx.column_letters(F.col("s_suppkey")).alias("letters"))


def _case(values: dict[str, str], name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN '{x}'" for k, x in values.items()) + " ELSE 'unknown' END"


_EVENT_STATE = {"click": "final", "view": "needs-translation", "purchase": "signed-off", "signup": "needs-review-l10n"}


@query(f"SELECT event_id, {_case(fx.TMX_STATUS, 's')} AS tmx, {_case(fx.XLIFF_STATUS, 's')} AS xliff FROM (SELECT event_id, {_case(_EVENT_STATE, 'event_type')} AS s FROM events)")
def status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx._mapped(F.col("event_type"), _EVENT_STATE, "unknown")
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", fx.tmx_status(F.upper("s")).alias("tmx"), fx.xliff_status(F.col("s"), F.col("s")).alias("xliff"))


@query("""SELECT doc_id, coalesce(l.toxic::VARCHAR, d.source) AS source, d.lang AS lang, l.quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def extensions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of two tables joined and merged; entries of labels win."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("a"))
    n = table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("source"), F.col("toxic").cast("string"), F.lit("quality"), F.col("quality").cast("string")).alias("b"))
    m = d.join(n, "doc_id", "left").select("doc_id", fx.merged_map(F.col("a"), F.col("b")).alias("m"))
    return m.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("source", "lang", "quality")])


# --- matching -------------------------------------------------------------------------------


def _match_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(untranslated units as queries, memory of the translated ones)."""
    t = v.translated(spark, sf_dir)
    q = t.where("target IS NULL").select(F.col("unit_id").alias("query_id"), "source", "source_locale", "target_locale", "previous_source", "next_source")
    return q, v.memory(t)


_LOC = "source_locale, target_locale"
_SIDES = f"""q AS (SELECT unit_id AS query_id, source, {_LOC}, previous_source, next_source, source_hash, context_hash FROM ({v.TRANSLATED_SQL}) WHERE target IS NULL),
    m AS ({v.MEMORY_SQL}),
    mi AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_hash, context_hash, {_LOC} ORDER BY usage_count DESC, unit_id) = 1),
    me AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_hash, {_LOC} ORDER BY usage_count DESC, unit_id) <= 5),
    i AS (SELECT q.query_id, mi.unit_id, mi.target, CAST(1 AS DOUBLE) AS score, 'ice' AS kind FROM q JOIN mi USING (source_hash, context_hash, {_LOC})),
    e AS (SELECT q.query_id, me.unit_id, me.target, CAST(1 AS DOUBLE) AS score, 'exact' AS kind FROM q JOIN me USING (source_hash, {_LOC})),
    t AS (SELECT * FROM i UNION ALL SELECT * FROM e WHERE query_id NOT IN (SELECT query_id FROM i))"""


@query(f"WITH {_SIDES} SELECT * FROM i")
def match_ice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ice(*_match_sides(spark, sf_dir))


@query(f"WITH {_SIDES} SELECT * FROM e")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact(*_match_sides(spark, sf_dir))


@query(f"WITH {_SIDES} SELECT * FROM t")
def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_tiers(*_match_sides(spark, sf_dir))


_NORM = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"
_EQ = "({} = {})".format
_CLASSIFIED = f"""SELECT t.query_id, t.unit_id, t.score, {_EQ(_NORM.format("q.source"), _NORM.format("m.source"))} AS source_equal, true AS tags_equal,
      {_EQ(_NORM.format("q.previous_source"), _NORM.format("m.previous_source"))} AS previous_equal, {_EQ(_NORM.format("q.next_source"), _NORM.format("m.next_source"))} AS next_equal, t.kind AS was
      FROM t JOIN q USING (query_id) JOIN m ON t.unit_id = m.unit_id"""


@query(f"""WITH {_SIDES}, c AS ({_CLASSIFIED})
    SELECT query_id, unit_id, score, CASE WHEN source_equal AND previous_equal AND next_equal AND was = 'ice' THEN 'ice' WHEN source_equal THEN 'exact' ELSE 'fuzzy' END AS kind, source_equal, tags_equal, previous_equal, next_equal FROM c""")
def match_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, m = _match_sides(spark, sf_dir)
    return matching.classify(matching.match_tiers(q, m), q, m)


def _signed(df: DataFrame, key: Column) -> DataFrame:
    """A bold tag where a third of the keys begins, an unpaired one for another third, else none."""
    n = F.pmod(F.length(key), F.lit(3))
    tag = lambda kind, pair: F.array(F.struct(F.lit(kind).alias("type"), F.lit(pair).cast("string").alias("pair_id")))
    return df.withColumn("signature", F.when(n == 0, tag("bold.open", "p1")).when(n == 1, tag("bold.open", None)))


@query(f"""WITH {_SIDES}, c AS (SELECT * REPLACE (length(query_id) % 3 = length(unit_id) % 3 AS tags_equal) FROM ({_CLASSIFIED}))
    SELECT query_id, unit_id, score, CASE WHEN source_equal AND tags_equal AND previous_equal AND next_equal AND was = 'ice' THEN 'ice' WHEN source_equal THEN 'exact' ELSE 'fuzzy' END AS kind, source_equal, tags_equal, previous_equal, next_equal FROM c""")
def match_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``match_classify``, with tags on both sides: a row whose tags differ is no in-context match."""
    q, m = _match_sides(spark, sf_dir)
    return matching.classify(matching.match_tiers(q, m), _signed(q, F.col("query_id")), _signed(m, F.col("unit_id")))


@query(f"""WITH {_SIDES}, c AS ({_CLASSIFIED}),
    k AS (SELECT query_id, unit_id, score, CASE WHEN source_equal AND previous_equal AND next_equal AND was = 'ice' THEN 'ice' WHEN source_equal THEN 'exact' ELSE 'fuzzy' END AS kind, source_equal, tags_equal, previous_equal, next_equal FROM c)
    SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE kind WHEN 'ice' THEN 0 WHEN 'exact' THEN 1 ELSE 2 END, unit_id) <= 2""")
def match_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best matches of each query, which is the limit that the caller sets."""
    q, m = _match_sides(spark, sf_dir)
    return matching.classify(matching.match_tiers(q, m), q, m, limit=2)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries in every language of documents."""
    locales = table(spark, sf_dir, "documents").select(F.col("lang").alias("source_locale")).distinct()
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"))
    none = F.lit(None).cast("string")
    return b.crossJoin(locales).select(F.concat_ws(":", "item_id", "source_locale").alias("query_id"), "source", "source_locale", F.lit("xx").alias("target_locale"), none.alias("previous_source"), none.alias("next_source"))


def _grams(side: str) -> str:
    """Distinct trigrams of each source of a side, by joining all that share one: brute force."""
    words = r"regexp_extract_all(lower(source), '[\p{L}\p{N}]+')"
    return f"SELECT DISTINCT {_LOC}, source, unnest(list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS gram FROM {side}"


def _fuzzy_sql(side: str, threshold: float, limit: int) -> str:
    """CTEs down to ``f``, the fuzzy matches of the queries in ``side`` among ``m``."""
    return f"""ga AS ({_grams(side)}), gb AS ({_grams("m")}),
    na AS (SELECT {_LOC}, source AS a, count(*) AS n_a FROM ga GROUP BY ALL), nb AS (SELECT {_LOC}, source AS b, count(*) AS n_b FROM gb GROUP BY ALL),
    p AS (SELECT ga.source_locale, ga.target_locale, ga.source AS a, gb.source AS b, count(*) AS n FROM ga JOIN gb USING ({_LOC}, gram) GROUP BY ALL),
    s AS (SELECT {_LOC}, a, b, n / (n_a + n_b - n) AS score FROM p JOIN na USING ({_LOC}, a) JOIN nb USING ({_LOC}, b) WHERE n / (n_a + n_b - n) >= {threshold}),
    r AS (SELECT {_LOC}, a, score, unit_id, target FROM s JOIN (SELECT {_LOC}, source AS b, unit_id, target, usage_count FROM m) USING ({_LOC}, b)
          QUALIFY row_number() OVER (PARTITION BY {_LOC}, a ORDER BY score DESC, usage_count DESC, unit_id) <= {limit}),
    f AS (SELECT query_id, unit_id, r.target, score, 'fuzzy' AS kind FROM {side} x JOIN r ON x.source_locale = r.source_locale AND x.target_locale = r.target_locale AND x.source = r.a)"""


_ITEMS = f"""q AS (SELECT item_id || ':' || source_locale AS query_id, text AS source, source_locale, 'xx' AS target_locale, NULL AS previous_source, NULL AS next_source, md5(lower(text)) AS source_hash,
      md5(lower(text) || '||') AS context_hash FROM benchmark, (SELECT DISTINCT lang AS source_locale FROM documents)), m AS ({v.MEMORY_SQL})"""


@query(f"WITH {_ITEMS}, {_fuzzy_sql('q', 0.6, 5)} SELECT * FROM f")
def match_fuzzy_trgm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory's lines that are similar to a benchmark item."""
    return matching.fuzzy(_items(spark, sf_dir), v.memory(v.translated(spark, sf_dir)), 0.6)


@query(f"""WITH {_ITEMS},
    mi AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_hash, context_hash, {_LOC} ORDER BY usage_count DESC, unit_id) = 1),
    me AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_hash, {_LOC} ORDER BY usage_count DESC, unit_id) <= 5),
    i AS (SELECT q.query_id, mi.unit_id, mi.target, CAST(1 AS DOUBLE) AS score, 'ice' AS kind FROM q JOIN mi USING (source_hash, context_hash, {_LOC})),
    e AS (SELECT q.query_id, me.unit_id, me.target, CAST(1 AS DOUBLE) AS score, 'exact' AS kind FROM q JOIN me USING (source_hash, {_LOC}) WHERE query_id NOT IN (SELECT query_id FROM i)),
    rest AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM i UNION ALL SELECT query_id FROM e)), {_fuzzy_sql('rest', 0.6, 5)},
    t AS (SELECT * FROM i UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f),
    c AS (SELECT t.query_id, t.unit_id, t.score, {_EQ(_NORM.format("q.source"), _NORM.format("m.source"))} AS source_equal, true AS tags_equal, true AS previous_equal, true AS next_equal, t.kind AS was FROM t JOIN q USING (query_id) JOIN m ON t.unit_id = m.unit_id)
    SELECT query_id, unit_id, score, CASE WHEN source_equal AND was = 'ice' THEN 'ice' WHEN source_equal THEN 'exact' ELSE 'fuzzy' END AS kind, source_equal, tags_equal, previous_equal, next_equal FROM c""")
def match_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers for all benchmark items in one join, classified."""
    folder = f"{scratch(spark)}/memory"  # a memory is stored once and read by each tier
    v.memory(v.translated(spark, sf_dir)).write.parquet(folder)
    q, m = _items(spark, sf_dir), spark.read.parquet(folder)
    return matching.classify(matching.match_tiers(q, m, 5, 0.6), q, m, require_context=False, limit=5)


@query("""WITH a AS (SELECT p_partkey AS unit_id, p_partkey AS ordinal, unnest(list_distinct(string_split(lower(p_name), ' '))) AS token FROM part),
    q AS (SELECT p_partkey AS query_id, lower(p_name || ' ' || p_type) AS text FROM part),
    b AS (SELECT text, unnest(list_distinct(string_split(text, ' '))) AS token FROM (SELECT DISTINCT text FROM q)),
    n AS (SELECT text, unit_id, count(*) AS shared, min(ordinal) AS ordinal FROM a JOIN b USING (token) GROUP BY text, unit_id),
    c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY text ORDER BY shared DESC, ordinal, unit_id) <= 1000)
    SELECT query_id, unit_id, shared, ordinal FROM q JOIN c USING (text)""")
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a sequence-ratio search for every part, as many of each as the operator defines; equal texts are searched once."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("source"))
    found = matching.token_candidates(rows.select(F.col("source").alias("query_id"), "source").distinct(), p.select(F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("source")))
    return rows.join(found.withColumnRenamed("query_id", "source"), "source").select("query_id", "unit_id", "shared", "ordinal")


@query()
def fuzzy_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part, the parts whose names are like its name and type, by sequence ratio.

    The type keeps names from being exact hits, so the search runs for every part; equal texts are searched once.
    """
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("source"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("source"))
    found = matching.fuzzy_find(rows.select(F.col("source").alias("query_id"), "source").distinct(), p, 0.6, 3)
    return rows.join(found.withColumnRenamed("query_id", "source"), "source").select("query_id", "unit_id", "score", "kind")


@query()
def pair_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before it."""
    c = lookup.with_neighbours(_chat(spark, sf_dir))
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    pairs = c.select("unit_id", F.col("text").alias("q_source"), F.lag("text").over(w).alias("u_source"), F.lit(None).cast("string").alias("q_previous"), F.lit(None).cast("string").alias("u_previous"), F.lit(None).cast("string").alias("q_next"), F.lit(None).cast("string").alias("u_next")).where("u_source IS NOT NULL")
    return matching.compare(pairs).select("unit_id", "score", "kind")


# --- loading a memory -----------------------------------------------------------------------


@query("""WITH o AS (SELECT *, CASE WHEN quality = 1 THEN 'approved' ELSE 'unknown' END AS xs FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id::VARCHAR AS unit_key, 'xx' AS target_locale, upper(lang) AS target, xs AS status, source AS origin, md5(lower(lang)) AS source_hash FROM o WHERE quality IS NOT NULL
    UNION ALL SELECT doc_id::VARCHAR, 'yy', reverse(lang), 'translated', source, md5(lower(lang)) FROM o""")
def load_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory rows of units with targets in two locales."""
    rows = memory.exploded(v.as_units(_multilingual(spark, sf_dir)))
    return rows.select("unit_key", "target_locale", "target", "status", F.col("extensions")["from"].alias("origin"), "source_hash")


@query(f"""SELECT unit_id FROM ({v.TRANSLATED_SQL}) QUALIFY row_number() OVER (PARTITION BY lower(source), target, source_locale, target_locale, lower(coalesce(previous_source, '')), lower(coalesce(next_source, '')) ORDER BY doc_id, ordinal) = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.translated(spark, sf_dir).withColumn("unit_key", F.col("unit_id"))
    return memory.first_of_key(t.withColumn("previous_source", F.coalesce("previous_source", F.lit(""))).withColumn("next_source", F.coalesce("next_source", F.lit("")))).select("unit_id")


_STAMP = "2026-01-01 00:00:00"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(memory of the lines of approved documents, rows of the lines of all labelled ones)."""
    t = v.translated(spark, sf_dir)

    def rows(df: DataFrame, uses: Column, mark: str) -> DataFrame:
        none = F.lit(None)
        return memory.as_rows(df, unit_key=F.col("unit_id"), usage_count=uses, extensions=F.create_map(F.lit(mark), F.col("unit_id")), updated_at=none, id=F.lit(""))

    old = rows(v.memory(t.where("status = 'approved'")), F.col("usage_count"), "old")
    old = old.withColumn("id", memory.row_id())
    new = rows(v.memory(t), F.lit(1), "new")
    return old, new


@query(f"""WITH a AS (SELECT * FROM ({v.TRANSLATED_SQL}) WHERE target IS NOT NULL),
    o AS (SELECT source_hash, context_hash, source_locale, target, count(*) AS n, arg_min(unit_id, {{'d': doc_id, 'o': ordinal}}) AS u FROM a WHERE status = 'approved' GROUP BY ALL),
    n AS (SELECT source_hash, context_hash, source_locale, target, arg_min(unit_id, {{'d': doc_id, 'o': ordinal}}) AS u FROM a GROUP BY ALL)
    SELECT n.u AS unit_key, source_hash, context_hash, CAST(CASE WHEN o.u IS NULL THEN 1 ELSE greatest(o.n, 1) + 1 END AS INTEGER) AS usage_count, o.u AS old_mark, n.u AS new_mark FROM n LEFT JOIN o USING (source_hash, context_hash, source_locale, target)""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    out = memory.upserted(old, new, F.lit(_STAMP).cast("timestamp"))
    return out.select("unit_key", "source_hash", "context_hash", "usage_count", F.try_element_at("extensions", F.lit("old")).alias("old_mark"), F.try_element_at("extensions", F.lit("new")).alias("new_mark"))


@query(f"""SELECT unit_id AS unit_key, source_hash, CASE WHEN status = 'new' AND n > 0 THEN 2 ELSE 1 END AS usage_count, CASE WHEN n > 0 THEN 'again' END AS mark FROM (
      SELECT *, CASE WHEN ordinal % 2 = 0 THEN 1 ELSE 0 END AS n FROM ({v.TRANSLATED_SQL}) WHERE target IS NULL)""")
def update_untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untranslated rows: those of even lines are loaded again, meet themselves by key and are counted up, the others stay."""
    t = v.translated(spark, sf_dir).where("target IS NULL")
    empty = F.create_map().cast("map<string,string>")
    rows = memory.as_rows(t, unit_key=F.col("unit_id"), usage_count=F.lit(1), extensions=empty).withColumn("id", memory.row_id())
    again = memory.as_rows(t.where("ordinal % 2 = 0"), unit_key=F.col("unit_id"), usage_count=F.lit(1), extensions=F.create_map(F.lit("mark"), F.lit("again")))
    out = memory.upserted(rows, again, F.lit(_STAMP).cast("timestamp"))
    return out.select("unit_key", "source_hash", "usage_count", F.try_element_at("extensions", F.lit("mark")).alias("mark"))


@query("""SELECT o_orderkey AS unit_id, l_linenumber AS position, 'new' AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'
    UNION ALL SELECT l_orderkey, l_linenumber, 'old' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def child_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the parents that were touched are replaced; all others stay."""
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("position"))
    touched = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("unit_id"))
    return memory.replaced_children(children.withColumn("side", F.lit("old")), children.withColumn("side", F.lit("new")), touched, ["unit_id"])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units: a target unless the status is F, a comment and a target in xx if it is O."""
    o = table(spark, sf_dir, "orders")
    open_ = F.col("o_orderstatus") == "O"
    note = F.when(open_, F.array(F.struct(F.col("o_orderpriority").alias("context")))).otherwise(F.array().cast("array<struct<context:string>>"))
    xx = F.create_map(F.lit("xx"), F.struct(F.col("o_orderpriority").alias("text")))
    return o.select(
        F.lit("orders").alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("unit_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("target"), F.col("o_orderstatus").alias("status"), note.alias("comments"),
        F.when(open_, xx).otherwise(F.create_map().cast("map<string,struct<text:string>>")).alias("targets"), F.create_map(F.lit("clerk"), F.col("o_orderpriority")).alias("extensions"),
    )


@query("""SELECT 'c' || o_custkey AS unit_id, CAST(min(o_orderkey) AS BIGINT) AS ordinal, arg_min(o_orderpriority, o_orderkey) AS source, arg_min(o_orderstatus, o_orderkey) AS status,
    arg_max(o_orderpriority, o_orderkey) AS clerk, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'F') AS target, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS note,
    arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS xx FROM orders GROUP BY o_custkey""")
def merge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units with the customer as id: the first of a customer, targets and extensions of the last."""
    out = targets.merge_by_id(_orders(spark, sf_dir))
    return out.select("unit_id", "ordinal", "source", "status", F.col("extensions")["clerk"].alias("clerk"), "target", F.get("comments", 0)["context"].alias("note"), F.try_element_at("targets", F.lit("xx"))["text"].alias("xx"))


@query("""SELECT 'c' || o_custkey AS unit_id, o_orderstatus AS target_locale, CAST(min(o_orderkey) AS BIGINT) AS ordinal, arg_min(o_orderpriority, o_orderkey) AS source, arg_max(o_orderpriority, o_orderkey) AS clerk
    FROM orders GROUP BY o_custkey, o_orderstatus""")
def merge_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each target locale merged by itself."""
    u = _orders(spark, sf_dir).withColumn("target_locale", F.col("status"))
    return targets.merge_by_id(u, ("doc_id", "target_locale", "unit_id")).select("unit_id", "target_locale", "ordinal", "source", F.col("extensions")["clerk"].alias("clerk"))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def extra_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied ids that nothing consumes."""
    return regen.extra_translations(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("lang = 'en'"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regen.missing_translations(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT coalesce(c_custkey, o_custkey)::VARCHAR AS unit_id, coalesce(c_mktsegment, p) AS source, p AS target FROM customer FULL JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def po_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue and its translation joined by id; unknown ids come in with their own source."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("ordinal"))
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("unit_id")).agg(F.min("o_orderpriority").alias("target"), F.min("o_orderkey").alias("ordinal"))
    return po.merged(c, {"xx": t.withColumn("source", F.col("target"))}).select("unit_id", "source", F.try_element_at("targets", F.lit("xx")).alias("target"))


@query("""SELECT p_partkey::VARCHAR AS unit_id, p_name AS source, s_name AS xx, CASE WHEN s_name IS NULL THEN NULL ELSE 'translated' END AS status,
    CASE WHEN p_partkey % 2 = 0 THEN c_name END AS yy FROM part LEFT JOIN supplier ON p_partkey = s_suppkey LEFT JOIN customer ON p_partkey = c_custkey""")
def json_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource and two files of translations, joined by key."""
    p = v.as_units(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("unit_id"), F.col("p_name").alias("source")))
    other = lambda name, key, text: table(spark, sf_dir, name).select(F.col(key).cast("string").alias("unit_id"), F.col(text).alias("source"))
    out = json_i18n.with_targets(p, {"xx": other("supplier", "s_suppkey", "s_name"), "yy": other("customer", "c_custkey", "c_name").where("unit_id % 2 = 0")})
    at = lambda loc: F.try_element_at("targets", F.lit(loc))
    return out.select("unit_id", "source", at("xx")["text"].alias("xx"), at("xx")["status"].alias("status"), at("yy")["text"].alias("yy"))


@query("SELECT doc_id, coalesce(CASE quality WHEN 1 THEN upper(source) END, source) AS cell FROM documents LEFT JOIN labels USING (doc_id)")
def regen_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they were, with the new target where there is one."""
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("cell"))
    new = records.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.upper("cell").alias("target"))
    return regen.merged(records, new, ["doc_id"], "cell")


# --- plurals, messages ----------------------------------------------------------------------

_N = "CAST(l_quantity AS BIGINT)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_N} = 1 THEN 'one' ELSE 'other' END AS en, CASE WHEN {_N} % 10 = 1 AND {_N} % 100 <> 11 THEN 'one' WHEN {_N} % 10 = 2 AND {_N} % 100 <> 12 THEN 'two' WHEN {_N} % 10 = 3 AND {_N} % 100 <> 13 THEN 'few' ELSE 'other' END AS en_ordinal FROM lineitem")
def plural_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pl.category_column("en", n, whole=True).alias("en"), pl.category_column("en", n, True, whole=True).alias("en_ordinal"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'one' WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS ru,
    CASE WHEN p_size = 0 THEN 'zero' WHEN p_size = 1 THEN 'one' WHEN p_size = 2 THEN 'two' WHEN p_size % 100 BETWEEN 3 AND 10 THEN 'few' WHEN p_size % 100 BETWEEN 11 AND 99 THEN 'many' ELSE 'other' END AS ar,
    CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 0 WHEN p_size % 10 BETWEEN 2 AND 4 AND (p_size % 100 < 10 OR p_size % 100 >= 20) THEN 1 ELSE 2 END AS gettext FROM part""")
def plural_ru_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = pl.gettext_rule("nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);")
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", pl.category_column("ru", n, whole=True).alias("ru"), pl.category_column("ar", n, whole=True).alias("ar"), rule.column(n).alias("gettext"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 'no parts' WHEN p_size = 1 THEN '1 part' ELSE p_size || ' parts' END || ' of ' || p_brand AS text FROM part")
def icu_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit("{n, plural, =0 {no parts} one {# part} other {# parts}} of {brand}")
    arguments = F.create_map(F.lit("n"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", msg.message_udf()(pattern, arguments, F.lit("en")).alias("text"))


# --- JSON and HTML --------------------------------------------------------------------------


_EVENT_JSON = """'{"event": {"type": "' || event_type || '", "n": 1}, "list": ["x"], "user": "u' || user_id || '", "props": ' || props || '}'"""


@query("SELECT event_id, unnest(['event.type', 'user']) AS key, unnest([event_type, 'u' || user_id]) AS value FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of JSON objects with dotted keys; numbers and lists are no texts."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_JSON).alias("json"))
    return json_i18n.leaves(e, "event_id", "json").select("event_id", "key", "value")


@query("SELECT event_id, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_i18n.at_path("props", ["k"]).cast("bigint").alias("k"))


@query()
def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translatable texts of all pages."""
    return html.units(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"SELECT normalized, count(*) AS n FROM (SELECT trim(regexp_replace(replace(lower(source), 'ß', 'ss'), '\\s+', ' ', 'g')) AS normalized FROM ({v.UNITS_SQL})) GROUP BY normalized")
def normalized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casefolded sources and how many units share each."""
    return v.units(spark, sf_dir).select(fx.casefolded("source").alias("normalized")).groupBy("normalized").agg(F.count("*").alias("n"))
