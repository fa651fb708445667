"""Queries that write the driver's tables as files, read them back, and compare with what was written.

Each writes into a folder of its own in the shared folder of the session, so that the
whole way through a sink and a source, or through a rewritten original, is checked by SQL.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions import inline
from segmenta.functions import sql as functions
from segmenta.operators import memory, targets
from segmenta.plans import views as v
from segmenta.plans.shared import scratch
from segmenta.plans.views import table
from segmenta.queries import query
from segmenta.sinks import files, regen
from segmenta.sources import detect, html, json_i18n, office, po, tabular, tmx, unit_json, xliff
from segmenta.sources.common import read_streams
from segmenta.streaming import ingest

PARTS = "(SELECT 'k' || p_partkey AS unit_id, p_partkey AS place, p_name AS source, upper(p_brand) AS fr, CASE WHEN p_size > 25 THEN lower(p_type) END AS de, p_brand || ' note' AS note, p_size AS n FROM part)"


def _text(locale: str) -> Column:
    return F.try_element_at("targets", F.lit(locale))["text"]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units: a target in fr each, one in de for the larger ones, a comment and two fields."""
    p = table(spark, sf_dir, "part")
    entry = lambda text: F.struct(text.alias("text"), F.lit("approved").alias("status"))
    both = F.map_concat(F.create_map(F.lit("fr"), entry(F.upper("p_brand"))), F.when(F.col("p_size") > 25, F.create_map(F.lit("de"), entry(F.lower("p_type")))).otherwise(F.create_map().cast("map<string,struct<text:string,status:string>>")))
    rows = p.select(
        F.lit("parts").alias("doc_id"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("k"), "p_partkey").alias("unit_id"), F.col("p_name").alias("source"), F.lit("en").alias("source_locale"),
        both.alias("targets"), F.array(F.lit("fr"), F.lit("de")).alias("target_locales"), F.lit("approved").alias("status"), F.array(F.struct(F.concat("p_brand", F.lit(" note")).alias("context"))).alias("comments"),
        F.struct(F.col("p_size").alias("usage_count")).alias("meta"), F.create_map(F.lit("domain"), F.col("p_type")).alias("extensions"),
    )
    return v.as_units(rows)


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the one target of fr."""
    return v.as_units(targets.select_target(parts(spark, sf_dir), "fr"))


# --- exchange formats -----------------------------------------------------------------------


@query(f"SELECT unit_id, place AS ordinal, source, 'en' AS source_locale, fr, de, 'approved' AS status, note, n AS uses FROM {PARTS}")
def tmx_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a TMX file, read by a splittable scan."""
    path = f"{scratch(spark)}/parts.tmx"
    files.write_tmx(parts(spark, sf_dir), path)
    return tmx.read(spark, path).select("unit_id", "ordinal", "source", "source_locale", _text("fr").alias("fr"), _text("de").alias("de"), "status", F.get("comments", 0)["context"].alias("note"), F.col("meta.usage_count").alias("uses"))


@query(f"SELECT unit_id, source, fr AS target, 'fr' AS target_locale, 'unknown' AS status, 0 AS notes FROM {PARTS}")
def tmx_text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read whole, texts of one target alone."""
    path = f"{scratch(spark)}/parts.tmx"
    files.write_tmx(parts(spark, sf_dir), path)
    return tmx.read(spark, path, target_locale="fr", mode="text", splittable=False).select("unit_id", "source", "target", "target_locale", "status", F.size("comments").alias("notes"))


@query("SELECT 'auto_' || (row_number() OVER (ORDER BY p_partkey) - 1) AS unit_id, p_partkey AS ordinal, p_name AS source FROM part")
def tmx_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without ids get their number in the file, over all splits of it."""
    path = f"{scratch(spark)}/parts.tmx"
    files.write_tmx(parts(spark, sf_dir).withColumn("unit_id", F.lit("")), path)
    return tmx.read(spark, path).select("unit_id", "ordinal", "source")


@query(f"SELECT unit_id, place AS ordinal, source, fr, de, note FROM {PARTS}")
def xliff_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an XLIFF 1.2 file with a file element for each target, merged by id again."""
    path = f"{scratch(spark)}/parts.xlf"
    files.write_xliff(parts(spark, sf_dir), path)
    return xliff.read(spark, path).select("unit_id", "ordinal", "source", _text("fr").alias("fr"), _text("de").alias("de"), F.get("comments", 0)["context"].alias("note"))


@query(f"SELECT unit_id || ':s' AS unit_id, source, fr AS target FROM {PARTS}")
def xliff2_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units of an XLIFF 2.1 file."""
    path = f"{scratch(spark)}/parts.xlf"

    def line(u: dict) -> str:
        return f'<unit id="{u["unit_id"]}"><segment id="s"><source>{inline.escape(u["source"])}</source><target>{inline.escape(u["target"])}</target></segment></unit>'

    files.publish(path, files.chained([b'<xliff version="2.1" srcLang="en" trgLang="fr"><file id="f">'], files.in_order(single(spark, sf_dir), line), [b"</file></xliff>"]))
    return xliff.read(spark, path).select("unit_id", "source", "target")


@query(f"SELECT unit_id, source, 'new ' || unit_id AS target FROM {PARTS}")
def xliff_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XLIFF file with new targets put in."""
    folder = scratch(spark)
    files.write_xliff(single(spark, sf_dir), f"{folder}/parts.xlf", target_locale="fr")
    return xliff.read(spark, _renewed(spark, f"{folder}/parts.xlf", regen.xliff_file())).select("unit_id", "source", "target")


@query(f"SELECT unit_id, source, 'new ' || unit_id AS fr, de FROM {PARTS}")
def tmx_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TMX file with new variants of one locale; the other stays."""
    folder = scratch(spark)
    files.write_tmx(parts(spark, sf_dir), f"{folder}/parts.tmx")
    return tmx.read(spark, _renewed(spark, f"{folder}/parts.tmx", regen.tmx_file("fr"))).select("unit_id", "source", _text("fr").alias("fr"), _text("de").alias("de"))


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _rewritten(spark: SparkSession, path: str, make) -> str:  # noqa: ANN001
    """The path of the file with the target "new <id>" for each of its units, by the function ``make``."""
    content = _content(spark, path)
    out = f"{path.rpartition('/')[0]}/new-{path.rpartition('/')[2]}"
    files.publish(out, [make(content, {u["unit_id"]: f"new {u['unit_id']}" for u in detect.parse_bytes(content, path)})])
    return out


def _news(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.concat(F.lit("new "), "unit_id").alias("target"))


def _renewed(spark: SparkSession, path: str, kind: object) -> str:
    """The same by executors, for files of any size."""
    out = f"{path.rpartition('/')[0]}/new-{path.rpartition('/')[2]}"
    units = xliff.read(spark, path) if path.endswith(".xlf") else tmx.read(spark, path) if path.endswith(".tmx") else html.read(spark, path) if path.endswith(".html") else json_i18n.read(spark, path) if path.endswith(".json") else detect.read(spark, path)
    regen.rewrite(spark, path, out, _news(units), kind)
    return out


# --- tables ---------------------------------------------------------------------------------


@query(f"SELECT unit_id, place AS ordinal, source, fr, de, 'approved' AS status, note FROM {PARTS}")
def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a CSV file with a column for each target."""
    path = f"{scratch(spark)}/parts.csv"
    files.write_csv(parts(spark, sf_dir), path)
    return tabular.read_csv(spark, path).select("unit_id", "ordinal", "source", _text("fr").alias("fr"), _text("de").alias("de"), "status", F.get("comments", 0)["context"].alias("note"))


@query(f"SELECT unit_id, source, fr, de, 'approved' AS status, note FROM {PARTS}")
def csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a folder of files that executors write, read by a splittable scan."""
    path = f"{scratch(spark)}/csv"
    files.write_csv_folder(parts(spark, sf_dir), path)
    return tabular.read_csv_lines(spark, path).select("unit_id", "source", _text("fr").alias("fr"), _text("de").alias("de"), "status", F.get("comments", 0)["context"].alias("note"))


@query(f"SELECT unit_id, source, 'new ' || unit_id AS target FROM {PARTS}")
def csv_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    files.write_csv(single(spark, sf_dir), f"{folder}/parts.csv")
    return tabular.read_csv(spark, _renewed(spark, f"{folder}/parts.csv", regen.csv_file("fr"))).select("unit_id", "source", F.coalesce("target", _text("fr")).alias("target"))


@query(f"SELECT unit_id, place AS ordinal, source, fr, de, 'approved' AS status, note FROM {PARTS}")
def xlsx_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/parts.xlsx"
    files.write_xlsx(parts(spark, sf_dir), path)
    return tabular.read_xlsx(spark, path).select("unit_id", "ordinal", "source", _text("fr").alias("fr"), _text("de").alias("de"), "status", F.get("comments", 0)["context"].alias("note"))


@query(f"SELECT unit_id, source, 'new ' || unit_id AS target FROM {PARTS}")
def xlsx_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    files.write_xlsx(single(spark, sf_dir), f"{folder}/parts.xlsx")
    regen.rewrite_xlsx(spark, f"{folder}/parts.xlsx", f"{folder}/new-parts.xlsx", _news(tabular.read_xlsx(spark, f"{folder}/parts.xlsx")), "fr")
    return tabular.read_xlsx(spark, f"{folder}/new-parts.xlsx").select("unit_id", "source", F.coalesce("target", _text("fr")).alias("target"))


# --- catalogues and trees -------------------------------------------------------------------


@query(f"SELECT unit_id, source, fr AS target, 'translated' AS status, note FROM {PARTS}")
def po_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries with a context each, so that equal names stay apart."""
    path = f"{scratch(spark)}/parts.po"
    files.write_po(_in_context(single(spark, sf_dir)), path, "fr")
    out = po.read(spark, path).select(F.substring_index("unit_id", "\x04", 1).alias("unit_id"), "source", "target", "status", F.get("comments", 0)["context"].alias("note"))
    return out


def _in_context(units: DataFrame) -> DataFrame:
    return units.withColumn("unit_id", F.concat("unit_id", F.lit("\x04"), "source"))


@query(f"SELECT unit_id, source, fr, CASE WHEN n > 25 THEN de END AS de FROM {PARTS}")
def po_target_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue and the files of two translations."""
    folder, u = scratch(spark), parts(spark, sf_dir)
    for loc in ("fr", "de"):
        files.write_po(_in_context(v.as_units(targets.select_target(u, loc))), f"{folder}/{loc}.po", loc)
    files.write_po(_in_context(u.withColumn("target", F.lit(None).cast("string"))), f"{folder}/source.po")
    out = po.read_targets(spark, f"{folder}/source.po", {loc: f"{folder}/{loc}.po" for loc in ("fr", "de")})
    return out.select(F.substring_index("unit_id", "\x04", 1).alias("unit_id"), "source", *[F.try_element_at("targets", F.lit(loc)).alias(loc) for loc in ("fr", "de")])


@query("SELECT p_partkey AS part, 'k' || p_partkey || '|n' || CASE i WHEN 0 THEN '' ELSE '[' || i || ']' END AS unit_id, i AS form, ['one', 'few', 'many'][i + 1] AS category, p_brand || i AS target FROM part, (SELECT unnest([0, 1, 2]) AS i)")
def po_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with three plural forms; their categories follow from the header."""
    path = f"{scratch(spark)}/parts.po"
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    key = F.concat(F.lit("k"), "p_partkey", F.lit("|n"))
    plural = F.struct(F.lit("things").alias("variant"), F.col("i").alias("count"), F.element_at(F.array(*map(F.lit, ("one", "few", "many"))), F.col("i") + 1).alias("category"))
    u = rows.select((F.col("p_partkey") * 3 + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, key).otherwise(F.concat(key, F.lit("["), "i", F.lit("]"))).alias("unit_id"), F.when(F.col("i") == 0, key).otherwise("things").alias("source"), F.concat("p_brand", "i").alias("target"), plural.alias("plural"))
    files.write_po(v.as_units(u), path, "ru")
    return po.read(spark, path).select(F.regexp_extract("unit_id", r"^k(\d+)", 1).cast("bigint").alias("part"), "unit_id", F.col("plural.count").alias("form"), F.col("plural.category").alias("category"), "target")


@query(f"SELECT unit_id, source, 'new ' || unit_id || chr(4) || source AS target FROM {PARTS}")
def po_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    files.write_po(_in_context(single(spark, sf_dir)), f"{folder}/parts.po", "fr")
    return po.read(spark, _renewed(spark, f"{folder}/parts.po", regen.po_file())).select(F.substring_index("unit_id", "\x04", 1).alias("unit_id"), "source", "target")


@query("SELECT p_brand || '.k' || p_partkey AS unit_id, p_name AS source, upper(p_type) AS fr, CASE WHEN p_size > 25 THEN lower(p_type) END AS de FROM part")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested resource file and two files of translations, joined by dotted key."""
    folder, p = scratch(spark), table(spark, sf_dir, "part")
    key, place = F.concat("p_brand", F.lit(".k"), "p_partkey"), F.row_number().over(_by("p_brand", "p_partkey"))
    for name, text, rows in (("en", F.col("p_name"), p), ("fr", F.upper("p_type"), p), ("de", F.lower("p_type"), p.where("p_size > 25"))):
        files.write_json_i18n(v.as_units(rows.select(key.alias("unit_id"), place.alias("ordinal"), text.alias("source"))), f"{folder}/{name}.json")
    out = json_i18n.read(spark, f"{folder}/en.json", target_paths={x: f"{folder}/{x}.json" for x in ("fr", "de")})
    return out.select("unit_id", "source", _text("fr").alias("fr"), _text("de").alias("de"))


def _by(*columns: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(*columns)


@query("SELECT 'k' || p_partkey AS unit_id, 'new k' || p_partkey AS source FROM part")
def json_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource file with its texts replaced in place."""
    folder = scratch(spark)
    files.write_json_i18n(parts(spark, sf_dir), f"{folder}/en.json", flat=True)
    return json_i18n.read(spark, _renewed(spark, f"{folder}/en.json", regen.json_file())).select("unit_id", "source")


@query(f"SELECT unit_id, place AS ordinal, source, fr, de, note, n AS uses FROM {PARTS}")
def own_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/parts.json"
    files.write_unit_json(parts(spark, sf_dir), path)
    return unit_json.read(spark, path).select("unit_id", "ordinal", "source", _text("fr").alias("fr"), _text("de").alias("de"), F.get("comments", 0)["context"].alias("note"), F.col("meta.usage_count").alias("uses"))


@query(f"SELECT unit_id, source, fr AS target, 'fr' AS target_locale FROM {PARTS}")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen fields as lines, written and read by executors."""
    path = f"{scratch(spark)}/lines"
    unit_json.write_lines(single(spark, sf_dir), path, ("unit_id", "source", "target", "target_locale"))
    return spark.read.schema("unit_id string, source string, target string, target_locale string").json(path)


@query(f"SELECT unit_id, source, fr FROM {PARTS}")
def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TMX to CSV to TMX, each file's format found by its name or content."""
    folder = scratch(spark)
    files.write_tmx(parts(spark, sf_dir), f"{folder}/a.tmx")
    files.convert(spark, f"{folder}/a.tmx", f"{folder}/b.csv")
    files.convert(spark, f"{folder}/b.csv", f"{folder}/c.tmx")
    return detect.read(spark, f"{folder}/c.tmx").select("unit_id", "source", _text("fr").alias("fr"))


# --- pages and packages ---------------------------------------------------------------------


@query("SELECT 'html:p:' || p_partkey AS unit_id, upper(p_brand) AS source FROM part")
def html_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/parts.html"
    files.write_html(single(spark, sf_dir), path, "fr")
    return html.read(spark, path).select("unit_id", "source")


@query("SELECT 'html:p:' || p_partkey AS unit_id, 'new html:p:' || p_partkey AS source FROM part")
def html_regen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    files.write_html(single(spark, sf_dir), f"{folder}/parts.html", "fr")
    return html.read(spark, _renewed(spark, f"{folder}/parts.html", regen.html_file())).select("unit_id", "source")


def package(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(texts: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{inline.escape(t)}</w:t></w:r></w:p>" for t in texts)
    return package({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def _pptx(texts: list[str]) -> bytes:
    space = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f"<a:p><a:r><a:t>{inline.escape(t)}</a:t></a:r></a:p>" for t in texts)
    return package({"ppt/presentation.xml": f'<p:presentation {space}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>', "ppt/slides/slide1.xml": f"<p:sld {space}>{body}</p:sld>"})


def _idml(texts: list[str]) -> bytes:
    body = "".join(f"<ParagraphStyleRange><CharacterStyleRange><Content>{inline.escape(t)}</Content></CharacterStyleRange></ParagraphStyleRange>" for t in texts)
    return package({"designmap.xml": "<D/>", "Stories/Story_u1.xml": f"<Story>{body}</Story>"})


def _suppliers(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names of suppliers; a package is one small file."""
    return [r[0] for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_name").collect()]


def _packaged(spark: SparkSession, sf_dir: str, suffix: str, make, put) -> tuple[str, str]:  # noqa: ANN001
    path = f"{scratch(spark)}/suppliers.{suffix}"
    files.publish(path, [make(_suppliers(spark, sf_dir))])
    return path, _rewritten(spark, path, put)


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("unit_id", "ordinal", "source").join(after.select("unit_id", F.col("source").alias("changed")), "unit_id", "full_outer")


_PLACE = "row_number() OVER (ORDER BY s_suppkey) - 1"


@query(f"SELECT 'word/document.xml:p' || p AS unit_id, p AS ordinal, s_name AS source, 'new word/document.xml:p' || p AS changed FROM (SELECT s_name, {_PLACE} AS p FROM supplier)")
def docx_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a DOCX, as they are and with new texts put in."""
    before, after = _packaged(spark, sf_dir, "docx", _docx, regen.regen_office)
    return _both(office.read_office(spark, before), office.read_office(spark, after))


@query(f"SELECT 'ppt/slides/slide1.xml:p' || p AS unit_id, p AS ordinal, s_name AS source, 'new ppt/slides/slide1.xml:p' || p AS changed FROM (SELECT s_name, {_PLACE} AS p FROM supplier)")
def pptx_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _packaged(spark, sf_dir, "pptx", _pptx, regen.regen_office)
    return _both(office.read_office(spark, before), office.read_office(spark, after))


@query(f"SELECT 'Story_u1:p' || p AS unit_id, p AS ordinal, s_name AS source, 'new Story_u1:p' || p AS changed FROM (SELECT s_name, {_PLACE} AS p FROM supplier)")
def idml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _packaged(spark, sf_dir, "idml", _idml, regen.regen_idml)
    return _both(office.read_idml(spark, before), office.read_idml(spark, after))


@query("SELECT 'csv' AS kind UNION ALL SELECT 'po' UNION ALL SELECT 'tmx' UNION ALL SELECT 'xlsx' UNION ALL SELECT 'json' UNION ALL SELECT 'xliff'")
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by content alone: the files have no suffix."""
    folder, u = scratch(spark), parts(spark, sf_dir)
    for suffix in ("csv", "po", "tmx", "xlsx", "json", "xliff"):
        files.write(u, f"{folder}/one.{suffix}")
        files.publish(f"{folder}/plain-{suffix}", files.content(spark, f"{folder}/one.{suffix}"))
    return read_streams(spark, f"{folder}/plain-*", lambda f, _: [{"unit_id": detect.detect_file(f)}]).select(F.col("unit_id").alias("kind"))


# --- the memory -----------------------------------------------------------------------------


def _memory(spark: SparkSession, sf_dir: str) -> memory.TranslationMemory:
    tm = memory.TranslationMemory(spark, f"{scratch(spark)}/memory")
    tm.setup()
    tm.load(parts(spark, sf_dir), now=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return tm


#: Of rows with equal source and target (and no neighbours) the first by place is loaded.
_LOADED = f"(SELECT unit_id, place, source, loc, target, note, n FROM (SELECT *, 'fr' AS loc, fr AS target FROM {PARTS} UNION ALL SELECT *, 'de', de FROM {PARTS} WHERE de IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lower(source), loc, target ORDER BY place) = 1)"


@query(f"SELECT unit_id, source, target, 'fr' AS target_locale, note, n AS uses, row_number() OVER (ORDER BY unit_id) - 1 AS ordinal FROM {_LOADED} WHERE loc = 'fr'")
def memory_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts loaded into a memory and read back as units of one pair of locales."""
    return _memory(spark, sf_dir).units("en", "fr").select("unit_id", "source", "target", "target_locale", F.get("comments", 0)["context"].alias("note"), F.col("meta.usage_count").alias("uses"), "ordinal")


@query(f"SELECT unit_id AS unit_key, min(source) AS source, min(target) FILTER (loc = 'fr') AS fr, min(target) FILTER (loc = 'de') AS de FROM {_LOADED} GROUP BY unit_id")
def memory_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same memory with all target locales side by side."""
    return _memory(spark, sf_dir).to_multilingual_document("en").select("unit_key", "source", _text("fr").alias("fr"), _text("de").alias("de"))


@query(f"SELECT loc AS target_locale, count(*) AS n, CAST(sum(n + 1) AS BIGINT) AS uses FROM {_LOADED} GROUP BY loc")
def memory_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded again, rows meet themselves: none is doubled, each is used once more."""
    tm = _memory(spark, sf_dir)
    tm.load(parts(spark, sf_dir))
    return tm.rows().groupBy("target_locale").agg(F.count("*").alias("n"), F.sum("usage_count").alias("uses"))


@query(f"SELECT source AS query_id, 1.0::DOUBLE AS score, CASE WHEN length(source) % 2 = 0 THEN 'exact' ELSE 'ice' END AS kind, length(source) % 2 = 1 AS tags_equal FROM (SELECT DISTINCT source FROM {PARTS})")
def memory_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name as a query, half of them with a tag, which the memory's rows lack: those are no in-context matches."""
    p = parts(spark, sf_dir).select("source").distinct()
    tag = F.when(F.length("source") % 2 == 0, F.array(F.struct(F.lit("bold.open").alias("type"), F.lit("p1").alias("pair_id"))))
    q = p.select(F.col("source").alias("query_id"), "source", F.lit("en").alias("source_locale"), F.lit("fr").alias("target_locale"), F.lit("").alias("previous_source"), F.lit("").alias("next_source"), tag.alias("signature"))
    return _memory(spark, sf_dir).match(q, limit=1, threshold=0.99).select("query_id", "score", "kind", "tags_equal")


@query(f"SELECT lower(source) AS source, 1.0::DOUBLE AS score, 'ice' AS kind FROM (SELECT DISTINCT source FROM {PARTS})")
def memory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name as a query in another case: the best match is in context."""
    p = parts(spark, sf_dir).select(F.lower("source").alias("source")).distinct()
    q = p.select(F.col("source").alias("query_id"), "source", F.lit("en").alias("source_locale"), F.lit("fr").alias("target_locale"), F.lit("").alias("previous_source"), F.lit("").alias("next_source"))
    return _memory(spark, sf_dir).match(q, limit=1, threshold=0.99).select(F.col("query_id").alias("source"), "score", "kind")


@query(f"SELECT unit_id AS unit_key, source, target, loc AS target_locale FROM {_LOADED} WHERE loc = 'fr'")
def memory_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of units streamed into a memory."""
    folder = scratch(spark)
    single(spark, sf_dir).repartition(1).write.json(f"{folder}/in")
    tm = memory.TranslationMemory(spark, f"{folder}/memory")
    tm.setup()
    ingest.stream_into(ingest.unit_lines(spark, f"{folder}/in"), tm, f"{folder}/check").awaitTermination()
    return tm.rows().select("unit_key", "source", "target", "target_locale")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by window in a stream of files; all windows together."""
    folder = scratch(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_folder_of(spark, sf_dir, "events", folder))
    out = ingest.windowed_counts(stream).select("event_type", "window.start", "n")
    done = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    done.awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))
    return last.groupBy("event_type").agg(F.sum("n").alias("n"))


def _folder_of(spark: SparkSession, sf_dir: str, name: str, folder: str) -> str:
    """A stream needs a folder, and a table may be one file."""
    table(spark, sf_dir, name).repartition(1).write.parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


# --- functions ------------------------------------------------------------------------------


@query("""SELECT p_partkey, lower(p_name) AS normalized, md5(lower(p_name)) AS source_hash, lower(left(p_name, 2)) AS base, md5(lower(p_name) || '|' || lower(p_brand) || '|') AS context_hash,
    CASE WHEN p_size = 1 THEN 'one' ELSE 'other' END AS category, CASE WHEN p_size = 1 THEN 0 ELSE 1 END AS plural_index, CASE WHEN p_size > 25 THEN 'approved' ELSE 'unknown' END AS status,
    len(list_distinct(string_split(lower(p_name), ' '))) AS words, 1.0::DOUBLE AS similarity, 'size ' || p_size AS message FROM part""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's functions as registered for SQL."""
    functions.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("_parts_for_functions")
    return spark.sql("""
        SELECT p_partkey, normalize_text(p_name) AS normalized, source_hash(p_name) AS source_hash, base_language(left(p_name, 2) || '_XX') AS base, context_hash(p_name, p_brand, NULL) AS context_hash,
               plural_category('en', CAST(p_size AS STRING)) AS category, gettext_index('nplurals=2; plural=(n != 1);', p_size) AS plural_index,
               tmx_status(CASE WHEN p_size > 25 THEN ' Final' END) AS status, CAST(size(token_set(p_name)) AS BIGINT) AS words, trgm_similarity(p_name, upper(p_name)) AS similarity,
               format_message('size {n}', map('n', CAST(p_size AS STRING)), 'en') AS message
        FROM _parts_for_functions""")


@query("SELECT p_partkey, 'a.b' AS unit_id, p_name AS source FROM part UNION ALL SELECT p_partkey, 'k' || p_partkey, p_brand FROM part")
def sql_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and PO contents of each row through table functions."""
    functions.register(spark)
    p = table(spark, sf_dir, "part")
    po_text = F.concat(F.lit('msgid "k'), "p_partkey", F.lit('"\nmsgstr "'), "p_brand", F.lit('"\n'))
    p.select("p_partkey", F.to_json(F.struct(F.struct(F.col("p_name").alias("b")).alias("a"))).alias("json"), po_text.alias("po")).createOrReplaceTempView("_parts_as_contents")
    return spark.sql("""SELECT p_partkey, u.unit_id, u.source FROM _parts_as_contents, LATERAL json_units(json) u
        UNION ALL SELECT p_partkey, u.unit_id, u.target FROM _parts_as_contents, LATERAL po_units(po) u""")
