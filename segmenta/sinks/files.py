"""New files from units.

A format renders a record for each unit, in executors (``rendered``), which write the
records in order as parts (``stored``); one file is those parts between a head and a tail,
copied piece by piece and published whole (``write``).  No rows go through the driver.
"""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.functions.inline import escape, render
from segmenta.functions.plural import gettext_categories, gettext_header
from segmenta.plans.shared import scratch
from segmenta.schema import UNIT_COLUMNS
from segmenta.sources.json_i18n import nest
from segmenta.sources.po import quote


def publish(path: str, chunks: Iterable[bytes]) -> int:
    """Write a file beside its place, make it durable and put it there; returns its size.

    Paths with a scheme other than file go through Hadoop's file systems.
    """
    path = path.removeprefix("file://")
    if "://" in path:
        return _publish_remote(path, chunks)
    folder = os.path.dirname(os.path.abspath(path))
    fd, name = tempfile.mkstemp(dir=folder, prefix=".part-")
    size = 0
    try:
        with os.fdopen(fd, "wb") as f:
            for chunk in chunks:
                size += f.write(chunk)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise
    at = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)
    return size


def _publish_remote(path: str, chunks: Iterable[bytes]) -> int:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a session")
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs, size = target.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    with tempfile.NamedTemporaryFile() as f:
        for chunk in chunks:
            size += f.write(chunk)
        f.flush()
        try:
            fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{f.name}"), part)
            fs.delete(target, False)
            if not fs.rename(part, target):
                raise OSError(f"could not put {path} in its place")
        except BaseException:
            fs.delete(part, False)
            raise
    return size


_PIECE = 1 << 20


def content(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The bytes of a file piece by piece; one of another file system is copied to the local disk first."""
    path = path.removeprefix("file://")
    with tempfile.NamedTemporaryFile() as copy:
        name = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        if "://" in path:
            at, name = spark._jvm.org.apache.hadoop.fs.Path(path), copy.name
            at.getFileSystem(spark._jsc.hadoopConfiguration()).copyToLocalFile(False, at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{name}"), True)
        with open(name, "rb") as f:
            while piece := f.read(_PIECE):
                yield piece


def stored(rows: DataFrame, separator: str = "\n", skip: int = 0, cut: int = 0) -> Iterator[bytes]:
    """The values of sorted rows, each with a separator after it, less the first and last bytes.

    Executors write them as text into the folder that all share, from where they are copied piece by piece.
    """
    spark = rows.sparkSession
    folder, jvm = scratch(spark), spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/parts")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.select("value").write.options(lineSep=separator, compression="none").text(f"{folder}/parts")
    held = b""
    try:
        for name in sorted(str(x.getPath()) for x in fs.listStatus(at) if x.getPath().getName().startswith("part-")):
            for piece in content(spark, name):
                start = min(skip, len(piece))
                skip -= start
                held += piece[start:]
                end = len(held) - cut
                if end > 0:
                    yield held[:end]
                    held = held[end:]
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def documents(units: DataFrame) -> Iterator[dict]:
    """Units as dicts in order, fetched by partition."""
    ordered = units.orderBy("doc_id", "ordinal").select(F.to_json(F.struct(*[c for c in UNIT_COLUMNS if c in units.columns])).alias("j"))
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        yield dict.fromkeys(UNIT_COLUMNS) | json.loads(row.j)


# --- records --------------------------------------------------------------------------------


def _side(u: dict, side: str, syntax: str) -> str:
    tags = u.get("tags") or {}
    return render(u.get(side) or "", tags.get(f"{side}_parts"), tags.get(f"{side}_ties"), syntax, "placeholder")


def _variants(u: dict) -> list[tuple[str, str]]:
    """(locale, text) of each target with a text."""
    out = [(loc, t["text"]) for loc, t in (u.get("targets") or {}).items() if t.get("text") is not None]
    if u.get("target") is not None and not out:
        out = [(u.get("target_locale") or "und", u["target"])]
    return out


def tmx_record(u: dict, source_locale: str = "en") -> str:
    src = u.get("source_locale") or source_locale
    lines = [f'    <tu tuid="{escape(u["unit_id"] or "", True)}"' + (f' usagecount="{u["meta"]["usage_count"]}"' if (u.get("meta") or {}).get("usage_count") is not None else "") + ">"]
    if u.get("status") and u["status"] != "unknown":
        lines.append(f'      <prop type="status">{u["status"]}</prop>')
    for k, v in (u.get("extensions") or {}).items():
        lines.append(f'      <prop type="{escape(k.removeprefix("property."), True)}">{escape(v or "")}</prop>')
    lines += [f"      <note>{escape(c['context'])}</note>" for c in u.get("comments") or [] if c.get("context")]
    lines.append(f'      <tuv xml:lang="{escape(src, True)}"><seg>{_side(u, "source", "tmx")}</seg></tuv>')
    for loc, text in _variants(u):
        tags = ((u.get("targets") or {}).get(loc) or {}).get("tags") or {}
        body = render(text, tags.get("parts"), tags.get("ties"), "tmx", "placeholder") if u.get("targets") else _side(u, "target", "tmx")
        lines.append(f'      <tuv xml:lang="{escape(loc, True)}"><seg>{body}</seg></tuv>')
    return "\n".join([*lines, "    </tu>"])


_STATES = {"approved": "final", "translated": "translated", "reviewed": "needs-review-adaptation", "new": "new", "draft": "needs-review-translation"}


def xliff_record(u: dict, locale: str | None = None) -> str:
    text = (u.get("targets") or {}).get(locale, {}).get("text") if locale and u.get("targets") else u.get("target")
    lines = [f'      <trans-unit id="{escape(u["unit_id"] or "", True)}">', f"        <source>{_side(u, 'source', 'xliff12')}</source>"]
    if text is not None:
        state = f' state="{_STATES[u["status"]]}"' if u.get("status") in _STATES else ""
        body = escape(text) if u.get("targets") else _side(u, "target", "xliff12")
        lines.append(f"        <target{state}>{body}</target>")
    lines += [f"        <note>{escape(c['context'])}</note>" for c in u.get("comments") or [] if c.get("context")]
    return "\n".join([*lines, "      </trans-unit>"])


def rendered(units: DataFrame, make: Callable[[dict], str]) -> DataFrame:
    """(doc_id, ordinal, value): each unit rendered by itself, in executors."""
    rows = units.select("doc_id", "ordinal", _as_json(units).alias("j"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "ordinal": f.ordinal, "value": [make(dict.fromkeys(UNIT_COLUMNS) | json.loads(j)) for j in f.j]})

    return rows.mapInPandas(run, "doc_id string, ordinal bigint, value string")


def _as_json(units: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in (*UNIT_COLUMNS, "_begins") if c in units.columns]))


def records(units: DataFrame, kind: str, **options: object) -> DataFrame:
    """(doc_id, ordinal, value): each unit as a record of its own; kind is tmx or xliff."""
    make = {"tmx": tmx_record, "xliff": xliff_record}[kind]
    return rendered(units, lambda u: make(u, **options))


def in_order(units: DataFrame, make: Callable[[dict], str]) -> Iterator[bytes]:
    """Lines of the units' records in order."""
    return stored(rendered(units.orderBy("doc_id", "ordinal"), make))


def write_tmx(units: DataFrame, path: str, source_locale: str = "en") -> int:
    """One TMX file."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n  <header creationtool="segmenta" creationtoolversion="1" datatype="plaintext" segtype="sentence" adminlang="en" o-tmf="segmenta" srclang="{escape(source_locale, True)}"/>\n  <body>\n'
    return publish(path, chained([head.encode()], in_order(units, lambda u: tmx_record(u, source_locale)), [b"  </body>\n</tmx>\n"]))


def chained(*parts: Iterable[bytes]) -> Iterator[bytes]:
    for p in parts:
        yield from p


def write_xliff(units: DataFrame, path: str, source_locale: str = "en", target_locale: str | None = None) -> int:
    """One XLIFF 1.2 file: a file element for each run of units of one resource, or for each target locale."""
    locales = [r[0] for r in units.select(F.explode(F.map_keys("targets")).alias("k")).distinct().orderBy("k").collect()] if "targets" in units.columns else []
    resource = F.coalesce(F.when(F.col("extensions")["resource"] != "", F.col("extensions")["resource"]), F.lit("document")) if "extensions" in units.columns else F.lit("document")
    names = units.select(resource.alias("r")).distinct().limit(2).collect()
    begins = units.select("doc_id", "ordinal", resource.alias("_resource"))
    if len(names) > 1:  # where the next file element begins: one task goes over the places and names alone
        place = Window.orderBy("doc_id", "ordinal")
        begins = begins.withColumn("_last", F.lag("_resource").over(place)).where("_last IS NOT NULL AND _last <> _resource").select("doc_id", "ordinal", F.col("_resource").alias("_begins"))
        marked = units.join(begins.distinct(), ["doc_id", "ordinal"], "left")
        first = units.orderBy("doc_id", "ordinal").select(resource.alias("r")).first()[0]
    else:
        marked, first = units.withColumn("_begins", F.lit(None).cast("string")), names[0][0] if names else None

    def opening(name: str, trg: str | None) -> str:
        return f'  <file original="{escape(name, True)}" datatype="plaintext" source-language="{escape(source_locale, True)}"' + (f' target-language="{escape(trg, True)}"' if trg else "") + ">\n    <body>\n"

    closing = "    </body>\n  </file>\n"

    def lines() -> Iterator[bytes]:
        yield b'<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">\n'
        for locale in (locales or [None]) if first is not None else []:
            trg = locale or target_locale
            yield opening(first, trg).encode()
            yield from in_order(marked, lambda u, locale=locale, trg=trg: (closing + opening(u["_begins"], trg) if u.get("_begins") else "") + xliff_record(u, locale))
            yield closing.encode()
        if first is None:
            yield f'  <file original="document" datatype="plaintext" source-language="{escape(source_locale, True)}">\n    <body/>\n  </file>\n'.encode()
        yield b"</xliff>\n"

    return publish(path, lines())


# --- tables ---------------------------------------------------------------------------------


def table_rows(units: Iterable[dict], target_locales: list[str]) -> Iterator[list[str]]:
    """Header and records: id, source, a column for each target, status (blank if unknown), comments."""
    yield ["id", "source", *(target_locales or ["target"]), "status", "comments"]
    for u in units:
        yield _table_row(u, target_locales)


def _table_row(u: dict, target_locales: list[str]) -> list[str]:
    own = u.get("targets") or {}
    cells = [(own.get(loc) or {}).get("text") or (u.get("target") if not own and loc == u.get("target_locale") else "") or "" for loc in target_locales] if target_locales else [u.get("target") or ""]
    known = next((t["status"] for t in own.values() if t.get("status") not in (None, "unknown")), u.get("status"))
    return [u.get("unit_id") or "", u.get("source") or "", *cells, "" if known in (None, "unknown") else known, "; ".join(c["context"] for c in u.get("comments") or [] if c.get("context"))]


def _locales(units: DataFrame) -> list[str]:
    keys = units.select(F.explode(F.map_keys("targets")).alias("k"))
    single = units.select(F.col("target_locale").alias("k")).where("k IS NOT NULL")
    return [r[0] for r in keys.unionByName(single).distinct().orderBy("k").collect()]


def csv_table(units: DataFrame, target_locales: list[str]) -> DataFrame:
    """The records of ``table_rows`` as columns, made by expressions: doc_id, ordinal, id, source, targets, status, comments."""
    own = F.size("targets") > 0
    text = lambda loc: F.coalesce(F.when(own, F.try_element_at("targets", F.lit(loc))["text"]), F.when(~own & (F.col("target_locale") == loc), F.col("target")), F.lit(""))
    cells = [text(loc).alias(f"target_{loc}") for loc in target_locales] or [F.coalesce("target", F.lit("")).alias("target")]
    first = F.try_element_at(F.filter(F.transform(F.map_values("targets"), lambda t: t["status"]), lambda s: s.isNotNull() & (s != "unknown")), F.lit(1))
    known = F.coalesce(F.when(own, first), "status", F.lit("unknown"))
    notes = F.array_join(F.filter(F.transform("comments", lambda c: c["context"]), lambda c: c != ""), "; ")
    return units.select("doc_id", "ordinal", F.coalesce("unit_id", F.lit("")).alias("id"), F.coalesce("source", F.lit("")).alias("source"), *cells, F.when(known == "unknown", "").otherwise(known).alias("status"), F.coalesce(notes, F.lit("")).alias("comments"))


def write_csv(units: DataFrame, path: str) -> int:
    """One CSV file with all records in order; ``write_csv_folder`` writes many at once."""
    locales = _locales(units)
    return publish(path, chained([f"{_csv_line(next(table_rows([], locales)))}\n".encode()], in_order(units, lambda u: _csv_line(_table_row(u, locales)))))


def _csv_line(row: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(row)
    return out.getvalue()


def write_csv_folder(units: DataFrame, path: str, target_locales: list[str] | None = None) -> None:
    """Records as a folder of CSV files, each with a header, in order over the names of the files; executors write them."""
    locales = _locales(units) if target_locales is None else target_locales
    rows = csv_table(units, locales).orderBy("doc_id", "ordinal").drop("doc_id", "ordinal").withColumnsRenamed({f"target_{loc}": loc for loc in locales})
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", lineSep="\n").csv(path)


def _xlsx_row(row: list[str]) -> str:
    """A row of inline strings on one line, with NUL for its number."""
    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    text = lambda v: escape(v.replace("\0", "\ufffd")).replace("\r", "&#13;").replace("\n", "&#10;")
    return '<row r="\0">' + "".join(f'<c r="{name(i)}\0" t="inlineStr"><is><t xml:space="preserve">{text(v)}</t></is></c>' for i, v in enumerate(row)) + "</row>"


def lines_of(pieces: Iterable[bytes]) -> Iterator[bytes]:
    left = b""
    for piece in pieces:
        *whole, left = (left + piece).split(b"\n")
        yield from whole
    if left:
        yield left


def _write_book(out: IO[bytes], rows: Iterable[bytes]) -> None:
    """A workbook of one sheet with the rows, streamed."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Units" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for n, row in enumerate(rows, 1):
                f.write(row.replace(b"\0", b"%d" % n))
            f.write(b"</sheetData></worksheet>")


def xlsx_bytes(rows: Iterable[list[str]]) -> bytes:
    """A workbook of one sheet with inline strings."""
    out = io.BytesIO()
    _write_book(out, (_xlsx_row(r).encode() for r in rows))
    return out.getvalue()


def write_xlsx(units: DataFrame, path: str) -> int:
    locales = _locales(units)
    head = _xlsx_row(next(table_rows([], locales))).encode()
    with tempfile.TemporaryFile() as f:
        _write_book(f, chained([head], lines_of(in_order(units, lambda u: _xlsx_row(_table_row(u, locales))))))
        f.seek(0)
        return publish(path, iter(lambda: f.read(_PIECE), b""))


# --- catalogues and trees -------------------------------------------------------------------


def _po_head(locale: str | None) -> str:
    head = ["Content-Type: text/plain; charset=UTF-8\n"] + ([f"Language: {locale}\n", f"Plural-Forms: {gettext_header(locale)}\n"] if locale else [])
    return "\n".join(['msgid ""', 'msgstr ""', *[quote(x) for x in head], ""])


def _po_entry(base: str, members: list[dict], order: list[str]) -> str:
    """One entry; ``members`` are the forms of a plural."""
    out: list[str] = []
    first = members[0]
    ext = first.get("extensions") or {}
    for c in first.get("comments") or []:
        out.append(f"{'#.' if c.get('context_key') == 'extracted' else '#'} {c.get('context') or ''}")
    if ext.get("references"):
        out.append(f"#: {ext['references']}")
    flags = (["fuzzy"] if first.get("status") == "draft" else []) + [f for f in (ext.get("flags") or "").split(",") if f]
    if flags:
        out.append(f"#, {', '.join(flags)}")
    ctx, _, msgid = base.rpartition("\x04")
    if ctx:
        out.append(f"msgctxt {quote(ctx)}")
    out.append(f"msgid {quote(first['source'] or msgid)}")
    if first.get("plural"):
        out.append(f"msgid_plural {quote(first['plural'].get('variant') or first['source'] or '')}")
        for n, u in enumerate(members):
            p = u.get("plural") or {}
            stored_ = (u.get("extensions") or {}).get("plural_index")
            index = int(stored_) if stored_ else order.index(p["category"]) if p.get("category") in order else n
            out.append(f"msgstr[{index}] {quote(u.get('target') or '')}")
    else:
        out.append(f"msgstr {quote(first.get('target') or '')}")
    return "\n".join([*out, ""])


def po_text(units: Iterable[dict], locale: str | None = None) -> str:
    """A catalogue: header, then entries; forms of a plural are gathered by their ids."""
    order = gettext_categories(locale) if locale else []
    groups: dict[str, list[dict]] = {}
    for u in units:
        key = u["unit_id"] or ""
        base = key.rpartition("[")[0] if u.get("plural") and key.endswith("]") else key
        groups.setdefault(base, []).append(u)
    return "\n".join([_po_head(locale), *[_po_entry(base, members, order) for base, members in groups.items()]])


def write_po(units: DataFrame, path: str, locale: str | None = None) -> int:
    """The same from a frame: entries gathered by a shuffle, rendered and written by executors."""
    order = gettext_categories(locale) if locale else []
    key = F.coalesce("unit_id", F.lit(""))
    base = F.when(F.col("plural").isNotNull() & key.endswith("]"), F.regexp_extract(key, r"(?s)^(.*)\[", 1)).otherwise(key) if "plural" in units.columns else key
    rows = units.select(base.alias("base"), F.struct("doc_id", "ordinal", _as_json(units).alias("j")).alias("u"), (F.col("plural").isNotNull() if "plural" in units.columns else F.lit(False)).alias("plural"))
    first = rows.groupBy("base").agg(F.min("u").alias("u"), F.min_by("plural", "u").alias("plural"))
    # only a plural has use for more than the first of equal ids
    single = first.where("NOT plural").select("base", F.array("u").alias("members"))
    several = rows.drop("plural").join(first.where("plural").select("base"), "base").groupBy("base").agg(F.array_sort(F.collect_list("u")).alias("members"))
    made = single.unionByName(several) if "plural" in units.columns else single

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"value": [_po_entry(b, [dict.fromkeys(UNIT_COLUMNS) | json.loads(j) for j in js], order) for b, js in zip(f.base, f.js, strict=True)]})

    entries = made.select("base", F.transform("members", lambda m: m["j"]).alias("js"), F.element_at("members", 1).alias("m")).orderBy("m.doc_id", "m.ordinal").select("base", "js").mapInPandas(run, "value string")
    return publish(path, chained([f"{_po_head(locale)}\n".encode()], stored(entries)))


def json_tree(units: Iterable[dict], locale: str | None = None, flat: bool = False) -> dict:
    """Texts by key; the target where there is one, else the source."""
    out = []
    for u in units:
        t = (u.get("targets") or {}).get(locale, {}).get("text") if locale else u.get("target")
        stored = (u.get("extensions") or {}).get("json_path")
        path = [u["unit_id"]] if flat else json.loads(stored) if stored else (u["unit_id"] or "").split(".")
        out.append((path, t if t is not None else u.get("source") or ""))
    return nest(out)


def _json_leaf(path: list[str], opens: int, closes: int, text: str, last: bool) -> str:
    """The lines of a text: the objects from level ``opens`` begin with it, those down to ``closes`` end after it."""
    name = lambda k: "  " * k + json.dumps(path[k - 1], ensure_ascii=False) + ": "
    lines = [f"{name(k)}{{" for k in range(opens, len(path))] + [name(len(path)) + json.dumps(text, ensure_ascii=False)]
    return "\n".join([*lines, *("  " * k + "}" for k in range(len(path) - 1, closes - 1, -1))]) + ("" if last else ",")


def write_json_i18n(units: DataFrame, path: str, locale: str | None = None, flat: bool = False) -> int:
    """One resource file, the tree of ``json_tree`` with two blanks a level.

    Executors find which texts remain, in what order, and which objects begin and end with each, level by level, so no tree is built.
    """
    spark, folder = units.sparkSession, scratch(units.sparkSession)
    has = lambda c, kind: F.col(c) if c in units.columns else F.lit(None).cast(kind)
    target = (F.try_element_at("targets", F.lit(locale))["text"] if "targets" in units.columns else F.lit(None).cast("string")) if locale else has("target", "string")
    kept = F.try_element_at(has("extensions", "map<string,string>"), F.lit("json_path"))
    at = F.array(F.coalesce("unit_id", F.lit("null"))) if flat else F.when(kept != "", F.from_json(kept, "array<string>")).otherwise(F.split(F.coalesce("unit_id", F.lit("")), r"\."))
    # numbers in the order of units, the same whenever they are read again
    units.orderBy("doc_id", "ordinal").select(at.alias("path"), F.coalesce(target, "source", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("n")).write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    depth, least = texts.agg(F.max(F.size("path")), F.min(F.size("path"))).first()
    if depth is None:
        return publish(path, [b"{}"])
    if least < 1:
        raise ValueError("a text has an empty path")
    # a later text at or above a place ends what is there, as does a later object at the place of a text; a member keeps the place at which it came in
    rows = texts.withColumns({"ended": F.lit(-1).cast("bigint"), "over": F.lit(False), "place": F.array().cast("array<bigint>")})
    node = lambda k: F.when(F.size("path") >= k, F.to_json(F.slice("path", 1, k)))
    for k in range(1, depth + 1):
        rows = rows.withColumn("node", node(k))
        seen = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.when(F.col("n") > F.col("ended"), F.col("n"))).alias("came"), F.max(F.when(F.size("path") == k, F.col("n"))).alias("leaf"), F.max(F.when(F.size("path") > k, F.col("n"))).alias("below"))
        own = F.size("path") >= k
        gone = (F.col("n") < F.col("leaf")) | ((F.size("path") == k) & (F.col("n") < F.col("below"))) | (F.col("n") < F.col("ended"))
        rows = rows.join(seen, "node", "left").select("path", "text", "n", F.when(own, F.greatest("ended", "leaf")).otherwise(F.col("ended")).alias("ended"), (F.col("over") | F.coalesce(own & gone, F.lit(False))).alias("over"), F.when(own, F.concat("place", F.array("came"))).otherwise(F.col("place")).alias("place"))
    rows.where("NOT over").select("path", "text", "place").write.parquet(f"{folder}/kept")
    rows = spark.read.parquet(f"{folder}/kept")
    end = rows.agg(F.max("place")).first()[0]
    rows = rows.withColumns({"opens": F.size("path"), "closes": F.size("path"), "last": F.col("place") == F.array(*[F.lit(x).cast("bigint") for x in end])})
    for k in range(depth - 1, 0, -1):
        rows = rows.withColumn("node", F.when(F.size("path") > k, F.to_json(F.slice("path", 1, k))))
        ends = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("place").alias("a"), F.max("place").alias("z"))
        rows = rows.join(ends, "node", "left").withColumns({"opens": F.when(F.col("place") == F.col("a"), k).otherwise(F.col("opens")), "closes": F.when(F.col("place") == F.col("z"), k).otherwise(F.col("closes"))}).drop("node", "a", "z")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"value": [_json_leaf(list(p), o, c, t, z) for p, o, c, t, z in zip(f.path, f.opens, f.closes, f.text, f["last"], strict=True)]})

    ordered = rows.orderBy("place").select("path", "text", "opens", "closes", "last").mapInPandas(run, "value string")
    return publish(path, chained([b"{\n"], stored(ordered), [b"}"]))


def write_unit_json(units: DataFrame, path: str, **header: object) -> int:
    """A document as ``unit_json.dump`` makes it, a unit on a line; of equal ids the last counts, at the place of the first."""
    from segmenta.sources.unit_json import dump, member

    place = F.struct("doc_id", "ordinal")
    last = units.groupBy("unit_id").agg(F.min(place).alias("p"), F.max(F.struct("doc_id", "ordinal", _as_json(units).alias("j")))["j"].alias("j"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"value": [f", {member(dict.fromkeys(UNIT_COLUMNS) | json.loads(j))}" for j in f.j]})

    lines = last.orderBy("p.doc_id", "p.ordinal").select("j").mapInPandas(run, "value string")
    head = dump([], **header).removesuffix("}}")
    return publish(path, chained([head.encode()], stored(lines, skip=2), [b"}}"]))


def _html_line(u: dict) -> str:
    return f"<p>{_side(u, 'target' if u.get('target') is not None else 'source', 'html')}</p>"


def _html_frame(language: str) -> tuple[str, str]:
    return f'<!DOCTYPE html>\n<html lang="{escape(language, True)}">\n<head><meta charset="utf-8"></head>\n<body>\n', "</body>\n</html>\n"


def html_page(units: Iterable[dict], language: str = "") -> str:
    """A minimal page of the units' texts."""
    head, tail = _html_frame(language)
    return head + "\n".join(_html_line(u) for u in units) + "\n" + tail


def write_html(units: DataFrame, path: str, language: str = "") -> int:
    head, tail = _html_frame(language)
    return publish(path, chained([head.encode()], in_order(units, _html_line), [tail.encode()]))


WRITERS = {"tmx": write_tmx, "xliff": write_xliff, "xlf": write_xliff, "csv": write_csv, "xlsx": write_xlsx, "po": write_po, "json": write_unit_json, "html": write_html}


def write(units: DataFrame, path: str, **options: object) -> int:
    """Write by the suffix of the path."""
    suffix = path.rpartition(".")[2].lower()
    if suffix not in WRITERS:
        raise ValueError(f"no writer for {suffix!r}")
    return WRITERS[suffix](units, path, **options)  # type: ignore[operator]


def convert(spark, source: str, target: str, **options: object) -> int:  # noqa: ANN001
    """Read a file of any format and write it as another."""
    from segmenta.sources.detect import read

    return write(read(spark, source), target, **options)
