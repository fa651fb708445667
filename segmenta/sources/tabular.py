"""CSV and XLSX tables: which column means what, and rows as units."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import IO
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.text import LANGUAGES, column_index, header_locale, tabular_status
from segmenta.schema import unit, unit_type
from segmenta.sources.common import elements, local, open_package, read_streams, units_frame

_ALIASES = {
    "id": {"id", "key", "unit_id", "string_id", "identifier", "name"},
    "source": {"source", "source_text", "original"},
    "target": {"target", "target_text", "translation"},
    "status": {"status", "state"},
    "comment": {"comment", "comments", "note", "notes", "context", "description"},
}


@dataclass
class Layout:
    """Places of the columns, from 0."""

    source: int
    targets: dict[str, int] = field(default_factory=dict)
    id: int | None = None
    status: int | None = None
    comment: int | None = None
    extras: dict[str, int] = field(default_factory=dict)
    header: bool = True
    source_locale: str | None = None


def locales_from_name(name: str) -> tuple[str, str] | None:
    """The locales in file names such as en-fr, en_US_fr_FR."""
    stem = re.split(r"[/\\]", name)[-1].partition(".")[0]
    m = re.fullmatch(r"([a-z]{2,3})(?:[-_]([A-Z]{2}))?[-_]([a-z]{2,3})(?:[-_]([A-Z]{2}))?", stem)
    if m is None or m[1] not in LANGUAGES or m[3] not in LANGUAGES:
        return None
    return m[1] + (f"-{m[2]}" if m[2] else ""), m[3] + (f"-{m[4]}" if m[4] else "")


def _base(locale: str) -> str:
    return locale.partition("-")[0].lower()


def resolve(first: list[str], source_locale: str | None = None, target_locale: str | None = None, selectors: dict[str, str] | None = None, has_header: bool | None = None) -> Layout:
    """The layout of a table from its first row.

    A selector names a column by its header or, where no header has that name, by its
    letters.  Without selectors, headers that name languages and the usual names count;
    a first row without any of them is data: source, then target.
    """
    names = [c.strip() for c in first]
    lowered = [re.sub(r"[\s-]+", "_", c.lower()) for c in names]
    named = set().union(*_ALIASES.values())
    locales = {i: loc for i, c in enumerate(names) if lowered[i] not in named and (loc := header_locale(c))}
    known = bool(locales) or any(c in a for c in lowered for a in _ALIASES.values())
    header = known if has_header is None else has_header
    chosen: dict[str, int] = {}
    for what, selector in (selectors or {}).items():
        if header is not False and selector.strip().lower() in [c.lower() for c in names]:
            chosen[what] = [c.lower() for c in names].index(selector.strip().lower())
            header = True
        else:
            chosen[what] = column_index(selector)
            if chosen[what] >= len(first):
                raise ValueError(f"no such column: {selector!r}")
    if header:
        seen: dict[str, int] = {}
        for i, loc in locales.items():
            if loc in seen:
                raise ValueError(f"two columns for {loc}")
            seen[loc] = i
        for what, aliases in _ALIASES.items():
            if what not in chosen and what not in ("source", "target"):
                at = next((i for i, c in enumerate(lowered) if c in aliases and i not in locales and i not in chosen.values()), None)
                if at is not None:
                    chosen[what] = at

        def find(locale: str | None) -> int | None:
            if locale is None:
                return None
            wanted = header_locale(locale) or locale
            if wanted in seen:
                return seen[wanted]
            near = [i for loc, i in seen.items() if _base(loc) == _base(wanted)]
            return near[0] if len(near) == 1 else None

        source = chosen.get("source", find(source_locale))
        if source is None:
            source = next((i for i, c in enumerate(lowered) if c in _ALIASES["source"]), None)
        if source is None:
            source = next(iter(locales), None)
        if source is None:
            raise ValueError("no source column")
        targets: dict[str, int] = {}
        if "target" in chosen:
            targets[target_locale or locales.get(chosen["target"], "")] = chosen["target"]
        elif target_locale is not None and find(target_locale) is not None:
            targets[header_locale(target_locale) or target_locale] = find(target_locale)  # type: ignore[assignment]
        else:
            targets = {loc: i for loc, i in seen.items() if i != source}
            plain = next((i for i, c in enumerate(lowered) if c in _ALIASES["target"]), None)
            if not targets and plain is not None:
                targets[target_locale or ""] = plain
        used = {source, *targets.values(), *[v for k, v in chosen.items()]}
        extras = {c: i for i, c in enumerate(names) if i not in used and c}
        return Layout(source, targets, chosen.get("id"), chosen.get("status"), chosen.get("comment"), extras, True, source_locale or locales.get(source))
    source = chosen.get("source", 0)
    rest = [i for i in range(len(first)) if i != source and i not in [v for k, v in chosen.items() if k != "target"]]
    target = chosen.get("target", rest[0] if rest and "source" not in chosen or len(rest) == 1 else None)
    name = header_locale(target_locale) if target_locale else ""
    return Layout(source, {name or (target_locale or ""): target} if target is not None else {}, chosen.get("id"), chosen.get("status"), chosen.get("comment"), {}, False, source_locale)


def row_unit(row: list[str], index: int, layout: Layout, prefix: str = "csv") -> dict:
    """One row as a unit: a single target stays single, several go into the map."""
    cell = lambda i: row[i] if i is not None and i < len(row) else ""
    status = cell(layout.status).strip().lower()
    status = status if status in ("new", "draft", "translated", "reviewed", "approved", "rejected") else "unknown"
    comment = cell(layout.comment)
    out = unit(
        unit_id=cell(layout.id) or f"{prefix}:{index}",
        source=cell(layout.source),
        status=status,
        ordinal=index,
        source_locale=layout.source_locale,
        comments=[{"context": comment, "extensions": {}}] if comment else [],
        extensions={k: cell(i) for k, i in layout.extras.items() if cell(i)},
    )
    filled = {loc: cell(i) for loc, i in layout.targets.items() if cell(i)}
    if len(layout.targets) == 1:
        locale = next(iter(layout.targets))
        return out | {"target": filled.get(locale), "target_locale": locale or None}
    made = {loc: {"text": text, "status": status, "extensions": {}} for loc, text in filled.items()}
    return out | {"targets": made, "target_locales": list(layout.targets)}


def rows_units(rows: Iterable[list[str]], path: str = "", prefix: str = "csv", **options: object) -> list[dict]:
    return list(iter_units(rows, path, prefix, **options))


def iter_units(rows: Iterable[list[str]], path: str = "", prefix: str = "csv", **options: object) -> Iterator[dict]:
    rows = iter(rows)
    first = next(rows, None)
    if first is None:
        return
    named = locales_from_name(path)
    if named and options.get("source_locale") is None:
        options |= {"source_locale": named[0], "target_locale": options.get("target_locale") or named[1]}
    layout = resolve(first, **options)  # type: ignore[arg-type]
    for i, r in enumerate(rows if layout.header else chain([first], rows)):
        if any(r):
            yield row_unit(r, i, layout, prefix)


def delimiter_of(text: str | IO[str]) -> str:
    """The delimiter of a table: of those that divide all its records into as many fields, more than one, the one with most; else a comma."""
    lines = io.StringIO(text, newline="") if isinstance(text, str) else text
    best, most = ",", 1
    for d in ",;\t|":
        lines.seek(0)
        width = 0
        for r in csv.reader(lines, delimiter=d):
            if r and (len(r) == 1 or width not in (0, len(r))):
                width = 0
                break
            width = len(r) or width
        if width > most:
            best, most = d, width
    if most == 1:  # records of different lengths: what the first one has most of
        lines.seek(0)
        first = next((r for r in lines if r.strip()), "")
        best = max(",;\t|", key=first.count) if any(d in first for d in ",;\t|") else ","
    lines.seek(0)
    return best


def csv_rows(content: bytes) -> list[list[str]]:
    """The records of a table; the whole text decides on the delimiter, quotes are doubled inside quotes."""
    return list(iter_csv(io.BytesIO(content)))


def iter_csv(f: IO[bytes]) -> Iterator[list[str]]:
    """The same from a file that can seek, record by record."""
    text = io.TextIOWrapper(f, "utf-8-sig", newline="")
    try:
        yield from csv.reader(text, delimiter=delimiter_of(text))
    finally:
        text.detach()


def xlsx_rows(content: bytes, sheet: str | int = 0) -> list[list[str]]:
    """Rows of a sheet (by name or place); every cell as text."""
    return list(iter_xlsx(io.BytesIO(content), sheet))


def iter_xlsx(f: IO[bytes], sheet: str | int = 0) -> Iterator[list[str]]:
    """The same from a file that can seek, row by row; only shared strings are held."""
    with open_package(f) as z:
        part = sheet_part(z, sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as s:
                shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si, _ in elements(s, frozenset({"si"}))]
        with z.open(part) as s:
            for r, _ in elements(s, frozenset({"row"})):
                yield _cells(r, shared)


def sheet_part(z: zipfile.ZipFile, sheet: str | int = 0) -> str:
    """The entry of a sheet by its name or place in the workbook."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = [e for e in book.iter() if local(e.tag) == "sheet"]
    names = [e.get("name") for e in sheets]
    at = names.index(sheet) if isinstance(sheet, str) else sheet
    rels = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    rid = next(v for k, v in sheets[at].attrib.items() if local(k) == "id")
    part = (rels[rid] or "").lstrip("/")
    return part if part.startswith("xl/") else f"xl/{part}"


def _cells(r: ET.Element, shared: list[str]) -> list[str]:
    cells: dict[int, str] = {}
    for c in r:
        ref = re.match(r"[A-Z]+", c.get("r", ""))
        i = column_index(ref[0]) if ref else len(cells)
        value = next((x.text or "" for x in c if local(x.tag) == "v"), "")
        if c.get("t") == "s":
            value = shared[int(value)] if value else ""
        elif c.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
        elif c.get("t") == "b":
            value = "True" if value == "1" else "False"
        cells[i] = value
    return [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def read_csv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_streams(spark, path, lambda f, name: iter_units(iter_csv(f), name, **options))


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0, **options: object) -> DataFrame:
    return read_streams(spark, path, lambda f, name: iter_units(iter_xlsx(f, sheet), name, "xlsx", **options))


def read_csv_lines(spark: SparkSession, path: str, delimiter: str = ",", **options: object) -> DataFrame:
    """Units of CSV files whose records have no line breaks, by a splittable scan of native expressions.

    All files have the columns of the first one and, if it has a header, the same header.
    Records without an id are numbered by split and line, so their ids tell nothing of
    their order.  ``options`` are those of ``resolve``.  Blank records are left out.
    """
    lines = spark.read.options(header=False, sep=delimiter, quote='"', escape='"', encoding="UTF-8", nullValue="\x00", emptyValue="").csv(path)
    first = lines.first()
    if first is None:
        return units_frame(spark, [])
    head = [(x or "").lstrip("\ufeff") for x in first]
    layout = resolve(head, **options)  # type: ignore[arg-type]
    cell = lambda i: F.coalesce(F.col(lines.columns[i]), F.lit("")) if i is not None else F.lit("")
    rows = lines.withColumn("_n", F.monotonically_increasing_id()).withColumn("_path", F.col("_metadata.file_path"))
    if layout.header:
        same = F.lit(True)
        for i, name in enumerate(head):
            same = same & (F.ltrim(cell(i), F.lit("\ufeff")) == F.lit(name))
        rows = rows.where(~same)
    filled = F.lit(False)
    for i in range(len(head)):
        filled = filled | (cell(i) != "")
    types = {f.name: f.dataType for f in unit_type().fields}
    kind = types["targets"].valueType  # type: ignore[attr-defined]
    status = tabular_status(cell(layout.status))
    note = F.when(cell(layout.comment) != "", F.array(F.struct(*[(cell(layout.comment) if f.name == "context" else F.lit(None)).cast(f.dataType).alias(f.name) for f in types["comments"].elementType.fields])))  # type: ignore[attr-defined]
    extra = F.map_filter(F.create_map(*[x for k, i in layout.extras.items() for x in (F.lit(k), cell(i))]) if layout.extras else F.create_map().cast("map<string,string>"), lambda _, v: v != "")
    value = {"text": lambda i: cell(i), "status": lambda _: status}
    entries = [F.struct(F.lit(loc).alias("key"), F.when(cell(i) != "", F.struct(*[value.get(f.name, lambda _: F.lit(None))(i).cast(f.dataType).alias(f.name) for f in kind.fields])).alias("value")) for loc, i in layout.targets.items()]
    one = len(layout.targets) == 1
    locale = next(iter(layout.targets), None)
    have = {
        "doc_id": F.col("_path"), "ordinal": F.col("_n"), "unit_id": F.when(cell(layout.id) != "", cell(layout.id)).otherwise(F.concat(F.lit("csv:"), F.col("_n").cast("string"))),
        "source": cell(layout.source), "source_locale": F.lit(layout.source_locale), "status": status, "extensions": extra, "comments": note,
        "target": F.when(cell(layout.targets[locale]) != "", cell(layout.targets[locale])) if one else F.lit(None), "target_locale": F.lit(locale or None) if one else F.lit(None),
        "targets": F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if not one and entries else F.create_map(),
        "target_locales": F.array(*[F.lit(x) for x in layout.targets]) if not one else F.array(),
    }
    empty = {"comments": F.array()}
    made = [(F.coalesce(have.get(c, F.lit(None)).cast(t), empty[c].cast(t)) if c in empty else have.get(c, F.lit(None)).cast(t)).alias(c) for c, t in types.items()]
    return rows.where(filled).select(*made)
