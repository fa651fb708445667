"""Which format a file has, and reading by it."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterable
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from segmenta.sources import html, json_i18n, office, po, tabular, tmx, unit_json, xliff
from segmenta.sources.common import Streamed, open_package, read_streams

SUFFIXES = {"csv": "csv", "tsv": "csv", "xlsx": "xlsx", "po": "po", "pot": "po", "html": "html", "htm": "html", "idml": "idml", "docx": "docx", "pptx": "pptx"}
_ROOTS = {"tmx": "tmx", "xliff": "xliff", "html": "html"}
_MACRO = ("docm", "pptm", "xlsm", "dotm", "potm")


def detect_bytes(data: bytes) -> str:
    """The format of a file from its content; ValueError if none fits."""
    head = data[:4096].lstrip(b"\xef\xbb\xbf").lstrip()
    if head.startswith((b"{", b"[")):
        return "json" if b'"format_version"' in head and b'"data"' in data else "json_i18n"
    if head.startswith(b"PK"):
        return _package(data)
    text = data[:4096].decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "ignore").lstrip("\ufeff").lstrip()
    if text.startswith("<"):
        for m in re.finditer(r"<(?![?!])(?:\w+:)?([\w-]+)", text):
            if m[1].lower() in _ROOTS:
                return _ROOTS[m[1].lower()]
            break
        if "<!doctype html" in text.lower():
            return "html"
        raise ValueError("unknown XML")
    if re.search(r"^msgid\s", text, re.MULTILINE):
        return "po"
    first = text.partition("\n")[0]
    if any(d in first for d in ",;\t|"):
        return "csv"
    raise ValueError("unknown format")


def detect_file(f: IO[bytes]) -> str:
    """The same of a file that can seek, by its beginning; a package and the unit of a JSON document are looked for in the rest."""
    head = f.read(1 << 16)
    start = head.lstrip(b"\xef\xbb\xbf").lstrip()
    if start.startswith(b"PK"):
        return _package(f)
    if start.startswith((b"{", b"[")) and b'"data"' not in head:
        left = head[-8:]
        for piece in iter(lambda: f.read(1 << 20), b""):
            if b'"data"' in left + piece:
                head += b'"data"'
                break
            left = piece[-8:]
    return detect_bytes(head)


def _package(data: bytes | IO[bytes]) -> str:
    try:
        with open_package(data) as z:
            names = z.namelist()
    except zipfile.BadZipFile as e:
        raise ValueError("a broken package") from e
    if any(n.startswith("Stories/") for n in names):
        return "idml"
    return "docx" if any(n.startswith("word/") for n in names) else "pptx" if any(n.startswith("ppt/") for n in names) else "xlsx"


def detect(path: str, head: bytes) -> str:
    """The format from the name, else from the content."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in _MACRO:
        raise ValueError("documents with macros are not read")
    return SUFFIXES.get(suffix) or detect_bytes(head)


PARSERS: dict[str, Callable[[bytes, str], list[dict]]] = {
    "tmx": lambda c, _: tmx.parse(c),
    "xliff": lambda c, _: xliff.parse(c),
    "po": lambda c, _: po.parse(c.decode("utf-8-sig")),
    "csv": lambda c, n: tabular.rows_units(tabular.csv_rows(c), n),
    "xlsx": lambda c, n: tabular.rows_units(tabular.xlsx_rows(c), n, "xlsx"),
    "json": lambda c, _: unit_json.parse(c.decode("utf-8-sig")),
    "json_i18n": lambda c, _: json_i18n.parse(c.decode("utf-8-sig")),
    "html": lambda c, _: html.page_units(c.decode("utf-8", "replace")),
    "idml": lambda c, _: office.parse_idml(c),
    "docx": lambda c, _: office.parse_office(c),
    "pptx": lambda c, _: office.parse_office(c),
}


def parse_bytes(data: bytes, name: str = "") -> list[dict]:
    return PARSERS[detect(name, data)](data, name)


#: Parsers that stream; a file of another format is parsed whole.
STREAMED: dict[str, Streamed] = {
    "tmx": lambda f, _: tmx.iter_units(f),
    "po": lambda f, _: po.iter_units(f),
    "csv": lambda f, n: tabular.iter_units(tabular.iter_csv(f), n),
    "xlsx": lambda f, n: tabular.iter_units(tabular.iter_xlsx(f), n, "xlsx"),
    "json": lambda f, _: unit_json.iter_units(f),
    "json_i18n": lambda f, _: json_i18n.iter_units(f),
    "html": lambda f, _: html.iter_units(f),
}


def parse_file(f: IO[bytes], name: str = "") -> Iterable[dict]:
    """Units of a file that can seek, by its own format."""
    suffix = name.rpartition(".")[2].lower()
    if suffix in _MACRO:
        raise ValueError("documents with macros are not read")
    kind = SUFFIXES.get(suffix) or detect_file(f)
    f.seek(0)
    return STREAMED[kind](f, name) if kind in STREAMED else PARSERS[kind](f.read(), name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Units of files of any format, each by its own."""
    return read_streams(spark, path, parse_file)
