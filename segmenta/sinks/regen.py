"""Originals with the targets of units put in; everything else stays as it was."""

from __future__ import annotations

import codecs
import csv
import io
import json
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from itertools import islice, takewhile
from typing import IO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.inline import escape
from segmenta.plans.shared import scratch
from segmenta.sinks import files
from segmenta.sources import html, json_i18n, office, po, tabular, tmx
from segmenta.sources.common import local, open_package, over_files

Targets = dict[str, str]
MISSING = ("keep", "error")


def regen_csv(original: bytes, targets: Targets, target_locale: str | None = None, **options: object) -> bytes:
    """Only target cells change; the order of the columns stays."""
    rows = tabular.csv_rows(original)
    if not rows:
        return original
    layout = tabular.resolve(rows[0], target_locale=target_locale, **options)  # type: ignore[arg-type]
    if len(layout.targets) != 1:
        raise ValueError("choose one target locale")
    at = next(iter(layout.targets.values()))
    for i, row in enumerate(rows[1:] if layout.header else rows):
        key = row[layout.id] if layout.id is not None and layout.id < len(row) and row[layout.id] else f"csv:{i}"
        if key in targets:
            row.extend([""] * (at + 1 - len(row)))
            row[at] = targets[key]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def regen_po(original: bytes, targets: Targets) -> bytes:
    """Blocks with new msgstr lines; comments, order and obsolete entries stay."""
    blocks = re.split(r"(\n[ \t]*\n)", original.decode("utf-8-sig"))
    for k in range(0, len(blocks), 2):
        found = po.entries(blocks[k])
        if len(found) != 1 or found[0]["msgid"] == "" and "msgctxt" not in found[0]:
            continue
        e = found[0]
        key = f"{e['msgctxt']}\x04{e['msgid']}" if "msgctxt" in e else e["msgid"]
        out, skipping, done = [], False, set()
        for line in blocks[k].split("\n"):
            m = re.match(r"\s*msgstr(?:\[(\d+)\])?", line)
            if m:
                i = int(m[1] or 0)
                name = key if not i else f"{key}[{i}]"
                skipping = name in targets and name not in done
                if skipping:
                    done.add(name)
                    out.append(f"msgstr{f'[{i}]' if m[1] else ''} {po.quote(targets[name])}")
                    continue
            elif line.strip().startswith('"') and skipping:
                continue
            else:
                skipping = False
            out.append(line)
        blocks[k] = "\n".join(out)
    return "".join(blocks).encode()


def _record(pattern: str, original: bytes, change: Callable[[re.Match[str]], str]) -> bytes:
    return re.sub(pattern, change, original.decode("utf-8"), flags=re.DOTALL).encode()


def regen_xliff(original: bytes, targets: Targets, two: bool | None = None) -> bytes:
    """XLIFF 1.2 and 2.x: new target elements; text between records stays byte for byte."""
    if two is None:
        two = re.search(rb'<xliff[^>]*\sversion="2', original[:65536]) is not None

    def put(block: str, text: str) -> str:
        new = f"<target>{escape(text)}</target>"
        if re.search(r"<target\b", block):
            return re.sub(r"<target(\b[^>]*?)(/>|>.*?</target>)", lambda m: f"<target{m[1].rstrip()}>{escape(text)}</target>", block, count=1, flags=re.DOTALL)
        return re.sub(r"(</source>|<source\s*/>)", lambda m: m[0] + new, block, count=1)

    def name(attributes: str) -> str:
        m = re.search(r"""\bid=["']([^"']*)""", attributes)
        return m[1] if m else ""

    if not two:
        return _record(r"<trans-unit\b([^>]*)>.*?</trans-unit>", original, lambda m: put(m[0], targets[name(m[1])]) if name(m[1]) in targets else m[0])

    def each(m: re.Match[str]) -> str:
        n = iter(range(1 << 30))

        def segment(s: re.Match[str]) -> str:
            key = f"{name(m[1])}:{name(s[1]) or next(n)}"
            return put(s[0], targets[key]) if key in targets else s[0]

        return re.sub(r"<segment\b([^>]*)>.*?</segment>", segment, m[0], flags=re.DOTALL)

    return _record(r"<unit\b([^>]*)>.*?</unit>", original, each)


def regen_tmx(original: bytes, targets: Targets, target_locale: str) -> bytes:
    """The variant of a locale gets the new text; a record without one gets it added."""
    wanted, auto = tmx.canonical(target_locale), iter(range(1 << 30))

    def each(m: re.Match[str]) -> str:
        found = re.search(r"""\btuid=["']([^"']*)""", m[1])
        key = found[1] if found and found[1] else f"auto_{next(auto)}"
        if key not in targets:
            return m[0]
        seg = f"<seg>{escape(targets[key])}</seg>"
        hit = False

        def variant(v: re.Match[str]) -> str:
            nonlocal hit
            lang = re.search(r"""(?:xml:)?lang=["']([^"']*)""", v[1])
            if hit or lang is None or tmx.canonical(lang[1]) != wanted:
                return v[0]
            hit = True
            return re.sub(r"<seg>.*?</seg>|<seg\s*/>", lambda _: seg, v[0], count=1, flags=re.DOTALL)

        out = re.sub(r"<tuv\b([^>]*)>.*?</tuv>", variant, m[0], flags=re.DOTALL)
        return out if hit else out.replace("</tu>", f'<tuv xml:lang="{escape(target_locale, True)}">{seg}</tuv></tu>')

    return _record(r"<tu\b(?!v)([^>]*)>.*?</tu>", original, each)


def regen_json(original: bytes, targets: Targets, locale: str | None = None) -> bytes:
    """The same tree with new texts; with a locale, that branch of a multilingual file."""
    tree = json.loads(original.decode("utf-8-sig"))
    used: set[str] = set()

    def walk(node: object, path: list[str]) -> object:
        if isinstance(node, dict):
            return {k: walk(v, [*path, k]) for k, v in node.items()}
        if not isinstance(node, str) or not path:
            return node
        key, n = ".".join(path), 1
        name = key
        while name in used:
            n += 1
            name = f"{key}#{n}"
        used.add(name)
        return targets.get(name, node)

    tree = tree | {locale: walk(tree.get(locale) or next(iter(tree.values())), [])} if locale is not None else walk(tree, [])
    return (json.dumps(tree, ensure_ascii=False, indent=2) + "\n").encode()


def _rewritten(original: bytes, change: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with open_package(original) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            w.writestr(info, change.get(info.filename, z.read(info.filename)))
    return out.getvalue()


def _xml(root: ET.Element, original: bytes, declaration: bool = True) -> bytes:
    for prefix, uri in re.findall(rb'xmlns:?([\w-]*)="([^"]+)"', original):
        try:
            ET.register_namespace(prefix.decode(), uri.decode())
        except ValueError:
            pass
    return ET.tostring(root, encoding="utf-8", xml_declaration=declaration)


def regen_idml(original: bytes, targets: Targets) -> bytes:
    """Stories with new paragraphs: the text goes to the first character range, the others are emptied."""
    change = {}
    with open_package(original) as z:
        for name in office.idml_stories(z):
            story, i, raw = posixpath.basename(name)[:-4], 0, z.read(name)
            root = ET.fromstring(raw)
            for _, ranges in office.idml_paragraphs(root):
                text = "".join(office._idml_text(r) for r in ranges)
                if not text.strip():
                    continue
                new = targets.get(f"{story}:p{i}")
                i += 1
                contents = [c for r in ranges for c in r.iter() if local(c.tag) == "Content"]
                if new is not None and contents:
                    contents[0].text = new
                    for c in contents[1:]:
                        c.text = ""
            change[name] = _xml(root, raw)
    return _rewritten(original, change)


def regen_office(original: bytes, targets: Targets, missing: str = "keep", extra: str = "keep") -> bytes:
    """DOCX and PPTX with new paragraphs and alternative texts; ``missing`` and ``extra`` may be errors."""
    if missing not in MISSING or extra not in MISSING:
        raise ValueError("policies are keep and error")
    change, used = {}, set()
    with open_package(original) as z:
        names = office.docx_parts(z) if "word/document.xml" in z.namelist() else office.pptx_parts(z)
        for name in names:
            raw = z.read(name)
            root = ET.fromstring(raw)
            for i, p in enumerate(e for e in root.iter() if local(e.tag) == "p"):
                key, texts = f"{name}:p{i}", [e for e in p.iter() if local(e.tag) == "t"]
                if not office.paragraph_text(p).strip():
                    continue
                if key not in targets:
                    if missing == "error":
                        raise ValueError(f"no translation for {key}")
                    continue
                used.add(key)
                for run in p.iter():
                    for mark in [x for x in run if local(x.tag) in ("tab", "br", "cr") and local(run.tag) in ("r", "p")]:
                        run.remove(mark)
                for k, t in enumerate(texts):
                    t.text = targets[key] if k == 0 else ""
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            for a, e in enumerate(e for e in root.iter() if local(e.tag) in ("docPr", "cNvPr") and (e.get("descr") or "").strip()):
                if f"{name}:alt{a}" in targets:
                    used.add(f"{name}:alt{a}")
                    e.set("descr", targets[f"{name}:alt{a}"])
            change[name] = _xml(root, raw)
    if extra == "error" and set(targets) - used:
        raise ValueError(f"translations without a place: {sorted(set(targets) - used)}")
    return _rewritten(original, change)


def regen_html(original: bytes, targets: Targets) -> bytes:
    """Pages with new texts in the blocks that have one source text, found in order."""
    text = original.decode("utf-8", "replace")
    at = 0
    for u in html.page_units(text):
        new, source = targets.get(u["unit_id"]), u["source"]
        for spelled in (source, escape(source), escape(source, True)):
            found = text.find(spelled, at if not u["unit_id"].startswith("html:meta") else 0)
            if found >= 0:
                if new is not None:
                    text = text[:found] + escape(new, u["unit_id"].startswith(("html:meta", "html:img"))) + text[found + len(spelled) :]
                if not u["unit_id"].startswith("html:meta"):
                    at = found + len(escape(new) if new is not None else spelled)
                break
    return text.encode()


def _put_cell(r: ET.Element, at: int, text: str) -> None:
    """A row's cell as an inline string."""
    from segmenta.functions.text import column_index

    ns = r.tag.partition("}")[0] + "}"
    cell = next((c for c in r if re.match(r"[A-Z]+", c.get("r", "")) and column_index(re.match(r"[A-Z]+", c.get("r", ""))[0]) == at), None)  # type: ignore[index]
    if cell is None:
        cell = ET.SubElement(r, f"{ns}c")
    for child in list(cell):
        cell.remove(child)
    cell.set("t", "inlineStr")
    ET.SubElement(ET.SubElement(cell, f"{ns}is"), f"{ns}t").text = text


def regen_xlsx(original: bytes, targets: Targets, target_locale: str | None = None, sheet: str | int = 0, **options: object) -> bytes:
    """The target column as inline strings."""
    rows = tabular.xlsx_rows(original, sheet)
    layout = tabular.resolve(rows[0], target_locale=target_locale, **options)  # type: ignore[arg-type]
    if len(layout.targets) != 1 or isinstance(sheet, str):
        raise ValueError("choose one target locale and the sheet by its place")
    at = next(iter(layout.targets.values()))
    new = {}
    for i, row in enumerate(rows[1:] if layout.header else rows):
        key = row[layout.id] if layout.id is not None and layout.id < len(row) and row[layout.id] else f"xlsx:{i}"
        if key in targets:
            new[i + layout.header] = targets[key]
    with open_package(original) as z:
        parts = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=office._order)
        raw = z.read(parts[sheet])
    root = ET.fromstring(raw)
    for n, r in enumerate(e for e in root.iter() if local(e.tag) == "row"):
        if n not in new:
            continue
        _put_cell(r, at, new[n])
    return _rewritten(original, {parts[sheet]: _xml(root, raw)})


# --- files of any size ------------------------------------------------------------------------

#: Pieces of an original in order, each with the ids of its units; ``mark`` comes after each but the last.
Piece = tuple[list[str], str]


def _split(f: IO[bytes], mark: str) -> Iterator[tuple[str, bool]]:
    """Text between marks, and whether one follows."""
    reader, left = codecs.getreader("utf-8")(f), ""
    while got := reader.read(1 << 20):
        *whole, left = (left + got).split(mark)
        for text in whole:
            yield text, True
    yield left, False


def _id(name: str, attributes: str) -> str:
    m = re.search(rf"""\b{name}=["']([^"']*)""", attributes)
    return m[1] if m else ""


class _Xml:
    """Records that end with a tag."""

    separator = ">"

    def __init__(self, mark: str, locale: str | None = None) -> None:
        self.mark, self.locale = mark, locale

    def pieces(self, f: IO[bytes]) -> Iterator[Piece]:
        auto = 0
        for text, whole in _split(f, self.mark):
            ids: list[str] = []
            if self.mark == "</tu>" and (m := re.search(r"<tu\b(?!v)([^>]*)>", text)) and whole:
                ids = [_id("tuid", m[1])]
                if not ids[0]:
                    ids, auto = [f"auto_{auto}"], auto + 1
            elif self.mark == "</trans-unit>" and (m := re.search(r"<trans-unit\b([^>]*)>", text)) and whole:
                ids = [_id("id", m[1])]
            elif self.mark == "</unit>" and (m := re.search(r"<unit\b([^>]*)>", text)) and whole:
                n = iter(range(1 << 30))
                ids = [f"{_id('id', m[1])}:{_id('id', x) or next(n)}" for x in re.findall(r"<segment\b([^>]*)>.*?</segment>", text, flags=re.DOTALL)]
            yield ids, text

    def put(self, text: str, new: Targets) -> str:
        block = f"{text}{self.mark}".encode()
        if self.mark == "</tu>":
            own = {"auto_0" if k.startswith("auto_") else k: x for k, x in new.items()}
            out = regen_tmx(block, own | new, self.locale or "")
        else:
            out = regen_xliff(block, new, self.mark == "</unit>")
        return out.decode().removesuffix(self.mark)


class _Po:
    separator = mark = "\n"

    def pieces(self, f: IO[bytes]) -> Iterator[Piece]:
        lines: list[str] = []
        blank = False
        for line, _ in _split(f, "\n"):
            if blank and line.strip(" \t"):
                yield self._piece(lines)
                lines = []
            lines.append(line)
            blank = not line.strip(" \t")
        yield self._piece(lines)

    @staticmethod
    def _piece(lines: list[str]) -> Piece:
        text = "\n".join(lines)
        found = po.entries(text)
        if len(found) != 1:
            return [], text
        e = found[0]
        key = f"{e['msgctxt']}\x04{e['msgid']}" if "msgctxt" in e else e["msgid"]
        return [key if not i else f"{key}[{i}]" for i in e.get("msgstr", {})] if key else [], text

    def put(self, text: str, new: Targets) -> str:
        return regen_po(text.encode(), new).decode()


class _Csv:
    separator = mark = "\n"

    def __init__(self, target_locale: str | None = None, **options: object) -> None:
        self.locale, self.options = target_locale, options

    def pieces(self, f: IO[bytes]) -> Iterator[Piece]:
        layout, at, i = None, 0, 0
        for row in tabular.iter_csv(f):
            ids: list[str] = []
            if layout is None:
                layout = tabular.resolve(row, target_locale=self.locale, **self.options)  # type: ignore[arg-type]
                if len(layout.targets) != 1:
                    raise ValueError("choose one target locale")
                at = next(iter(layout.targets.values()))
                if layout.header:
                    yield ids, json.dumps([at, row])
                    continue
            ids = [row[layout.id] if layout.id is not None and layout.id < len(row) and row[layout.id] else f"csv:{i}"]
            i += 1
            yield ids, json.dumps([at, row])
        if layout is not None:
            yield [], ""

    def put(self, text: str, new: Targets) -> str:
        at, row = json.loads(text)
        for value in new.values():
            row.extend([""] * (at + 1 - len(row)))
            row[at] = value
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        return out.getvalue()

    def plain(self, text: str) -> str:
        return self.put(text, {}) if text else ""


class _Xlsx:
    """Rows of a sheet; ``names`` are the namespaces that its root declares."""

    separator = "\n"

    def __init__(self, part: str, mark: str, names: str, target_locale: str | None, sheet: str | int, options: dict) -> None:
        self.part, self.mark, self.names, self.locale, self.sheet, self.options = part, mark, names, target_locale, sheet, options
        self.start = re.compile(rf"<{re.escape(mark[2:-1])}(?=[\s/>])[^>]*?(/?)>")

    def pieces(self, f: IO[bytes]) -> Iterator[Piece]:
        layout, at, i = None, 0, 0
        rows = tabular.iter_xlsx(f, self.sheet)
        with open_package(f) as z, z.open(self.part) as s:
            for text, _ in _split(s, self.mark):
                ids: list[str] = []
                for m in self.start.finditer(text):
                    row = next(rows)
                    ids = []
                    if layout is None:
                        layout = tabular.resolve(row, target_locale=self.locale, **self.options)
                        if len(layout.targets) != 1:
                            raise ValueError("choose one target locale")
                        at = next(iter(layout.targets.values()))
                        if layout.header:
                            continue
                    if not m[1]:
                        ids = [row[layout.id] if layout.id is not None and layout.id < len(row) and row[layout.id] else f"xlsx:{i}"]
                    i += 1
                yield ids, json.dumps([at, text])

    def put(self, text: str, new: Targets) -> str:
        at, piece = json.loads(text)
        if not new:
            return piece
        *_, start = self.start.finditer(piece)
        root = ET.fromstring(f"<w {self.names}>{piece[start.start() :]}{self.mark}</w>")
        _put_cell(root[0], at, next(iter(new.values())))
        return piece[: start.start()] + _xml(root[0], self.names.encode(), False).decode().removesuffix(self.mark)

    def plain(self, text: str) -> str:
        return json.loads(text)[1]


_TEXTS = re.compile(r"""<!--.*?-->|<(?:[^<>"']|"[^"]*"|'[^']*')*>|([^<]+|<)""", re.DOTALL)


class _Html:
    """Runs of a page outside of open blocks; a text is replaced in its own block, where one piece of text there is its source."""

    separator = mark = ">"

    def pieces(self, f: IO[bytes]) -> Iterator[Piece]:
        for text, units in html.cut_units(f):
            yield [u[0] for u in units], json.dumps([units, text])

    def put(self, text: str, new: Targets) -> str:
        units, page = json.loads(text)
        units.sort(key=lambda u: u[2])  # an outer block comes before those inside it
        changes = []
        for n, (key, source, begin, end) in enumerate(units):
            if key in new and (found := self._place(page, units, n)):
                name = key.split(":")[1]
                spelled = escape(new[key], name in ("meta", "img"))
                changes.append((*found, f'"{spelled}"' if name in ("meta", "img") else spelled))
        out, at = [], 0
        for begin, end, value in sorted(changes):
            out += [page[at:begin], value]
            at = end
        return "".join([*out, page[at:]])

    @staticmethod
    def _place(page: str, units: list, n: int) -> tuple[int, int] | None:
        key, source, begin, end = units[n]
        source = source.strip()
        if (name := key.split(":")[1]) in ("meta", "img"):
            attribute = "content" if name == "meta" else "alt"
            for m in re.finditer(rf"""(?<![\w-]){attribute}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", page[begin:end], re.IGNORECASE):
                if unescape(m[1].strip(m[1][0] if m[1][0] in "\"'" else "")).strip() == source:
                    return begin + m.start(1), begin + m.end(1)
            return None
        inner = list(takewhile(lambda u: u[2] < end, islice(units, n + 1, None)))
        for m in _TEXTS.finditer(page, begin, end):
            if m[1] is None or unescape(m[1]).strip() != source or any(u[2] <= m.start() < u[3] for u in inner):
                continue
            for spelled in (source, escape(source), escape(source, True), m[1].strip()):
                if (at := m[1].find(spelled)) >= 0:
                    return m.start() + at, m.start() + at + len(spelled)
        return None

    def plain(self, text: str) -> str:
        return json.loads(text)[1]


class _Json:
    """String leaves of a resource file, each with what stands before it; all but the texts stays as it was written."""

    separator = mark = '"'

    def pieces(self, f: IO[bytes]) -> Iterator[Piece]:
        if json_i18n._multilingual(f):
            raise ValueError("a multilingual file is rewritten by regen_json")
        f.seek(0)
        for key, _, _, raw, place in json_i18n.named_leaves(f):
            # the closing quote of a leaf is the mark
            yield ([key], json.dumps([place, raw[:-1]])) if key is not None else ([], json.dumps([0, raw]))

    def put(self, text: str, new: Targets) -> str:
        place, raw = json.loads(text)
        return raw[: place + 1] + json.dumps(next(iter(new.values())), ensure_ascii=False)[1:-1]

    def plain(self, text: str) -> str:
        return json.loads(text)[1]


def rewrite_xlsx(spark: SparkSession, path: str, out: str, targets: DataFrame, target_locale: str | None = None, sheet: str | int = 0, **options: object) -> int:
    """A workbook with the targets in the target column of a sheet; other entries are copied as they are."""
    with tempfile.TemporaryFile() as old, tempfile.TemporaryFile() as new:
        for piece in files.content(spark, path):
            old.write(piece)
        with open_package(old) as z, zipfile.ZipFile(new, "w", zipfile.ZIP_DEFLATED) as w:
            part = tabular.sheet_part(z, sheet)
            with z.open(part) as s:
                m = re.search(r"<([\w.-]+:)?worksheet\b[^>]*>", s.read(1 << 16).decode("utf-8", "ignore"))
            if m is None:
                raise ValueError("not a sheet")
            names = " ".join(re.findall(r"""xmlns(?::[\w.-]+)?=(?:"[^"]*"|'[^']*')""", m[0]))
            kind = _Xlsx(part, f"</{m[1] or ''}row>", names, target_locale, sheet, options)
            for info in z.infolist():
                if info.filename != part:
                    w.writestr(info, z.read(info.filename))
                    continue
                with w.open(part, "w", force_zip64=True) as s:
                    for piece in _renewed(spark, path, targets, kind):
                        s.write(piece)
        new.seek(0)
        return files.publish(out, iter(lambda: new.read(1 << 20), b""))


def tmx_file(target_locale: str) -> _Xml:
    return _Xml("</tu>", target_locale)


def xliff_file(version: str = "1.2") -> _Xml:
    return _Xml("</unit>" if version.startswith("2") else "</trans-unit>")


csv_file, po_file, html_file, json_file = _Csv, _Po, _Html, _Json


def rewrite(spark: SparkSession, path: str, out: str, targets: DataFrame, kind: object) -> int:
    """A file at ``out`` with the targets (unit_id, target) put into the original at ``path``, of any size.

    A task cuts the original into records as a stream; targets are joined by id and put in by executors,
    which write the records in order.  ``kind`` is made by ``tmx_file``, ``xliff_file``,
    ``csv_file``, ``po_file``, ``html_file`` or ``json_file``.
    """
    return files.publish(out, _renewed(spark, path, targets, kind))


def _renewed(spark: SparkSession, path: str, targets: DataFrame, kind: object) -> Iterator[bytes]:
    folder = f"{scratch(spark)}/pieces"
    make = lambda f, _: (json.dumps({"n": n, "k": list(dict.fromkeys(ids)), "t": text}, ensure_ascii=False) for n, (ids, text) in enumerate(kind.pieces(f)))
    over_files(spark, path, make, "json", kind.separator).select(F.from_json("json", "n bigint, k array<string>, t string").alias("p")).select("p.*").write.parquet(folder)
    pieces = spark.read.parquet(folder)
    given = targets.where("target IS NOT NULL").groupBy("unit_id").agg(F.min("target").alias("target"))
    new = pieces.select("n", F.explode("k").alias("unit_id")).join(given, "unit_id").groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "target"))).alias("m"))
    plain = getattr(kind, "plain", lambda text: text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"value": [kind.put(t, json.loads(m)) if m is not None else plain(t) for t, m in zip(f.t, f.m, strict=True)]})

    ordered = pieces.join(new, "n", "left").orderBy("n").select("t", F.to_json("m").alias("m")).mapInPandas(run, "value string")
    return files.stored(ordered, kind.mark, cut=len(kind.mark.encode()))


# --- records and translations as frames -------------------------------------------------------


def merged(records: DataFrame, translations: DataFrame, by: list[str], value: str, new: str = "target") -> DataFrame:
    """Original records with ``value`` replaced by the translation of the same keys, where there is one with a text."""
    t = translations.where(F.col(new).isNotNull()).groupBy(*by).agg(F.min(new).alias("_new"))
    return records.join(t, by, "left").withColumn(value, F.coalesce("_new", value)).drop("_new").select(*records.columns)


def extra_translations(supplied: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """The supplied translations that no record takes."""
    return supplied.join(records.select(*by).distinct(), by, "left_anti")


def missing_translations(records: DataFrame, supplied: DataFrame, by: list[str]) -> DataFrame:
    """The records that nothing is supplied for."""
    return records.join(supplied.select(*by).distinct(), by, "left_anti")
