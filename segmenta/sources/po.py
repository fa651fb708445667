"""PO catalogues."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.plural import gettext_rule, plural_category
from segmenta.schema import unit
from segmenta.sources.common import read_streams

MODES = ("gettext", "source", "target_as_source")
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9A-Fa-f]{1,2})|(.))", re.DOTALL)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 8)) if m[1] else chr(int(m[2], 16)) if m[2] else _NAMED.get(m[3], m[3]), text)


def quote(text: str) -> str:
    body = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f'"{body}"'


def entries(text: str) -> list[dict]:
    """Entries as dicts of msgctxt, msgid, msgid_plural, msgstr (by index), flags, references, comments; obsolete ones are left out."""
    return list(iter_entries(text.splitlines()))


def iter_entries(lines: Iterable[str]) -> Iterator[dict]:
    """The same from lines, entry by entry."""
    e: dict = {}
    last: tuple[str, int | None] | None = None
    ended: list[dict] = []

    def end() -> None:
        nonlocal e, last
        if "msgid" in e:
            ended.append(e)
        e, last = {}, None

    for line in lines:
        while ended:
            yield ended.pop()
        s = line.strip()
        if not s:
            end()
            continue
        if s.startswith("#~"):
            continue
        if s.startswith("#"):
            if "msgstr" in e:
                end()
            kind, body = s[1:2], s[2:].strip()
            if kind == ",":
                e.setdefault("flags", []).extend(x.strip() for x in body.split(",") if x.strip())
            elif kind == ":":
                e.setdefault("references", []).extend(body.split())
            elif kind == ".":
                e.setdefault("extracted", []).append(body)
            elif kind != "|":
                e.setdefault("comments", []).append(s[1:].strip())
            continue
        m = re.match(r'(msgctxt|msgid_plural|msgid|msgstr)(?:\[(\d+)\])?\s*"(.*)"$', s)
        if m:
            name, index = m[1], int(m[2] or 0)
            if name in ("msgctxt", "msgid") and "msgstr" in e:
                end()
            value = unescape(m[3])
            if name == "msgstr":
                e.setdefault("msgstr", {})[index] = value
                last = (name, index)
            else:
                e[name] = value
                last = (name, None)
        elif (m := re.match(r'"(.*)"$', s)) and last:
            if last[0] == "msgstr":
                e["msgstr"][last[1]] += unescape(m[1])
            else:
                e[last[0]] += unescape(m[1])
    end()
    yield from ended


def index_categories(locale: str | None, header: str | None) -> dict[int, str]:
    """The category of each plural index, where the samples of an index have one and no other index has it."""
    if not locale or not header:
        return {}
    try:
        rule = gettext_rule(header)
        seen: dict[int, set[str]] = {}
        for n in [*range(1001), 10_000, 100_000, 1_000_000]:
            seen.setdefault(rule.index(n), set()).add(plural_category(locale, n))
    except ValueError:
        return {}
    single = {i: next(iter(c)) for i, c in seen.items() if len(c) == 1}
    return {i: c for i, c in single.items() if list(single.values()).count(c) == 1}


def parse(text: str, mode: str = "gettext", target_locale: str | None = None) -> list[dict]:
    """Units of a catalogue; a plural entry has one for each form, id, id[1], ..."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    found = entries(text)
    return list(_units(found, found, mode, target_locale))


def iter_units(f: IO[bytes], mode: str = "gettext", target_locale: str | None = None) -> Iterator[dict]:
    """The same from a file that can seek, entry by entry."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")

    def found() -> Iterator[dict]:
        f.seek(0)
        text = io.TextIOWrapper(f, "utf-8-sig")
        try:
            yield from iter_entries(part for line in text for part in line.splitlines())
        finally:
            text.detach()

    header = found()
    first = list(islice((e for e in header if e["msgid"] == "" and "msgctxt" not in e), 1))
    header.close()
    yield from _units(first, found(), mode, target_locale)


def _units(heads: Iterable[dict], found: Iterable[dict], mode: str, target_locale: str | None) -> Iterator[dict]:
    header = next((e["msgstr"].get(0, "") for e in heads if e["msgid"] == "" and "msgctxt" not in e), "")
    meta = dict(x.split(":", 1) for x in header.split("\n") if ":" in x)
    meta = {k.strip(): x.strip() for k, x in meta.items()}
    locale = target_locale or meta.get("Language") or None
    categories = index_categories(locale, meta.get("Plural-Forms"))
    ordinal = 0
    for e in found:
        if e["msgid"] == "" and "msgctxt" not in e:
            continue
        key = f"{e['msgctxt']}\x04{e['msgid']}" if "msgctxt" in e else e["msgid"]
        flags = e.get("flags", [])
        ext = {k: v for k, v in (("flags", ",".join(f for f in flags if f != "fuzzy")), ("references", " ".join(e.get("references", []))), ("context", e.get("msgctxt", ""))) if v}
        comments = [{"context": c, "context_key": "extracted", "extensions": {}} for c in e.get("extracted", [])] + [{"context": c, "context_key": "translator", "extensions": {}} for c in e.get("comments", [])]
        plural = "msgid_plural" in e
        forms = e.get("msgstr", {0: ""})
        for i in sorted(forms) if plural else [0]:
            text_ = forms.get(i) or None
            source = e["msgid_plural"] if plural and i else e["msgid"]
            status = "draft" if "fuzzy" in flags else "translated" if text_ else "new"
            if mode == "target_as_source":
                source, text_ = text_ or source, None
            yield unit(unit_id=key if not i else f"{key}[{i}]", source=source, target=None if mode == "source" else text_, target_locale=locale if mode == "gettext" else None, status=status, comments=comments, extensions=ext | ({"plural_index": str(i)} if plural else {}), ordinal=ordinal, plural={"variant": e["msgid_plural"], "count": i, "category": categories.get(i), "extensions": {}} if plural else None)
            ordinal += 1


def read(spark: SparkSession, path: str, mode: str = "gettext", target_locale: str | None = None) -> DataFrame:
    return read_streams(spark, path, lambda f, _: iter_units(f, mode, target_locale))


def merged(base: DataFrame, translations: dict[str, DataFrame]) -> DataFrame:
    """(unit_id, source, ordinal, targets): a catalogue and its translations, joined by id in full.

    ``base`` has unit_id, source and ordinal, a translation target too; ids that the base
    lacks come last, with their own source.
    """
    empty = F.create_map().cast("map<string,string>")
    out = base.select("unit_id", "source", "ordinal", empty.alias("targets"))
    for locale, rows in translations.items():
        t = rows.select("unit_id", F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("ordinal").alias("_o"))
        entry = F.when(F.col("_t").isNotNull(), F.create_map(F.lit(locale), F.col("_t"))).otherwise(empty)
        out = out.join(t, "unit_id", "full_outer").select("unit_id", F.coalesce("source", "_s").alias("source"), F.coalesce("ordinal", F.col("_o") + F.lit(1 << 40)).alias("ordinal"), F.map_concat(F.coalesce("targets", empty), entry).alias("targets"))
    return out


def read_targets(spark: SparkSession, source_path: str, target_paths: dict[str, str]) -> DataFrame:
    """A catalogue file and the files of its translations, as ``merged`` joins them."""
    return merged(read(spark, source_path, "source"), {locale: read(spark, path) for locale, path in target_paths.items()})
