"""TMX as a splittable text scan: a record ends at </tu>, and each is parsed by itself."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import IO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.inline import Builder
from segmenta.functions.text import TMX_STATUS
from segmenta.schema import UNIT_COLUMNS, UNIT_DDL, unit
from segmenta.sources.common import elements, local, read_streams

MODES = ("full", "text", "text_with_status")
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_CODES = {"bpt": "open", "ept": "close", "ph": "standalone", "it": "standalone", "ut": "standalone", "x": "standalone"}
_META = {"creationdate": "created", "changedate": "updated", "lastusagedate": "last_used"}


@lru_cache(maxsize=4096)
def canonical(locale: str) -> str:
    parts = locale.strip().replace("_", "-").split("-")
    return "-".join([parts[0].lower(), *[p.upper() if len(p) == 2 and p.isalpha() else p.title() if len(p) == 4 and p.isalpha() else p for p in parts[1:]]])


def _segment(seg: ET.Element) -> Builder:
    b, pairs = Builder(), {}
    if not len(seg):
        b.text(seg.text)
        return b
    inner = lambda e: "".join(e.itertext())

    def walk(e: ET.Element) -> None:
        b.text(e.text)
        for child in e:
            name = local(child.tag)
            meaning = (child.get("type") or "custom").lower()
            attributes = {local(k): v for k, v in child.attrib.items()}
            if name in ("hi", "sub"):
                pair = b.new_pair()
                b.code(f"{meaning}.open", name, attributes, None, pair)
                walk(child)
                b.code(f"{meaning}.close", name, {}, None, pair)
            elif name in _CODES:
                side, pair = _CODES[name], None
                if name in ("bpt", "ept"):
                    key = child.get("i") or ""
                    pair = pairs.setdefault(key, None) or b.new_pair()
                    pairs[key] = pair
                elif name == "it":
                    side = {"begin": "open", "end": "close"}.get(child.get("pos") or "", "standalone")
                b.code(f"{meaning}.{side}", name, attributes, inner(child), pair)
            else:
                walk(child)
            b.text(child.tail)

    walk(seg)
    return b


def tu_unit(tu: ET.Element, srclang: str, target_locale: str | None = None, mode: str = "full") -> dict:
    """One tu as a unit; its id is null where it has none."""
    found: list[tuple[str, Builder]] = []
    for tuv in tu:
        if local(tuv.tag) == "tuv":
            seg = next((e for e in tuv if local(e.tag) == "seg"), None)
            found.append((canonical(tuv.get(_LANG) or tuv.get("lang") or ""), _segment(seg) if seg is not None else Builder()))
    src = canonical(srclang) if srclang and srclang != "*all*" else ""
    base = lambda loc: loc.partition("-")[0]
    at = next((i for i, (loc, _) in enumerate(found) if loc == src), None)
    if at is None:
        at = next((i for i, (loc, _) in enumerate(found) if base(loc) == base(src)), 0 if found else None)
    out = unit(unit_id=tu.get("tuid") or None, source=found[at][1].plain if at is not None else "", source_locale=found[at][0] if at is not None else src or None)
    status, ext, comments, context = "unknown", {}, [], {}
    if mode != "text":
        for p in tu:
            name, value = local(p.tag), "".join(p.itertext())
            if name == "note" and mode == "full":
                comments.append({"context": value, "extensions": {}})
            if name != "prop":
                continue
            key = (p.get("type") or "").lower()
            plain = key.replace(" ", "_").replace("-", "_")
            if key in ("status", "x-status") or re.fullmatch(r"x-.*-status", key):
                status = TMX_STATUS.get(value.strip().lower(), status)
            elif mode == "full" and (m := re.fullmatch(r"(?:x_)?(prev|previous|next)_(id|source|target)", plain)):
                context[("next" if m[1] == "next" else "previous", m[2])] = value
            elif mode == "full":
                ext["domain" if plain in ("domain", "x_domain") else "project" if plain in ("project", "x_project") else f"property.{key}"] = value
    if mode == "full":
        out["meta"] = {v: tu.get(k) for k, v in _META.items()} | {"usage_count": int(tu.get("usagecount", "")) if (tu.get("usagecount") or "").isdigit() else None, "extensions": {}}
        ext |= {k: v for k in ("creationid", "changeid") if (v := tu.get(k))}
        for side in ("previous", "next"):
            got = {k: v for (s, k), v in context.items() if s == side}
            out[f"{side}_context"] = ({"unit_id": got.get("id"), "source": got.get("source"), "target": got.get("target"), "extensions": {}}) if got else None
    out |= {"status": status, "extensions": ext, "comments": comments}
    others = [(loc, b) for i, (loc, b) in enumerate(found) if i != at]
    own = found[at][1] if at is not None else Builder()
    chosen = None
    if target_locale is not None:
        wanted = canonical(target_locale)
        chosen = next((b for loc, b in others if loc == wanted), None) or next((b for loc, b in others if base(loc) == base(wanted)), None)
        out |= {"target": chosen.plain if chosen else None, "target_locale": wanted}
    else:
        out["targets"] = {loc: {"text": b.plain, "status": status, "tags": {"ties": b.ties, "parts": b.parts} if b.ties else None, "extensions": {}} for loc, b in others}
        out["target_locales"] = list(dict.fromkeys(loc for loc, _ in others))
    if own.ties or chosen and chosen.ties:
        out["tags"] = {"source_ties": own.ties, "source_parts": own.parts, "target_ties": chosen.ties if chosen else [], "target_parts": chosen.parts if chosen else []}
    return out


_BARE = json.JSONEncoder(ensure_ascii=False, check_circular=False).encode


def _elements(records: list[str]) -> Iterator[ET.Element]:
    """The tu elements of records that begin with <tu and lack the end tag, parsed together."""
    try:
        yield from ET.fromstring("<b>" + "".join(f"{r}</tu>" for r in records) + "</b>")
    except ET.ParseError:
        for r in records:  # tells which record is broken
            try:
                ET.fromstring(f"{r}</tu>")
            except ET.ParseError as e:
                raise ValueError(f"not a tu element ({e}): {r[:200]!r}") from e
        raise


def parse(content: bytes, target_locale: str | None = None, mode: str = "full", source_locale: str | None = None) -> list[dict]:
    """Units of a whole TMX file, whatever its encoding and prefixes."""
    return list(iter_units(io.BytesIO(content), target_locale, mode, source_locale))


def iter_units(f: IO[bytes], target_locale: str | None = None, mode: str = "full", source_locale: str | None = None) -> Iterator[dict]:
    """The same from a file that can seek, record by record."""
    head = None
    for e, above in elements(f, frozenset({"header"})):  # reads on to the first header, which is at the top
        if len(above) == 1:
            head = e
            break
    f.seek(0)
    srclang = source_locale or (head.get("srclang") if head is not None else None) or "*all*"
    n = auto = 0
    checked = False
    for tu, above in elements(f, frozenset({"tu"})):
        if not checked and local(above[0].tag if above else tu.tag) != "tmx":
            raise ValueError("not a TMX file")
        checked = True
        u = tu_unit(tu, srclang, target_locale, mode)
        if not u["unit_id"]:
            u["unit_id"], auto = f"auto_{auto}", auto + 1
        yield u | {"ordinal": n}
        n += 1
    if not checked:
        f.seek(0)
        if local(next(ET.iterparse(f, ("start",)))[1].tag) != "tmx":
            raise ValueError("not a TMX file")


def read(spark: SparkSession, path: str, source_locale: str | None = None, target_locale: str | None = None, mode: str = "full", splittable: bool = True) -> DataFrame:
    """Units of TMX files.

    Splittable scans need UTF-8 without a DTD of entities, unprefixed tags, and no </tu>
    in comments; read other files with ``splittable=False``.  ``ordinal`` is the place in
    the file; ids of units without one count those in order.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    if not splittable:
        return read_streams(spark, path, lambda f, _: iter_units(f, target_locale, mode, source_locale), ">")
    raw = spark.read.option("lineSep", "</tu>").text(path).select(F.regexp_extract("value", r"(?s)<tu(?:\s[^>]*)?>.*$", 0).alias("tu"), "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    # places in a file come from counts of its splits, so that no file has to go through one task; the driver gets
    # a row for each split, as it has for each task anyway
    start = F.regexp_extract("tu", r"^<tu[^>]*>", 0)
    unnamed = (F.col("tu") != "") & ~F.regexp_like(start, F.lit(r"\stuid\s*=\s*[\"'][^\"']"))
    head = F.max(F.when(F.col("value").contains("<header"), F.regexp_extract("value", r"<header[^>]*?\ssrclang=[\"']([^\"']*)", 1)))
    splits = raw.groupBy("path", "block").agg(F.count_if(F.col("tu") != "").alias("n"), F.count_if(unnamed).alias("unnamed"), head.alias("srclang")).collect()
    places, languages = [], {}
    at, first, auto = None, 0, 0
    for r in sorted(splits, key=lambda r: (r.path, r.block)):
        if r.path != at:
            at, first, auto = r.path, 0, 0
        places.append((r.path, r.block, first, auto))
        first, auto = first + r.n, auto + r.unnamed
        if r.srclang:
            languages[r.path] = r.srclang
    usual = max(sorted(set(languages.values())), key=list(languages.values()).count) if len(set(languages.values())) > 1 else next(iter(languages.values()), "*all*")
    others = {r.path: languages.get(r.path, "*all*") for r in splits if languages.get(r.path, "*all*") != usual}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        i = auto = 0
        for batch in batches:
            made, place, count = [], [], []
            names, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for tu, name, block in zip(_elements(batch.column(0).to_pylist()), names, blocks, strict=True):
                if (name, block) != at:
                    at, i, auto = (name, block), 0, 0
                u = tu_unit(tu, source_locale or others.get(name, usual), target_locale, mode)
                made.append(_BARE({k: v for k, v in u.items() if v is not None}))
                place.append(i)
                count.append(auto)
                i, auto = i + 1, auto + (not u["unit_id"])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), batch.column(1), batch.column(2), pa.array(place, pa.int64()), pa.array(count, pa.int64())], ["json", "path", "block", "i", "auto"])

    found = raw.where("tu <> ''").select("tu", "path", "block").mapInArrow(run, "json string, path string, block bigint, i bigint, auto bigint")
    of = spark.createDataFrame(places, "path string, block bigint, first bigint, first_auto bigint")
    units = found.select(F.from_json("json", UNIT_DDL).alias("u"), "path", "block", "i", "auto").join(of, ["path", "block"])
    own = {"doc_id": F.col("path"), "ordinal": F.col("first") + F.col("i"), "unit_id": F.coalesce("u.unit_id", F.concat(F.lit("auto_"), (F.col("first_auto") + F.col("auto")).cast("string")))}
    return units.select(*[own.get(c, F.col(f"u.{c}")).alias(c) for c in UNIT_COLUMNS])
