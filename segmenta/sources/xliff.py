"""XLIFF 1.2 and 2.x."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.functions.inline import Builder
from segmenta.functions.text import XLIFF_STATUS
from segmenta.plans.shared import scratch
from segmenta.schema import UNIT_COLUMNS, unit, unit_type
from segmenta.sources.common import elements, local, read_streams

_CONTAINERS = {"g", "mrk", "sub", "pc"}
_OPEN, _CLOSE = {"bpt", "bx", "sc"}, {"ept", "ex", "ec"}
_HINTS = {"bold": "bold", "x-bold": "bold", "fmt:bold": "strong", "italic": "italic", "x-italic": "italic", "fmt:italic": "em", "b": "bold", "i": "italic", "underlined": "underline", "link": "link", "image": "image", "lb": "break"}


def _meaning(e: ET.Element) -> str:
    hint = (e.get("ctype") or e.get("type") or "").lower()
    return _HINTS.get(hint, hint.replace(":", "_").replace(".", "_") or "custom")


def segment(e: ET.Element | None) -> Builder:
    b, pairs = Builder(), {}

    def walk(x: ET.Element) -> None:
        b.text(x.text)
        for c in x:
            name, attributes = local(c.tag), {local(k): v for k, v in c.attrib.items()}
            if name in _CONTAINERS:
                pair = b.new_pair()
                b.code(f"{_meaning(c)}.open", name, attributes, None, pair)
                walk(c)
                b.code(f"{_meaning(c)}.close", name, {}, None, pair)
            elif name in _OPEN | _CLOSE:
                key = c.get("rid") or c.get("startRef") or c.get("id") or ""
                pair = pairs.setdefault(key, None) or b.new_pair()
                pairs[key] = pair
                b.code(f"{_meaning(c)}.{'open' if name in _OPEN else 'close'}", name, attributes, "".join(c.itertext()) or None, pair)
            else:
                b.code(f"{_meaning(c)}.standalone", name, attributes, "".join(c.itertext()) or None)
            b.text(c.tail)

    if e is not None:
        walk(e)
    return b


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if local(c.tag) == name), None)


def _made(unit_id: str, source: ET.Element | None, target: ET.Element | None, state: str | None, notes: list[str], source_locale: str | None, locale: str | None, resource: str | None) -> dict:
    s, t = segment(source), segment(target)
    status = XLIFF_STATUS.get(state or "", "new" if target is None and state is None else "unknown")
    tags = {"source_ties": s.ties, "source_parts": s.parts, "target_ties": t.ties, "target_parts": t.parts} if s.ties or t.ties else None
    return unit(unit_id=unit_id, source=s.plain, target=t.plain if target is not None else None, status=status, source_locale=source_locale, target_locale=locale, tags=tags, comments=[{"context": n, "extensions": {}} for n in notes], extensions={"resource": resource} if resource else {})


def iter_raw(f: IO[bytes]) -> Iterator[dict]:
    """Units of a document one by one, before those of one id merge."""
    files, last, checked = -1, None, False
    for u, above in elements(f, frozenset({"trans-unit", "unit"})):
        root = above[0] if above else u
        if not checked and local(root.tag) != "xliff":
            raise ValueError("not an XLIFF file")
        checked = True
        two = (root.get("version") or "").startswith("2")
        if len(above) < 2 or local(above[1].tag) != "file" or local(u.tag) != ("unit" if two else "trans-unit"):
            continue
        file = above[1]
        if file is not last:
            files, last = files + 1, file
        if two:
            holder = _child(u, "notes")
            notes = ["".join(n.itertext()) for n in [*u, *(holder if holder is not None else [])] if local(n.tag) == "note"]
            for k, s in enumerate(e for e in u if local(e.tag) == "segment"):
                state = {"initial": "new", "translated": "translated", "reviewed": "needs-review-l10n", "final": "final"}.get(s.get("state") or "")
                yield _made(f"{u.get('id')}:{s.get('id') or k}", _child(s, "source"), _child(s, "target"), state, notes, root.get("srcLang"), root.get("trgLang"), file.get("original"))
            continue
        target = _child(u, "target")
        notes = ["".join(n.itertext()) for n in u if local(n.tag) == "note"]
        yield _made(u.get("id") or str(files), _child(u, "source"), target, target.get("state") if target is not None else None, notes, file.get("source-language"), file.get("target-language"), file.get("original"))
    if not checked:
        f.seek(0)
        if local(next(ET.iterparse(f, ("start",)))[1].tag) != "xliff":
            raise ValueError("not an XLIFF file")


def parse(content: bytes) -> list[dict]:
    """Units of a document.

    Units of one id merge (first source wins); where the files of a document have several
    target locales, targets go into the map, else they stay single.
    """
    raw = list(iter_raw(io.BytesIO(content)))
    locales = list(dict.fromkeys(u["target_locale"] for u in raw if u["target_locale"]))
    out: dict[str, dict] = {}
    for u in raw:
        had = out.setdefault(u["unit_id"], u | {"ordinal": len(out)})
        if len(locales) > 1:
            if had is not u and not had["targets"]:
                had["targets"] = {}
            if u["target"] is not None and u["target_locale"]:
                had["targets"] = had["targets"] | {u["target_locale"]: {"text": u["target"], "status": u["status"], "tags": {"ties": u["tags"]["target_ties"], "parts": u["tags"]["target_parts"]} if u["tags"] else None, "extensions": {}}}
        elif had["target"] is None:
            had["target"] = u["target"]
        had["source"] = had["source"] or u["source"]
        had["comments"] = had["comments"] or u["comments"]
    if len(locales) > 1:
        for u in out.values():
            u |= {"target": None, "target_locale": None, "target_locales": [x for x in locales if x in u["targets"]]}
    return list(out.values())


def read(spark: SparkSession, path: str) -> DataFrame:
    """Units of XLIFF files; one task streams a whole file, as units need the file element round them, and a shuffle merges them by id."""
    folder = f"{scratch(spark)}/raw"
    read_streams(spark, path, lambda f, _: iter_raw(f), ">").write.parquet(folder)
    return merged(spark.read.parquet(folder))


def merged(raw: DataFrame) -> DataFrame:
    """Units of documents, as ``parse`` merges them, from those of ``iter_raw`` with their places as ordinals."""
    key = ["doc_id", "unit_id"]
    types = {f.name: f.dataType for f in unit_type().fields}
    named = raw.where("target_locale <> ''")
    locales = named.groupBy("doc_id", "target_locale").agg(F.min("ordinal").alias("o")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "target_locale"))), lambda x: x["target_locale"]).alias("locales"))
    fields = {"text": "target", "status": "status"}
    have = F.struct("target", "status", F.when(F.col("tags").isNotNull(), F.struct(F.col("tags.target_ties").alias("ties"), F.col("tags.target_parts").alias("parts"))).alias("tags"))
    of = named.where("target IS NOT NULL").groupBy(*key, "target_locale").agg(F.max_by(have, "ordinal").alias("v"), F.min("ordinal").alias("o"))
    kind = types["targets"].valueType  # type: ignore[attr-defined]
    value = lambda v: F.struct(*[(v[fields.get(f.name, f.name)] if f.name in ("text", "status", "tags") else F.create_map() if f.name == "extensions" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    entries = of.groupBy(*key).agg(F.collect_list(F.struct("o", F.col("target_locale").alias("k"), value(F.col("v")).alias("v"))).alias("e"))
    made = entries.select(*key, F.map_from_entries(F.transform(F.array_sort("e", lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))).alias("_targets"))
    first = lambda name, there: F.min_by(name, F.when(there, F.col("ordinal"))).alias(f"_{name}")
    units = raw.groupBy(*key).agg(
        F.min_by(F.struct(*[c for c in UNIT_COLUMNS if c not in key]), "ordinal").alias("u"), F.min("ordinal").alias("_o"),
        first("source", F.col("source") != ""), first("target", F.col("target").isNotNull()), first("comments", F.size("comments") > 0),
    )
    places = units.select(*key, (F.row_number().over(Window.partitionBy("doc_id").orderBy("_o")) - 1).cast("bigint").alias("_place"))
    all_ = units.join(places, key).join(made, key, "left").join(F.broadcast(locales), "doc_id", "left")
    several = F.coalesce(F.size("locales") > 1, F.lit(False))
    empty = F.create_map().cast(types["targets"])
    own = {
        "doc_id": F.col("doc_id"), "unit_id": F.col("unit_id"), "ordinal": F.col("_place"),
        "source": F.coalesce("_source", "u.source"), "comments": F.coalesce("_comments", "u.comments"),
        "target": F.when(~several, F.col("_target")), "target_locale": F.when(~several, F.col("u.target_locale")),
        "targets": F.when(several, F.coalesce("_targets", empty)).otherwise(F.col("u.targets")),
        "target_locales": F.when(several, F.filter("locales", lambda x: F.map_contains_key(F.coalesce("_targets", empty), x))).otherwise(F.col("u.target_locales")),
    }
    return all_.select(*[own.get(c, F.col(f"u.{c}")).cast(types[c]).alias(c) for c in UNIT_COLUMNS])
