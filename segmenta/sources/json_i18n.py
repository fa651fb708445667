"""JSON resource files: string leaves with dotted keys."""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.text import header_locale
from segmenta.schema import unit
from segmenta.sources.common import read_streams, units_frame


class _Pairs(list):
    """An object as its pairs, so that repeated keys and their order stay."""


def _load(text: str) -> object:
    return json.loads(text, object_pairs_hook=_Pairs)


def flatten(tree: object) -> list[tuple[str, str, list[str]]]:
    """(key, text, path) of each string leaf; a key that is taken gets #2, #3, ..."""
    out: list[tuple[str, str, list[str]]] = []
    used: set[str] = set()

    def walk(node: object, path: list[str]) -> None:
        if isinstance(node, _Pairs):
            for k, v in node:
                walk(v, [*path, k])
        elif isinstance(node, str) and path:
            key, n = ".".join(path), 1
            name = key
            while name in used:
                n += 1
                name = f"{key}#{n}"
            used.add(name)
            out.append((name, node, path))

    walk(tree, [])
    return out


def nest(entries: list[tuple[list[str], str]]) -> dict:
    """Paths and texts as nested objects, in order; a text gives way to an object at the same place."""
    root: dict = {}
    for path, text in entries:
        at = root
        for k in path[:-1]:
            if not isinstance(at.get(k), dict):
                at[k] = {}
            at = at[k]
        at[path[-1]] = text
    return root


def locales_of(tree: object) -> list[str]:
    """The locales of a multilingual file: two or more root keys, all language tags with objects."""
    if not isinstance(tree, _Pairs) or len(tree) < 2:
        return []
    names = [k for k, v in tree if header_locale(k) and isinstance(v, _Pairs)]
    return names if len(names) == len(tree) else []


def _unit(key: str, source: str, path: list[str], targets: dict[str, str], target_locale: str | None, source_locale: str | None) -> dict:
    made = {k: {"text": v, "status": "translated"} for k, v in targets.items()}
    out = unit(unit_id=key, source=source, source_locale=source_locale, extensions={"json_path": json.dumps(path)})
    if target_locale is not None:
        return out | {"target": targets.get(target_locale), "target_locale": target_locale, "status": "translated" if target_locale in targets else "new"}
    return out | {"targets": made, "target_locales": list(targets)}


def parse(text: str, source_locale: str | None = None, target_locale: str | None = None, target_texts: dict[str, str] | None = None) -> list[dict]:
    """Units of a resource file, of a multilingual one, or of one with files of translations."""
    tree = _load(text)
    names = locales_of(tree)
    others: dict[str, dict[str, str]] = {}
    if names:
        by = {k: flatten(v) for k, v in tree}  # type: ignore[union-attr]
        first = next((n for n in names if source_locale and header_locale(n) == header_locale(source_locale)), names[0])
        leaves_, source_locale = by[first], header_locale(first)
        others = {header_locale(n): {k: t for k, t, _ in by[n]} for n in names if n != first}
    else:
        leaves_ = flatten(tree)
    for name, body in (target_texts or {}).items():
        others[name] = {k: t for k, t, _ in flatten(_load(body))}
    return [_unit(k, s, path, {loc: t[k] for loc, t in others.items() if k in t}, target_locale, source_locale) for k, s, path in leaves_]


_BLANK = re.compile(r"[ \t\r\n]*")
_decode = json.JSONDecoder().raw_decode
#: A member with a text, both without escapes, and what comes after it: most members are such.
_PLAIN = re.compile(r'[ \t\r\n]*"([^"\\\x00-\x1f]*)"[ \t\r\n]*:[ \t\r\n]*"([^"\\\x00-\x1f]*)"[ \t\r\n]*([,}])')


def _streamed(f: IO[bytes]) -> Iterator[tuple[list[str] | None, str, str, int]]:
    """(path, text, raw, place) of each string leaf of a file: raw is all since the leaf before it, with the leaf itself from ``place``.

    The last has no path, and the rest of the file as raw.
    """
    reader = codecs.getreader("utf-8-sig")(f)
    text, begin, at, ended = "", 0, 0, False

    def more() -> None:
        nonlocal text, begin, at, ended
        got = reader.read(1 << 20)
        ended = not got
        text, begin, at = text[begin:] + got, 0, at - begin

    def peek() -> str:
        nonlocal at
        while (at := _BLANK.match(text, at).end()) == len(text) and not ended:  # type: ignore[union-attr]
            more()
        return text[at : at + 1]

    def value() -> object:
        nonlocal at
        peek()
        while True:
            try:
                out, end = _decode(text, at)
                if end < len(text) or ended:
                    at = end
                    return out
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    def mark(allowed: str) -> str:
        nonlocal at
        if peek() not in tuple(allowed):
            raise ValueError(f"no JSON: one of {allowed} is missing")
        at += 1
        return text[at - 1]

    path: list[str] = []
    inside = peek() == "{"
    if inside:
        at += 1
    else:
        value()
    fresh = inside
    while inside:
        if m := _PLAIN.match(text, at):
            raw, place = text[begin : m.end(2) + 1], m.start(2) - 1 - begin
            begin, at, fresh = m.end(2) + 1, m.end(), False
            yield [*path, m[1]], m[2], raw, place
            if m[3] == ",":
                continue
        elif fresh and peek() == "}":
            at += 1
        else:
            name = value()
            if not isinstance(name, str):
                raise ValueError("no JSON: a name is missing")
            mark(":")
            path.append(name)
            kind = peek()
            if kind == "{":
                at += 1
                fresh = True
                continue
            place = at - begin
            found = value()
            if kind == '"':
                yield list(path), found, text[begin:at], place  # type: ignore[misc]
                begin = at
            path.pop()
            fresh = False
            if mark(",}") == ",":
                continue
        # an object has ended, and those round it that end with it
        while True:
            fresh = False
            if not path:
                inside = False
                break
            path.pop()
            if mark(",}") == ",":
                break
    if peek():
        raise ValueError("no JSON: there is more after the end")
    yield None, "", text[begin:], 0


def _multilingual(f: IO[bytes]) -> bool:
    """Whether the root's members are all locales with objects, two at least; it reads on to the first that isn't."""
    reader = codecs.getreader("utf-8-sig")(f)
    head = reader.read(1 << 10)
    m = re.match(r"""\s*\{\s*("(?:[^"\\]|\\.)*")\s*:\s*(.)""", head, re.DOTALL)
    f.seek(0)
    if m is None and len(head) < 1 << 10 or m is not None and (m[2] != "{" or not header_locale(json.loads(m[1]))):
        return False
    return bool(locales_of(_load(f.read().decode("utf-8-sig"))))


def _base(key: str) -> str | None:
    """The key that #2, #3, ... was put to."""
    base, _, n = key.rpartition("#")
    return base if n.isdigit() else None


def named_leaves(f: IO[bytes]) -> Iterator[tuple[str | None, str, list[str], str, int]]:
    """(key, text, path, raw, place) of the leaves of a file that can seek, with the keys of ``flatten``; the last has no key.

    What is kept is a number of 8 bytes for each leaf, and the keys that are repeated.
    """
    hashes = array("q", (hash(".".join(path)) for path, *_ in _streamed(f) if path))
    found, n = np.unique(np.frombuffer(hashes, np.int64), return_counts=True)
    repeated = set(found[n > 1].tolist())
    used: set[str] = set()
    f.seek(0)
    for path, text, raw, place in _streamed(f):
        if path is None:
            yield None, "", [], raw, 0
            return
        key = name = ".".join(path)
        root: str | None = key
        while repeated and root is not None and hash(root) not in repeated:
            root = _base(root)
        if repeated and root is not None:
            i = 1
            while name in used:
                i += 1
                name = f"{key}#{i}"
            used.add(name)
        yield name, text, path, raw, place


def iter_units(f: IO[bytes], source_locale: str | None = None, target_locale: str | None = None) -> Iterator[dict]:
    """Units of a file that can seek as ``parse`` gives them, one by one; a multilingual file is parsed whole."""
    if _multilingual(f):
        f.seek(0)
        yield from parse(f.read().decode("utf-8-sig"), source_locale, target_locale)
        return
    f.seek(0)
    for key, text, path, _, _ in named_leaves(f):
        if key is not None:
            yield _unit(key, text, path, {}, target_locale, source_locale)


def leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key column, key, value) of the string leaves of a JSON column; what isn't JSON has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame[key], frame[column], strict=True):
                try:
                    found = flatten(_load(text)) if text is not None else []
                except ValueError:
                    found = []
                out += [(i, k, v) for k, v, _ in found]
            yield pd.DataFrame(out, columns=[key, "key", "value"])

    return rows.select(F.col(key).cast("bigint").alias(key), column).mapInPandas(run, f"{key} bigint, key string, value string")


def at_path(column: str, path: list[str]) -> Column:
    """The value at a path of keys in a JSON column, as text."""
    return F.get_json_object(column, "$" + "".join(f"['{k}']" for k in path))


def with_targets(units: DataFrame, translations: dict[str, DataFrame], target_locale: str | None = None) -> DataFrame:
    """Units with translations joined on the left by key; of a repeated key the first by text counts.

    A translation has unit_id and source, which is its text.  With ``target_locale`` the
    one of that locale becomes the single target; else all go into ``targets``.
    """
    kind = units.schema["targets"].dataType
    texts = F.create_map().cast("map<string,string>")
    out = units.withColumn("_texts", texts)
    for locale, rows in translations.items():
        t = rows.groupBy("unit_id").agg(F.min("source").alias("_t"))
        out = out.join(t, "unit_id", "left").withColumn("_texts", F.when(F.col("_t").isNotNull(), F.map_concat("_texts", F.create_map(F.lit(locale), F.col("_t")))).otherwise(F.col("_texts"))).drop("_t")
    if target_locale is not None:
        one = F.try_element_at("_texts", F.lit(target_locale))
        return out.withColumn("target", one).withColumn("target_locale", F.lit(target_locale)).withColumn("status", F.when(one.isNotNull(), "translated").otherwise("new")).drop("_texts").select(*units.columns)
    given = {"text": lambda v: v, "status": lambda _: F.lit("translated")}
    made = F.transform_values("_texts", lambda _, v: F.struct(*[given.get(f.name, lambda _: F.lit(None))(v).cast(f.dataType).alias(f.name) for f in kind.valueType.fields]))
    own = F.map_filter("targets", lambda k, _: ~F.map_contains_key("_texts", k))
    named = F.array_union(F.coalesce("target_locales", F.array().cast("array<string>")), F.map_keys("_texts"))
    return out.withColumn("target_locales", named).withColumn("targets", F.map_concat(own, made)).drop("_texts").select(*units.columns)


def read(spark: SparkSession, path: str, source_locale: str | None = None, target_locale: str | None = None, target_paths: dict[str, str] | None = None) -> DataFrame:
    """Units of JSON files; translations in other files are joined by key."""
    if not target_paths:
        return read_streams(spark, path, lambda f, _: iter_units(f, source_locale, target_locale), '"')
    units = read_streams(spark, path, lambda f, _: iter_units(f, source_locale), '"')
    others = {loc: read_streams(spark, p, lambda f, _: iter_units(f), '"') for loc, p in target_paths.items()}
    return with_targets(units, others, target_locale)


__all__ = ["flatten", "leaves", "nest", "parse", "read", "units_frame"]
