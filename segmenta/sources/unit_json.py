"""The engine's own JSON: a document with all its units, and units as lines."""

from __future__ import annotations

import codecs
import io
import json
import re
from array import array
from collections.abc import Iterator
from typing import IO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.schema import CATEGORIES, STATUSES, UNIT_COLUMNS, unit
from segmenta.sources.common import read_streams

FORMAT_VERSION = 1


def member(u: dict) -> str:
    """One member of ``data``."""
    return f"{json.dumps(u['unit_id'] if u['unit_id'] is not None else 'null', ensure_ascii=False)}: {json.dumps({k: v for k, v in u.items() if k != 'unit_id' and v not in (None, {}, [])}, ensure_ascii=False)}"


def dump(units: list[dict], **header: object) -> str:
    """A document: header fields, then ``data`` by unit id in order."""
    data = {u["unit_id"]: {k: v for k, v in u.items() if k != "unit_id" and v not in (None, {}, [])} for u in units}
    return json.dumps({"format_version": FORMAT_VERSION, **header, "data": data}, ensure_ascii=False)


def parse(text: str) -> list[dict]:
    return list(iter_units(io.BytesIO(text.encode())))


_BLANK = re.compile(r"[ \t\r\n]*")
_decode = json.JSONDecoder().raw_decode


def _members(f: IO[bytes]) -> Iterator[tuple[str, str | None, object]]:
    """(name, None, value) of the document's members; of ``data`` each of its members (name, id, value), read one by one."""
    reader = codecs.getreader("utf-8-sig")(f)
    text, at, ended = "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        got = reader.read(1 << 20)
        ended = not got
        text, at = text[at:] + got, 0

    def value() -> object:
        nonlocal at
        while True:
            at = _BLANK.match(text, at).end()  # type: ignore[union-attr]
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
        while (at := _BLANK.match(text, at).end()) == len(text) and not ended:  # type: ignore[union-attr]
            more()
        if text[at : at + 1] not in tuple(allowed):
            raise ValueError(f"no JSON: one of {allowed} is missing")
        at += 1
        return text[at - 1]

    def inside() -> Iterator[str]:
        """The names of an object's members; the caller takes the value of each."""
        nonlocal at
        mark("{")
        while (at := _BLANK.match(text, at).end()) == len(text) and not ended:  # type: ignore[union-attr]
            more()
        if text[at : at + 1] == "}":
            at += 1
            return
        while True:
            name = value()
            if not isinstance(name, str):
                raise ValueError("no JSON: a name is missing")
            mark(":")
            yield name
            if mark(",}") == "}":
                return

    for name in inside():
        if name == "data":
            for key in inside():
                yield name, key, value()
        else:
            yield name, None, value()


def iter_units(f: IO[bytes]) -> Iterator[dict]:
    """Units of a document in a file that can seek, one by one; of equal ids the last counts, at the place of the first."""
    hashes, version = array("q"), None
    for name, key, v in _members(f):
        if key is not None:
            hashes.append(hash(key))
        elif name == "format_version":
            version = v
    if version != FORMAT_VERSION:
        raise ValueError("unknown format_version")
    found, n = np.unique(np.frombuffer(hashes, np.int64), return_counts=True)
    repeated = set(found[n > 1].tolist())
    last: dict[str, object] = {}
    if repeated:
        f.seek(0)
        last = {key: v for _, key, v in _members(f) if key is not None and hash(key) in repeated}
    f.seek(0)
    i = 0
    for _, key, v in _members(f):
        if key is None:
            continue
        if hash(key) in repeated:
            if key not in last:
                continue
            v = last.pop(key)
        u = unit(unit_id=key, **{x: y for x, y in v.items() if x in UNIT_COLUMNS})  # type: ignore[attr-defined]
        if u["status"] not in STATUSES or u["plural"] and u["plural"].get("category") not in (None, *CATEGORIES):  # type: ignore[attr-defined]
            raise ValueError(f"unit {key!r} has an unknown status or category")
        yield u | {"ordinal": i}
        i += 1


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_streams(spark, path, lambda f, _: iter_units(f), '"')


def lines(units: DataFrame, fields: tuple[str, ...] = ("unit_id", "source", "target")) -> DataFrame:
    """One JSON object for each unit with the chosen fields, nulls kept."""
    unknown = set(fields) - set(UNIT_COLUMNS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return units.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(units: DataFrame, path: str, fields: tuple[str, ...] = ("unit_id", "source", "target")) -> None:
    lines(units.orderBy("doc_id", "ordinal"), fields).write.mode("overwrite").text(path)
