"""Inline codes of segments: validation, adaptation and rendering in several syntaxes."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYNTAXES = ("native", "html", "tmx", "xliff12", "xliff2", "plain")
POLICIES = ("error", "placeholder", "drop")
#: Meanings that have an HTML element.
_HTML = {"bold": "b", "italic": "i", "underline": "u", "em": "em", "strong": "strong", "code": "code", "sub": "sub", "sup": "sup", "link": "a", "span": "span", "break": "br", "image": "img"}
_VOID = {"br", "img", "wbr"}
_UNSAFE_ATTRIBUTE = re.compile(r"on\w+|style|xmlns.*", re.IGNORECASE)
_UNSAFE_URL = re.compile(r"\s*(javascript|vbscript|data):", re.IGNORECASE)


class InlineError(ValueError):
    pass


def escape(text: str, quotes: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if quotes else out


def text_of(parts: Sequence[dict]) -> str:
    return "".join(p["value"] for p in parts if p["kind"] == "text")


def adapted(text: str, parts: Sequence[dict] | None) -> list[dict]:
    """The parts, or the text alone if they no longer say it."""
    if parts and text_of(parts) == text:
        return list(parts)
    return [{"kind": "text", "value": text}] if text else []


def validate(parts: Sequence[dict], ties: Sequence[dict]) -> None:
    """Each code is referenced once and each half of a pair has the other."""
    known = {t["id"] for t in ties}
    seen: set[str] = set()
    for p in parts:
        if p["kind"] != "code":
            continue
        if p["value"] in seen:
            raise InlineError(f"code {p['value']!r} is there twice")
        if p["value"] not in known:
            raise InlineError(f"no such code: {p['value']!r}")
        seen.add(p["value"])
    if known - seen:
        raise InlineError(f"codes without a place: {sorted(known - seen)}")
    pairs: dict[str, int] = {}
    for t in ties:
        if t.get("pair_id"):
            pairs[t["pair_id"]] = pairs.get(t["pair_id"], 0) + 1
    half = sorted(k for k, n in pairs.items() if n != 2)
    if half:
        raise InlineError(f"half pairs: {half}")


def kind_of(tie: dict) -> tuple[str, str]:
    """(meaning, open | close | alone) of a tie's type such as bold.open."""
    meaning, _, side = (tie.get("type") or "custom.standalone").rpartition(".")
    return meaning or "custom", {"open": "open", "close": "close"}.get(side, "alone")


def _attributes(tie: dict, safe: bool) -> str:
    out = ""
    for k, v in sorted((tie.get("attributes") or {}).items()):
        if safe and (_UNSAFE_ATTRIBUTE.fullmatch(k) or k.lower() in ("href", "src") and _UNSAFE_URL.match(v or "")):
            continue
        out += f' {k}="{escape(v or "", True)}"'
    return out


def _code(tie: dict, syntax: str, numbers: dict[str, int], policy: str) -> str:
    meaning, side = kind_of(tie)
    if syntax == "native":
        return tie.get("original_text") or ""
    number = numbers[tie.get("pair_id") or tie["id"]]
    if syntax == "html":
        name = _HTML.get(meaning) or (tie.get("original_name") if tie.get("original_name") in _HTML.values() else None)
        if name is None:
            if policy == "error":
                raise InlineError(f"no HTML for {tie.get('type')!r}")
            return "" if policy == "drop" else f'<span data-code="{escape(tie["id"], True)}"></span>'
        if side == "close":
            return f"</{name}>"
        return f"<{name}{_attributes(tie, True)}>" if side == "open" or name in _VOID else f"<{name}{_attributes(tie, True)}></{name}>"
    native = escape(tie.get("original_text") or "")
    if syntax == "tmx":
        kind = f' type="{escape(meaning, True)}"' if meaning != "custom" else ""
        if side == "open":
            return f'<bpt i="{number}"{kind}>{native}</bpt>'
        return f'<ept i="{number}">{native}</ept>' if side == "close" else f'<ph x="{number}"{kind}>{native}</ph>'
    if syntax == "xliff12":
        kind = f' ctype="{escape(meaning, True)}"' if meaning != "custom" and side != "close" else ""
        return f'<{ {"open": "bx", "close": "ex"}.get(side, "x") } id="{escape(tie["id"], True)}"' + (f' rid="{number}"' if side != "alone" else "") + kind + "/>"
    if side == "close":
        opener = f' startRef="p{number}"'
        return f"<ec{opener}/>"
    return f'<sc id="p{number}"/>' if side == "open" else f'<ph id="{escape(tie["id"], True)}"/>'


def render(text: str, parts: Sequence[dict] | None, ties: Sequence[dict] | None, syntax: str, policy: str = "error") -> str:
    """A segment in a syntax; text is escaped, codes are spelled in that syntax."""
    if syntax not in SYNTAXES or policy not in POLICIES:
        raise InlineError(f"unknown syntax or policy: {syntax!r}, {policy!r}")
    if syntax == "plain":
        return text
    by_id = {t["id"]: t for t in ties or []}
    numbers: dict[str, int] = {}
    ordered = adapted(text, parts)
    for p in ordered:
        if p["kind"] == "code" and p["value"] in by_id:
            numbers.setdefault(by_id[p["value"]].get("pair_id") or p["value"], len(numbers) + 1)
    out = []
    for p in ordered:
        if p["kind"] == "text":
            out.append(escape(p["value"]))
        elif p["value"] in by_id:
            out.append(_code(by_id[p["value"]], syntax, numbers, policy))
        elif policy == "error":
            raise InlineError(f"no such code: {p['value']!r}")
    return "".join(out)


def render_udf(syntax: str, policy: str = "placeholder"):  # noqa: ANN201
    """A vectorized function of (text, parts, ties)."""

    @F.pandas_udf(T.StringType())  # type: ignore[call-overload]
    def run(text: pd.Series, rows: pd.DataFrame) -> pd.Series:
        def one(t: str | None, parts: object, ties: object) -> str | None:
            return None if t is None else render(t, [dict(p) for p in parts] if parts is not None else None, [dict(x) | {"attributes": dict(x["attributes"] or {})} for x in ties] if ties is not None else None, syntax, policy)  # type: ignore[attr-defined]

        return pd.Series([one(t, p, x) for t, p, x in zip(text, rows["parts"], rows["ties"], strict=True)], dtype="object")

    def column(text: Column, parts: Column, ties: Column) -> Column:
        return run(text, F.struct(parts.alias("parts"), ties.alias("ties")))

    return column


class Builder:
    """Collects the parts and ties of one segment."""

    def __init__(self) -> None:
        self.parts: list[dict] = []
        self.ties: list[dict] = []
        self.open: list[tuple[str, str]] = []
        self.pairs = 0

    def text(self, value: str | None) -> None:
        if not value:
            return
        if self.parts and self.parts[-1]["kind"] == "text":
            self.parts[-1]["value"] += value
        else:
            self.parts.append({"kind": "text", "value": value})

    def code(self, kind: str, name: str, attributes: dict[str, str], original: str | None = None, pair: str | None = None) -> None:
        n = len(self.ties) + 1
        if kind == "custom.close":  # a closing code means what its opening one does
            kind = next((t["type"].rpartition(".")[0] + ".close" for t in self.ties if pair is not None and t["pair_id"] == pair), kind)
        self.ties.append({"id": f"c{n}", "type": kind, "attributes": attributes, "attribute_data": None, "position": sum(len(p["value"]) for p in self.parts if p["kind"] == "text"), "ord": n - 1, "pair_id": pair, "original_name": name, "original_text": original})
        self.parts.append({"kind": "code", "value": f"c{n}"})

    def new_pair(self) -> str:
        self.pairs += 1
        return f"p{self.pairs}"

    @property
    def plain(self) -> str:
        return text_of(self.parts)
