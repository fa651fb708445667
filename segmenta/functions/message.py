"""ICU message patterns: text, {argument}, select, plural and selectordinal."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions.plural import plural_category

MAX_DEPTH = 64
MAX_LENGTH = 1_000_000
#: ("text", s) | ("arg", name) | ("pound",) | ("select" | "plural" | "selectordinal", name, offset, {key: nodes})
Node = tuple


class MessageError(ValueError):
    pass


class _Parser:
    def __init__(self, pattern: str, max_depth: int, max_length: int) -> None:
        if len(pattern) > max_length:
            raise MessageError("the pattern is too long")
        self.s, self.at, self.deepest = pattern, 0, max_depth

    def fail(self, what: str) -> MessageError:
        return MessageError(f"{what} at {self.at}")

    def blank(self) -> None:
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1

    def word(self) -> str:
        self.blank()
        begin = self.at
        while self.at < len(self.s) and self.s[self.at] not in "{},#'" and not self.s[self.at].isspace():
            self.at += 1
        if begin == self.at:
            raise self.fail("a name is missing")
        out = self.s[begin : self.at]
        self.blank()
        return out

    def expect(self, c: str) -> None:
        if self.s[self.at : self.at + 1] != c:
            raise self.fail(f"{c!r} is missing")
        self.at += 1

    def nodes(self, depth: int, counted: bool) -> tuple[Node, ...]:
        if depth > self.deepest:
            raise self.fail("nested too deeply")
        out: list[Node] = []
        text = ""
        while self.at < len(self.s) and self.s[self.at] != "}":
            c = self.s[self.at]
            if c == "'":
                following = self.s[self.at + 1 : self.at + 2]
                if following == "'":
                    text += "'"
                    self.at += 2
                elif following and following in ("{}#|" if counted else "{}|"):
                    self.at += 1
                    while self.at < len(self.s):
                        if self.s[self.at] == "'":
                            if self.s[self.at + 1 : self.at + 2] != "'":
                                break
                            self.at += 1
                        text += self.s[self.at]
                        self.at += 1
                    self.at += 1
                else:
                    text += "'"
                    self.at += 1
                continue
            if c == "{" or c == "#" and counted:
                if text:
                    out.append(("text", text))
                    text = ""
                self.at += 1
                out.append(("pound",) if c == "#" else self.argument(depth))
                continue
            text += c
            self.at += 1
        if text:
            out.append(("text", text))
        return tuple(out)

    def argument(self, depth: int) -> Node:
        name = self.word()
        if self.s[self.at : self.at + 1] == "}":
            self.at += 1
            return ("arg", name)
        self.expect(",")
        kind = self.word()
        if kind not in ("select", "plural", "selectordinal"):
            level = 0
            while self.at < len(self.s) and (level or self.s[self.at] != "}"):
                level += {"{": 1, "}": -1}.get(self.s[self.at], 0)
                self.at += 1
            self.expect("}")
            return ("arg", name)
        self.expect(",")
        self.blank()
        offset, cases = Decimal(0), {}
        if kind != "select" and self.s.startswith("offset:", self.at):
            self.at += 7
            offset = Decimal(self.word())
        while self.s[self.at : self.at + 1] != "}":
            key = self.word()
            if key in cases:
                raise self.fail(f"{key!r} is there twice")
            self.expect("{")
            cases[key] = self.nodes(depth + 1, kind != "select")
            self.expect("}")
            self.blank()
        self.at += 1
        if "other" not in cases:
            raise self.fail("the case 'other' is missing")
        return (kind, name, offset, cases)

    def whole(self) -> tuple[Node, ...]:
        out = self.nodes(0, False)
        if self.at != len(self.s):
            raise self.fail("a brace too many")
        return out


@lru_cache(maxsize=1024)
def parse_message(pattern: str, max_depth: int = MAX_DEPTH, max_length: int = MAX_LENGTH) -> tuple[Node, ...]:
    return _Parser(pattern, max_depth, max_length).whole()


def _plain(d: Decimal) -> str:
    return format(d.normalize() if d == d.to_integral_value() else d, "f")


def _render(nodes: tuple[Node, ...], arguments: Mapping[str, object], locale: str, number: str | None) -> str:
    out = []
    for node in nodes:
        if node[0] == "text":
            out.append(node[1])
        elif node[0] == "pound":
            out.append(number or "")
        else:
            if node[1] not in arguments:
                raise MessageError(f"no argument {node[1]!r}")
            value = arguments[node[1]]
            if node[0] == "arg":
                out.append("" if value is None else str(value))
            elif node[0] == "select":
                out.append(_render(node[3].get(str(value), node[3]["other"]), arguments, locale, number))
            else:
                try:
                    exactly = Decimal(str(value))
                except ArithmeticError as e:
                    raise MessageError(f"{node[1]!r} is not a number") from e
                shown = str(value) if not node[2] else _plain(exactly - node[2])
                chosen = next((v for k, v in node[3].items() if k[0] == "=" and Decimal(k[1:]) == exactly), None)
                if chosen is None:
                    chosen = node[3].get(plural_category(locale, shown, node[0] == "selectordinal"), node[3]["other"])
                out.append(_render(chosen, arguments, locale, shown))
    return "".join(out)


def format_message(pattern: str, arguments: Mapping[str, object], locale: str) -> str:
    """The pattern with its arguments; number and date formats just spell the value."""
    return _render(parse_message(pattern), arguments, locale, None)


def message_udf() -> Callable[[Column, Column, Column], Column]:
    """A vectorized function of (pattern, map of arguments, locale); null for patterns that fail."""

    @F.pandas_udf(T.StringType())  # type: ignore[call-overload]
    def run(pattern: pd.Series, arguments: pd.Series, locale: pd.Series) -> pd.Series:
        def one(p: str | None, a: object, loc: str | None) -> str | None:
            try:
                return None if p is None or loc is None else format_message(p, dict(a or {}), loc)  # type: ignore[call-overload]
            except MessageError:
                return None

        return pd.Series([one(p, a, x) for p, a, x in zip(pattern, arguments, locale, strict=True)], dtype="object")

    return run
