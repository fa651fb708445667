"""Plural categories of CLDR 48, evaluated in Python or compiled to Column expressions.

A rule is written with ``|`` between alternatives and ``&`` between conditions; a
condition is an operand, a modulus if any, ``=`` or ``!``, and values or ranges.
Operands: n the absolute value, i its integer digits, v and f the number and value
of visible fraction digits, w and t the same without trailing zeros, e the exponent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MILLION = "many: e=0 & i!0 & i%1000000=0 & v=0 | e!0-5"
_SLAVIC_F = "one: v=0 & i%10=1 & i%100!11 | f%10=1 & f%100!11"
_CARDINAL = f"""
one: n=1 : af an asa az bal bem bez bg brx ce cgg chr ckb dv ee el eo eu fo fur gsw ha haw hu jgo jmc ka kaj kcg kk kkj kl ks ksb ku ky lb lg mas mgo ml mn mr nah nb nd ne nn nnh no nr ny nyn om or os pap ps rm rof rwk saq sd sdh seh sn so sq ss ssy st syr ta te teo tig tk tn tr ts ug uz ve vo vun wae xh xog
one: n=0-1 : ak bho csw guw ln mg nso pa ti wa
one: i=0 | n=1 : am as bn doi fa gu hi kn kok kok-latn pcm zu
zero: n=0 ; one: n=1 ; two: n=2 ; few: n%100=3-10 ; many: n%100=11-99 : ar ars
one: i=1 & v=0 : ast de en et fi fy gl ia ie io ji lij nl sc sv sw ur yi
one: n%10=1 & n%100!11 ; few: n%10=2-4 & n%100!12-14 ; many: n%10=0 | n%10=5-9 | n%100=11-14 : be
zero: n=0 ; one: n=1 : blo cv ksh
: bm bo dz hnj id ig ii in ja jbo jv jw kde kea km ko lkt lo ms my nqo osa root sah ses sg su th to tpi vi wo yo yue zh
one: n%10=1 & n%100!11,71,91 ; two: n%10=2 & n%100!12,72,92 ; few: n%10=3-4,9 & n%100!10-19,70-79,90-99 ; many: n!0 & n%1000000=0 : br
{_SLAVIC_F} ; few: v=0 & i%10=2-4 & i%100!12-14 | f%10=2-4 & f%100!12-14 : bs hr sh sr
one: i=1 & v=0 ; {_MILLION} : ca it lld pt-pt scn vec
one: v=0 & i=1-3 | v=0 & i%10!4,6,9 | v!0 & f%10!4,6,9 : ceb fil tl
one: i=1 & v=0 ; few: i=2-4 & v=0 ; many: v!0 : cs sk
zero: n=0 ; one: n=1 ; two: n=2 ; few: n=3 ; many: n=6 : cy
one: n=1 | t!0 & i=0,1 : da
one: v=0 & i%100=1 | f%100=1 ; two: v=0 & i%100=2 | f%100=2 ; few: v=0 & i%100=3-4 | f%100=3-4 : dsb hsb
one: n=1 ; {_MILLION} : es
one: i=0,1 : ff hy kab
one: i=0,1 ; {_MILLION} : fr
one: n=1 ; two: n=2 ; few: n=3-6 ; many: n=7-10 : ga
one: n=1,11 ; two: n=2,12 ; few: n=3-10,13-19 : gd
one: v=0 & i%10=1 ; two: v=0 & i%10=2 ; few: v=0 & i%100=0,20,40,60,80 ; many: v!0 : gv
one: i=1 & v=0 | i=0 & v!0 ; two: i=2 & v=0 : he iw
one: t=0 & i%10=1 & i%100!11 | t%10=1 & t%100!11 : is
one: n=1 ; two: n=2 : iu naq sat se sma smi smj smn sms
zero: n=0 ; one: n=1 ; two: n%100=2,22,42,62,82 | n%1000=0 & n%100000=1000-20000,40000,60000,80000 | n!0 & n%1000000=100000 ; few: n%100=3,23,43,63,83 ; many: n!1 & n%100=1,21,41,61,81 : kw
zero: n=0 ; one: i=0,1 & n!0 : lag
one: n%10=1 & n%100!11-19 ; few: n%10=2-9 & n%100!11-19 ; many: f!0 : lt
zero: n%10=0 | n%100=11-19 | v=2 & f%100=11-19 ; one: n%10=1 & n%100!11 | v=2 & f%10=1 & f%100!11 | v!2 & f%10=1 : lv prg
{_SLAVIC_F} : mk
one: i=1 & v=0 ; few: v!0 | n=0 | n!1 & n%100=1-19 : mo ro
one: n=1 ; two: n=2 ; few: n=0 | n%100=3-10 ; many: n%100=11-19 : mt
one: i=1 & v=0 ; few: v=0 & i%10=2-4 & i%100!12-14 ; many: v=0 & i!1 & i%10=0-1 | v=0 & i%10=5-9 | v=0 & i%100=12-14 : pl
one: i=0-1 ; {_MILLION} : pt
one: v=0 & i%10=1 & i%100!11 ; few: v=0 & i%10=2-4 & i%100!12-14 ; many: v=0 & i%10=0 | v=0 & i%10=5-9 | v=0 & i%100=11-14 : ru uk
one: n%10=1 & n%100!11 ; two: n=2 ; few: n!2 & n%10=2-9 & n%100!11-19 ; many: f!0 : sgs
one: i=0 | n=1 ; few: n=2-10 : shi
one: n=0,1 | i=0 & f=1 : si
one: v=0 & i%100=1 ; two: v=0 & i%100=2 ; few: v=0 & i%100=3-4 | v!0 : sl
one: n=0-1 | n=11-99 : tzm
"""
_ORDINAL = """
: af am an ar ast bg bs ce cs cv da de dsb el es et eu fa fi fy gl gsw he hr hsb ia id ie in is iw ja km kn ko ky lt lv ml mn my nb nl no pa pl prg ps pt root ru sd sh si sk sl sr sw ta te th tpi tr ur uz yue zh zu
one: n=1,5,7-10 ; two: n=2-3 ; few: n=4 ; many: n=6 : as bn
one: i%10=1,2,5,7,8 | i%100=20,50,70,80 ; few: i%10=3-4 | i%1000=100,200,300,400,500,600,700,800,900 ; many: i=0 | i%10=6 | i%100=40,60,90 : az
one: n=1 : bal fil fr ga hy lo mo ms ro tl vi
few: n%10=2-3 & n%100!12-13 : be
zero: i=0 ; one: i=1 ; few: i=2-6 : blo
one: n=1,3 ; two: n=2 ; few: n=4 : ca
zero: n=0,7-9 ; one: n=1 ; two: n=2 ; few: n=3-4 ; many: n=5-6 : cy
one: n%10=1 & n%100!11 ; two: n%10=2 & n%100!12 ; few: n%10=3 & n%100!13 : en
one: n=1,11 ; two: n=2,12 ; few: n=3,13 : gd
one: n=1 ; two: n=2-3 ; few: n=4 ; many: n=6 : gu hi
one: n=1,5 : hu
many: n=8,11,80,800 : it lld sc vec
one: i=1 ; many: i=0 | i%100=2-20,40,60,80 : ka
many: n%10=6 | n%10=9 | n%10=0 & n!0 : kk
one: n=1 ; two: n=2-3 ; few: n=4 : kok kok-latn mr
one: n=1-4 | n%100=1-4,21-24,41-44,61-64,81-84 ; many: n=5 | n%100=5 : kw
many: n=8,11,80-89,800-899 : lij scn
one: i%10=1 & i%100!11 ; two: i%10=2 & i%100!12 ; many: i%10=7-8 & i%100!17-18 : mk
one: n=1-4 : ne
one: n=1,5,7-9 ; two: n=2-3 ; few: n=4 ; many: n=6 : or
one: n=1 ; many: n%10=4 & n%100!14 : sq
one: n%10=1-2 & n%100!11-12 : sv
few: n%10=6,9 | n=10 : tk
few: n%10=3 & n%100!13 : uk
"""
#: (operand, modulus or 0, negated, ranges)
Condition = tuple[str, int, bool, tuple[tuple[int, int], ...]]
Rule = tuple[str, tuple[tuple[Condition, ...], ...]]
_CONDITION = re.compile(r"([nivwfte])(?:%(\d+))?([=!])([\d,-]+)")


def _condition(text: str) -> Condition:
    m = _CONDITION.fullmatch(text.strip())
    if m is None:
        raise ValueError(f"not a condition: {text!r}")
    spans = [x.split("-") for x in m[4].split(",")]
    return m[1], int(m[2] or 0), m[3] == "!", tuple((int(s[0]), int(s[-1])) for s in spans)


def _parse(table: str) -> dict[str, tuple[Rule, ...]]:
    out: dict[str, tuple[Rule, ...]] = {}
    for line in table.strip().splitlines():
        rules, _, locales = line.rpartition(":")
        made = []
        for rule in filter(str.strip, rules.split(";")):
            category, _, body = rule.partition(":")
            made.append((category.strip(), tuple(tuple(_condition(c) for c in alt.split("&")) for alt in body.split("|"))))
        for locale in locales.split():
            out[locale] = tuple(made)
    return out


CARDINAL, ORDINAL = _parse(_CARDINAL), _parse(_ORDINAL)


def rules_for(locale: str, ordinal: bool = False) -> tuple[Rule, ...]:
    """The rules of a locale, else of its shorter forms, else of the root."""
    table = ORDINAL if ordinal else CARDINAL
    name = locale.replace("_", "-").lower()
    while name not in table and "-" in name:
        name = name.rpartition("-")[0]
    return table.get(name, table["root"])


_NUMBER = re.compile(r"\s*[+-]?(\d+)(?:\.(\d*))?(?:[ceE]\+?(\d+))?\s*")


def operands(value: object) -> dict[str, Decimal]:
    """The operands of a number; strings keep their visible fraction digits."""
    text = format(value, "f") if isinstance(value, Decimal) else repr(value) if isinstance(value, float) else str(value)
    m = _NUMBER.fullmatch(text)
    if m is None:
        raise ValueError(f"not a number: {value!r}")
    whole, fraction, e = m[1], m[2] or "", int(m[3] or 0)
    moved = fraction[:e].ljust(e, "0")
    whole, fraction = whole + moved, fraction[e:]
    short = fraction.rstrip("0")
    number = Decimal(f"{whole}.{fraction or '0'}")
    return {"n": number, "i": Decimal(int(whole)), "v": Decimal(len(fraction)), "w": Decimal(len(short)), "f": Decimal(int(fraction or 0)), "t": Decimal(int(short or 0)), "e": Decimal(e)}


def _true(c: Condition, ops: dict[str, Decimal]) -> bool:
    x = ops[c[0]] % c[1] if c[1] else ops[c[0]]
    inside = x == x.to_integral_value() and any(a <= x <= b for a, b in c[3])
    return inside != c[2]


def plural_category(locale: str, value: object, ordinal: bool = False) -> str:
    ops = operands(value)
    return next((category for category, alternatives in rules_for(locale, ordinal) if any(all(_true(c, ops) for c in alt) for alt in alternatives)), "other")


def _whole_operands(value: Column) -> dict[str, Column]:
    n, none = F.abs(value.cast("bigint")), F.lit(0).cast("bigint")
    return {"n": n, "i": n} | dict.fromkeys("vwfte", none)


def _decimal_operands(value: Column) -> dict[str, Column]:
    text = F.trim(value.cast("string"))
    whole = F.regexp_extract(text, r"^[+-]?(\d+)", 1)
    fraction = F.regexp_extract(text, r"^[+-]?\d+\.(\d*)$", 1)
    short = F.regexp_replace(fraction, "0+$", "")
    blank = lambda c: F.when(c == "", "0").otherwise(c)
    number = lambda c: F.coalesce(blank(c).cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)"))
    return {
        "n": F.concat(blank(whole), F.lit("."), blank(fraction)).cast("decimal(38,10)"),
        "i": number(whole),
        "v": F.length(fraction).cast("decimal(28,0)"),
        "w": F.length(short).cast("decimal(28,0)"),
        "f": number(fraction),
        "t": number(short),
        "e": F.lit(0).cast("decimal(28,0)"),
    }


def category_column(locale: str, value: Column, ordinal: bool = False, whole: bool = False) -> Column:
    """The category of a number as an expression.

    Pass a string column where fraction digits count.  With ``whole``, the column is an
    integer one and everything is integer arithmetic.
    """
    ops = _whole_operands(value) if whole else _decimal_operands(value)

    def condition(c: Condition) -> Column:
        x = ops[c[0]] % F.lit(c[1]) if c[1] else ops[c[0]]
        inside = F.lit(False)
        for a, b in c[3]:
            inside = inside | ((x == a) if a == b else x.between(a, b))
        if not whole:
            inside = inside & (x == F.floor(x))
        return ~inside if c[2] else inside

    out = F.lit("other")
    for category, alternatives in reversed(rules_for(locale, ordinal)):
        any_of = F.lit(False)
        for alt in alternatives:
            all_of = F.lit(True)
            for c in alt:
                all_of = all_of & condition(c)
            any_of = any_of | all_of
        out = F.when(any_of, F.lit(category)).otherwise(out)
    return F.when(value.isNotNull(), out)


def plural_udf(ordinal: bool = False) -> Callable[[Column, Column], Column]:
    """A vectorized function of (locale, number as a string); null for what isn't a number."""

    @F.pandas_udf(T.StringType())  # type: ignore[call-overload]
    def run(locale: pd.Series, value: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str | None:
            try:
                return None if a is None or b is None else plural_category(a, b, ordinal)
            except (ValueError, InvalidOperation):
                return None

        return pd.Series([one(a, b) for a, b in zip(locale, value, strict=True)], dtype="object")

    return run


# --- gettext ---------------------------------------------------------------------------------

_GETTEXT_TOKEN = re.compile(r"\s*(\d+|n|&&|\|\||[=!<>]=|[?:()<>!%*/+-])")
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))


class GettextRule:
    """A Plural-Forms header: nplurals and an expression in C's syntax, never evaluated as code."""

    def __init__(self, header: str) -> None:
        m = re.search(r"nplurals\s*=\s*(\d+)\s*;\s*plural\s*=\s*([^;]+)", header)
        if m is None or not 1 <= int(m[1]) <= 32:
            raise ValueError(f"not a Plural-Forms header: {header!r}")
        self.nplurals, body = int(m[1]), m[2].strip()
        self.tokens: list[str] = []
        at = 0
        while at < len(body):
            t = _GETTEXT_TOKEN.match(body, at)
            if t is None or len(self.tokens) >= 512:
                raise ValueError(f"bad plural expression: {body!r}")
            self.tokens.append(t[1])
            at = t.end()
        self.at = 0
        self.tree = self._ternary()
        if self.at != len(self.tokens):
            raise ValueError(f"bad plural expression: {body!r}")

    def _peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _take(self, wanted: str | None = None) -> str:
        t = self._peek()
        if not t or wanted is not None and t != wanted:
            raise ValueError("bad plural expression")
        self.at += 1
        return t

    def _ternary(self) -> tuple:
        test = self._binary(0)
        if self._peek() != "?":
            return test
        self._take()
        yes = self._ternary()
        self._take(":")
        return ("?", test, yes, self._ternary())

    def _binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self._unary()
        left = self._binary(level + 1)
        while self._peek() in _LEVELS[level]:
            op = self._take()
            left = (op, left, self._binary(level + 1))
        return left

    def _unary(self) -> tuple:
        t = self._take()
        if t in ("!", "-", "+"):
            return ("u" + t, self._unary())
        if t == "(":
            inner = self._ternary()
            self._take(")")
            return inner
        if t == "n" or t.isdigit():
            return (t,)
        raise ValueError("bad plural expression")

    def index(self, n: int) -> int:
        out = int(_evaluate(self.tree, abs(int(n))))
        if not 0 <= out < self.nplurals:
            raise ValueError(f"plural index {out} is out of range")
        return out

    def column(self, n: Column) -> Column:
        return _compile(self.tree, F.abs(n.cast("bigint"))).cast("int")


def _evaluate(tree: tuple, n: int) -> int:
    op = tree[0]
    if len(tree) == 1:
        return n if op == "n" else int(op)
    if op == "?":
        return _evaluate(tree[2] if _evaluate(tree[1], n) else tree[3], n)
    a = _evaluate(tree[1], n)
    if op[0] == "u":
        return int(not a) if op == "u!" else -a if op == "u-" else a
    if op == "&&":
        return int(bool(a) and bool(_evaluate(tree[2], n)))
    if op == "||":
        return int(bool(a) or bool(_evaluate(tree[2], n)))
    b = _evaluate(tree[2], n)
    if op in "%/" and b == 0:
        raise ValueError("division by zero in a plural expression")
    return int({"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b, "/": a // b if b else 0, "%": a % b if b else 0}[op])


def _compile(tree: tuple, n: Column) -> Column:
    op = tree[0]
    if len(tree) == 1:
        return n if op == "n" else F.lit(int(op)).cast("bigint")
    truth = lambda t: _compile(t, n) != 0
    if op == "?":
        return F.when(truth(tree[1]), _compile(tree[2], n)).otherwise(_compile(tree[3], n))
    if op == "u!":
        return (~truth(tree[1])).cast("bigint")
    a = _compile(tree[1], n)
    if op[0] == "u":
        return -a if op == "u-" else a
    if op == "&&":
        return (truth(tree[1]) & truth(tree[2])).cast("bigint")
    if op == "||":
        return (truth(tree[1]) | truth(tree[2])).cast("bigint")
    b = _compile(tree[2], n)
    if op == "/":
        return F.floor(a / b)
    if op == "%":
        return a % b
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op].cast("bigint")


@lru_cache(maxsize=512)
def gettext_rule(header: str) -> GettextRule:
    return GettextRule(header)


def _c_condition(c: Condition) -> str:
    x = f"n%{c[1]}" if c[1] else "n"
    if c[0] in ("v", "w", "f", "t", "e"):
        inside = "1" if any(a <= 0 <= b for a, b in c[3]) else "0"
    else:
        inside = "(" + " || ".join(f"{x}=={a}" if a == b else f"({x}>={a} && {x}<={b})" for a, b in c[3]) + ")"
    return f"!{inside}" if c[2] else inside


def gettext_categories(locale: str) -> list[str]:
    """The categories that whole numbers of a locale have, in the order of gettext's indexes."""
    seen = {plural_category(locale, n) for n in [*range(1000), 1_000_000]}
    return [c for c, _ in rules_for(locale) if c in seen] + ["other"]


def gettext_header(locale: str) -> str:
    """A Plural-Forms header that gives the same categories for whole numbers."""
    names = gettext_categories(locale)
    body = str(len(names) - 1)
    for category, alternatives in reversed(rules_for(locale)):
        if category in names:
            test = " || ".join("(" + " && ".join(_c_condition(c) for c in alt) + ")" for alt in alternatives)
            body = f"({test}) ? {names.index(category)} : {body}"
    return f"nplurals={len(names)}; plural={body};"
