"""Scalar functions as Column builders; Python only for casefold and the sequence ratio."""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"\s+"
#: Base languages that a header may name; ISO 639-1 codes, and three-letter ones in common use.
LANGUAGES = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz "
    "ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt "
    "qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu fil haw hmn ceb".split()
)


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed: equal to casefolding where no character folds specially."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


@F.pandas_udf(T.StringType())  # type: ignore[call-overload]
def casefolded(text: pd.Series) -> pd.Series:
    """Casefolded text with white space collapsed."""
    return text.map(lambda x: None if x is None else " ".join(x.casefold().split()))


def token_set(text: Column) -> Column:
    """Distinct words of the normalized text."""
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda t: t != ""))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of each word, two blanks put before and one after it."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pad = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(pad, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _word_codes(word: str) -> frozenset[int]:
    p = [32, 32, *map(ord, word), 32]
    return frozenset(a << 42 | b << 21 | c for a, b, c in zip(p, p[1:], p[2:], strict=False))


_kept_codes = lru_cache(1 << 15)(_word_codes)


def gram_codes(lowered: str) -> set[int]:
    """The trigrams of a text in lower case as numbers, 21 bits a character: the same sets as ``trigrams``."""
    return set().union(*(_kept_codes(w) if len(w) <= 32 else _word_codes(w) for w in set(_WORD.findall(lowered))))


@F.pandas_udf(T.ArrayType(T.LongType()))  # type: ignore[call-overload]
def trigram_codes(lowered: pd.Series) -> pd.Series:
    """``gram_codes`` of texts, in order."""
    return lowered.map(lambda text: None if text is None else sorted(gram_codes(text)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0))


def ratio(query: str | None, text: str | None) -> float | None:
    """The sequence ratio of two texts; the first is the query."""
    if query is None or text is None:
        return None
    return difflib.SequenceMatcher(None, query, text).ratio()


@F.pandas_udf(T.DoubleType())  # type: ignore[call-overload]
def seq_ratio(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([ratio(q, t) for q, t in zip(query, text, strict=True)], dtype="float64")


def source_hash(source: Column) -> Column:
    return F.md5(F.lower(F.coalesce(source, F.lit(""))))


def context_hash(source: Column, previous: Column, following: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.lower(F.coalesce(c, F.lit(""))) for c in (source, previous, following)]))


def _parts(locale: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(locale), "_", "-"), "-")


def canonical_locale(locale: Column) -> Column:
    """Language in lower case, two letters after it in upper case, four with a capital, others as they are."""
    rest = F.transform(F.slice(_parts(locale), 2, 99), lambda p: F.when(F.regexp_like(p, F.lit("^[A-Za-z]{2}$")), F.upper(p)).when(F.regexp_like(p, F.lit("^[A-Za-z]{4}$")), F.initcap(p)).otherwise(p))
    return F.when(F.trim(locale) == "", F.lit("")).otherwise(F.array_join(F.concat(F.array(F.lower(_parts(locale)[0])), rest), "-"))


def header_locale(header: str) -> str:
    """The locale that a column header names, or '' when it names none."""
    parts = [p for p in header.strip().replace("_", "-").split("-")]
    if not parts or parts[0].lower() not in LANGUAGES or not all(re.fullmatch(r"[A-Za-z0-9]{2,8}", p) for p in parts[1:]):
        return ""
    out = [parts[0].lower()]
    for p in parts[1:]:
        out.append(p.upper() if len(p) == 2 and p.isalpha() or len(p) == 3 and p.isdigit() else p.title() if len(p) == 4 and p.isalpha() else p.lower())
    return "-".join(out)


def base_language(locale: Column) -> Column:
    return F.lower(_parts(locale)[0])


def same_language(a: Column, b: Column) -> Column:
    return base_language(a) == base_language(b)


def column_letters(index: Column) -> Column:
    """The spreadsheet name of a column from 0: A, B, ..., Z, AA, AB, ..., ZZZ, AAAA, ...; null below 0."""
    state = lambda n, out: F.struct(n.cast("bigint").alias("n"), out.alias("out"))

    def step(x: Column, _: Column) -> Column:
        r = F.pmod(x["n"], F.lit(26))
        more = state(F.call_function("div", x["n"] - r, F.lit(26)) - 1, F.concat(F.char(F.lit(65) + r), x["out"]))
        return F.when(x["n"] >= 0, more).otherwise(x)

    # 14 letters are enough for any bigint
    return F.when(index >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), state(index, F.lit("")), step, lambda x: x["out"]))


def column_index(letters: str) -> int:
    """The place from 0 of a column named A, B, ..."""
    if not re.fullmatch(r"[A-Za-z]{1,3}", letters):
        raise ValueError(f"not a column name: {letters!r}")
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


#: Words for a unit's status in translation memories.
TMX_STATUS = {
    "new": "new", "untranslated": "new", "needs-translation": "new", "draft": "draft", "fuzzy": "draft", "needs-review": "draft", "translated": "translated",
    "complete": "translated", "reviewed": "reviewed", "needs-approval": "reviewed", "approved": "approved", "final": "approved", "signed-off": "approved", "rejected": "rejected",
}
XLIFF_STATUS = {
    "final": "approved", "signed-off": "approved", "translated": "translated", "needs-review-translation": "translated",
    "needs-review-adaptation": "reviewed", "needs-review-l10n": "reviewed", "new": "new", "needs-translation": "new",
}


def _mapped(value: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def tmx_status(value: Column) -> Column:
    return _mapped(F.lower(F.trim(value)), TMX_STATUS, "unknown")


def xliff_status(state: Column, target: Column) -> Column:
    return F.when(state.isNull() & target.isNull(), "new").otherwise(_mapped(state, XLIFF_STATUS, "unknown"))


def tabular_status(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("new", "draft", "translated", "reviewed", "approved", "rejected"), v).otherwise("unknown")


def tag_signature(ties: Column) -> Column:
    """(type, pair) of the tags in their order; an empty pair is none."""
    ordered = F.array_sort(F.transform(ties, lambda t: F.struct(t["ord"].alias("ord"), t["id"].alias("id"), t["type"].alias("type"), F.when(t["pair_id"] == "", None).otherwise(t["pair_id"]).alias("pair_id"))))
    return F.transform(ordered, lambda t: F.struct(t["type"].alias("type"), t["pair_id"].alias("pair_id")))


def plain_text(parts: Column) -> Column:
    """The text parts in a row."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["value"]), "")


def parts_match(parts: Column, text: Column) -> Column:
    return plain_text(parts) == text


def merged_map(left: Column, right: Column) -> Column:
    """Entries of both maps; the right one wins."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def escaped(text: Column) -> Column:
    """Text for XML or HTML: the ampersand first."""
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def key_name(text: Column) -> Column:
    return F.translate(F.lower(text), " -", "__")
