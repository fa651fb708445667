"""The library's functions and sources for SQL.

Functions that are expressions become SQL functions of the session, so they stay inside
the plan; the others are Pandas functions.  Sources become table functions of a content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions import message, plural
from segmenta.functions import text as fx

_PARTS = r"split(replace(trim(t), '_', '-'), '-')"
_WORDS = r"array_distinct(filter(split(trim(regexp_replace(lower(t), '\\s+', ' ')), ' '), w -> w <> ''))"
_GRAMS = r"array_distinct(flatten(transform(transform(filter(split(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), w -> concat('  ', w, ' ')), w -> transform(sequence(1, length(w) - 2), i -> substring(w, i, 3)))))"


def _case(value: str, table: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE 'unknown' END"


def _rest(p: str) -> str:
    return f"CASE WHEN {p} RLIKE '^[A-Za-z]{{2}}$' THEN upper({p}) WHEN {p} RLIKE '^[A-Za-z]{{4}}$' THEN initcap({p}) ELSE {p} END"


#: name: (arguments, type, body)
EXPRESSIONS: dict[str, tuple[str, str, str]] = {
    "token_set": ("t STRING", "ARRAY<STRING>", _WORDS),
    "trgm_similarity": ("a STRING, b STRING", "DOUBLE", f"coalesce(try_divide(CAST(size(array_intersect({_GRAMS.format('a')}, {_GRAMS.format('b')})) AS DOUBLE), CAST(size(array_union({_GRAMS.format('a')}, {_GRAMS.format('b')})) AS DOUBLE)), 0.0D)"),
    "source_hash": ("t STRING", "STRING", "md5(lower(coalesce(t, '')))"),
    "context_hash": ("t STRING, p STRING, n STRING", "STRING", "md5(concat_ws('|', lower(coalesce(t, '')), lower(coalesce(p, '')), lower(coalesce(n, ''))))"),
    "canonical_locale": ("t STRING", "STRING", f"CASE WHEN trim(t) = '' THEN '' ELSE array_join(concat(array(lower({_PARTS}[0])), transform(slice({_PARTS}, 2, 99), p -> {_rest('p')})), '-') END"),
    "base_language": ("t STRING", "STRING", f"lower({_PARTS}[0])"),
    "tmx_status": ("t STRING", "STRING", _case("lower(trim(t))", fx.TMX_STATUS)),
    "xliff_status": ("s STRING, t STRING", "STRING", f"CASE WHEN s IS NULL AND t IS NULL THEN 'new' ELSE {_case('s', fx.XLIFF_STATUS)} END"),
    "tag_signature": ("ties ARRAY<STRUCT<type: STRING, ord: INT, pair_id: STRING>>", "ARRAY<STRUCT<type: STRING, pair_id: STRING>>", "transform(array_sort(transform(ties, x -> struct(x.ord AS ord, x.type AS type, nullif(x.pair_id, '') AS pair_id))), x -> struct(x.type AS type, x.pair_id AS pair_id))"),
}


@F.pandas_udf(T.LongType())  # type: ignore[call-overload]
def gettext_index(header: pd.Series, number: pd.Series) -> pd.Series:
    """The plural index of a number by a Plural-Forms header."""
    return pd.Series([None if h is None or n is None or n != n else plural.gettext_rule(h).index(int(n)) for h, n in zip(header, number, strict=True)], dtype="Int64")


_UNIT = "unit_id string, source string, target string, status string"


def _table(parse):  # noqa: ANN001, ANN202
    class Units:
        def eval(self, content: str) -> Iterator[tuple]:
            for u in parse(content) if content is not None else ():
                yield u["unit_id"], u["source"], u["target"], u["status"]

    return F.udtf(Units, returnType=_UNIT)


def register(spark: SparkSession) -> None:
    """normalize_text, token_set, trgm_similarity, seq_ratio, hashes, locales, statuses, plural_category, gettext_index,
    format_message, tag_signature; html_units, json_units, po_units, tmx_units, xliff_units as table functions of a text."""
    from segmenta.sources import html, json_i18n, po, tmx, xliff

    spark.udf.register("normalize_text", fx.casefolded)
    spark.udf.register("seq_ratio", fx.seq_ratio)
    spark.udf.register("plural_category", plural.plural_udf())
    spark.udf.register("gettext_index", gettext_index)
    spark.udf.register("format_message", message.message_udf())
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    tables = {
        "html_units": html.page_units, "json_units": json_i18n.parse, "po_units": po.parse,
        "tmx_units": lambda c: tmx.parse(c.encode()), "xliff_units": lambda c: xliff.parse(c.encode()),
    }
    for name, parse in tables.items():
        spark.udtf.register(name, _table(parse))
