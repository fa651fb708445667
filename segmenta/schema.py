"""Types of translation units, as DDL that DataFrames and Python parsers share."""

from __future__ import annotations

from pyspark.sql import types as T

MAP = "map<string,string>"
TIE = f"struct<id:string,type:string,attributes:{MAP},attribute_data:string,position:int,ord:int,pair_id:string,original_name:string,original_text:string>"
PART = "struct<kind:string,value:string>"
META = f"struct<usage_count:int,last_used:string,first_used:string,created:string,updated:string,max_length:int,min_length:int,extensions:{MAP}>"
ORIGIN = f"struct<system:string,project:string,creator_id:string,extensions:{MAP}>"
COMMENT = f"struct<context:string,timestamp:string,origin:{ORIGIN},context_key:string,extensions:{MAP}>"
PLURAL = f"struct<variant:string,count:int,category:string,extensions:{MAP}>"
CONTEXT = f"struct<unit_id:string,source:string,target:string,extensions:{MAP}>"
TARGET_TAGS = f"struct<ties:array<{TIE}>,parts:array<{PART}>>"
TARGET = f"struct<text:string,status:string,tags:{TARGET_TAGS},plural:{PLURAL},meta:{META},comments:array<{COMMENT}>,extensions:{MAP}>"
TAGS = f"struct<source_ties:array<{TIE}>,target_ties:array<{TIE}>,source_parts:array<{PART}>,target_parts:array<{PART}>>"
_FIELDS = {
    "doc_id": "string",
    "ordinal": "bigint",
    "unit_id": "string",
    "source": "string",
    "target": "string",
    "targets": f"map<string,{TARGET}>",
    "target_locales": "array<string>",
    "source_locale": "string",
    "target_locale": "string",
    "plural": PLURAL,
    "tags": TAGS,
    "meta": META,
    "status": "string",
    "comments": f"array<{COMMENT}>",
    "previous_context": CONTEXT,
    "next_context": CONTEXT,
    "extensions": MAP,
}
UNIT_COLUMNS = tuple(_FIELDS)
UNIT_DDL = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())

STATUSES = ("new", "draft", "translated", "reviewed", "approved", "rejected", "unknown")
CATEGORIES = ("zero", "one", "two", "few", "many", "other")


def unit_type() -> T.StructType:
    return T._parse_datatype_string(UNIT_DDL)


def unit(**fields: object) -> dict[str, object]:
    """One unit as a dict with every column; missing ones are null, maps and lists empty."""
    out: dict[str, object] = dict.fromkeys(UNIT_COLUMNS)
    out |= {"targets": {}, "target_locales": [], "comments": [], "extensions": {}, "status": "unknown"}
    unknown = set(fields) - set(UNIT_COLUMNS)
    if unknown:
        raise ValueError(f"no such unit column: {sorted(unknown)}")
    return out | fields
