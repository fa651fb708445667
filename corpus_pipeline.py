"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import binary, decontamination, langid, mixing, simhash
from segmenta.llm.common import dropped, shared_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the network is sure enough of.

    Null and empty texts go, repeated rows are judged each, an empty table stays empty;
    columns other than those of documents are left out, whatever their names.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id, nulls last; of equal rows one.

    Texts without words stay, once for equal rows; an empty table stays empty; other
    columns are left out.
    """
    return simhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark; null and empty texts and repeated rows stay as they are.

    With an empty benchmark all documents stay; other columns are left out.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its token budget, repeated by epoch; the last one is cut.

    Texts without tokens are left out, a null source is one of its own, repeated rows count
    each, equal doc_ids go by their token counts; an empty table stays empty; other columns
    are left out.
    """
    return mixing.mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of compressed bit planes, with their index, in which every row of docs is listed.

    Null and empty texts have no ids; an empty table gives no chunks; other columns are
    left out.
    """
    return binary.write_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]
#: Neural language identification, fingerprints and byte-pair encoding have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder.

    A table is deleted when the next one is written; the last one stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
