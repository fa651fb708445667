"""Learned operators on the driver's tables: one half of the labels trains, the other half judges."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from segmenta.llm import langid, toxicity

FOLDER = Path(os.environ.get("TESTDATA", "/root/testdata"))


def halves(df):
    own = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2))
    return df.where(own == 0), df.where(own == 1)


@pytest.mark.skipif(not (FOLDER / "sf0.01").exists(), reason="needs the driver's tables")
def test_languages_of_the_other_half(spark):
    docs = spark.read.parquet(str(FOLDER / "sf0.01/documents.parquet")).where("lang IS NOT NULL AND length(trim(text)) > 0")
    mine, other = halves(docs)
    found = {r.doc_id: r.detected for r in langid.identify(other, langid.fit(mine)).collect()}
    truth = {r.doc_id: r.lang for r in other.select("doc_id", "lang").collect()}
    assert len(truth) > 300 and sum(found[i] == x for i, x in truth.items()) >= 0.97 * len(truth)


@pytest.mark.skipif(not (FOLDER / "sf0.1").exists(), reason="needs the driver's tables")
def test_toxicity_of_the_other_half(spark):
    docs = spark.read.parquet(str(FOLDER / "sf0.1/documents.parquet"))
    mine, other = halves(spark.read.parquet(str(FOLDER / "sf0.1/labels.parquet")))
    found = {r.doc_id for r in toxicity.toxic_documents(docs, mine).collect()}
    truth = {r.doc_id: r.toxic for r in other.join(docs, "doc_id", "left_semi").collect()}
    toxic = {i for i, y in truth.items() if y == 1}
    assert len(toxic) > 150 and len(found & toxic) >= 0.85 * len(toxic)
    assert len(found & (truth.keys() - toxic)) <= 0.015 * len(truth)
