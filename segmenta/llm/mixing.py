"""Mixing sources to target weights.

Each row gets a hash-random key, the same in each run.  Rows of a source are in
the order of their keys: range buckets of the key hold about equal numbers, each
bucket is sorted by itself, and prefix sums of token counts are those inside the
bucket plus the sums of the buckets before it.  A source's sequence is repeated
in epochs until its budget, and cut at exactly that token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import DOCUMENT_COLUMNS, cut, word_count, written

SEED = 11
#: Rows that a bucket of a source has about, so that no task sorts a whole source.
BUCKET_ROWS = 20_000


def _key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{SEED}")))


def _counted(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, _key), written once: all that the plan needs to know of a row, at some 60 bytes each."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("tokens"))
    return written(rows.withColumn("_key", _key()))


def _placed(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("_bucket", F.substring("_key", 1, digits)).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))


def _plan(counted: DataFrame, weights: dict[str, int] | None, total_tokens: int | None) -> tuple[int, DataFrame]:
    """(digits of a bucket's name, a row for each source and bucket with budget, tokens of the source and tokens before the bucket)."""
    n = counted.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while n / 16**digits > BUCKET_ROWS:
        digits += 1
    weight: Column = F.lit(1)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source") == F.lit(f"s{name}"), F.lit(int(value))).otherwise(weight)
    sums = cut(_placed(counted, digits).groupBy("_source", "_bucket").agg(F.sum("tokens").alias("_sum")))
    of_source = Window.partitionBy("_source")
    sums = sums.select("_source", "_bucket", F.sum("_sum").over(of_source).alias("_all"), (F.sum("_sum").over(of_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))
    totals = sums.groupBy("_source").agg(F.first("_all").alias("_all")).withColumn("_weight", weight.cast("bigint"))
    whole = totals.agg(F.sum("_all").alias("_whole"), F.sum("_weight").alias("_weights")).first()
    tokens, parts = (total_tokens if total_tokens is not None else whole[0] or 0), whole[1] or 1
    budget = F.expr(f"CAST(CAST({int(tokens)} AS DECIMAL(38,0)) * _weight div {int(parts)} AS BIGINT)")
    return digits, sums.join(totals.select("_source", budget.alias("_budget")), "_source")


def _sequence(rows: DataFrame, digits: int, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, doc_id, tokens and _key) plus epoch, start and take."""
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = _placed(rows, digits).withColumn("_prefix", F.sum("tokens").over(in_bucket) - F.col("tokens")).join(plan.hint("shuffle_hash"), ["_source", "_bucket"]).withColumn("_prefix", F.col("_prefix") + F.col("_before"))
    epochs = F.expr("CASE WHEN tokens > 0 AND _budget > _prefix THEN sequence(0L, (_budget - _prefix - 1) div _all) END")
    return placed.withColumn("epoch", F.explode(epochs)).withColumn("start", F.col("epoch") * F.col("_all") + F.col("_prefix")).withColumn("take", F.least("tokens", F.col("_budget") - F.col("start")))


def mix(documents: DataFrame, weights: dict[str, int] | None = None, total_tokens: int | None = None) -> DataFrame:
    """(source, epoch, doc_id, tokens, start, take): which documents make up the mixture.

    A source's budget is ``total_tokens`` (by default, the tokens of all documents)
    times its whole-number weight (1 if not named) over the sum of weights, rounded
    down.  The ``take`` of a source add up to its budget exactly: the last document
    is cut, and a source with fewer tokens is repeated.  Tokens are runs of
    characters other than white space.  A null source is a source of its own; null
    and empty texts have no tokens and are left out, and a source of only such
    texts stays empty.  Rows of equal doc_id are in the order of their token counts;
    equal rows each count.  An empty table gives no rows.  Other columns are ignored,
    whatever their names.

    Documents are read once, for a table of keys and token counts in the checkpoint
    folder, from which all sums and the result are made.
    """
    counted = _counted(documents)
    return _sequence(counted, *_plan(counted, weights, total_tokens)).select("source", "epoch", "doc_id", "tokens", "start", "take")


def mix_documents(documents: DataFrame, weights: dict[str, int] | None = None, total_tokens: int | None = None) -> DataFrame:
    """The documents of ``mix``, repeated by epoch; the text of a cut document ends with its last token.

    Null texts, empty ones and those without words are left out, as they have no tokens;
    repeated rows stay repeated; an empty table stays empty; other columns are left out,
    whatever their names.  Documents are read twice: for the plan, and for whole texts to
    go through the one shuffle by source and bucket, with no join on the way back.
    """
    plan = _plan(_counted(documents), weights, total_tokens)
    rows = documents.select(*DOCUMENT_COLUMNS).withColumn("tokens", word_count(F.col("text"))).withColumn("_key", _key())
    words = F.split("text", r"(?<=[ \t\n\r\f\x0B])(?=[^ \t\n\r\f\x0B])")
    lead = F.when(F.regexp_like("text", F.lit(r"^[ \t\n\r\f\x0B]")), 1).otherwise(0)
    short = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int") + lead), ""), r"[ \t\n\r\f\x0B]+$", "")
    mixed = _sequence(rows, *plan)
    cut_off = F.col("take") < F.col("tokens")
    return mixed.withColumn("n_chars", F.when(cut_off, F.length(short).cast("bigint")).otherwise(F.col("n_chars"))).withColumn("text", F.when(cut_off, short).otherwise(F.col("text"))).select(*DOCUMENT_COLUMNS)


def mix_sql() -> str:
    return f"""
    WITH d AS (
      SELECT source, doc_id, coalesce('s' || source, 'n') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}') AS k,
             CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0) AS BIGINT) AS tokens
      FROM documents),
    t AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS a FROM d GROUP BY s),
    b AS (SELECT s, a, CAST((SELECT sum(a) FROM t) // (SELECT count(*) FROM t) AS BIGINT) AS budget FROM t),
    p AS (
      SELECT d.*, a, budget, CAST(sum(tokens) OVER (PARTITION BY d.s ORDER BY k, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS prefix
      FROM d JOIN b USING (s)),
    e AS (SELECT *, unnest(range(0, (budget - prefix - 1) // a + 1)) AS epoch FROM p WHERE tokens > 0 AND budget > prefix)
    SELECT source, epoch, doc_id, tokens, epoch * a + prefix AS start, least(tokens, budget - epoch * a - prefix) AS take FROM e
    """
