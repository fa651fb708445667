"""Secret scans by sliding-window entropy.

A candidate is a run of MIN_LENGTH or more characters that keys are made of.  Its
character class sets the threshold; the Shannon entropy of every window of WINDOW
characters is computed from counts that are updated by one character in and one
out.  Candidates that the allow list matches as a whole are suppressed.

What is left out on purpose: numbers of 13 to 19 digits (cards, accounts, phones) by
the allow list; keys shorter than MIN_LENGTH; keys whose best window is below the
threshold of their class, which are those made of few different characters.  Keys of
letters of one case look like long words, whose windows reach 3.5 bits, so of random
ones with 16, 20, 24 and 32 letters only about 29, 51, 64 and 84 % are found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import map_batches

WINDOW = 16
MIN_LENGTH = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"
#: (class, pattern of the whole candidate, least entropy in bits of its best window), the first that matches counts.
CLASSES: tuple[tuple[str, str, float], ...] = (
    ("digits", r"[0-9/_+-]+=*", 2.7),
    ("hex", r"[0-9a-f]+|[0-9A-F]+", 2.6),
    ("letters", r"[A-Z]?[a-z/_+-]+=*|[A-Z/_+-]+=*", 3.6),
    ("upper", r"[A-Z0-9]+=*", 3.0),
    ("lower", r"[a-z0-9]+=*", 3.1),
    ("base64", r"[A-Za-z0-9+/_-]+=*", 3.3),
)
#: Candidates that are known to be harmless: identifiers, examples, runs of the alphabet, card and phone numbers and
#: dates, words and numbers joined by marks.
ALLOWED: tuple[str, ...] = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r".*(EXAMPLE|example|xxxxxxxx|XXXXXXXX).*",
    r".*(0123456789|abcdefghij|ABCDEFGHIJ|qwertyuiop).*",
    r"[0-9]{13,19}",
    r"[+]?[0-9]{1,8}([/_+-]+[0-9]{1,8})+",
    r"/?([A-Z]?[a-z]+|[0-9]+)([/_-]+([A-Z]?[a-z]+|[0-9]+))+/?",
)
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def best_entropy(value: str, window: int = WINDOW) -> float:
    """The greatest entropy of a window of ``value``, rounded to six places; of all of a shorter one."""
    n = min(window, len(value))
    if not n:
        return 0.0
    term = _TERM if n <= WINDOW else [0.0] + [k * math.log2(k) for k in range(1, n + 1)]
    counts: dict[str, int] = {}
    held = 0.0  # the sum of c log2 c over the counts c
    for c in value[:n]:
        k = counts.get(c, 0)
        counts[c] = k + 1
        held += term[k + 1] - term[k]
    least = held
    for old, new in zip(value, value[n:], strict=False):
        if old != new:
            k, m = counts[old], counts.get(new, 0)
            counts[old], counts[new] = k - 1, m + 1
            held += term[k - 1] - term[k] + term[m + 1] - term[m]
            if held < least:
                least = held
    return round(math.log2(n) - least / n, 6) + 0.0


class Scanner:
    def __init__(self, classes: tuple = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> None:
        self.find = re.compile(CANDIDATE).finditer
        self.classes = [(name, re.compile(p).fullmatch, least) for name, p, least in classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed)).fullmatch if allowed else lambda _: None

    def scan(self, text: str) -> list[tuple[int, str, int, float]]:
        """(position, class, length, entropy) of each secret."""
        out = []
        for m in self.find(text):
            value = m.group()
            kind, least = next((name, least) for name, match, least in self.classes if match(value))
            entropy = best_entropy(value)
            if entropy >= least and not self.allowed(value):
                out.append((m.start(), kind, len(value), entropy))
        return out


def secrets(documents: DataFrame, classes: tuple = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(doc_id, position, class, length, entropy) of each secret, whole texts scanned.

    ``position`` counts characters from 0.  Null, empty and short texts give no rows.
    Repeated rows of documents give repeated results; equal secrets in a text are told
    apart by position.  An empty table gives no rows.  Other columns are ignored.  No
    shuffle, and the values themselves are not repeated in the result.
    """
    if not re.fullmatch(classes[-1][1], "aZ09+/_-="):
        raise ValueError("the last class must match every candidate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(classes, allowed).scan
        for batch in batches:
            rows = [(doc_id, *found) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in scan(text.as_py() or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "position", "class", "length", "entropy"])

    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, position bigint, class string, length int, entropy double")


def secrets_sql() -> str:
    kind = " ".join(f"WHEN regexp_full_match(v, '{p}') THEN '{name}'" for name, p, _ in CLASSES)
    least = " ".join(f"WHEN '{name}' THEN {least}" for name, _, least in CLASSES)
    allowed = " OR ".join(f"regexp_full_match(v, '{a}')" for a in ALLOWED)
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{CANDIDATE}') AS found, regexp_split_to_array(text, '{CANDIDATE}') AS gaps
      FROM documents WHERE regexp_matches(text, '{CANDIDATE}')),
    c AS (
      SELECT r, doc_id, i, found[i] AS v,
             CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS position
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM d)),
    w AS (SELECT r, i, j, substr(v, j, {WINDOW}) AS part FROM (SELECT *, unnest(range(1, length(v) - {WINDOW} + 2)) AS j FROM c)),
    k AS (SELECT r, i, j, ch, count(*) AS n FROM (SELECT r, i, j, unnest(string_split(part, '')) AS ch FROM w) GROUP BY ALL),
    e AS (SELECT r, i, max(h) AS entropy FROM (SELECT r, i, j, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h FROM k GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT doc_id, position, v, length(v)::INTEGER AS length, round(entropy, 6) + 0.0 AS entropy, CASE {kind} END AS class FROM c JOIN e USING (r, i))
    SELECT doc_id, position, class, length, entropy FROM s WHERE entropy >= CASE class {least} END AND NOT ({allowed})
    """
