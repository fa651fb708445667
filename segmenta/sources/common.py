"""Reading files into units: a pure parser for each format, run over files in Arrow batches."""

from __future__ import annotations

import io
import json
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from typing import IO
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.schema import UNIT_COLUMNS, UNIT_DDL

#: (content, path) to units as dicts of the unit schema.
Parser = Callable[[bytes, str], Iterable[dict]]
_BARE = json.JSONEncoder(ensure_ascii=False, check_circular=False).encode
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 10_000, 1 << 30, 100


def from_json_rows(rows: DataFrame, column: str = "json") -> DataFrame:
    """Rows with a unit as JSON, as typed columns."""
    return rows.select(F.from_json(column, UNIT_DDL).alias("u")).select(*[F.col(f"u.{c}").alias(c) for c in UNIT_COLUMNS])


def read_files(spark: SparkSession, path: str, parse: Parser) -> DataFrame:
    """Units of all files at a path (a file, folder or pattern); one task reads whole files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                made = []
                for i, u in enumerate(parse(bytes(content), name)):
                    made.append(json.dumps(u | {"doc_id": u.get("doc_id") or name, "ordinal": u.get("ordinal") if u.get("ordinal") is not None else i}))
                yield pd.DataFrame({"json": made})

    return from_json_rows(files.mapInPandas(run, "json string"))


#: (binary file that can seek, path) to units as dicts; parsers that yield keep no more than they need.
Streamed = Callable[[IO[bytes], str], Iterable[dict]]
_CHUNK, _ROWS = 1 << 13, 1000


def streamed(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(path, size, block, seq, chunk): the bytes of files in pieces, from a splittable scan by a separator of one byte."""
    raw = spark.read.option("lineSep", separator).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = (), 0
        for batch in batches:
            values, rows = batch.column(0).to_pylist(), list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            made, begin, length = [], 0, 0
            for i, value in enumerate(values):
                length += len(value) + 1
                if i + 1 == len(values) or rows[i + 1] != rows[begin] or length >= _CHUNK:
                    if rows[begin] != at:
                        at, seq = rows[begin], 0
                    made.append((*at, seq, mark.join(values[begin : i + 1]) + mark))
                    seq, begin, length = seq + 1, i + 1, 0
            names, sizes, blocks, seqs, chunks = zip(*made, strict=True) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.int64()), pa.array(seqs, pa.int64()), pa.array(chunks, pa.binary())], ["path", "size", "block", "seq", "chunk"])

    return raw.select("value", "path", "size", "block").mapInArrow(run, "path string, size bigint, block bigint, seq bigint, chunk binary")


def _spooled(chunks: Iterable[bytes], size: int) -> IO[bytes]:
    """A file's bytes on the local disk of the executor, without the separator that the last one may lack."""
    f = tempfile.TemporaryFile()
    total = sum(f.write(c) for c in chunks)
    if total - size in (1, -2):  # the scan leaves out a byte order mark of three bytes
        f.truncate(total - 1)
    f.seek(0)
    return f


def over_files(spark: SparkSession, path: str, make: Callable[[IO[bytes], str], Iterable[str]], column: str, separator: str = "\n") -> DataFrame:
    """Strings made from all files at a path; a task has a file on its disk and streams it, so its memory doesn't grow with the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

        for (name, size), group in groupby(rows(), key=lambda r: r[:2]):
            with _spooled((r[2] for r in group), size) as f:
                made = iter(make(f, name))
                while some := list(islice(made, _ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], [column])

    pieces = streamed(spark, path, separator).repartition("path").sortWithinPartitions("path", "block", "seq")
    return pieces.select("path", "size", "chunk").mapInArrow(run, f"{column} string")


def read_streams(spark: SparkSession, path: str, parse: Streamed, separator: str = "\n") -> DataFrame:
    """Units of all files at a path as ``read_files`` gives them, by parsers that stream.

    ``separator`` is a byte that is frequent in the format: pieces between two of them are rows of the scan.
    """

    def make(f: IO[bytes], name: str) -> Iterator[str]:
        for i, u in enumerate(parse(f, name)):
            yield _BARE({k: v for k, v in (u | {"doc_id": u.get("doc_id") or name, "ordinal": u.get("ordinal") if u.get("ordinal") is not None else i}).items() if v is not None})

    return from_json_rows(over_files(spark, path, make, "json", separator))


def units_frame(spark: SparkSession, units: Iterable[dict], doc_id: str = "doc") -> DataFrame:
    """Units made in Python as a DataFrame."""
    made = [(json.dumps(u | {"doc_id": u.get("doc_id") or doc_id, "ordinal": u.get("ordinal") if u.get("ordinal") is not None else i}),) for i, u in enumerate(units)]
    return from_json_rows(spark.createDataFrame(made, "json string"))


def open_package(content: bytes | IO[bytes]) -> zipfile.ZipFile:
    """A zip package whose entries are safe to read."""
    z = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    infos = z.infolist()
    names = [i.filename for i in infos]
    if len(infos) > MAX_ENTRIES or len(set(names)) != len(names):
        raise ValueError("the package has too many or repeated entries")
    for i in infos:
        if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/"):
            raise ValueError(f"unsafe entry: {i.filename!r}")
        if i.flag_bits & 1:
            raise ValueError("the package is encrypted")
        if i.file_size > MAX_BYTES or i.file_size > 1 << 20 and i.file_size > MAX_RATIO * max(1, i.compress_size):
            raise ValueError(f"entry is too large: {i.filename!r}")
    if sum(i.file_size for i in infos) > MAX_BYTES:
        raise ValueError("the package is too large")
    return z


def local(tag: object) -> str:
    """An XML name without its namespace."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def elements(f: IO[bytes], wanted: frozenset[str]) -> Iterator[tuple[ET.Element, list[ET.Element]]]:
    """The elements of some local names with those round them, outermost first; each is dropped when the next one is asked for."""
    above: list[ET.Element] = []
    for event, e in ET.iterparse(f, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if local(e.tag) in wanted:
            yield e, above
        if above and not any(local(x.tag) in wanted for x in above):
            above[-1].remove(e)
