"""Token ids as bit-plane shuffled, zstandard-compressed chunks with an index.

The ids of a partition's documents are laid end to end and divided into blocks of
BLOCK ids.  A block is transposed into planes: plane i holds bit i (or byte i) of
every id.  Each plane is compressed by itself, so high planes, which hardly vary,
shrink to nothing.  A row of the result is one chunk; its columns other than
``data`` are the chunk index.  ``write_files`` puts the chunks of a stream into one file
and keeps the index beside it; ``read_files`` seeks chunks by their position.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm import tokens
from segmenta.llm.common import map_batches

BLOCK = 1 << 16
LEVEL = 3
SCHEMA = "stream string, chunk int, position bigint, n_ids int, plane_bits int, plane_bytes array<int>, doc_row array<bigint>, doc_id array<bigint>, doc_ids array<int>, data binary"


@lru_cache(maxsize=4)
def _tools(level: int) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray, bits: int = 1, level: int = LEVEL) -> tuple[list[int], bytes]:
    """(compressed size of each plane, the planes end to end); ``bits`` is 1 for bit planes, 8 for byte planes."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, -(-int(ids.max()).bit_length() // 8)) if len(ids) else 1
    planes = np.ascontiguousarray(octets[:, :width].T)
    if bits == 1:
        planes = np.packbits(np.concatenate([np.stack([(p >> i) & 1 for i in range(8)]) for p in planes]), axis=1, bitorder="little")
    packed = [_tools(level)[0].compress(p.tobytes()) for p in planes]
    return [len(p) for p in packed], b"".join(packed)


def unpack(n: int, sizes: list[int], data: bytes, bits: int = 1) -> np.ndarray:
    """The ids of a block."""
    expand = _tools(LEVEL)[1]
    at, planes = 0, []
    for size in sizes:
        planes.append(np.frombuffer(expand.decompress(data[at : at + size]), np.uint8))
        at += size
    out = np.zeros(n, np.uint32)
    for i, p in enumerate(planes):
        out |= (np.unpackbits(p, count=n, bitorder="little") if bits == 1 else p).astype(np.uint32) << np.uint32(i * bits)
    return out


class _Stream:
    """Cuts one partition's ids into blocks; a document may go on in the next block."""

    def __init__(self, name: str, block: int, bits: int, level: int) -> None:
        self.name, self.block, self.bits, self.level = name, block, bits, level
        self.chunk = self.position = self.row = self.held = 0
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple[int, int | None, int]] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        at = 0
        for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
            end, first = at + n, True
            while first or at < end:
                first = False
                take = min(end - at, self.block - self.held)
                self.rows.append((self.row, doc_id, take))
                self.ids.append(ids[at : at + take])
                at, self.held = at + take, self.held + take
                if self.held == self.block:
                    yield self.flush()
            self.row += 1

    def flush(self) -> tuple:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        sizes, data = pack(ids, self.bits, self.level)
        row, doc, n = zip(*self.rows, strict=True)
        out = (self.name, self.chunk, self.position, len(ids), self.bits, sizes, list(row), list(doc), list(n), data)
        self.chunk, self.position, self.held, self.ids, self.rows = self.chunk + 1, self.position + len(data), 0, [], []
        return out


_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def write_ids(documents: DataFrame, vocabulary: str | None = None, block: int = BLOCK, plane_bits: int = 1, level: int = LEVEL) -> DataFrame:
    """One row for each chunk: (stream, chunk, position, n_ids, plane_bits, plane_bytes, doc_row, doc_id, doc_ids, data).

    A stream is one partition; ``position`` is the byte at which the chunk begins
    in it, ``plane_bytes`` the compressed size of each plane of ``data``.
    ``doc_row``, ``doc_id`` and ``doc_ids`` list the stream's documents of which the
    chunk holds ids: place in the stream, identifier, number of ids here.  Every row of
    documents is listed: null and empty texts with 0 ids, repeated rows each with a
    place of their own, texts longer than a block in several chunks.  A stream is
    named by its partition and a hash of its first document.  An empty table gives
    no rows.  Other columns are ignored.  No shuffle.
    """
    if block < 1 or plane_bits not in (1, 8):
        raise ValueError("block must be 1 at least, plane_bits 1 or 8")
    path = vocabulary or tokens.vocabulary_path()
    docs = documents.select(F.spark_partition_id().alias("part"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stream = tokens.encoder(path), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                stream = _Stream(f"{batch.column(0)[0].as_py():06d}-{batch.column(1)[0].as_py() & 0xFFFFFFFFFFFFFFFF:016x}", block, plane_bits, level)
            ids, counts = coder.column(batch.column(3))
            if rows := list(stream.add(batch.column(2).to_pylist(), ids, counts)):
                yield _batch(rows)
        if stream is not None and stream.rows:
            yield _batch([stream.flush()])

    return map_batches(docs, run, SCHEMA)


def _file_system(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)


def write_files(documents: DataFrame, folder: str, **options: Any) -> DataFrame:
    """The chunks of ``write_ids`` as a file for each stream, ``<folder>/<stream>.planes``, with an index in ``<folder>/index``.

    Returns the index: a row for each chunk, without data.  A file is written beside its
    place and moved there when its partition is done, so a task that is run again writes
    the same file again and a lost one leaves none that is half written.  ``folder`` is one
    that all executors share, a path or a URI that pyarrow knows.  Nulls, empty and long
    texts and repeated rows are listed as by ``write_ids``; an empty table gives an empty
    index and no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        out, place, part = None, "", f"{uuid.uuid4().hex}.part"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                place = f"{root}/{batch.column(0)[0].as_py()}.planes"
                out = fs.open_output_stream(f"{place}.{part}")
            for data in batch.column(len(_NAMES) - 1):
                out.write(data.as_buffer())
            yield batch.select(_NAMES[:-1])
        if out is not None:
            out.close()
            fs.move(f"{place}.{part}", place)

    index = write_ids(documents, **options).mapInArrow(run, SCHEMA.rpartition(", ")[0])
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return documents.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_files(spark: SparkSession, folder: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """(stream, doc_row, doc_id, ids) of documents that ``write_files`` wrote: of all, or of those in ``doc_ids``.

    Only the chunks that hold a wanted document are read, each by seeking its position.
    A null doc_id is wanted if ``doc_ids`` has a null; unknown ones give no rows.
    """
    index = spark.read.schema(SCHEMA.rpartition(", ")[0]).parquet(f"{folder}/index")
    wanted = None
    if doc_ids is not None:
        wanted = doc_ids.select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
        own = index.select("stream", "chunk", F.explode("doc_id").alias("doc_id")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        index = index.join(own.select("stream", "chunk").distinct(), ["stream", "chunk"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for batch in batches:
            data = []
            for stream, at, sizes in zip(batch.column("stream").to_pylist(), batch.column("position").to_pylist(), batch.column("plane_bytes").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{stream}.planes") as f:
                    f.seek(at)
                    data.append(f.read(sum(sizes)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in _NAMES[:-1]], pa.array(data, pa.binary())], _NAMES)

    found = read_ids(index.select(*_NAMES[:-1]).mapInArrow(run, SCHEMA))
    return found if wanted is None else found.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def read_ids(chunks: DataFrame) -> DataFrame:
    """(stream, doc_row, doc_id, ids) of each document of ``write_ids``.

    Documents without ids have an empty list, null ids stay null, repeated rows are
    documents of their own, by their place in the stream.  No chunks give no rows; other
    columns are ignored.
    """
    parts = "stream string, chunk int, doc_row bigint, doc_id bigint, ids array<int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for c in frame.itertuples():
                ids, at = unpack(c.n_ids, list(c.plane_bytes), c.data, c.plane_bits).astype(np.int32), 0
                for row, doc, n in zip(c.doc_row, c.doc_id, c.doc_ids, strict=True):
                    rows.append((c.stream, c.chunk, row, None if doc is None or doc != doc else int(doc), ids[at : at + n]))
                    at += n
            out = pd.DataFrame(rows, columns=["stream", "chunk", "doc_row", "doc_id", "ids"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    laid = chunks.mapInPandas(run, parts)
    return laid.groupBy("stream", "doc_row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
