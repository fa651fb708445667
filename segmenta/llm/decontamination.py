"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with runs of white space as one blank.  An item
of m characters has an error budget of k = floor(m * rate) edits.  It is split
into k + 1 pieces; a passage within k edits of the item holds one piece at least
unchanged.  An Aho-Corasick automaton finds all pieces in one pass over a text,
and Myers' bit-parallel distance over the window round each hit decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import DOCUMENT_COLUMNS, map_batches

ERROR_RATE = 0.08
#: Characters of benchmark items that one automaton holds; more items take more passes.
SHARD_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` contiguous pieces with their offsets, as equal in length as can be."""
    n, edges = len(item), [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if a < b] if n else []


class Item:
    __slots__ = ("id", "m", "k", "eq", "top", "mask")

    def __init__(self, item_id: int | None, text: str, k: int) -> None:
        self.id, self.m, self.k = item_id, len(text), k
        self.top, self.mask = 1 << (self.m - 1), (1 << self.m) - 1
        self.eq: dict[str, int] = {}
        for i, c in enumerate(text):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def least(self, window: str, bound: int) -> int:
        """The least edit distance of the item to a substring of ``window`` (``bound`` if not below it)."""
        eq, mask, top, get = self.eq, self.mask, self.top, self.eq.get
        pv, mv, score, best = mask, 0, self.m, min(bound, self.m)
        left = len(window)
        for c in window:
            e = get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
                    if not best:
                        return 0
            left -= 1
            if score - left >= best:
                break  # the rest can lower the score by one a character at most
            ph <<= 1
            mh <<= 1
            pv = mask & (mh | ~(xv | ph))
            mv = ph & xv
        return best


class Matcher:
    def __init__(self, items: list[tuple[int | None, str | None]], rate: float) -> None:
        self.items: list[Item] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (t := normal(text)):
                continue
            it = Item(item_id, t, int(len(t) * rate))
            for at, piece in split_pieces(t, it.k):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append(it)
        self.tree = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.tree.add_word(piece, (len(piece), owners))
        if found:
            self.tree.make_automaton()
        self.any = bool(found)

    def find(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item, least distance) for each item that ``text`` has within its budget."""
        if not self.any or not text:
            return []
        t = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.tree.iter(t):
            begin = end - size + 1
            for i, at in owners:
                windows.setdefault(i, []).append((begin - at, begin))
        out = []
        for i, starts in windows.items():
            it = self.items[i]
            k = it.k
            best = k + 1
            ranges: list[list[int]] = []
            for s in sorted({s for s, _ in starts}):
                a, b = max(0, s - k), min(len(t), s + it.m + k)
                if ranges and a <= ranges[-1][0] + k:
                    ranges[-1][1] = max(ranges[-1][1], b)
                else:
                    ranges.append([a, b])
            for a, b in ranges:
                best = min(best, it.least(t[a:b], best))
                if not best:
                    break
            if best <= k:
                out.append((it.id, best))
        return out


_known: dict[tuple[str, float], Matcher] = {}


def _matcher(shard: tuple[str, Broadcast], rate: float) -> Matcher:
    """The matcher of a shard, made once in a worker; the last one is kept.

    A worker serves many jobs, so the key is the shard's own name: the address of a
    broadcast in a worker can be that of an earlier job's.
    """
    name, items = shard
    if (name, rate) not in _known:
        _known.clear()
        _known[name, rate] = Matcher(items.value, rate)
    return _known[name, rate]


def _item_shards(benchmark: DataFrame, least_chars: int) -> Iterator[tuple[str, Broadcast]]:
    """Shards of items, of SHARD_CHARS characters at most, about: a name that no other shard has, and a broadcast."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where((F.trim("text") != "") & (F.length("text") >= least_chars))
    n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // SHARD_CHARS + 1
    for shard in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == shard) if n > 1 else items
        yield uuid.uuid4().hex, context.broadcast([(r[0], r[1]) for r in part.collect()])


def leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least_chars: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, budget): every item that a document has within its error budget.

    The benchmark is read in shards of SHARD_CHARS characters, each with an
    automaton of its own, so what a task holds is bounded, and the documents are read
    once for each shard.  Items shorter than ``least_chars`` are left out; by default none
    is, so an item of one word matches every document that holds it.  Null and empty
    texts and items match nothing; an empty table on either side gives no rows.  Repeated rows of documents give repeated results;
    a repeated item counts by its least distance.  Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for shard in _item_shards(benchmark, least_chars):

        def run(batches: Iterator[pa.RecordBatch], shard: tuple[str, Broadcast] = shard) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shard, rate)
            budget = {}
            for it in matcher.items:
                budget[it.id] = max(it.k, budget.get(it.id, 0))
            for batch in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    least: dict = {}
                    for item, d in matcher.find(text.as_py()):
                        least[item] = min(d, least.get(item, d))
                    rows += [(doc_id, item, d, budget[item]) for item, d in least.items()]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "item_id", "distance", "budget"])

        part = map_batches(docs, run, "doc_id bigint, item_id bigint, distance int, budget int")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least_chars: int = 1) -> DataFrame:
    """The documents that hold no benchmark item; a filter inside the scan, with no shuffle.

    Columns are those of documents, unchanged; others are left out, whatever their names.
    Repeated rows stay repeated.  Null and empty texts are kept, as are all when there are
    no items.  ``least_chars`` is that of ``leaks``.
    """
    kept = documents.select(*DOCUMENT_COLUMNS)
    schema = kept.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    for shard in _item_shards(benchmark, least_chars):

        def run(batches: Iterator[pa.RecordBatch], shard: tuple[str, Broadcast] = shard) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shard, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(1)], pa.bool_()))

        kept = map_batches(kept, run, schema)
    return kept
