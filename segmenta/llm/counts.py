"""Edit-aware token counts.

Each document keeps a segment tree over leaves of whole pre-tokens.  A leaf ends
at a safe cut (see ``tokens``), so its token count doesn't depend on the rest of
the text.  The tree is an array in heap order: node i has children 2i and 2i + 1,
and holds the bytes and the tokens below it.  An edit is looked up by its byte
offset on the way down, the leaves it touches (with neighbours, where the edit
spoils the cut between them) are encoded anew, and sums are updated on the way up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm import textkernel as tk
from segmenta.llm import tokens
from segmenta.llm.common import map_batches

#: Bytes of a leaf, at least, where the text has cuts.
LEAF_BYTES = 512
#: (what must be in the text, pattern, replacement): edits of the query, which take personal data out.
REDACTIONS = (
    (b"@", re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"), b"<email>"),
    (b"", re.compile(rb"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|\d[\d ()-]{8,}\d"), b"<number>"),
)
Edit = tuple[int, int, bytes]


def redactions(data: bytes) -> list[Edit]:
    """(byte offset, bytes removed, bytes put in) of each piece of personal data."""
    out = []
    for needle, pattern, new in REDACTIONS:
        if needle in data:
            out += [(m.start(), m.end() - m.start(), new) for m in pattern.finditer(data)]
    return sorted(out)


def _safe(left: bytes, right: bytes) -> bool:
    """Whether the place between two pieces is a safe cut."""
    if not left or not right:
        return False
    around = np.frombuffer(left[-2:] + right[:2], np.uint8)
    return len(left[-2:]) in tokens.cuts(around)


class Tree:
    """Sums of bytes and tokens over the leaves of one text."""

    def __init__(self, leaf_bytes: list[int], leaf_tokens: list[int]) -> None:
        self.n = max(1, len(leaf_bytes))
        self.base = 1 << (self.n - 1).bit_length()
        self.size = [0] * (2 * self.base)
        self.tokens = [0] * (2 * self.base)
        self.size[self.base : self.base + len(leaf_bytes)] = leaf_bytes
        self.tokens[self.base : self.base + len(leaf_tokens)] = leaf_tokens
        for i in range(self.base - 1, 0, -1):
            self.size[i] = self.size[2 * i] + self.size[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first byte) of the byte at ``offset``; the last leaf with bytes, if it is the end."""
        if offset >= self.size[1]:
            offset = max(0, self.size[1] - 1)
        i, begin = 1, 0
        while i < self.base:
            i *= 2
            if offset - begin >= self.size[i]:
                begin += self.size[i]
                i += 1
        return min(i - self.base, self.n - 1), begin

    def update(self, leaf: int, size: int, count: int) -> None:
        i = leaf + self.base
        by, more = size - self.size[i], count - self.tokens[i]
        while i:
            self.size[i] += by
            self.tokens[i] += more
            i //= 2


def _split(region: bytes, slots: int) -> list[bytes]:
    """``slots`` pieces of ``region``, divided at safe cuts as evenly as these allow; some may be empty."""
    if slots == 1:
        return [region]
    at = tokens.cuts(np.frombuffer(region, np.uint8)) if region else np.zeros(0, np.int64)
    edges = [0]
    for k in range(1, slots):
        i = int(np.searchsorted(at, len(region) * k // slots))
        edges.append(max(edges[-1], int(at[i]) if i < len(at) else len(region)))
    edges.append(len(region))
    return [region[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def apply_edits(data: bytes, tree: Tree, edits: list[Edit], coder: tiktoken.Encoding) -> tuple[bytes, int, int]:
    """(new text, edits applied, bytes encoded anew); ``tree`` is brought up to date.

    Offsets are bytes of the old text; those inside a character are moved to its
    beginning, those beyond the end to the end.  Of edits that overlap, the later is
    left out.
    """
    ok: list[Edit] = []
    done = 0
    for s, size, new in sorted(edits, key=lambda e: e[:2]):
        a, b = max(0, min(s, len(data))), max(0, min(s + size, len(data)))
        while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        while 0 < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a >= done and b >= a:
            ok.append((a, b, new))
            done = b
    starts = np.concatenate([[0], np.cumsum(tree.size[tree.base : tree.base + tree.n])]).tolist()
    changed: dict[int, bytes] = {}

    def content(i: int) -> bytes:
        return changed[i] if i in changed else data[starts[i] : starts[i + 1]]

    work = 0
    for a, b, new in reversed(ok):  # from the end, so that offsets before it stay true
        i, begin = tree.find(a)
        j = tree.find(b - 1)[0] if b > a else i
        region = b"".join(content(k) for k in range(i, j + 1))
        region = region[: a - begin] + new + region[b - begin :]
        while i and not _safe(content(i - 1), region):
            i -= 1
            region = content(i) + region
        while j < tree.n - 1 and not _safe(region, content(j + 1)):
            j += 1
            region += content(j)
        for k, piece in enumerate(_split(region, j - i + 1), i):
            changed[k] = piece
            tree.update(k, len(piece), len(coder.encode_ordinary(piece.decode("utf-8", "replace"))))
        work += len(region)
    return b"".join(content(k) for k in range(tree.n)), len(ok), work


def leaves(body: np.ndarray, offs: np.ndarray, coder: tokens.Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each leaf, tokens of each leaf, number of leaves of each text) of texts laid end to end."""
    starts = tokens.unit_starts(body, offs)
    _, size = coder.units(body, starts)
    doc = np.searchsorted(offs, starts, side="right") - 1
    block = (starts - offs[doc]) // LEAF_BYTES
    first = np.ones(len(starts), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(first)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs) - 1, np.int64)
    return np.diff(np.append(starts[at], len(body))), np.add.reduceat(size, at), np.bincount(doc[at], minlength=len(offs) - 1)


_OUT = "doc_id bigint, tokens_before bigint, edits int, bytes_encoded bigint, tokens bigint, leaf_bytes array<int>, tree array<bigint>"


def _trees(batch: pa.RecordBatch, coder: tokens.Encoder, edits: list[list[Edit]] | None, redact: bool, kept: list | None = None) -> tuple[list[tuple], list[str | None]]:
    body, offs = tk.raw(batch.column(1))
    ids, null = batch.column(0).to_pylist(), batch.column(1).is_null().to_pylist()
    rows, texts = [], []
    for a, b in tk.pieces(offs):
        part, o = body[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        if kept is None:
            sizes, counts, n = leaves(part, o, coder)
            end = np.cumsum(n)
        data = part.tobytes()
        for d in range(a, b):
            if kept is None:
                own = slice(end[d - a] - n[d - a], end[d - a])
                tree = Tree(sizes[own].tolist(), counts[own].tolist())
            else:
                tree = Tree(list(kept[d][0] or []), list((kept[d][1] or [])[len(kept[d][1] or []) // 2 :][: len(kept[d][0] or [])]))
            text, before = data[o[d - a] : o[d - a + 1]], tree.tokens[1]
            todo = redactions(text) if redact else edits[d] if edits else []
            new, made, work = apply_edits(text, tree, todo, coder.coder) if todo else (text, 0, 0)
            rows.append((ids[d], before, made, work, tree.tokens[1], tree.size[tree.base : tree.base + tree.n], tree.tokens))
            texts.append(None if null[d] and not new else new.decode("utf-8", "replace"))
    return rows, texts


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
_NAMES = ["doc_id", "tokens_before", "edits", "bytes_encoded", "tokens", "leaf_bytes", "tree"]


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
    return [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]


def count_tokens(documents: DataFrame, redact: bool = True, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens_before, edits, bytes_encoded, tokens, leaf_bytes, tree) of each row of documents.

    ``tokens_before`` counts the text as it is; with ``redact``, the edits that
    ``redactions`` finds are then applied and ``tokens`` counts the outcome, of which
    ``bytes_encoded`` were encoded anew.  ``leaf_bytes`` and ``tree`` (tokens, in heap
    order, root at 1) are kept for ``recount``.  Null and empty texts have 0 tokens and
    one empty leaf.  Repeated rows are counted each.  An empty table gives no rows.
    Other columns are ignored.  No shuffle.
    """
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_arrays(_trees(batch, coder, None, redact)[0]), _NAMES)

    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, _OUT)


def recount(kept: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Kept trees after edits: the columns of ``count_tokens`` and the new text.

    ``kept`` has doc_id, text, leaf_bytes, tree and edits, an array of (at, size,
    text) with byte offsets; null edits are none.  Only regions that edits touch are
    encoded.
    """
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        for batch in batches:
            edits = [[(e["at"] or 0, e["size"] or 0, (e["text"] or "").encode()) for e in x or [] if e is not None] for x in batch.column(4).to_pylist()]
            trees = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            rows, texts = _trees(batch, coder, edits, False, trees)
            yield pa.RecordBatch.from_arrays([*_arrays(rows), pa.array(texts, pa.string())], [*_NAMES, "text"])

    return map_batches(kept.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "leaf_bytes", "tree", "edits"), run, _OUT + ", text string")
