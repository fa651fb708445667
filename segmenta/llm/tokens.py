"""Byte-level BPE over whole Arrow columns, one vocabulary lookup for each distinct unit.

A unit is a run of bytes between safe cuts.  A cut stands before one blank or
line feed that has a character other than white space on either side: the
pre-tokenizer always divides there, so units encode independently and the ids of
a text are those of its units in a row.  Texts without such cuts are one unit.
A worker keeps the ids of the units that it has met, by 64-bit hash, up to
MEMO_UNITS; then it begins anew.  That changes time, never ids.
"""

from __future__ import annotations

import base64
import os
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import SparkSession

from segmenta.llm import textkernel as tk

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units whose ids a worker remembers, which bounds its memory.
MEMO_UNITS = 1_500_000
#: Longer units are encoded each time, as they hardly repeat.
MEMO_BYTES = 64


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    """A vocabulary file in ``folder``, else in the one that the session names in ``spark.segmenta.tokenizers``, else in TOKENIZER_DIR."""
    session = SparkSession.getActiveSession() if folder is None else None
    return os.path.join(folder or (session.conf.get("spark.segmenta.tokenizers", None) if session is not None else None) or TOKENIZER_DIR, name)


_BLANK = np.zeros(256, bool)
_BLANK[[32, 10]] = True
#: ASCII characters other than white space, for the byte before a cut.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
#: First bytes of characters that are never white space, for the byte after a cut.
_LEAD = _SOLID.copy()
_LEAD[0xC3:0xE1] = True
_LEAD[0xE4:0xF5] = True
#: First bytes of two-byte characters that are never white space.
_PAIR = np.zeros(256, bool)
_PAIR[0xC3:0xE0] = True


def cuts(body: np.ndarray) -> np.ndarray:
    """Positions of the safe cuts in one text's bytes (or in texts laid end to end)."""
    at = np.flatnonzero(_BLANK[body])
    at = at[(at > 0) & (at < len(body) - 1)]
    before = _SOLID[body[at - 1]] | ((at > 1) & _PAIR[body[at - 2]])
    return at[before & _LEAD[body[at + 1]]]


def unit_starts(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the units of texts laid end to end at ``offs``; empty texts have none."""
    at = cuts(body)
    # a cut needs its neighbours in the same text
    doc = np.searchsorted(offs, at, side="right") - 1
    inner = (at > offs[doc]) & (at + 1 < offs[doc + 1])
    first = offs[:-1][offs[:-1] < offs[1:]]
    return np.sort(np.concatenate([at[inner], first]))


class Encoder:
    """Encodes columns of texts; holds the memo of units."""

    def __init__(self, path: str) -> None:
        self.coder = encoding(path)
        self.token_bytes = np.array([len(self.coder.decode_single_token_bytes(i)) for i in range(self.coder.n_vocab)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each unit).

        Units that begin with a blank and end with a solid character are encoded end
        to end in one call, as there are safe cuts between them; the ids are divided
        by the bytes that they stand for.
        """
        encode, plain = self.coder.encode_ordinary, b" \n"
        joined = [len(x) > 1 and x[0] in plain and 32 < x[-1] < 127 and x[1] > 32 for x in raw]
        text = b"".join([x for x, j in zip(raw, joined, strict=True) if j])
        ids = np.array(encode(text.decode("utf-8", "replace")), np.uint32)
        ends = np.cumsum(np.fromiter((len(x) for x, j in zip(raw, joined, strict=True) if j), np.int64))
        upto = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1 if len(ends) else ends
        if all(joined):
            return ids, np.diff(upto, prepend=0)
        sizes, flat, at = np.zeros(len(raw), np.int64), [], 0
        where = iter(upto.tolist())
        for i, (x, j) in enumerate(zip(raw, joined, strict=True)):
            if j:
                end = next(where)
                own, at = ids[at:end], end
            else:
                own = np.array(encode(x.decode("utf-8", "replace")), np.uint32)
            sizes[i] = len(own)
            flat.append(own)
        return np.concatenate(flat), sizes

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        flat, sizes = self._encode(raw)
        slots = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(raw))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.slots = np.insert(self.slots, at, slots)

    def units(self, body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) in ``self.ids`` of each unit; long units go to the end of ``ids`` for this call."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.keys) > MEMO_UNITS:
            self.clear()
        ends = np.append(starts[1:], len(body))
        sizes = ends - starts
        up, down = tk._pow(len(body))
        run = np.add.accumulate(tk._BYTE_ALL[body] * up)
        h = run[ends - 1] - run[starts] + tk._BYTE_ALL[body[starts]] * up[starts]
        h = tk.mix64(h * down[starts] + sizes.astype(np.uint64))
        short = sizes <= MEMO_BYTES
        slot = np.zeros(n, np.int64)
        data = body.tobytes()
        if short.any():
            u, first, back = np.unique(h[short], return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, u)
            known = np.zeros(len(u), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == u[inside]
            if not known.all():
                where = np.flatnonzero(short)[first[~known]]
                self._learn(u[~known], [data[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            slot[short] = self.slots[np.searchsorted(self.keys, u)][back]
        begin, size = self.begin[slot], self.begin[slot + 1] - self.begin[slot] if short.any() else np.zeros(n, np.int64)
        if not short.all():
            at = len(self.ids)
            where = np.flatnonzero(~short)
            flat, size[where] = self._encode([data[starts[i] : ends[i]] for i in where])
            self.extra = [flat]
            begin[where] = at + np.cumsum(size[where]) - size[where]
        else:
            self.extra = []
        return begin, size

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        body, offs = tk.raw(column)
        flat, counts = [], np.zeros(len(offs) - 1, np.int64)
        for a, b in tk.pieces(offs):
            part, o = body[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            starts = unit_starts(part, o)
            begin, size = self.units(part, starts)
            total = int(size.sum())
            ids = np.concatenate([self.ids, *self.extra]) if self.extra else self.ids
            shift = np.repeat(begin - (np.cumsum(size) - size), size)
            flat.append(ids[shift + np.arange(total)])
            sums = np.concatenate([[0], np.cumsum(size)])
            counts[a:b] = np.diff(sums[np.searchsorted(starts, o)])
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


assert sys.byteorder == "little"
