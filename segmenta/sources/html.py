"""Translatable texts of HTML: descriptions, blocks with their inline codes, texts of images."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.inline import Builder
from segmenta.schema import unit
from segmenta.sources.common import read_streams

BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd caption figcaption blockquote label option title".split())
INLINE = frozenset("b i em strong a span u s small mark code sub sup abbr q cite dfn kbd samp var br img wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MEANING = {"b": "bold", "i": "italic", "a": "link", "u": "underline", "br": "break", "img": "image"}
#: A start tag ends these, when open, without an end tag.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
_P_ENDERS = BLOCKS - {"label", "option", "title", "caption"} | frozenset("div ul ol dl table section article nav aside header footer form hr pre main figure fieldset address".split())
_FENCES = frozenset("html body table ul ol dl div select td th li".split())


class _Pages(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.language = ""
        self.stack: list[str] = []
        self.blocks: list[tuple[int, str, Builder, int]] = []  # start, tag, content, depth of the stack
        self.found: list[tuple[int, str, str, Builder | None]] = []
        self.metas: list[tuple[str, str]] = []
        self.starts = self.silent = 0

    def _pop(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            self._closed(top)
            if top == tag:
                break

    def _closed(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if self.blocks and self.blocks[-1][1] == tag and self.blocks[-1][3] == len(self.stack):
            start, name, b, _ = self.blocks.pop()
            self.found.append((start, name, b.plain, b))
        elif self.blocks and tag in INLINE:
            b = self.blocks[-1][2]
            for i in range(len(b.open) - 1, -1, -1):
                if b.open[i][0] == tag:
                    pair = b.open.pop(i)[1]
                    b.code(f"{MEANING.get(tag, tag)}.close", tag, {}, f"</{tag}>", pair)
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.language = a.get("lang", "")
        for ended in (_ENDS.get(tag, frozenset()) | ({"p"} if tag in _P_ENDERS else frozenset())):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i] == ended:
                    self._pop(ended)
                    break
                if self.stack[i] in _FENCES:
                    break
        self.starts += 1
        if tag == "meta" and a.get("name", "").lower() in ("description", "keywords") and a.get("content", "").strip():
            self.metas.append((a["name"].lower(), a["content"].strip()))
        if tag == "img" and a.get("alt", "").strip():
            self.found.append((self.starts, "img", a["alt"].strip(), None))
        if self.blocks and tag in INLINE:
            b = self.blocks[-1][2]
            if tag in VOID:
                b.code(f"{MEANING.get(tag, tag)}.standalone", tag, a, self.get_starttag_text())
            else:
                pair = b.new_pair()
                b.open.append((tag, pair))
                b.code(f"{MEANING.get(tag, tag)}.open", tag, a, self.get_starttag_text(), pair)
        if tag in VOID:
            return
        if tag in BLOCKS:
            self.blocks.append((self.starts, tag, Builder(), len(self.stack)))
        self.stack.append(tag)
        self.silent += tag in ("script", "style")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop(tag)

    def handle_endtag(self, tag: str) -> None:
        self._pop(tag)

    def handle_data(self, data: str) -> None:
        if self.blocks and not self.silent:
            self.blocks[-1][2].text(data)

    def finish(self) -> None:
        self.close()
        while self.stack:
            self._closed(self.stack.pop())


def _trimmed(b: Builder) -> None:
    texts = [p for p in b.parts if p["kind"] == "text"]
    if texts:
        texts[0]["value"] = texts[0]["value"].lstrip()
        texts[-1]["value"] = texts[-1]["value"].rstrip()
    b.parts = [p for p in b.parts if p["kind"] == "code" or p["value"]]


def page_units(html: str | None) -> list[dict]:
    """Units in order: descriptions first, then blocks and images by where they begin; ids html:<tag>:<place>.

    A block's text is its own, with inline elements as codes; blocks inside it come
    after it.  Places count units only.  Missing end tags of p, li, td, tr, dt, dd and
    option are supplied.  Null and empty pages have no units.
    """
    p = _Pages()
    p.feed(html or "")
    p.finish()
    return list(_units(_texts(p.metas, [p.found]), p.language))


def _texts(metas: list[tuple[str, str]], found: Iterable[list[tuple[int, str, str, Builder | None]]]) -> Iterator[tuple[str, str, Builder | None]]:
    for _, text in metas:
        yield "meta", text, None
    for some in found:
        for _, tag, text, b in sorted(some, key=lambda x: x[0]):
            if b is not None:
                _trimmed(b)
                text = b.plain
            if text.strip():
                yield tag, text, b


def _units(texts: Iterable[tuple[str, str, Builder | None]], language: str) -> Iterator[dict]:
    for i, (tag, text, b) in enumerate(texts):
        tags = {"source_ties": b.ties, "source_parts": b.parts, "target_ties": [], "target_parts": []} if b is not None and b.ties else None
        yield unit(unit_id=f"html:{tag}:{i}", source=text if tags else text.strip(), tags=tags, source_locale=language, ordinal=i)


_HEADS = re.compile(rb"<(?:meta|html)\b", re.IGNORECASE)


_SIZE = 1 << 16


def _fed(f: IO[bytes], p: _Pages, until: int | None = None) -> Iterator[_Pages]:
    """The parser after each piece of a file, up to piece ``until`` or with the end of the file."""
    f.seek(0)
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for n, piece in enumerate(iter(lambda: f.read(_SIZE), b"")):
        p.feed(decoder.decode(piece))
        yield p
        if until is not None and n >= until and not p.rawdata.startswith("<"):
            return
    p.feed(decoder.decode(b"", True))
    p.finish()
    yield p


def heads(f: IO[bytes]) -> tuple[list[tuple[str, str]], str]:
    """The descriptions and the language of a page, which may stand anywhere in it."""
    f.seek(0)
    last, left = -1, b""
    for n, piece in enumerate(iter(lambda: f.read(_SIZE), b"")):
        if _HEADS.search(left + piece):
            last = n
        left = piece[-8:]
    metas, language = [], ""
    for p in _fed(f, _Pages(), last):
        p.found = []
        metas, language = p.metas, p.language
    return metas, language


class _Placed(_Pages):
    """A parser that knows where in the text its finds are: ``spans`` by their start, of blocks without their tags."""

    def __init__(self) -> None:
        super().__init__()
        self.at = 0
        self.spans: dict[int, list[int]] = {}
        self.tags: list[tuple[int, int]] = []  # of descriptions

    def updatepos(self, i: int, j: int) -> int:
        self.at += max(0, j - i)
        return super().updatepos(i, j)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        metas, end = len(self.metas), self.at + len(self.get_starttag_text() or "")
        super().handle_starttag(tag, attrs)
        if len(self.metas) > metas:
            self.tags.append((self.at, end))
        if tag == "img":
            self.spans[self.starts] = [self.at, end]
        elif tag in BLOCKS:
            self.spans[self.starts] = [end, end]

    def _closed(self, tag: str) -> None:
        top = self.blocks[-1][0] if self.blocks else None
        super()._closed(tag)
        if top is not None and (not self.blocks or self.blocks[-1][0] != top):
            self.spans[top][1] = max(self.at, self.spans[top][0])


def cut_units(f: IO[bytes], size: int = 1 << 13) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """A page as pieces of text, to be joined by ``>``, each with its units (id, source, where it begins and ends in the piece).

    Pieces end outside of open blocks; ids and sources are those of ``iter_units``.
    """
    metas, i = 0, len(heads(f)[0])
    f.seek(0)
    p, decoder, text, base = _Placed(), codecs.getincrementaldecoder("utf-8")("replace"), "", 0
    waiting: list[tuple[str, str, int, int]] = []
    ended = False
    while not ended:
        piece = f.read(size)
        ended = not piece
        more = decoder.decode(piece, ended)
        text += more
        p.feed(more)
        if ended:
            p.finish()
        for begin, end in p.tags:
            waiting.append((f"html:meta:{metas}", p.metas[metas][1], begin, end))
            metas += 1
        p.tags = []
        start = p.blocks[0][0] if p.blocks else p.starts + 1
        done, p.found = sorted((x for x in p.found if x[0] < start), key=lambda x: x[0]), [x for x in p.found if x[0] >= start]
        for n, tag, plain, b in done:
            span = p.spans.pop(n)
            for tag, source, _ in _texts([], [[(n, tag, plain, b)]]):
                waiting.append((f"html:{tag}:{i}", source, *span))
                i += 1
        p.spans = {k: x for k, x in p.spans.items() if k >= start}
        if ended:
            break
        limit = min([p.spans[start][0]] if p.blocks else [p.at]) - base
        while True:
            cut = text.rfind(">", 0, limit) + 1
            across = [b - base for _, _, b, e in waiting if b - base < cut < e - base]
            if not across:
                break
            limit = min(across)
        if cut:
            yield text[: cut - 1], [(k, x, b - base, e - base) for k, x, b, e in waiting if b - base < cut]
            waiting = [x for x in waiting if x[2] - base >= cut]
            text, base = text[cut:], base + cut
    yield text, [(k, x, b - base, e - base) for k, x, b, e in waiting]


def iter_units(f: IO[bytes]) -> Iterator[dict]:
    """The same from a file that can seek: what is outside of open blocks is given out while the rest is read."""
    metas, language = heads(f)

    def found() -> Iterator[list]:
        for p in _fed(f, _Pages()):
            if not p.blocks:
                yield p.found
                p.found = []
                continue
            # what begins before the outermost open block is done
            start = p.blocks[0][0]
            yield [x for x in p.found if x[0] < start]
            p.found = [x for x in p.found if x[0] > start]

    yield from _units(_texts(metas, found()), language)


def units(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ordinal, unit_id, source, codes) of a column of pages."""
    schema = f"{key} bigint, ordinal int, unit_id string, source string, codes int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, u["ordinal"], u["unit_id"], u["source"], len((u["tags"] or {}).get("source_ties", []))) for k, text in zip(frame[key], frame[column], strict=True) for u in page_units(text)]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "unit_id", "source", "codes"])

    return pages.select(F.col(key).cast("bigint").alias(key), column).mapInPandas(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_streams(spark, path, lambda f, _: iter_units(f), ">")


