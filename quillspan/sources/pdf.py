"""Text of simple PDF files, page by page: the offline converter. Others can take its place as providers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a file may have at most: pages, characters, bytes that its streams inflate to, levels of its tree of pages.
MOST_PAGES, MOST_CHARS, MOST_INFLATED, MOST_LEVELS = 100, 200_000, 1 << 26, 64
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_SHOWN = re.compile(r"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Td|TD|T\*|ET)\b|['\"]", re.DOTALL)


class Refused(ValueError):
    """Why a file gives no page."""


def _string(token: str) -> str:
    if token.startswith("<"):
        digits = "".join(token[1:-1].split())
        return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("latin-1")
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: _ESCAPES.get(m[1], chr(int(m[1], 8) & 255) if m[1].isdigit() else m[1]), token[1:-1], flags=re.DOTALL)


def _shown(stream: bytes) -> str:
    """The strings that a content stream shows; moves to another line are line ends."""
    out = []
    for token in _SHOWN.findall(stream.decode("latin-1")):
        out.append(_string(token) if token.startswith(("(", "<")) else "\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


class File:
    """Objects of a file, those in object streams too. What streams inflate to is bounded over the whole file."""

    def __init__(self, content: bytes, most_inflated: int) -> None:
        self.left = most_inflated
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._packed(body)
        roots = [int(m[1]) for m in re.finditer(rb"/Root\s+(\d+)\s+\d+\s+R", content)]
        self.root = next((self.objects[r] for r in reversed(roots) if r in self.objects), b"") or next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")

    def _packed(self, body: bytes) -> None:
        """An object stream: pairs of number and offset, then the objects themselves."""
        count, first = re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        for data in self.streams(body) if count and first else ():
            start = int(first[1])
            numbers = [int(x) for x in data[:start].split()[: 2 * int(count[1])]]
            places = [*numbers[1::2], len(data) - start]
            for number, a, b in zip(numbers[::2], places, places[1:], strict=False):
                self.objects.setdefault(number, data[start + a : start + b])

    def streams(self, body: bytes) -> Iterator[bytes]:
        for data in _STREAM.findall(body):
            if b"/FlateDecode" in body:
                reader = zlib.decompressobj()
                data = reader.decompress(data, self.left + 1)
                self.left -= len(data)
                if self.left < 0:
                    raise Refused("inflates to too much")
            yield data

    def references(self, body: bytes, name: bytes) -> list[int]:
        """What an entry refers to: one object, an array of them, or an object that is such an array."""
        m = re.search(rb"/" + name + rb"\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R\b)", body)
        if not m:
            return []
        if m[1] is not None:
            return [int(x) for x in _REFERENCE.findall(m[1])]
        held = self.objects.get(int(m[2]), b"").strip()
        return [int(x) for x in _REFERENCE.findall(held)] if held.startswith(b"[") else [int(m[2])]

    def pages(self) -> list[bytes]:
        """Leaves of the tree of pages, in its order; without a tree, pages by their numbers."""
        out, seen = [], set()

        def visit(number: int, level: int) -> None:
            body = self.objects.get(number, b"")
            if number in seen or level > MOST_LEVELS:
                return
            seen.add(number)
            if re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
            for kid in self.references(body, b"Kids"):
                visit(kid, level + 1)

        for number in self.references(self.root, b"Pages"):
            visit(number, 0)
        return out or [body for _, body in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", body)]


def page_texts(content: bytes, most_pages: int = MOST_PAGES, most_chars: int = MOST_CHARS, most_inflated: int = MOST_INFLATED) -> list[str]:
    """The text of each page, in the order of the file's tree of pages; raises Refused for what is no PDF, encrypted, too
    long, inflates to too much or has no pages."""
    if not content.startswith(b"%PDF-"):
        raise Refused("not a PDF")
    if b"/Encrypt" in content:
        raise Refused("encrypted")
    file = File(content, most_inflated)
    pages = file.pages()
    if not pages:
        raise Refused("no pages")
    if len(pages) > most_pages:
        raise Refused(f"over {most_pages} pages")
    out, size = [], 0
    for page in pages:
        text = "\n".join(_shown(data) for ref in file.references(page, b"Contents") for data in file.streams(file.objects.get(ref, b"")))
        out.append(text)
        size += len(text)
        if size > most_chars:
            raise Refused(f"over {most_chars} characters")
    return out


#: Converters by name.
CONVERTERS: dict[str, Callable[[bytes], list[str]]] = {"text": page_texts}


def pdf_pages(files: DataFrame, key: str, content: str, converter: str | Callable[[bytes], list[str]] = "text") -> DataFrame:
    """(key, page, text, reason): a row for each page of each file; of a file that gives none, one with the reason."""
    convert = CONVERTERS[converter] if isinstance(converter, str) else converter

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, c in zip(f[key], f[content], strict=True):
                try:
                    rows = [(k, i + 1, t, None) for i, t in enumerate(convert(bytes(c or b"")))]
                except Exception as e:  # noqa: BLE001  a converter is foreign code; its failure is a value here
                    rows = [(k, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=[key, "page", "text", "reason"]).astype({"page": "Int32"})

    return files.select(key, content).mapInPandas(work, f"`{key}` {files.schema[key].dataType.simpleString()}, page int, text string, reason string")


def sections(pages: DataFrame, key: str) -> DataFrame:
    """(key, markdown): a file's pages under headings."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("## Page "), x["page"], F.lit("\n\n"), x["text"]))
    return pages.filter("page IS NOT NULL").groupBy(key).agg(F.array_join(each, "\n\n").alias("markdown"))
