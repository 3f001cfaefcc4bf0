"""Text of PDF pages on the standard library: page tree, object and content streams, text operators.

It reads what most writers of plain documents produce: uncompressed or deflated streams, object streams, and simple fonts of Latin
encoding. Fonts that need a character map, and encrypted files, are errors, so a page is never silently wrong.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_object = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_stream = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_reference = re.compile(rb"(\d+)\s+\d+\s+R")
_token = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]()<>]+", re.S)
_escape = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
#: What a backslash stands for before these letters.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class BadPdf(ValueError):
    """A file or page whose text cannot be read."""


def _inflated(header: bytes, data: bytes) -> bytes:
    filters = re.findall(rb"/(\w+Decode)\b", header.split(b"/Filter", 1)[1][:80]) if b"/Filter" in header else []
    for name in filters:
        if name != b"FlateDecode":
            raise BadPdf(f"streams of {name.decode()} are not read")
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error as error:
            raise BadPdf(str(error)) from error
    return data


def _objects(content: bytes) -> tuple[dict[int, bytes], dict[int, tuple[bytes, bytes]]]:
    """(number -> body, number -> (header, raw data)) of plain and packed objects."""
    plain, streams = {}, {}
    for m in _object.finditer(content):
        number, body = int(m[1]), m[2]
        if found := _stream.match(body):
            streams[number], body = (found[1], found[2]), found[1]
        plain[number] = body
    for number, (header, data) in list(streams.items()):
        if re.search(rb"/Type\s*/ObjStm", header):
            text, first = _inflated(header, data), int(re.search(rb"/First\s+(\d+)", header)[1])
            table = [int(x) for x in text[:first].split()]
            places = list(zip(table[::2], table[1::2], strict=True))
            for (n, at), end in zip(places, [p for _, p in places[1:]] + [len(text) - first], strict=True):
                plain.setdefault(n, text[first + at : first + end])
    return plain, streams


def _value(body: bytes, key: bytes) -> bytes:
    found = re.search(rb"/" + key + rb"\s*(\[.*?\]|<<.*?>>|\d+\s+\d+\s+R|/?[^\s/<>\[\]]+)", body, re.S)
    return found[1] if found else b""


def _literal(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    plain = lambda m: ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else m[1])
    return _escape.sub(plain, token[1:-1]).decode("latin-1")


def text_of(content: bytes) -> str:
    """The text that a content stream shows, a line for each move of the text position."""
    out, given, inside = [], [], False
    for token in _token.findall(content):
        if token[:1] in b"(<" and token != b"<" and not token.startswith(b"<<"):
            given.append(_literal(token))
        elif token == b"[":
            inside, given = True, []
        elif token == b"]":
            inside = False
        elif inside:
            if re.fullmatch(rb"-?\d*\.?\d+", token) and float(token) < -200:  # a wide gap between two pieces
                given.append(" ")
        else:
            if token in (b"'", b'"', b"T*", b"Td", b"TD", b"Tm", b"ET") and out and out[-1] != "\n":
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out.append("".join(given))
            if not re.fullmatch(rb"[-+]?\d*\.?\d+|/\S+", token):
                given = []
    return "".join(out).strip("\n")


def page_texts(content: bytes) -> Iterator[str]:
    """The text of each page in page order."""
    if not content.lstrip().startswith(b"%PDF"):
        raise BadPdf("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise BadPdf("encrypted files are not read")
    plain, streams = _objects(content)
    root = next((b for b in plain.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    top = _reference.match(_value(root or b"", b"Pages"))
    if not top:
        raise BadPdf("no page tree")

    def walk(number: int, seen: frozenset[int]) -> Iterator[str]:
        if number in seen or number not in plain:
            raise BadPdf(f"page {number} is missing")
        body = plain[number]
        if re.search(rb"/Type\s*/Pages\b", body):
            for kid in _reference.findall(_value(body, b"Kids")):
                yield from walk(int(kid), seen | {number})
            return
        parts = []
        for part in map(int, _reference.findall(_value(body, b"Contents"))):
            if part not in streams:
                raise BadPdf(f"content {part} is missing")
            parts.append(_inflated(*streams[part]))
        shown = b"\n".join(parts)
        if b"Tj" in shown or b"TJ" in shown:
            if any(re.search(rb"/Subtype\s*/Type0\b", plain.get(int(f), b"")) for f in _reference.findall(_value(body, b"Resources") + body)):
                raise BadPdf("fonts with a character map are not read")
        yield text_of(shown)

    yield from walk(int(top[1]), frozenset())
