"""Text and page count of PDF files, with what was wrong with each, by a small reader that needs no PDF library.

It reads classic and compressed objects, Flate streams and the text operators of page contents, with the characters'
codes as Latin letters or by the font's map to Unicode. Encrypted files and fonts without such a map give warnings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The format's syntax.
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_TREE = re.compile(rb"/Type\s*/Pages\b")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_NEW_LINE = {b"T*", b"'", b'"', b"TD", b"ET"}
#: A gap in a line of characters, in thousandths of their size, that is a blank.
WORD_GAP = 180


def _inflated(body: bytes) -> tuple[bytes, str | None]:
    held = _STREAM.search(body)
    if not held:
        return b"", None
    data = held.group(1)
    if b"FlateDecode" in body[: held.start()]:
        try:
            return zlib.decompressobj().decompress(data), None
        except zlib.error as failure:
            return b"", f"broken stream: {failure}"
    return (b"", "unread stream") if b"/Filter" in body[: held.start()] else (data, None)


def objects(content: bytes) -> tuple[dict[int, bytes], list[str]]:
    """The file's objects by number, those inside object streams too, and warnings."""
    found = {int(n): body for n, body in _OBJECT.findall(content)}
    warnings = []
    for number in list(found):
        if b"/ObjStm" not in found[number]:
            continue
        data, problem = _inflated(found[number])
        first, count = re.search(rb"/First\s+(\d+)", found[number]), re.search(rb"/N\s+(\d+)", found[number])
        if problem or not first or not count:
            warnings.append(problem or "object stream without directory")
            continue
        places = list(map(int, data[: int(first[1])].split()[: 2 * int(count[1])]))
        starts = [int(first[1]) + p for p in places[1::2]] + [len(data)]
        for k, inner in enumerate(places[::2]):
            found.setdefault(inner, data[starts[k] : starts[k + 1]])
    return found, warnings


def _numbers(body: bytes, name: bytes) -> list[int]:
    place = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in _REFERENCE.findall(place[1])] if place else []


def pages(found: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree, or of their numbers where there is no tree."""
    roots = [n for n, b in found.items() if _TREE.search(b) and not re.search(rb"/Parent\s+\d+", b)]
    ordered: list[bytes] = []
    seen: set[int] = set()
    stack = roots[:1]
    while stack:
        number = stack.pop()
        if number in seen or number not in found:
            continue
        seen.add(number)
        if _TREE.search(found[number]):
            stack.extend(reversed(_numbers(found[number], b"Kids")))
        elif _PAGE.search(found[number]):
            ordered.append(found[number])
    return ordered or [b for _, b in sorted(found.items()) if _PAGE.search(b)]


def _unicode_maps(found: dict[int, bytes]) -> dict[int, str]:
    """Codes of two bytes to text, of all maps to Unicode in the file."""
    table: dict[int, str] = {}
    for body in found.values():
        data = _inflated(body)[0] if b"stream" in body else b""
        if b"begincmap" not in data:
            continue
        text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
            for code, meant in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
                table[int(code, 16)] = text(meant)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
            for low, high, meant in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
                for step in range(min(int(high, 16) - int(low, 16), 0xFFFF) + 1):
                    first = text(meant)
                    table[int(low, 16) + step] = first[:-1] + chr(ord(first[-1]) + step) if first else ""
    return table


def _string(token: bytes, table: dict[int, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if table and len(raw) % 2 == 0:
            return "".join(table.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.DOTALL)
    return raw.decode("cp1252", "replace")


def page_text(content: bytes, table: dict[int, str]) -> str:
    """Text of a page's content: strings that are shown, lines where the position moves down."""
    out: list[str] = []
    operands: list[bytes] = []
    for match in _TOKEN.finditer(content):
        token = match.group()
        if token[:1] in b"(<[]/+-.0123456789":
            operands.append(token)
            continue
        if token in _NEW_LINE or token in (b"Td", b"Tm") and len(operands) >= 2 and operands[-1] not in (b"0", b"0.0"):
            if out and not out[-1].endswith("\n"):
                out.append("\n")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for operand in operands:
                if operand[:1] in b"(<":
                    out.append(_string(operand, table))
                elif token == b"TJ" and operand[:1] == b"-" and float(operand) < -WORD_GAP:
                    out.append(" ")
        operands = []
    return "".join(out)


def read(content: bytes | None, min_pages: int | None = None) -> tuple[int | None, str | None, str]:
    """(pages, text, warnings) of a file. Pages and text are null for what is no PDF; text too if there are fewer pages than asked for."""
    if not content or b"%PDF" not in content[:1024]:
        return None, None, "no PDF"
    found, warnings = objects(content)
    if re.search(rb"/Encrypt\s+\d+", content):
        warnings.append("encrypted")
    own = pages(found)
    if not own:
        return None, None, ";".join([*warnings, "no pages"])
    if min_pages is not None and len(own) < min_pages:
        return len(own), None, ";".join([*warnings, "too few pages"])
    table = _unicode_maps(found)
    texts = []
    for page in own:
        parts = []
        for number in _numbers(page, b"Contents"):
            data, problem = _inflated(found.get(number, b""))
            parts.append(data)
            if problem:
                warnings.append(problem)
        texts.append(page_text(b"\n".join(parts), table))
    text = "\n".join(texts)
    if not text.strip():
        warnings.append("no text")
    return len(own), text, ";".join(dict.fromkeys(warnings))


def extract(files: DataFrame, min_pages: int | None = None) -> DataFrame:
    """(id, pages, text, warnings) of files with their content; a file that cannot be read is a row with a warning, never a failure.

    Files without a byte are not listed by the file source and so have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["id"], batch["content"]):
                try:
                    rows.append((name, *read(content, min_pages)))
                except Exception as failure:  # one broken file must not end the run
                    rows.append((name, None, None, f"{type(failure).__name__}: {failure}"))
            made = pd.DataFrame(rows, columns=["id", "pages", "text", "warnings"], dtype=object)
            yield made

    return files.select("id", "content").mapInPandas(run, "id string, pages int, text string, warnings string")
