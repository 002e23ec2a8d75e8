"""The cells of an exported notebook (source and outputs) as blocks of text, without the export's own markup."""

from __future__ import annotations

import json
import re

STRING = re.compile(r'"((?:[^"\\]|\\.)*+)("?)(\s*:)?', re.DOTALL)
CONTENT_KEYS = {"source", "text", "text/plain", "text/html", "text/markdown", "text/latex", "traceback", "evalue"}
MARKER = re.compile(r"^(?:#[ \t]*%%.*|#[ \t]*Out:[ \t]*|(?:In|Out) ?\[[\d ]*\]:[ \t]*|[ \t]*(?:```|~~~)[\w{}. -]*)$", re.MULTILINE)
PREFIX = re.compile(r"^#{1,6}(?: |$)(?:#{1,6} )?", re.MULTILINE)
BLANK = re.compile(r"\n[ \t]*\n")


def _joined(x: object) -> str:
    return x if isinstance(x, str) else "".join(y for y in x if isinstance(y, str)) if isinstance(x, list) else ""


def _walked(x: object, out: list[str]) -> None:
    if isinstance(x, dict):
        for k, v in x.items():
            if k in CONTENT_KEYS:
                out.append(_joined(v))
            elif isinstance(v, (dict, list)):
                _walked(v, out)
    elif isinstance(x, list):
        for v in x:
            _walked(v, out)


def _scanned(text: str) -> list[str]:
    """Contents of a notebook JSON that breaks off: string values by the key before them."""
    out: list[str] = []
    parts: list[str] = []
    key = ""
    for m in STRING.finditer(text):
        if m[3]:
            out.append("".join(parts))
            key, parts = m[1], []
        elif key in CONTENT_KEYS:
            try:
                parts.append(json.loads(f'"{m[1]}"', strict=False))
            except ValueError:
                parts.append(m[1])
    out.append("".join(parts))
    return out


def blocks(text: str) -> list[str]:
    """Non-blank blocks: the paragraphs of each cell's source and outputs."""
    head = text.lstrip()[:1]
    if head == "{" and '"cells"' in text:
        cells: list[str] = []
        try:
            _walked(json.loads(text, strict=False), cells)
        except (ValueError, RecursionError):
            cells = _scanned(text)
    else:
        text = text.replace("\r\n", "\n")
        cells = [PREFIX.sub("", x) for x in MARKER.split(text)]
    return [b for c in cells for b in BLANK.split(c) if b and not b.isspace()]
