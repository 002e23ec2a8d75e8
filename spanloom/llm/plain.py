"""Words of a text whatever way it was typed, escaped, marked up or wrapped, as flat arrays over many texts."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

#: Characters that vanish: soft hyphen, zero-width and directional marks, joiners, byte order marks, combining marks.
INVISIBLE = re.compile("[\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u0300-\u036f]")
#: Fixed value: letters of other scripts that look like Latin ones, and the Latin letters they pass for.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁһԛԝαορνικυτηγ", "abekmhopctyxijsdhqwaopvikutny")
#: Letters that decompose to nothing plainer, by common transliteration.
FOLDED = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i"})
NOT_WORD = re.compile(r"[^\w\x00-\x7f]+")
IDEOGRAPH = re.compile("([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af])")
UNICODE_ESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})")
ESCAPE = re.compile(r"\\+[nrtbf]?")
#: A tag of any length by its syntax (name, attributes), so that a comparison in code is none.
TAG = re.compile(r"""</?[a-zA-Z][\w:.-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=]++))?+)*+\s*+/?>|<!--|-->|<![a-zA-Z][^<>]*+>""")
LINK_TARGET = re.compile(r"\]\([^()\s]*+\)")
WRAPPED_WORD = re.compile(r"(?<=[a-z])-[ \t]*\r?\n[ \t#>*]*(?=[a-z])")

WORD_BYTE = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    WORD_BYTE[_c] = True
WORD_BYTE[128:] = True


def plain(text: str) -> str:
    """Lower-case text whose words are runs of ASCII letters and digits and of non-ASCII characters."""
    if "\\" in text:
        if "\\u" in text:
            text = UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = ESCAPE.sub(lambda m: "\n" if m[0][-1] in "nr" else " " if m[0][-1] == "t" else "", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "](" in text:
        text = LINK_TARGET.sub("]", text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", text).lower()
        text = INVISIBLE.sub("", text).translate(FOLDED)
        text = NOT_WORD.sub(" ", text.translate(LOOKALIKES))
        text = IDEOGRAPH.sub(r" \1 ", text)
    if "-\n" in text:
        text = WRAPPED_WORD.sub("", text)
    return text


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of each word's text) of plain texts."""
    from spanloom.llm.tokenize import ByteBpe

    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = WORD_BYTE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.r_[0, edge]
    start, stop = edge[::2], edge[1::2]
    text_at = np.cumsum([len(r) + 1 for r in raw])
    return ByteBpe.hash(data, start, stop - start)[0], np.searchsorted(text_at, start, "right")
