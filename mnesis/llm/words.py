"""The words of a text, as all text operators here count them."""

from __future__ import annotations

import re
import unicodedata

import regex

_RUN = re.compile(r"[^\W_]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def clean(text: str) -> str:
    """Unicode NFKC, without format characters, lower-cased."""
    if text.isascii():
        return text.lower()
    return _FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the cleaned text; none of a null text."""
    return _RUN.findall(clean(text)) if text else []


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """Words with the span (start, end) of the original text that each comes from.

    A character is cleaned together with the combining marks after it, so offsets stay true where
    NFKC changes lengths.
    """
    out, origin, i, n = [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = clean(text[i:j])
        out.append(piece)
        origin += [(i, j)] * len(piece)
        i = j
    return [(m[0], origin[m.start()][0], origin[m.end() - 1][1]) for m in _RUN.finditer("".join(out))]
