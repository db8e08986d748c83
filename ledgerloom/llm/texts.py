"""Word streams of whole texts, free of markup, quoting, accents, case and line numbers, and their codes."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import numpy as np

_MARKUP = re.compile(r"<!--.*?-->|<[A-Za-z/!?][^<>]*>|\[\^?\d+\]|[\u200b\u200c\u200d\u2060\ufeff\u00ad]", re.S)
_LINE_NUMBER = re.compile(r"^[ \t>*|-]*\(?\d+[.:)|\]](?=\s)", re.M)
_BROKEN = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]+")
_WORD = re.compile(r"[^\W_]+")
_OTHER_LETTER = re.compile(r"[^\W_\x00-\x7f]")
_MARKS = re.compile("[" + "".join(map(chr, filter(lambda c: unicodedata.combining(chr(c)), range(0x300, 0x10000)))) + "]+")
_RARE = re.compile("[\U00010000-\U0010ffff]")
#: Letters and digits in lower case, all other bytes a blank.
_BARE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _mend(match: re.Match) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read again as what it was."""
    for code in ("cp1252", "latin-1"):
        try:
            return match[0].encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return match[0]


def words(text: str | None) -> list[str]:
    """The words of a whole text apart from letter case, punctuation, spacing, accents, quoting, markup, line numbers."""
    if not text:
        return []
    plain = text.isascii()
    if "<" in text or "[" in text or not plain:
        text = _MARKUP.sub("", text)
    if "&" in text:
        text = html.unescape(text)
        plain = plain and text.isascii()
    text = _LINE_NUMBER.sub(" ", text)
    if not plain:
        if "\u00c3" in text or "\u00c2" in text or "\u00e2" in text:
            text = _BROKEN.sub(_mend, text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
        if _RARE.search(text):
            text = "".join(c for c in text if not unicodedata.combining(c))
        if _OTHER_LETTER.search(text):
            return _WORD.findall(text)
    return text.encode("ascii", "replace").translate(_BARE).decode("ascii").split()


class Codes(dict):
    """64-bit codes of words; a word is hashed once until the memory of words is full, then again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return code

    def of(self, w: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


_BASE, _FIRST, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(32)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash (signed) of every ``k`` codes in a row: a polynomial over them, mixed."""
    n = max(len(codes) - k + 1, 0)
    h = codes[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h = h * _BASE + codes[j : j + n]
        h = (h ^ (h >> _FIRST)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> _LAST)).view(np.int64)
