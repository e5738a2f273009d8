"""Pre-token splitting: the given pattern, and the same pattern spelled out for texts of low code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import regex

#: Texts below this code point (Basic Latin to Latin Extended-B) are split by the spelled-out pattern.
LOW = 0x250
_ABOVE = re.compile(f"[^\\x00-{chr(LOW - 1)}]")
_CLASS = {r"\p{L}": lambda c: unicodedata.category(c)[0] == "L", r"\p{N}": lambda c: unicodedata.category(c)[0] == "N", r"\s": lambda c: bool(regex.match(r"\s", c))}


def spelled_out(pattern: str) -> re.Pattern | None:
    r"""``pattern`` with \p{L}, \p{N}, \s and \S as lists of characters; None if it has other classes."""
    lists = {k: "".join(re.escape(chr(c)) for c in range(LOW) if f(chr(c))) for k, f in _CLASS.items()}

    def swap(m: re.Match) -> str:
        if m[0] == r"\S":
            return "[^" + lists[r"\s"] + "]"
        if m[0][0] == "[":
            return re.sub(r"\\p\{[LN]\}|\\s", lambda x: lists[x[0]], m[0])
        return "[" + lists[m[0]] + "]"

    out = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", swap, pattern)
    try:
        return None if r"\p" in out else re.compile(out)
    except re.error:
        return None


class Splitter:
    def __init__(self, pattern: str):
        self.any, self.low = regex.compile(pattern), spelled_out(pattern)

    def of(self, text: str):
        return self.low if self.low is not None and (text.isascii() or not _ABOVE.search(text)) else self.any

    def pieces(self, text: str) -> list[str] | Iterator[str]:
        p = self.of(text)
        return p.findall(text) if len(text) < 1 << 20 else (m[0] for m in p.finditer(text))
