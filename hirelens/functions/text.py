"""Small text helpers shared by every cleaner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_RX_SPECIAL = set("\\^$.|?*+()[]{}")


def rx_escape(word: str) -> str:
    """Escape regex metacharacters only (valid in both Java regex and RE2)."""
    return "".join("\\" + ch if ch in _RX_SPECIAL else ch for ch in word)


# Characters Python's str.strip()/str.split() treat as blanks.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex class body, valid in Java regex and RE2.
WS_CLASS = ("\\t\\n\\x{0b}\\f\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")


def ustrip(c: Column) -> Column:
    """Strip leading/trailing Unicode blanks (tabs, U+3000, NBSP ...).

    Spark ``trim`` only removes U+0020; ``btrim`` with the explicit blank set is a
    native string operation (no regex).
    """
    return F.btrim(c, F.lit(WS_CHARS))


def any_substring(c: Column, words: list[str]) -> Column:
    """True when ``c`` contains any of ``words`` (case-sensitive, literal)."""
    if not words:
        return F.lit(False)
    return c.rlike("|".join(rx_escape(w) for w in words))
