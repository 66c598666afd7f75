"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and what they fold to (fixed values).
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīįłńňōőřśşšťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegiilnnoorssstuuuzzz"


def fold_word(word: str) -> str:
    """A word without diacritics, by the same table."""
    return word.translate(str.maketrans(_MARKED, _PLAIN))


def tokens(text: Column, fold: bool = False) -> Column:
    """The lower-case runs of letters and digits, in order; with ``fold`` without diacritics. Null gives null."""
    low = F.lower(text)
    return F.regexp_extract_all(F.translate(low, _MARKED, _PLAIN) if fold else low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def count_of(array: Column, value: str) -> Column:
    """How often a value is in an array."""
    return F.size(F.filter(array, lambda x: x == value))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def glob_regex(pattern: str, star_crosses: bool) -> str:
    """A glob as an anchored regular expression. ``*`` crosses ``/`` in search globs; in discovery globs only ``**`` does."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": ".*" if star_crosses else "[^/]*", "?": "." if star_crosses else "[^/]"}.get(c) or ("\\" + c if not c.isalnum() and c not in "_/" else c)
        i += 1
    return f"^{out}$"
