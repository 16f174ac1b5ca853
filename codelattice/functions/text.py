"""Text expressions: white space, assembly, tokens and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``\s`` matches in text; Java's ``\s`` is ASCII only, and its Unicode form lacks U+001C to U+001F.
SPACES = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


#: The same characters one by one.
SPACE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_newlines(text: Column) -> Column:
    """Every run of white space becomes one space; the ends are not trimmed."""
    return F.regexp_replace(text, SPACES, " ")


def assemble(title: Column | None, bodies: list[Column], *, lower: bool = False, collapse: bool = True) -> Column:
    """Title, if there is one that isn't empty, a space, and the bodies joined by spaces, with white space collapsed. A null body counts as empty.

    ``collapse`` off leaves white space as it is, for what is cut into tokens anyway.
    """
    text = F.concat_ws("  ", *(F.coalesce(b, F.lit("")) for b in bodies))
    if title is not None:
        text = F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(" "), text)).otherwise(text)
    text = strip_newlines(text) if collapse else text
    return F.lower(text) if lower else text


def tokens(text: Column) -> Column:
    """The tokens of the built-in tokenizer: what lies between white space. No regular expression and no function for each token is needed."""
    return F.array_remove(F.split(F.translate(text, SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS)), " "), "")


def window_starts(n: Column, stride: int) -> Column:
    """0, stride, 2 stride, ... below n; none for n = 0. Trailing windows may lie within the one before, as defined."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def docid_of(tag: Column) -> Column:
    """A tag without its last ``_`` and what follows; empty if it has no ``_``."""
    return F.regexp_replace(tag, "(?s)_?[^_]*\\z", "")
