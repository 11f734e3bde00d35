"""Text expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from staffmart.schemas import COLLATION

_BLANK = r"[\s\p{Z}]"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def matches(text: Column, pattern: str) -> Column:
    """The whole text matches the pattern; NULL does not."""
    return F.coalesce(text.rlike(rf"^(?:{pattern})\z"), F.lit(False))


def numbered(prefix: str, number: Column, width: int) -> Column:
    """``E000042``; wider numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", number)


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def hashed_id(prefix: str, digits: int, *parts: Column) -> Column:
    """Upper-case hexadecimal id that a retried task computes again unchanged."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, digits)))


def insensitive(text: Column) -> Column:
    """Text that compares, groups and joins without case, accents and trailing spaces."""
    return F.collate(text, COLLATION)


def _accented() -> tuple[str, str]:
    """Letters that consist of another one and marks, and that other one."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, base) for c, base in pairs if c != base]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def insensitive_key(text: Column) -> Column:
    """Plain text that is equal for texts that differ in case, accents and trailing spaces; for keys that are hashed,
    since a hash of collated text is one of its bytes. Letters such as the sharp s stay letters of their own.
    """
    bare = F.regexp_replace(F.translate(F.lower(text), *_accented()), r"\p{M}+", "")
    return F.rtrim(F.lower(bare))
