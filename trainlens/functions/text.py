"""String predicates and transforms matching Python ``str`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() and str.split() take every Unicode white-space character
# and the four separators U+001C-U+001F (Spark's trim() the space only). One
# class serves stripping, splitting and the blank test; the property class is
# faster than the characters listed.
_SPACE, _OTHER_RE = r"[\s\x1c-\x1f]", r"(?U)[^\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{_SPACE}+|{_SPACE}+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def is_blank(c) -> Column:
    """True when the value is null or only whitespace (``not str(x).strip()``).
    The search ends at the first character that is none."""
    c = _col(c)
    return c.isNull() | ~c.cast("string").rlike(_OTHER_RE)


def nonblank(c) -> Column:
    """The stripped value, or null when blank."""
    return F.nullif(strip(_col(c)), F.lit(""))


def first_nonblank(*cols) -> Column:
    """Stripped value of the first column holding non-blank text."""
    return F.coalesce(*[nonblank(c) for c in cols])


def word_tokens(c) -> Column:
    """Lower-case, whitespace split, empty pieces dropped (``str.lower().split()``)."""
    return F.array_remove(F.split(F.lower(_col(c)), rf"(?U){_SPACE}+"), "")
