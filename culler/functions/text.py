"""Line and text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(text: Column | str) -> Column:
    """``str.strip()``: white space off both ends."""
    return F.regexp_replace(_col(text), r"\A\s+|\s+\z", "")


def split_lines(text: Column | str) -> Column:
    """``text.split('\\n')``: keeps empty pieces, including a trailing one."""
    return F.split(_col(text), "\n", -1)


def is_nonblank(line: Column) -> Column:
    """A line with something other than white space."""
    return line.rlike(r"\S")


def interaction_lines(code: Column | str) -> Column:
    """The non-empty lines of the stripped code, as they are (not trimmed)."""
    return F.filter(split_lines(strip_ws(code)), lambda l: l != "")


def clean_code(code: Column | str) -> Column:
    """T4: drop ``//`` and ``#`` line tails and ``/*...*/`` blocks, collapse blank
    lines, drop indentation, trim.  ``(?d)`` makes only ``\\n`` a line end."""
    c = _col(code)
    c = F.regexp_replace(c, r"(?md)//.*$", "")
    c = F.regexp_replace(c, r"(?md)#.*$", "")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(c, r"\n\s*\n", "\n")
    c = F.regexp_replace(c, r"(?md)^\s+", "")
    return strip_ws(c)
