"""Text forms of lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One quoted element of a printed list, single or double quotes, backslash escapes allowed.
_ELEMENT = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_LITERAL = rf"(?s)^\s*\[\s*(?:(?:{_ELEMENT})(?:\s*,\s*(?:{_ELEMENT}))*\s*,?)?\s*\]\s*$"


def parse_list(text: Column) -> Column:
    """``"['a', \\"b's\\"]"`` to an array; null, ``[]`` and malformed text give an empty array."""
    quoted = F.regexp_extract_all(text, F.lit(_ELEMENT), F.lit(0))
    bare = F.transform(quoted, lambda q: F.regexp_replace(
        F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    return F.when(text.rlike(_LITERAL), bare).otherwise(F.array().cast("array<string>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row.

    The optimizer may move a computed column into a lambda, where it would be evaluated for
    every element; a lambda variable holds the value instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
