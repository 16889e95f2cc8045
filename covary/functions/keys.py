"""Column expressions for calendar keys, codes and column names.

Everything here is a native Spark expression (no Python per row). Parsing
uses the ``try_*`` forms: under ANSI mode a plain cast or parse of dirty
text raises, while these return NULL for the bad row only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_start(col: str | Column) -> Column:
    """First day of the month of a date or timestamp, as DATE.

    A real date key sorts by time; text keys such as ``MM-yyyy`` do not.
    """
    return F.trunc(F.to_date(_c(col)), "month")


def month_text(col: str | Column, fmt: str = "yyyy-MM") -> Column:
    """Display form of a month key."""
    return F.date_format(_c(col), fmt)


def parse_timestamp(col: str | Column, fmt: str) -> Column:
    """Text -> TIMESTAMP with a Java date pattern; NULL where it does not parse."""
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def timestamp_text(col: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """TIMESTAMP -> text in a fixed layout (the epoch round trip of a parse)."""
    return F.date_format(_c(col), fmt)


def split_part(col: str | Column, sep: str, index: int) -> Column:
    """Part ``index`` (0-based) of a split; NULL when the part is missing."""
    return F.get(F.split(_c(col), re.escape(sep)), index)


def split_date_key(col: str | Column, sep: str = "/", order: Iterable[int] = (2, 0),
                   joiner: str = "-") -> Column:
    """Key text from picked parts of a split date, e.g. ``MM/dd/yyyy`` -> ``yyyy-MM``.

    ``concat`` (not ``concat_ws``) so that a missing part gives NULL instead
    of a shortened key.
    """
    parts: list[Column] = []
    for i, idx in enumerate(order):
        if i:
            parts.append(F.lit(joiner))
        parts.append(split_part(col, sep, idx))
    return F.concat(*parts)


def zero_pad(col: str | Column, width: int) -> Column:
    """Left pad with zeros to ``width`` characters."""
    return F.lpad(_c(col).cast("string"), width, "0")


def period_number(col: str | Column, start: int = 2, length: int = 2) -> Column:
    """Number inside a period label, e.g. ``M07`` -> 7; NULL when not numeric."""
    return safe_int(F.substring(_c(col), start, length))


def safe_int(col: str | Column) -> Column:
    """Text code -> INT; codes such as ``143A`` or empty text give NULL."""
    return _c(col).try_cast("int")


def month_from_position(pos: str | Column) -> Column:
    """Calendar month 1..12 from a 0-based row position of a monthly series
    that starts in January."""
    return (_c(pos) % 12 + 1).cast("int")


def months_since(col: str | Column, origin: str | Column) -> Column:
    """Whole months from ``origin`` to ``col`` (both month starts)."""
    return F.months_between(_c(col), _c(origin)).cast("int")


def sanitize_name(name: str) -> str:
    """Column name with dots and spaces removed."""
    return name.replace(".", "").replace(" ", "")


def distinct_names(names: Iterable[str]) -> list[str]:
    """``names`` made distinct as Spark compares them, without regard to case:
    one that meets an earlier name gets ``_2``, ``_3`` ... appended (the first
    keeps its name)."""
    out: list[str] = []
    seen: set[str] = set()
    for name in names:
        cand, k = name, 1
        while cand.lower() in seen:
            k += 1
            cand = f"{name}_{k}"
        seen.add(cand.lower())
        out.append(cand)
    return out


def sanitized_names(names: Iterable[str]) -> list[str]:
    """Sanitised names, made distinct (:func:`distinct_names`)."""
    return distinct_names(sanitize_name(name) for name in names)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns by the sanitising rule, resolving collisions."""
    return df.toDF(*sanitized_names(df.columns))
