"""Scalar expressions over text, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

VISIBLE_ENDS = r"(?s)\A[!-~](?:.*[!-~])?\z"


def strip_text(value: Column) -> Column:
    """Text of ``value`` without white space at the ends; null stays null.

    ``trim`` would only remove U+0020."""
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def strip_value(value: Column) -> Column:
    """:func:`strip_text` of a column or variable, which is looked at twice: a pattern
    sees sooner than trimming does that both ends are visible signs."""
    text = value.cast("string")
    return F.when(text.rlike(VISIBLE_ENDS), text).otherwise(strip_text(value))


def norm_key(value: Column, null_token: str = "None") -> Column:
    """Key text: stripped, and null as ``null_token`` so that null keys meet."""
    return F.coalesce(strip_text(value), F.lit(null_token))


def text_or_token(value: Column, null_token: str = "None") -> Column:
    """Text of ``value`` with white space kept and null as ``null_token``."""
    return F.coalesce(value.cast("string"), F.lit(null_token))


def title_text(value: Column) -> Column:
    """``hire_date`` -> ``Hire Date``."""
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def display_label(name: str) -> str:
    """Heading for a column name known on the driver."""
    return name.replace("_", " ").title()


def file_stem(path: Column) -> Column:
    """Base name of a path up to its first dot."""
    return F.split_part(base_name(path), F.lit("."), F.lit(1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """Lower-case text after the last dot of a path."""
    return F.lower(F.element_at(F.split(path, "[.]"), -1))


def schema_from_filename(name: Column, schemas: Sequence[str]) -> Column:
    """First configured schema whose name occurs in the file name, else the stem."""
    stem = F.lower(F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", ""))
    picks = [F.when(F.contains(stem, F.lit(s.lower())), F.lit(s)) for s in schemas]
    return F.coalesce(*picks, stem)


def match_percentage(matching: Column, source: Column) -> Column:
    """Share of matching rows in percent, one decimal, 0 for an empty source."""
    return F.when(source > 0, F.round(matching / source * 100, 1)).otherwise(F.lit(0.0))


def status_text(match: Column, different: Column, missing: Column) -> Column:
    """``Match``, ``n different, m missing`` or ``No Match``."""
    parts = F.concat_ws(
        ", ",
        F.when(different > 0, F.concat(different.cast("string"), F.lit(" different"))),
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" missing"))),
    )
    return (
        F.when(match, F.lit("Match"))
        .when(F.length(parts) > 0, parts)
        .otherwise(F.lit("No Match"))
    )


def run_id(moment: Column) -> Column:
    """Identifier of a run from its start time."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")
