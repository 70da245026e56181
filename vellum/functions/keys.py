"""Native expressions that bring patent numbers, file names and run paths to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two letters and seven digits with any blanks or punctuation between them; what follows must not be an eighth digit.
NUMBER_HEAD = r"^[^A-Za-z0-9]*([A-Za-z])[^A-Za-z0-9]*([A-Za-z])((?:[^A-Za-z0-9]*[0-9]){7})(?![0-9])"
RUN_FOLDER = "runs/corpus_gated"


def plain_patent(col: Column) -> Column:
    """Plain number ``XX0000000`` of any spelling; a text of another form gives its upper-case letters and digits, null stays null."""
    flat = F.upper(F.regexp_replace(col, "[^A-Za-z0-9]", ""))
    return F.when(flat.rlike("^[A-Z]{2}[0-9]{7}([A-Z][0-9]?)?$"), F.substring(flat, 1, 9)).otherwise(flat)


def leading_patent(col: Column) -> Column:
    """Plain number that a text starts with, or null."""
    head = F.regexp_extract(col, NUMBER_HEAD, 0)
    return F.when(head != "", F.upper(F.regexp_replace(head, "[^A-Za-z0-9]", "")))


def last_part(col: Column) -> Column:
    """File name of a path written with either kind of slash."""
    return F.regexp_extract(F.trim(col), r"([^/\\]*)$", 1)


def run_path(col: Column) -> Column:
    """Path below the run folder, without roots, dots and doubled slashes; null for null and blank paths."""
    tidy = F.regexp_replace(F.translate(col, "\\", "/"), r"^\s+|\s+$", "")
    parts = F.filter(F.split(tidy, "/"), lambda s: (s != "") & (s != "."))
    none = F.slice(parts, 1, 0)
    solved = F.aggregate(
        parts,
        none,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    whole = F.array_join(F.when(F.array_contains(parts, ".."), solved).otherwise(parts), "/")
    below = F.regexp_extract(whole, f"^(?:.*/)?{RUN_FOLDER}/(.*)$", 1)
    return F.when(tidy != "", F.when(below != "", below).otherwise(whole))


def utc_month(col: Column) -> Column:
    """``YYYY-MM`` of a timestamp in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM")
