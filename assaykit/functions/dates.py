"""Dates kept as strings, career length, seniority rank by years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _read(c: Column, shape: str) -> Column:
    """Date of a string of the given shape, NULL for another shape or no such day.

    The shape check is what limits the accepted formats; the cast then reads the digits (a missing day is the first).
    """
    return F.when(c.rlike(r"^(?!0000)[0-9]{4}-[0-9]{1,2}" + shape + r"\z"), c.try_cast("date"))


def parse_full(c: Column) -> Column:
    """``YYYY-MM-DD`` (one-digit month or day accepted) to date, else NULL."""
    return _read(c, "-[0-9]{1,2}")


def parse_month(c: Column) -> Column:
    """``YYYY-MM`` to the first of that month, else NULL."""
    return _read(c, "")


def parse_date(c: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM``, else NULL. Bare and five-digit years are not dates."""
    return _read(c, "(-[0-9]{1,2})?")


def is_open_end(c: Column) -> Column:
    """An end date that means "still there": NULL, empty or "present" in any case."""
    return c.isNull() | (c == "") | (F.lower(c) == "present")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def career_spans(experience: Column, as_of: Column) -> Column:
    """Entries as struct(s, i, title, e): start and end read once, -position, title. Open ends run to ``as_of``."""
    return F.transform(
        experience,
        lambda e, i: F.struct(
            parse_date(e["start_date"]).alias("s"),
            (-i).alias("i"),
            e["title"].alias("title"),
            F.when(is_open_end(e["end_date"]), as_of).otherwise(parse_date(e["end_date"])).alias("e"),
        ),
    )


def years_of(spans: Column) -> Column:
    """Sum of whole-month differences over all entries, in years; overlaps count twice.

    Days are ignored; an unreadable start or end, or an end before the start, adds nothing.
    """
    months = F.aggregate(
        spans,
        F.lit(0),
        lambda acc, x: acc + F.when(x["e"] > x["s"], month_index(x["e"]) - month_index(x["s"])).otherwise(0),
    )
    return months / F.lit(12.0)


def experience_years(experience: Column, as_of: Column) -> Column:
    return years_of(career_spans(experience, as_of))


def title_of(spans: Column) -> Column:
    """Title of the entry with the latest readable start; ties keep the first in list order."""
    return F.array_max(F.filter(spans, lambda x: x["s"].isNotNull()))["title"]


def years_rank(years: Column) -> Column:
    """Years to seniority rank 0..4 at the bounds 2, 5, 10, 15."""
    return (
        F.when(years < 2, 0).when(years < 5, 1).when(years < 10, 2).when(years < 15, 3).otherwise(4)
    )
