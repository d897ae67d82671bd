"""Dates as certificates write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.binding import let
from meritlake.functions.text import strip


def parse_finnish_date(text: Column) -> Column:
    """``D.M.YYYY`` (spaces around dots allowed), ``D/M/YYYY`` or ``YYYY-M-D`` -> date or null."""
    iso = F.regexp_replace(
        strip(text), r"^(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4})$", "$3-$2-$1")
    iso = F.regexp_replace(iso, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    # anything else comes out of the extraction as '', which is no date
    return F.regexp_extract(iso, r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$", 0).try_cast("date")


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def is_future_date(date: Column, as_of: Column) -> Column:
    return F.coalesce(date > as_of, F.lit(False))


def date_range_problem(start: Column, end: Column) -> Column:
    """Message when the start is after the end; a missing side is fine."""
    return F.when(
        start > end,
        F.concat(F.lit("Start date "), iso(start), F.lit(" is after end date "), iso(end)),
    )


def parse_and_validate_dates(start: Column, end: Column, as_of: Column) -> Column:
    """Raw and parsed start and end with errors (unreadable, reversed) and warnings (future)."""
    read = F.struct(
        F.when(start != "", start).alias("start"), F.when(end != "", end).alias("end"),
        parse_finnish_date(start).alias("start_parsed"), parse_finnish_date(end).alias("end_parsed"))
    return let(read, lambda r: _date_findings(r, as_of))


def _date_findings(r: Column, as_of: Column) -> Column:
    raw_start, raw_end = r["start"], r["end"]
    parsed_start, parsed_end = r["start_parsed"], r["end_parsed"]

    def unreadable(label: str, raw: Column, parsed: Column) -> Column:
        return F.when(raw.isNotNull() & parsed.isNull(),
                      F.concat(F.lit(f"Could not parse {label} date: "), raw))

    def future(label: str, parsed: Column) -> Column:
        return F.when(is_future_date(parsed, as_of),
                      F.concat(F.lit(f"{label} date "), iso(parsed), F.lit(" is in the future")))

    errors = F.array_compact(F.array(
        unreadable("start", raw_start, parsed_start),
        unreadable("end", raw_end, parsed_end),
        date_range_problem(parsed_start, parsed_end),
    ))
    warnings = F.array_compact(F.array(future("Start", parsed_start), future("End", parsed_end)))
    return let(errors, lambda found: F.struct(
        raw_start.alias("start_date"),
        raw_end.alias("end_date"),
        parsed_start.alias("start_date_parsed"),
        parsed_end.alias("end_date_parsed"),
        (F.size(found) == 0).alias("is_valid"),
        found.alias("errors"),
        warnings.alias("warnings"),
    ))


def iso_or_raw(text: Column) -> Column:
    """The date in ISO form, or the text as it was when it cannot be read."""
    return F.coalesce(iso(parse_finnish_date(text)), text)


def fix_extraction_dates(extraction: Column) -> Column:
    """Bring issue date and every position's dates to ISO form.

    An answer without positions is left alone.
    """
    fixed = extraction.withField(
        "certificate_issue_date", iso_or_raw(extraction["certificate_issue_date"])
    ).withField(
        "positions",
        F.transform(
            extraction["positions"],
            lambda p: p.withField("start_date", iso_or_raw(p["start_date"])).withField(
                "end_date", iso_or_raw(p["end_date"])),
        ),
    )
    return F.when(extraction["positions"].isNull(), extraction).otherwise(fixed)


def duration_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def years_of(days: Column) -> Column:
    """Days in years; null for zero or null days."""
    return F.nullif(days, F.lit(0)) / F.lit(K.DAYS_PER_YEAR)
