"""Fields of a certificate by written rules, where the caller has no model.

The rules are ours: they follow the phrases a certificate uses, and their results will
differ from a model's. All patterns keep to what Java and RE2 both understand.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.dates import iso, parse_finnish_date
from meritlake.functions.text import detect_language

_NAME = r"(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)+)"
_TITLE = r"(?:(?:Mr|Mrs|Ms)\.? |(?:Herra|Rouva|Neiti) )?"
_DATE = r"\d{1,2}\. ?\d{1,2}\. ?\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"
EMPLOYEE = rf"(?:certify that|todistaa, että|että|Employee:|Työntekijä:) {_TITLE}{_NAME}"
EMPLOYER = (rf"(\p{{Lu}}[\p{{L}}&-]*(?: \p{{Lu}}[\p{{L}}&-]*)* "
            rf"(?:{'|'.join(K.COMPANY_SUFFIXES)}))(?:[^\p{{L}}]|$)")
ISSUE_DATE = rf"(?m)^(?:Date:? |Päiväys:? )?({_DATE})$"
DATE_RANGE = rf"({_DATE})(?: ?[–-] ?| to )({_DATE})"
OPEN_RANGE = rf"(?:since|alkaen) ({_DATE})"
WEEKLY_HOURS = (r"(\d{1,2}(?:\.\d+)?) ?(?:h/week|hours/week|hours per week|h/vko|tuntia viikossa)")
PERCENT = r"(\d{1,3}) ?% ?(?:schedule|position|työaika)"
CREDIT_NUMBERS = r"(\d{1,3}) ?(?:ECTS|credits|op)(?:[^\p{L}]|$)"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(phrase)) for phrase in phrases])


def employee_name(text: Column) -> Column:
    # without one of its phrases the pattern finds nothing, and plain search is cheaper
    return F.when(_has_any(text, ("certify that ", "että ", "Employee: ", "Työntekijä: ")), _found(text, EMPLOYEE))


def main_employer(text: Column) -> Column:
    return _found(text, EMPLOYER)


def issue_date(text: Column) -> Column:
    return parse_finnish_date(_found(text, ISSUE_DATE))


def positions(text: Column, employer: Column, issued: Column) -> Column:
    """Date ranges as positions; a missing end is the issue date, the employer the main one."""
    # a range starts with a digit; its two dates are read from the range, not from the text again
    ranges = F.regexp_extract_all(text, F.lit(rf"(?=\d){DATE_RANGE}"), 0)
    closed = F.transform(ranges, lambda r: F.struct(
        parse_finnish_date(F.regexp_extract(r, DATE_RANGE, 1)).alias("start_date"),
        parse_finnish_date(F.regexp_extract(r, DATE_RANGE, 2)).alias("end_date")))
    starts = F.when(_has_any(text, ("since ", "alkaen ")), F.regexp_extract_all(text, F.lit(OPEN_RANGE), 1))
    opened = F.transform(
        F.when(text.isNotNull(), F.coalesce(starts, F.array().cast("array<string>"))),
        lambda start: F.struct(parse_finnish_date(start).alias("start_date"), issued.alias("end_date")))
    return F.transform(F.concat(closed, opened), lambda p: F.struct(
        F.coalesce(employer, F.lit("Unknown Employer")).alias("employer"),
        iso(p["start_date"]).alias("start_date"),
        iso(p["end_date"]).alias("end_date")))


def document_language(text: Column) -> Column:
    return F.when(detect_language(text) == "fin", F.lit("fi")).otherwise(F.lit("en"))


def stated_weekly_hours(text: Column) -> Column:
    """Hours per week, only from numbers with a time unit."""
    return _found(text, WEEKLY_HOURS).try_cast("double")


def stated_percent(text: Column) -> Column:
    return _found(text, PERCENT).try_cast("double")


def credit_numbers(text: Column) -> Column:
    """Numbers next to credit words; these are never hours."""
    return F.transform(F.regexp_extract_all(text, F.lit(CREDIT_NUMBERS), 1), lambda n: n.cast("int"))


def extract_fields(df, text: str = "text"):
    """Add employee_name, employer, issue_date, document_language, positions, weekly hours, percent."""
    t = F.col(text)
    return (
        df.withColumns({
            "employee_name": employee_name(t),
            "employer": main_employer(t),
            "issue_date": issue_date(t),
            "document_language": document_language(t),
            "weekly_hours": stated_weekly_hours(t),
            "percent": stated_percent(t),
        })
        .withColumn("positions", positions(t, F.col("employer"), F.col("issue_date")))
    )
