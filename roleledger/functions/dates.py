"""Dates from texts such as "3 days ago"."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- Fixed values: number, up to three blanks or plus signs, then the unit ------------------
_GAP = r"(\d+)[ +]{0,3}"
HOURS = _GAP + "(?:hour|hr|heure)"
DAYS = _GAP + "(?:day|d|jour)"
MONTHS = _GAP + "(?:month|mois)"
YEARS = _GAP + "(?:year|annee)"
TODAY = "[tT]oday|[jJ]ust [pP]osted"
YESTERDAY = "[yY]esterday"
# Optional German units, used only when asked for.
GERMAN_HOURS, GERMAN_DAYS = _GAP + "Stunde", _GAP + "Tag"
GERMAN_MONTHS, GERMAN_YEARS = _GAP + "Monat", _GAP + "Jahr"
# ---- End of fixed values ------------------------------------------------------------------


def _number(phrase: Column, pattern: str) -> Column:
    found = F.regexp_extract(phrase, pattern, 1)
    return F.when(found != "", found).try_cast("int")


def relative_date(phrase: Column, as_of: Column, german: bool = False) -> Column:
    """Day meant by ``phrase`` when read at the timestamp ``as_of``; null when it names none.

    The first unit found wins, in the order hours, days, months, years. Months and years keep the
    day of the month where they can and else take the last day.
    """
    def amount(pattern: str, german_pattern: str) -> Column:
        plain = _number(phrase, pattern)
        return F.coalesce(plain, _number(phrase, german_pattern)) if german else plain

    hours = amount(HOURS, GERMAN_HOURS)
    days = amount(DAYS, GERMAN_DAYS)
    months = amount(MONTHS, GERMAN_MONTHS)
    years = amount(YEARS, GERMAN_YEARS)
    today = as_of.cast("date")
    return (
        F.when(hours.isNotNull(), (as_of - F.make_dt_interval(hours=hours)).cast("date"))
        .when(days.isNotNull(), F.date_sub(today, days))
        .when(months.isNotNull(), F.add_months(today, -months))
        .when(years.isNotNull(), F.add_months(today, -12 * years))
        .when(phrase.rlike(TODAY), today)
        .when(phrase.rlike(YESTERDAY), F.date_sub(today, 1))
    )
