"""Time windows that questions ask for, read from a closed list of Japanese and English expressions; spans of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The expressions, in the order in which they count, and the days that "recently" reaches back.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
BEFORE_LAST_YEAR = ("一昨年",)
LAST_YEAR = ("去年", "昨年", "last year")
THIS_YEAR = ("今年", "this year")
LAST_MONTH = ("先月", "last month")
THIS_MONTH = ("今月", "this month")
LAST_WEEK = ("先週", "last week")
THIS_WEEK = ("今週", "this week")
YESTERDAY = ("昨日", "yesterday")
TODAY = ("今日", "today")
RECENTLY = ("最近", "recently", "lately")
RECENT_DAYS = 90
YEAR_MONTH_JA = r"(?U)([0-9]{4})年\s*([0-9]{1,2})月"
MONTH_YEAR_EN = rf"(?U)\b({'|'.join(MONTHS)})\s+([0-9]{{4}})\b"
BARE_MONTH_JA = r"(?<![0-9])([0-9]{1,2})月"
YEAR_JA = r"([0-9]{4})年"
YEAR_EN = r"(?U)\b(19[0-9]{2}|20[0-9]{2})\b"
SPAN_JA = r"(?U)(?:ここ|この|過去|直近)\s*([0-9]+)\s*(日|週間|[ヶケか]月|年)"
SPAN_EN = r"(?U)last\s+([0-9]+)\s+(day|week|month|year)s?"
UNIT_DAYS = {"日": 1, "day": 1, "週間": 7, "week": 7, "年": 365, "year": 365}
MONTH_DAYS = 30
FULL_WIDTH = "０１２３４５６７８９"
#: The furthest that a span may reach back: the clock's first year.
FIRST_US = -62_135_596_800_000_000

DAY_US, SECOND_US = 86_400_000_000, 1_000_000


def _window(since: Column, until: Column) -> Column:
    return F.when(since.isNotNull() & until.isNotNull(), F.struct(since.alias("since"), until.alias("until")))


def _first_of(year: Column, month: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%04d-%02d-01 00:00:00", year, month), F.lit("yyyy-MM-dd HH:mm:ss"))


def _months(year: Column, month: Column, many: int = 1) -> Column:
    start = _first_of(year, month)
    return _window(start, F.timestamp_micros(F.unix_micros(F.add_months(start, many).cast("timestamp")) - SECOND_US))


def _year(year: Column) -> Column:
    return _months(year, F.lit(1), 12)


def time_window(question: Column, now: Column) -> Column:
    """(since, until), both included, that a question asks for at the instant ``now``; null when it asks for none.

    The clock is the session's time zone. Full-width digits are digits. Months and years out of range, and spans that reach back
    before the first year, give no window.
    """
    text = F.lower(F.translate(question, FULL_WIDTH, "0123456789"))
    says = lambda words: F.greatest(*(text.contains(w) for w in words), F.lit(False))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    number = lambda pattern, i=1: part(pattern, i).try_cast("int")
    year, month, micros = F.year(now), F.month(now), F.unix_micros(now)
    day = F.unix_micros(F.date_trunc("day", now))
    week = F.unix_micros(F.date_trunc("week", now))
    at = F.timestamp_micros
    last_year = says(LAST_YEAR) & ~says(BEFORE_LAST_YEAR)
    bare = number(BARE_MONTH_JA)
    named = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), part(MONTH_YEAR_EN, 1)).cast("int")
    before = F.add_months(F.trunc(now, "month"), -1)
    japanese = F.regexp_like(text, F.lit(SPAN_JA))
    amount, unit = (F.when(japanese, part(SPAN_JA, i)).otherwise(part(SPAN_EN, i)) for i in (1, 2))
    days = F.lit(MONTH_DAYS)
    for word, n in UNIT_DAYS.items():
        days = F.when(unit == word, n).otherwise(days)
    back = micros - F.try_multiply(amount.try_cast("int").cast("long"), days.cast("long")) * F.lit(DAY_US).cast("decimal(20,0)")
    span = _window(F.when(back >= FIRST_US, at(back.cast("long"))), now)
    return (
        F.when(F.regexp_like(text, F.lit(YEAR_MONTH_JA)), _months(number(YEAR_MONTH_JA, 1), number(YEAR_MONTH_JA, 2)))
        .when(F.regexp_like(text, F.lit(MONTH_YEAR_EN)), _months(number(MONTH_YEAR_EN, 2), named))
        .when(bare.between(1, 12), _months(F.when(last_year | (bare > month), year - 1).otherwise(year), bare))
        .when(says(BEFORE_LAST_YEAR), _year(year - 2))
        .when(last_year, _year(year - 1))
        .when(says(THIS_YEAR), _year(year))
        .when(F.regexp_like(text, F.lit(YEAR_JA)), _year(number(YEAR_JA)))
        .when(F.regexp_like(text, F.lit(YEAR_EN)), _year(number(YEAR_EN)))
        .when(says(LAST_MONTH), _months(F.year(before), F.month(before)))
        .when(says(THIS_MONTH), _months(year, month))
        .when(says(LAST_WEEK), _window(at(week - 7 * DAY_US), at(week - SECOND_US)))
        .when(says(THIS_WEEK), _window(at(week), now))
        .when(says(YESTERDAY), _window(at(day - DAY_US), at(day - SECOND_US)))
        .when(says(TODAY), _window(at(day), now))
        .when(japanese | F.regexp_like(text, F.lit(SPAN_EN)), span)
        .when(says(RECENTLY), _window(at(micros - RECENT_DAYS * DAY_US), now))
    )


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two spans, ends included, share a moment."""
    return (a0 <= b1) & (b0 <= a1)


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """What lies between two spans, in their unit; 0 when they share a moment."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0))


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from one moment to another, both in microseconds of one clock; a part of a day before is a day back."""
    return F.floor((later - earlier) / DAY_US)
