"""Parsers of dirty cells: Column of text -> Column of a proper type, null where the text has no such value."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievespark.functions import text as T

#: Month names and number words, in order.
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
ENGLISH_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NUMBER_WORDS = ["bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz", "on"]
#: Fixed value: what counts as an address.
EMAIL = r"^[a-z0-9._%+\-]+@[a-z0-9\-]+(\.[a-z0-9\-]+)*\.[a-z]{2,}$"


def let(x: Column, body) -> Column:  # noqa: ANN001
    """body(x) with x evaluated once a row."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def once(f):  # noqa: ANN001, ANN201
    """A parser of a Column that evaluates its input once a row, however often it names it: parsers are put into one another."""

    @wraps(f)
    def run(s: Column, *rest) -> Column:  # noqa: ANN002
        return let(s, lambda x: f(x, *rest))

    return run


def _plain(word: str) -> str:
    return word.replace("I", "ı").replace("İ", "i").lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))


def _month_numbers() -> dict[str, int]:
    full = {_plain(m): i for i, m in enumerate(MONTHS, 1)}
    return full | {m[:3]: i for m, i in full.items()} | {m: i for i, m in enumerate(ENGLISH_MONTHS, 1)}


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null for what the calendar lacks."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, pattern, group).try_cast("int")


def _full_year(year: Column) -> Column:
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


@once
def date_candidates(s: Column) -> Column:
    """array<date> of the ways to read a date, the day-first one first; empty if there is none."""
    s = F.trim(F.coalesce(s, F.lit("")))
    iso, compact = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{4})(\d{2})(\d{2})$"
    numeric, named = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$", r"^(\d{1,2})[ \-]+([^\d\s\-]+?)\.?[ \-]+(\d{4}|\d{2})$"

    def ymd(pattern: str) -> Column:
        return F.array(_date(_part(s, pattern, 1), _part(s, pattern, 2), _part(s, pattern, 3)))

    year = _full_year(_part(s, numeric, 3))
    day_first = _date(year, _part(s, numeric, 2), _part(s, numeric, 1))
    month_first = F.when(s.contains("/"), _date(year, _part(s, numeric, 1), _part(s, numeric, 2)))
    month = F.try_element_at(_lookup(_month_numbers()), T.fold(T.lower(F.regexp_extract(s, named, 2))))
    by_name = F.array(F.when(month.isNotNull(), _date(_full_year(_part(s, named, 3)), month, _part(s, named, 1))))
    found = F.when(s.rlike(iso), ymd(iso)).when(s.rlike(compact), ymd(compact)).when(s.rlike(numeric), F.array(day_first, month_first)).when(s.rlike(named), by_name)
    return F.coalesce(F.array_distinct(F.array_compact(found)), F.array().cast("array<date>"))


def within(candidates: Column, low: str, high: str) -> Column:
    """The candidates in [low, high)."""
    return F.filter(candidates, lambda d: (d >= F.lit(low).cast("date")) & (d < F.lit(high).cast("date")))


@once
def money(s: Column) -> Column:
    """decimal(18,2). Of two different separators the right one is decimal; a lone comma or point is one unless three digits follow."""
    return let(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?iU)tl|try|₺|\s", ""), _number)


def _number(bare: Column) -> Column:
    comma, point = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    no_point, no_comma = F.replace(bare, F.lit("."), F.lit("")), F.replace(bare, F.lit(","), F.lit(""))
    comma_decimal = F.replace(no_point, F.lit(","), F.lit("."))
    thousands_point = bare.rlike(r"\.\d{3}$") | (F.length(bare) - F.length(no_point) > 1)
    number = (
        F.when((comma > 0) & (point > 0), F.when(comma < point, comma_decimal).otherwise(no_comma))
        .when(comma > 0, F.when(bare.rlike(r",\d{3}$"), no_comma).otherwise(comma_decimal))
        .when((point > 0) & thousands_point, no_point)
        .otherwise(bare)
    )
    return F.when(bare.rlike(r"^-?[\d.,]+$"), F.round(number.try_cast("decimal(24,6)"), 2).cast("decimal(18,2)"))


@once
def ratio(s: Column) -> Column:
    """decimal(6,4) in [0, 1); percentages and numbers over 1 count in hundredths."""
    share = s.contains("%")
    hundred = let(_precise(F.replace(s, F.lit("%"), F.lit(""))), lambda v: F.when(share | (v > 1), v / 100).otherwise(v))
    return let(hundred, lambda v: F.when((v >= 0) & (v < 1), F.round(v, 4).cast("decimal(6,4)")))


def _precise(s: Column) -> Column:
    return money(s).cast("decimal(18,4)")


@once
def count(s: Column) -> Column:
    """int: a number word up to ten, or a whole number with a unit before or after."""
    s = T.lower(F.trim(F.coalesce(s, F.lit(""))))
    word = F.try_element_at(_lookup({w: i for i, w in enumerate(NUMBER_WORDS, 1)}), s)
    shape = r"^x?\s*(-?\d+)(?:[.,]0+)?\s*(?:adet|ad\.?|pcs|x)?$"
    return F.coalesce(word, F.when(s.rlike(shape), F.regexp_extract(s, shape, 1).try_cast("int")))


@once
def phone(s: Column) -> Column:
    """+90 5XX XXX XX XX from the last ten digits of a mobile number."""
    digits = F.regexp_replace(F.coalesce(s, F.lit("")), r"\D", "")
    last = F.right(digits, F.lit(10))
    piece = lambda at, n: F.substring(last, at, n)
    return F.when((F.length(digits) >= 10) & last.startswith("5"), F.concat_ws(" ", F.lit("+90"), piece(1, 3), piece(4, 3), piece(7, 2), piece(9, 2)))


@once
def email_text(s: Column) -> Column:
    """An address made comparable: plain lower-case letters, no spaces, one at sign, points for commas in the domain."""
    s = F.regexp_replace(T.fold(F.lower(F.replace(F.coalesce(s, F.lit("")), F.lit("İ"), F.lit("i")))), "[ ̇]", "")
    s = F.regexp_replace(s, "@+", "@")
    at = F.instr(s, "@")
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at), F.replace(F.substr(s, at + 1), F.lit(","), F.lit(".")))).otherwise(s)


def is_email(s: Column) -> Column:
    return s.rlike(EMAIL)


@once
def identifier(s: Column, prefix: str, digits: int) -> Column:
    """prefix + digits from forms like '#367', 'm-00367', 'M 12' or '367'; null if the number is too long for it, or white space parts its digits."""
    shape = rf"(?iU)^\s*#?\s*{prefix}?\s*-?\s*(\d{{1,{digits}}})\s*$"
    s = F.translate(F.coalesce(s, F.lit("")), "\u00a0\u202f", "  ")
    return F.when(s.rlike(shape), F.concat(F.lit(prefix), F.lpad(F.regexp_extract(s, shape, 1), digits, "0")))
