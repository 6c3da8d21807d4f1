"""Conversion of text cells to target field types. A value that can't be converted is null, with `failed` true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.text import blank, filled, strip

# Date shapes and the patterns that read them, in order of trial.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
)
YES, NO = ("yes", "true", "y", "1"), ("no", "false", "n", "0")
INTEGERS, NUMBERS = ("Int", "Check"), ("Float", "Currency", "Percent")
# A currency sign or code beside a number, and a comma before two decimal digits.
CURRENCY_PATTERN = r"[$€£]\s?[\d.,]+|[\d.,]+\s?(USD|EUR|GBP|CNY|RMB)"
DECIMAL_COMMA_PATTERN = r"^\d{1,3}(\.\d{3})*,\d{2}$"


def to_int(c: Column | str) -> Column:
    """Yes and no words, else all digits and minus signs together; '12.5' is 125 and text without digits 0."""
    low, digits = F.lower(strip(c)), F.regexp_replace(strip(c), r"[^-\d]", "")
    value = F.when(low.isin(*YES), 1).when(low.isin(*NO), 0).when(digits == "", 0).otherwise(F.expr("null")).cast("long")
    return F.when(~blank(c), F.coalesce(value, F.when(digits.rlike(r"^-?\d+$"), digits.try_cast("long"))))


def to_number(c: Column | str) -> Column:
    """With both separators the last is the decimal one; a lone comma is, before two digits, unless a 0 leads."""
    s = F.replace(strip(c), F.lit(" "), F.lit(""))
    comma, point = s.contains(","), s.contains(".")
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    without = lambda x, y: F.replace(x, F.lit(y), F.lit(""))
    decimal = (F.length(F.substring_index(s, ",", -1)) == 2) & ~s.startswith("0")
    plain = (
        F.when(comma & point & comma_last, F.replace(without(s, "."), F.lit(","), F.lit(".")))
        .when(comma & point, without(s, ","))
        .when(comma & decimal, F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(without(s, ","))
    )
    kept = F.regexp_replace(plain, r"[^\d.,\-]", "")
    return F.when(~blank(c) & kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def to_date(c: Column | str) -> Column:
    s = strip(c)
    return F.coalesce(*(F.when(s.rlike(shape), F.try_to_date(s, pattern)) for shape, pattern in DATE_SHAPES))


def date_text(c: Column | str) -> Column:
    return F.date_format(to_date(c), "yyyy-MM-dd")


def to_datetime(c: Column | str) -> Column:
    """The date part read, what follows the first space as it is."""
    s = F.replace(strip(c), F.lit("T"), F.lit(" "))
    day, time = F.split(s, " "), F.get(F.split(s, " "), F.lit(1))
    date = date_text(F.get(day, F.lit(0)))
    return F.when(time.isNotNull(), F.concat(date, F.lit(" "), time)).otherwise(date)


def converted(c: Column | str, fieldtype: str) -> Column:
    """The value of a cell for a target field type; blank cells are null."""
    if fieldtype in INTEGERS:
        return to_int(c)
    if fieldtype in NUMBERS:
        return to_number(c)
    if fieldtype == "Date":
        return date_text(c)
    if fieldtype == "Datetime":
        return to_datetime(c)
    return F.when(~blank(c), strip(c))


def from_number(c: Column | str, fieldtype: str) -> Column:
    """The value of a cell that is a number already: whole numbers lose their decimals, other fields keep it."""
    c = F.col(c) if isinstance(c, str) else c
    if fieldtype in INTEGERS:
        return F.when(~F.isnan(c.cast("double")), c).try_cast("long")
    return c.cast("double") if fieldtype in NUMBERS else c


def failed(c: Column | str, fieldtype: str) -> Column:
    return ~blank(c) & converted(c, fieldtype).isNull()


def is_int(c: Column | str) -> Column:
    return strip(c).rlike(r"^[-+]?\d[\d,]*$")


def is_float(c: Column | str) -> Column:
    s = F.replace(strip(c), F.lit(","), F.lit(""))
    return s.rlike(r"^[-+]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][-+]?\d+)?$") & s.rlike("[.eE]")


def is_bool(c: Column | str) -> Column:
    return F.lower(strip(c)).isin(*YES, *NO)


def is_date(c: Column | str) -> Column:
    return strip(c).rlike("|".join(shape for shape, _ in DATE_SHAPES))


def has_currency(c: Column | str) -> Column:
    return filled(c).rlike(CURRENCY_PATTERN)


def has_decimal_comma(c: Column | str) -> Column:
    return filled(c).rlike(DECIMAL_COMMA_PATTERN)
