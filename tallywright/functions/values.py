"""Reading values by what they mean: blanks, dates, numbers, booleans, texts, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month abbreviations in order, and the words that stand for true and false.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

SPACE = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """Outer white space off, inner white space to one blank; Unicode's white space counts."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def is_blank(c: Column) -> Column:
    """Null, empty, or only white space."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def calendar_date(c: Column) -> Column:
    """The date a text means, or null.

    Reads YYYY-MM-DD with or without a time, YYYY/MM/DD, DD/MM/YYYY and DD.MM.YYYY (day first),
    DD-MON-YYYY and YYYYMMDD. A date that the calendar does not have is null.
    """
    s = F.upper(F.regexp_replace(c, SPACE, ""))
    iso = F.regexp_extract(s, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})(T?[0-9:.]*Z?)?$", 1)
    day_first = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    named = r"^(\d{1,2})[- ]?([A-Z]{3})[A-Z]*[- ]?(\d{4})$"
    at = F.instr(F.lit("".join(MONTHS)), F.regexp_extract(s, named, 2)) - 1
    month = F.when(at % 3 == 0, F.lpad((at / 3 + 1).cast("int").cast("string"), 2, "0"))
    text = (
        F.when(iso != "", F.translate(iso, "/", "-"))
        .when(s.rlike(day_first), F.concat_ws("-", F.regexp_extract(s, day_first, 3), F.regexp_extract(s, day_first, 2), F.regexp_extract(s, day_first, 1)))
        .when(s.rlike(named), F.concat(F.regexp_extract(s, named, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(s, named, 1)))
        .when(s.rlike(r"^\d{8}$"), F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    )
    return text.try_cast("date")


def amount(c: Column) -> Column:
    """The number a text means, with or without a pound sign and thousands separators, or null."""
    return F.regexp_replace(c, r"(?U)[£,\s]", "").try_cast("decimal(38,10)")


def truth(c: Column) -> Column:
    """The boolean a text means, or null."""
    s = F.lower(F.regexp_replace(c, SPACE, ""))
    return F.when(s.isin(*TRUE_WORDS), F.lit(True)).when(s.isin(*FALSE_WORDS), F.lit(False))


def folded(c: Column) -> Column:
    """Text without regard to letter case and to outer or repeated white space."""
    return F.lower(squeeze(c))


def is_ascii(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"[^\x00-\x7f]"), F.lit(True))


@F.pandas_udf(T.BooleanType())
def same_composed(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts are one after Unicode composition and full case folding."""

    def fold(x: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold())

    return pd.Series([fold(x) == fold(y) if x is not None and y is not None else False for x, y in zip(a, b, strict=True)], dtype="bool")


def age_years(born: Column, at: Column) -> Column:
    """Days from a birth date to a day, in years of 365.25; null where either is."""
    return F.datediff(at, born) / 365.25


def cut_at_word(c: Column, longest: int) -> Column:
    """Text up to a length, cut at the last blank before it, with an ellipsis; shorter texts whole."""
    head = F.left(c, F.lit(longest - 1))
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r"\s+\S*$", "")), F.lit("…")))


def uuid_key(c: Column) -> Column:
    """A UUID without regard to letter case, blanks and braces."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s{}]", ""))


def numbered_key(c: Column) -> Column:
    """A code of letters and a number without regard to letter case, blanks, hyphens and leading zeros."""
    s = F.upper(F.regexp_replace(c, r"(?U)[\s-]", ""))
    return F.regexp_replace(s, r"^([A-Z]*)0+(?=\d)", "$1")
