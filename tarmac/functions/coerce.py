"""Coercions that return ``Column`` expressions (all JVM-side, codegen-friendly).

Semantics follow a lenient pandas-style reader: anything that is not a clean
number / date becomes null instead of failing the job (ANSI mode is on in
Spark 4, so every cast here is a ``try_`` form).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MISSING_HOUR, MISSING_KEY, NA_TOKENS

# Accepts " 5 ", "1e3", ".5", "5.", "-3.5"; rejects "5d", "0x1F", "1_0", "nan", "inf".
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_EDGE_WS = r"^\s+|\s+$"
# What may stand at an end that the pattern changes: its white space, and the line ends that ``$`` stops before.
_EDGE_CHARS = " \t\n\x0b\f\r\x85\u2028\u2029"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Whitespace strip including tabs/newlines (Spark ``trim`` strips spaces only); the pattern runs only on text with such an end."""
    x = _c(c).cast("string")
    printable = (x >= "!") & (x < "\x7f") & F.substring(x, -1, 1).between("!", "~")
    return F.when(printable | (F.btrim(x, F.lit(_EDGE_CHARS)) == x), x).otherwise(F.regexp_replace(x, _EDGE_WS, ""))


def null_if_na_token(c) -> Column:
    """Text that a pandas reader treats as missing becomes null."""
    s = _c(c)
    return F.when(strip(s).isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(s)


def no_na_token(s: Column) -> Column:
    """Stripped text, null where it is an NA token."""
    return F.when(~s.isin(*NA_TOKENS), s)


def clean_text(c) -> Column:
    """NA tokens -> null, then strip."""
    return no_na_token(strip(c))


def upper_key(c) -> Column:
    """Key normalisation: strip + upper."""
    return F.upper(strip(c))


def nan_to_null(c) -> Column:
    x = _c(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def _bare_number(txt: Column) -> Column:
    """True for text from a digit, sign or point to a digit or point without an ``x``: a cast takes of it just what the pattern does."""
    return (txt >= "+") & (txt < ":") & F.substring(txt, -1, 1).between(".", "9") & ~txt.contains("x") & ~txt.contains("X")


def to_double(c) -> Column:
    """Guarded numeric cast: non-numeric text, NaN and inf -> null (P1, D6, D7); the pattern runs only on text with odd ends."""
    txt = _c(c).cast("string")
    d = F.when(_bare_number(txt), txt).when(txt.rlike(NUMERIC_PATTERN), strip(txt)).try_cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def integral(d: Column, dtype: T.DataType) -> Column:
    """A parsed double as an integer width; non-integral or out-of-range -> null."""
    return F.when(d == F.floor(d), d.try_cast(dtype))


def not_integral(d: Column) -> Column:
    """True where a parsed double is there but not integral."""
    return d.isNotNull() & (d != F.floor(d))


def to_integral(c, dtype: T.DataType) -> Column:
    """Numeric cast to an integer width; non-integral or out-of-range -> null.

    A non-integral value is a data error; :func:`integral_violations` counts them
    so a strict caller can raise instead of silently nulling.
    """
    return integral(to_double(c), dtype)


def integral_violation(c) -> Column:
    """True where a value is numeric but not integral (counted by strict ingest)."""
    return not_integral(to_double(c))


def coerce_numeric(c, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return to_integral(c, dtype)
    return to_double(c)


def stripped_to_date(s: Column) -> Column:
    """:func:`to_date_lenient` of text without white space at its ends."""
    # yyyy-MM-dd as such: the cast needs no pattern and no formatter.
    plain = ((F.length(s) == 10) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-") & (s >= "0001") & (s < ":")
             & F.substring(s, -1, 1).between("0", "9"))
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.regexp_extract(s, r"^\d{4}-\d{1,2}-\d{1,2}(?=$|[ T])", 0), "yyyy-M-d"))
    # A failed parse costs an exception: only text with the format's own signs is tried.
    us = F.when(s.contains(":"), F.to_date(F.try_to_timestamp(s, F.lit("M/d/yyyy h:mm:ss a"))))
    us_date = F.when(s.contains("/"), F.try_to_date(s, "M/d/yyyy"))
    return F.when(plain, s.try_cast("date")).otherwise(F.coalesce(iso, us, us_date))


def to_date_lenient(c) -> Column:
    """Per-row date parse of ``yyyy-MM-dd`` (a time may follow after a space or ``T``) or ``M/d/yyyy h:mm:ss a``; bad -> null."""
    return stripped_to_date(strip(_c(c).cast("string")))


def sanitize_key(c) -> Column:
    """String key: null -> ``__MISSING__``, stripped."""
    return strip(F.coalesce(_c(c).cast("string"), F.lit(MISSING_KEY)))


def sanitize_hour(c) -> Column:
    """Hour key: null -> -1, as smallint."""
    return F.coalesce(_c(c).cast("smallint"), F.lit(MISSING_HOUR).cast("smallint"))
