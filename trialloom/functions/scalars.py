"""Scalar expressions: text, time, binning and arithmetic."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.nulls import as_col, case_when


def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Join as text; a missing value becomes the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def token(x: Column | str, position: int, sep: str) -> Column:
    """The ``position``-th token, NULL if there are fewer."""
    return F.try_element_at(F.split(as_col(x), re.escape(sep)), F.lit(position))


def course_of_run(run_id: Column | str) -> Column:
    """Course from a run id such as ``org/COURSE_run/term``: second token, without its run suffix."""
    return F.substring_index(token(run_id, 2, "/"), "_", 1)


def detect(x: Column | str, pattern: str) -> Column:
    return as_col(x).rlike(pattern)


def to_number(x: Column | str) -> Column:
    """Text to double; text that is no number gives NULL rather than an error."""
    return as_col(x).try_cast("double")


def cut(x: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(a, b]``; values outside give NULL."""
    x = as_col(x)
    spans = zip(breaks[:-1], breaks[1:], labels, strict=True)
    return case_when(*[((x > lo) & (x <= hi), F.lit(label)) for lo, hi, label in spans])


def reverse_code(x: Column | str, top: int = 10) -> Column:
    return F.lit(top) - as_col(x)


def int_div(x: Column | str, k: int) -> Column:
    return F.floor(as_col(x) / F.lit(k))


def modulo(x: Column | str, k: int) -> Column:
    return F.pmod(as_col(x), F.lit(k))


def round_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(x), digits)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def age_from_birth_year(year_of_birth: Column | str, year: int = 2017) -> Column:
    return F.lit(year) - as_col(year_of_birth)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch for a zoneless timestamp (session zone UTC)."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours between two epoch-second columns."""
    return (later - earlier) / F.lit(3600)


def days_between(later: Column, earlier: Column) -> Column:
    """Days between two epoch-second columns."""
    return (later - earlier) / F.lit(86400)


def md5_of(*parts: Column | str | int) -> Column:
    """Reproducible hash of the parts; used wherever a random order has to survive task retries.

    A NULL part counts as a zero character, so keys that differ only in which part is NULL hash differently.
    """
    cols = [F.lit(p) if isinstance(p, int) else as_col(p) for p in parts]
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
