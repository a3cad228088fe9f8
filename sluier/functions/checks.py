"""Checksums and normalisers of single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bsn_valid(value: Column) -> Column:
    """Nine digits whose weighted sum (9, 8, .. 2, -1) is not 0 and divides by 11."""
    digits = [F.substring(value, i + 1, 1).try_cast("int") for i in range(9)]
    total = reduce(lambda a, b: a + b, [d * w for d, w in zip(digits, [9, 8, 7, 6, 5, 4, 3, 2, -1], strict=True)])
    return F.coalesce(value.rlike("^[0-9]{9}$") & (total != 0) & (total % 11 == 0), F.lit(False))


def iban_valid(value: Column) -> Column:
    """Country, check digits and account whose rearranged digits leave 1 when divided by 97."""
    plain = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c)))
    return F.coalesce(F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), rest == 1), F.lit(False))


def icd_normalise(value: Column) -> Column:
    return F.upper(F.trim(value))


DATE_FORM = r"^\s*\d{1,2}[-/]\d{1,2}[-/]\d{4}\s*$"


def date_triplet(value: Column) -> Column:
    """(day, month, year) of D-M-YYYY or D/M/YYYY; day 1-31, month 1-12, year 1900-2100, else null. No calendar check."""
    parts = F.when(value.rlike(DATE_FORM), F.transform(F.split(value, "[-/]"), lambda x: F.trim(x).cast("int")))
    fits = lambda p: p[0].between(1, 31) & p[1].between(1, 12) & p[2].between(1900, 2100)
    named = F.transform(F.array(parts), lambda p: F.when(fits(p), F.struct(p[0].alias("day"), p[1].alias("month"), p[2].alias("year"))))
    return named[0]
