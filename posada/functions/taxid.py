"""Spanish tax ids: normal form and control characters (survey F09, F10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control letters by remainder.
PERSON_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
COMPANY_LETTERS = "JABCDEFGHI"
LETTER_ONLY, DIGIT_ONLY = "KLMNPQRSW", "ABEH"

PERSON, FOREIGNER = r"^[0-9]{8}[A-Z]$", r"^[XYZ][0-9]{7}[A-Z]$"
COMPANY, EUROPEAN = r"^[ABCDEFGHJKLMNPQRSUVW][0-9]{7}[0-9A-J]$", r"^[A-Z]{2}[0-9A-Z]{2,13}$"


def normalise(c: Column) -> Column:
    """Without spaces, dots, dashes and slashes, upper case; the ES of a long form goes."""
    nif = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s.\-/]", ""))
    return F.when(nif.startswith("ES") & (F.length(nif) > 9), F.substr(nif, F.lit(3))).otherwise(nif)


def _letter(number: Column) -> Column:
    return F.substr(F.lit(PERSON_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def company_control(digits: Column) -> Column:
    """The control digit of a company's seven digits."""
    at = lambda k: F.substring(digits, k, 1).try_cast("int")
    odd = sum((F.floor(at(k) * 2 / 10).cast("int") + at(k) * 2 % 10 for k in (1, 3, 5, 7)), F.lit(0))
    even = sum((at(k) for k in (2, 4, 6)), F.lit(0))
    return (10 - (odd + even) % 10) % 10


def is_valid(c: Column) -> Column:
    """Whether a normalised id is valid; blank is, other EU forms are by shape only."""
    last, head = F.substring(c, 9, 1), F.substring(c, 1, 1)
    person = F.substring(c, 1, 8).try_cast("long")
    foreigner = F.concat(F.translate(head, "XYZ", "012"), F.substring(c, 2, 7)).try_cast("long")
    control = company_control(F.substring(c, 2, 7))
    letter, digit = F.substr(F.lit(COMPANY_LETTERS), (control + 1).cast("int"), F.lit(1)), control.cast("string")
    company = (
        F.when(head.isin(*LETTER_ONLY), last == letter).when(head.isin(*DIGIT_ONLY), last == digit).otherwise((last == letter) | (last == digit))
    )
    return (
        F.when(c == "", F.lit(True)).when(c.rlike(PERSON), _letter(person) == last).when(c.rlike(FOREIGNER), _letter(foreigner) == last)
        .when(c.rlike(COMPANY), company).otherwise(c.rlike(EUROPEAN))
    )


def is_spanish(c: Column) -> Column:
    return c.rlike(PERSON) | c.rlike(FOREIGNER) | c.rlike(COMPANY)
