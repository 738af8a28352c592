"""Address expressions: digit form and contact key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PHONE_DIGITS = 7
MIN_KEY_DIGITS = 5
KEY_DIGITS = 10


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def phone_digits(address: Column) -> Column:
    """Digit form of an address, when it is long enough to be a phone number."""
    digits = digits_of(address)
    return F.when(F.length(digits) >= MIN_PHONE_DIGITS, digits)


def contact_key(address: Column) -> Column:
    """Lower-cased e-mail, else the last ten digits, else NULL."""
    trimmed = F.trim(address)
    digits = digits_of(trimmed)
    return F.when(trimmed.contains("@"), F.lower(trimmed)).when(
        F.length(digits) >= MIN_KEY_DIGITS, F.right(digits, F.lit(KEY_DIGITS))
    )
