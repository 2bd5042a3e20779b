"""Check digits of national IDs and business numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ID scheme: the two digits that each letter stands for.
LETTERS = {
    "A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16, "H": 17, "I": 34, "J": 18,
    "K": 19, "L": 20, "M": 21, "N": 22, "O": 35, "P": 23, "Q": 24, "R": 25, "S": 26, "T": 27,
    "U": 28, "V": 29, "W": 32, "X": 30, "Y": 31, "Z": 33,
}
TAX_WEIGHTS = (1, 2, 1, 2, 1, 2, 4, 1)


def _digit(s: Column, i: int) -> Column:
    return F.substring(s, i, 1).cast("int")


def valid_national_id(s: Column) -> Column:
    """A letter, 1 or 2, and eight digits whose weighted sum is a multiple of ten; null is not valid."""
    letter = F.instr(F.lit("".join(LETTERS)), F.substring(s, 1, 1))
    value = F.element_at(F.lit(list(LETTERS.values())), F.greatest(letter, F.lit(1)))
    total = F.floor(value / 10) + value % 10 * 9 + sum((_digit(s, i + 2) * (8 - i) for i in range(8)), F.lit(0)) + _digit(s, 10)
    return F.when(s.rlike(r"\A[A-Z][12][0-9]{8}\z"), total % 10 == 0).otherwise(False)


def valid_tax_id(s: Column) -> Column:
    """Digit sums of the weighted digits: a multiple of five, or one less if the seventh digit is 7; null is not valid."""
    products = [_digit(s, i + 1) * w for i, w in enumerate(TAX_WEIGHTS)]
    total = sum((F.floor(p / 10) + p % 10 for p in products), F.lit(0))
    return F.when(s.rlike(r"\A[0-9]{8}\z"), (total % 5 == 0) | ((F.substring(s, 7, 1) == "7") & ((total + 1) % 5 == 0))).otherwise(False)
