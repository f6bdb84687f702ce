"""Check digits of identifiers, from their public specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn(digits: Column) -> Column:
    """Card numbers: every second digit from the right doubled, the sum divisible by 10."""

    def term(d: Column, k: Column) -> Column:
        twice = d * 2
        return F.when(k % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    terms = F.transform(F.reverse(_digits(digits)), term)
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def iban(text: Column) -> Column:
    """Bank accounts, ISO 13616: first four characters to the end, letters as 10 to 35, mod 97 is 1."""
    plain = F.upper(F.regexp_replace(text, r"[ \-]", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    number = F.transform(
        chars, lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - F.lit(55))
    )
    rest = F.aggregate(
        number, F.lit(0), lambda acc, d: F.when(d > 9, acc * 100 + d).otherwise(acc * 10 + d) % 97
    )
    return plain.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def german_tax_id(text: Column) -> Column:
    """Eleven digits, ISO 7064 mod 11, 10; one digit of the first ten twice or thrice."""
    d = _digits(text)
    product = F.aggregate(
        F.slice(d, 1, 10),
        F.lit(10),
        lambda acc, x: F.when((acc + x) % 10 == 0, F.lit(10)).otherwise((acc + x) % 10) * 2 % 11,
    )
    check = F.when(11 - product == 10, 0).otherwise(11 - product)
    kinds = F.size(F.array_distinct(F.slice(d, 1, 10)))
    return F.coalesce(text.rlike("^[1-9][0-9]{10}$") & kinds.isin(8, 9) & (check == F.try_element_at(d, F.lit(11))), F.lit(False))


def german_pension_id(text: Column) -> Column:
    """Twelve places with a letter at the ninth, weights 2 1 2 5 7 1 2 1 2 1 2 1 and digit sums."""
    letter = F.lpad((F.ascii(F.substring(text, 9, 1)) - 64).cast("string"), 2, "0")
    spelled = F.concat(F.substring(text, 1, 8), letter, F.substring(text, 10, 2))
    weights = F.array(*[F.lit(w) for w in (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1)])
    sums = F.zip_with(_digits(spelled), weights, lambda d, w: (d * w / 10).cast("int") + d * w % 10)
    total = F.aggregate(sums, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    ok = text.rlike("^[0-9]{8}[A-Z][0-9]{3}$")
    return F.coalesce(ok & (total % 10 == F.substring(text, 12, 1).try_cast("int")), F.lit(False))


def german_health_id(text: Column) -> Column:
    """A letter and nine digits: letter as two digits, weights 1 and 2 in turn, digit sums."""
    letter = F.lpad((F.ascii(F.substring(text, 1, 1)) - 64).cast("string"), 2, "0")
    d = _digits(F.concat(letter, F.substring(text, 2, 8)))
    sums = F.transform(d, lambda x, k: F.when(k % 2 == 0, x).otherwise((x * 2 / 10).cast("int") + x * 2 % 10))
    total = F.aggregate(sums, F.lit(0), lambda a, b: a + b)
    ok = text.rlike("^[A-Z][0-9]{9}$")
    return F.coalesce(ok & (total % 10 == F.substring(text, 10, 1).try_cast("int")), F.lit(False))


def german_doctor_id(text: Column) -> Column:
    """Nine digits: six weighted 4 and 9 in turn, the seventh fills their sum up to a ten."""
    d = _digits(text)
    total = F.aggregate(
        F.transform(F.slice(d, 1, 6), lambda x, k: x * F.when(k % 2 == 0, 4).otherwise(9)), F.lit(0), lambda a, b: a + b
    )
    return F.coalesce(text.rlike("^[0-9]{9}$") & ((10 - total % 10) % 10 == F.try_element_at(d, F.lit(7))), F.lit(False))
