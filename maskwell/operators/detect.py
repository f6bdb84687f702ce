"""Detection of contact data and identifiers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import checks, spans, words

#: kind -> (pattern, check of a match or None). Postal codes, number plates and practice
#: numbers have no check digit and are left out on purpose.
RECOGNISERS = {
    "email": (words.EMAIL, None),
    "phone": (words.PHONE, None),
    "id": (words.ID_MARK, None),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:[ \-]?[A-Z0-9]{4}){2,7}(?:[ \-]?[A-Z0-9]{1,3})?\b", checks.iban),
    "card": (words.CARD, checks.luhn),
    "de_tax": (r"\b[1-9][0-9]{10}\b", checks.german_tax_id),
    "de_pension": (r"\b[0-9]{8}[A-Z][0-9]{3}\b", checks.german_pension_id),
    "de_health": (r"\b[A-Z][0-9]{9}\b", checks.german_health_id),
    "de_doctor": (r"\b[0-9]{9}\b", checks.german_doctor_id),
}


def _passing(found: Column, check) -> Column:
    return F.filter(found, lambda m: check(m["value"]))


def pii_of(text: Column, kinds: list[str] | None = None) -> Column:
    """All spans of a text, one for each occurrence of each kind, as an array."""
    found = []
    for kind in kinds or list(RECOGNISERS):
        pattern, check = RECOGNISERS[kind]
        spans_of = spans.matches(text, pattern, kind)
        found.append(_passing(spans_of, check) if check else spans_of)
    return F.concat(*found)


def pii_spans(texts: DataFrame, key: str, text: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """``key``, ``kind``, ``value``, ``s``, ``e`` for each occurrence. Stays inside the row until it explodes."""
    return texts.select(key, F.explode(pii_of(F.col(text), kinds)).alias("m")).select(key, "m.kind", "m.value", "m.s", "m.e")


def counts_by_kind(found: DataFrame, key: str) -> DataFrame:
    """Distinct values and occurrences per ``key`` and kind."""
    once = found.groupBy(key, "kind", "value").agg(F.count("*").alias("n"))
    return once.groupBy(key, "kind").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_spans"))


def phone_shaped(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Candidates that look like a national phone number without a plus sign."""
    found = spans.matches(F.col(text), words.PHONE_SHAPE, "phone-shaped")
    return texts.select(key, F.explode(found).alias("m")).select(key, "m.value", "m.s", "m.e")
