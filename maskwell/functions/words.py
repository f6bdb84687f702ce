"""Words, folding, legal forms and reserved shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.scripts import latin

#: A word in any script.
WORD = r"[\p{L}\p{N}_]+"
#: One upper-case letter, then lower-case letters only.
TITLE = r"^\p{Lu}\p{Ll}+$"

# Patterns of contact data.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9][0-9 \-.()]{6,18}[0-9]"
ID_MARK = r"\bID[:\-][ ]?[0-9]{6,}\b"
CARD = r"\b[0-9]{13,16}\b"
PHONE_SHAPE = r"(?<![0-9])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ \-.])?[0-9]{3}-[0-9]{4}(?![0-9])"

# Trailing legal forms, in the order in which they are tried.
LEGAL_FORMS = (
    "GmbH & Co. KG", "GmbH", "AG", "KG", "SE", "Ltd.", "Ltd", "LLC", "LLP", "PLC", "Inc.", "Inc", "Corp.", "Corp",
    "Co.", "S.A.", "SA", "BV", "NV",
)

# Suffixes that a name may carry over when it is replaced.
NAME_SUFFIXES = ("'s", "en", "s", "n", "'")

#: Accented Latin letters and what they fold to; ß, æ, œ and þ fold to two letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿłšžčćđőűąęśźżńěřťďňůāēīū"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyylszccdouaeszznertdnuaeiu"


def fold(text: Column) -> Column:
    """Lower case in plain Latin letters: accents go, letters of other scripts are transcribed, ideographs stay.

    Texts of the common Latin letters alone take one translation; only others are looked up letter by letter.
    """
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    for letter, pair in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        plain = F.replace(plain, F.lit(letter), F.lit(pair))
    return F.when(plain.rlike(r"[^\x00-\x7F]"), latin(plain)).otherwise(plain)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_title(word: Column) -> Column:
    return word.rlike(TITLE)


def quote(text: Column) -> Column:
    """A literal as a regular expression."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def strip_legal_form(name: Column) -> Column:
    """Without the first legal form of the list that follows a space at the end."""
    out = name
    for form in reversed(LEGAL_FORMS):
        bare = F.rtrim(F.substring(name, F.lit(1), F.length(name) - F.lit(len(form) + 1)))
        out = F.when(name.endswith(" " + form), bare).otherwise(out)
    return out


# The shapes below.
def is_reserved_provisional(value: Column) -> Column:
    """Shape of the numbered surrogates that follow an exhausted pool."""
    return value.rlike("^(BFX|BFR|BFP|BFT|BFO|BFK)[0-9]{4,}$")


# The shapes below.
def is_reserved_pii(value: Column) -> Column:
    """Shape of a surrogate for contact data."""
    return value.rlike(
        r"^(pii-user-[0-9]+@maskwell\.invalid|\+1-555-[0-9]+|XX99 0000 0000 0000 0000 [0-9]+"
        r"|ID-RESERVED-[0-9]+|PII-RESERVED-.+-[0-9]+)$"
    )


# The shapes below.
def pii_surrogate(kind: Column, index: Column) -> Column:
    """Surrogate of the index-th value of a kind, in name spaces that nobody can own."""

    def padded(width: int) -> Column:
        digits = index.cast("string")
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))

    return (
        F.when(kind == "email", F.concat(F.lit("pii-user-"), padded(4), F.lit("@maskwell.invalid")))
        .when(kind == "phone", F.concat(F.lit("+1-555-"), F.lpad((100 + index % 100).cast("string"), 4, "0")))
        .when(kind == "iban", F.concat(F.lit("XX99 0000 0000 0000 0000 "), padded(4)))
        .when(kind == "id", F.concat(F.lit("ID-RESERVED-"), padded(6)))
        .otherwise(F.concat(F.lit("PII-RESERVED-"), kind, F.lit("-"), padded(4)))
    )


def scrubbed(real: Column, surrogate: Column) -> Column:
    """What a report may show of a value: its surrogate, else twelve digits of its hash."""
    return F.coalesce(surrogate, F.concat(F.lit("hash:"), F.substring(F.sha2(real, 256), 1, 12)))


# The beginnings and kinds below.
def audit_kind(event: Column) -> Column:
    return (
        F.when(event.startswith("re-identif") | event.startswith("re-identify"), "reveal")
        .when(event == "entity-list-searched", "lookup")
        .when(event.startswith("blocked-"), "block")
    )
