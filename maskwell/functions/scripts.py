"""Latin letters for the letters of other scripts, by the names that Unicode gives them.

The table is no list of letters: a letter's Unicode name tells how it is read ("HEBREW LETTER BET" begins
with b, "KATAKANA LETTER KA" is ka), and a few rules turn names into Latin letters. Letters with
marks are read as their base, compatibility forms as what they stand for. Syllables of Hangul are
composed by arithmetic from the readings of their parts. Ideographs have no reading in their names and stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
#: Code points of Hangul syllables; each first part has 21 vowels, each of these 28 endings.
HANGUL, HANGUL_END, VOWELS, ENDINGS = 0xAC00, 0xD7A4, 21, 28
_SILENT = HANGUL + 11 * VOWELS * ENDINGS
#: Ideographs: read by no rule.
IDEOGRAPHS = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00))

# Letters that are usually read otherwise than their names begin.
READ_AS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ł": "l",
    "ŋ": "n", "ŧ": "t", "ƒ": "f", "ə": "e", "ɓ": "b", "ɗ": "d", "ɛ": "e", "ɔ": "o",
    "η": "i", "θ": "th", "ρ": "r", "ξ": "x", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "ё": "io", "є": "ie", "і": "i", "ї": "i", "ґ": "g", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "ђ": "dj", "џ": "dz",
    "ѓ": "g", "ќ": "k",
    "ء": "", "چ": "ch", "ذ": "dh", "ー": "",
}
# Syllables of kana that are usually spelt otherwise than their names.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}

_NAMED = re.compile(r"(?:LETTER|SYLLABLE|CHARACTER|VOWEL SIGN|SARA) (.+)$")
_SPECIFIC = re.compile(r"^(?:SMALL|CAPITAL|FINAL|ARCHAIC|FARSI|VOCALIC|SARA|OLD|TURNED|REVERSED|SHORT|LONG|YIDDISH)\s+")


def _reading(char: str) -> str | None:
    """Latin letters of one lower-case letter or mark; None if its name tells none."""
    if char in READ_AS:
        return READ_AS[char]
    name = unicodedata.name(char, "")
    kana = name.startswith(("HIRAGANA", "KATAKANA"))
    parts = [p for p in unicodedata.normalize("NFKD", char) if not unicodedata.combining(p)]
    if parts and parts != [char] and not kana:
        read = [p if p.isascii() else _reading(p.lower()) for p in parts]
        return None if None in read else "".join(read).lower()
    vowel_sign = "VOWEL SIGN" in name or " SARA " in name
    if unicodedata.category(char).startswith("M") and not vowel_sign:
        return ""
    found = _NAMED.search(name)
    if not found or name.startswith("CJK") or unicodedata.category(char)[0] not in "LM":
        return None
    rest = found.group(1)
    while _SPECIFIC.match(rest):
        rest = _SPECIFIC.sub("", rest)
    word = re.split(r"[ \-]", rest)[0].lower()
    if not word.isalpha():
        return None
    if kana or "SYLLABLE" in name:
        return KANA.get(word, word)
    if vowel_sign or set(word) <= set("aeiou"):
        return word
    return re.match(r"[^aeiou]+|[aeiou]", word).group()


@cache
def readings() -> tuple[list[int], list[str | None]]:
    """Of every block of 256 code points of the basic plane where its readings begin (-1: none), and all readings."""
    starts, flat = [], []
    for first in range(0, 0x10000, BLOCK):
        block: list[str | None] = [None] * BLOCK
        apart = first < HANGUL_END and first + BLOCK > HANGUL or any(a <= first < b for a, b in IDEOGRAPHS)
        if not apart and not 0xD800 <= first < 0xE000:
            for code in range(max(first, 0x80), first + BLOCK):
                char = chr(code).lower()
                if len(char) == 1 and unicodedata.category(char)[0] in "LM":
                    block[code - first] = _reading(char)
        if any(r is not None for r in block):
            starts.append(len(flat))
            flat += block
        else:
            starts.append(-1)
    return starts, flat


@cache
def hangul_parts() -> tuple[list[str], list[str], list[str]]:
    """Readings of the first parts, vowels and endings of Hangul syllables, taken from names of syllables."""

    def name(code: int) -> str:
        return unicodedata.name(chr(code)).removeprefix("HANGUL SYLLABLE ").lower()

    firsts = [name(HANGUL + k * VOWELS * ENDINGS)[:-1] for k in range((HANGUL_END - HANGUL) // (VOWELS * ENDINGS))]
    vowels = [name(_SILENT + k * ENDINGS) for k in range(VOWELS)]
    return firsts, vowels, [name(_SILENT + k)[1:] for k in range(ENDINGS)]


def _listed(values: list) -> Column:
    """A constant array: one literal is split, so the plan holds no node per value."""
    return F.split(F.lit(",".join("?" if v is None else str(v) for v in values)), ",")


def latin(text: Column) -> Column:
    """Lower-case ``text`` with letters of any script but ideographs in Latin letters; null stays null.

    Letters whose names tell no reading, ideographs, digits and signs stay as they are. Every
    character is looked up by its block and place, whatever the number of scripts.
    """
    starts, flat = readings()
    firsts, vowels, endings = hangul_parts()
    begins, read = _listed(starts), _listed(flat)

    def one(char: Column) -> Column:
        code = F.ascii(char)
        at = code - F.lit(HANGUL)
        syllable = F.concat(
            F.get(_listed(firsts), F.floor(at / (VOWELS * ENDINGS)).cast("int")),
            F.get(_listed(vowels), F.floor(at % (VOWELS * ENDINGS) / ENDINGS).cast("int")),
            F.get(_listed(endings), at % ENDINGS),
        )
        begin = F.get(begins, F.shiftright(code, 8)).cast("int")
        known = F.when(begin >= 0, F.get(read, begin + code.bitwiseAND(F.lit(BLOCK - 1))))
        return (
            F.when(code < 0x80, char)
            .when(code.between(HANGUL, HANGUL_END - 1), syllable)
            .otherwise(F.coalesce(F.nullif(known, F.lit("?")), char))
        )

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0)), one), "")
