"""Dictionary detection: exact, folded and edit-distance joins over word windows."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions import words
from maskwell.functions.spans import let, running
from maskwell.operators import overlap
from maskwell.shared import materialize

# Shortest surface and most edits of the fuzzy pass.
FUZZY_LENGTH = 5
FUZZY_EDITS = 2
#: Letters from which on a name is looked up by pieces, as it has too many shorter forms.
LONG_NAME = 20
#: Texts whose words a task holds at once, and distinct words and runs.
TEXTS, HELD_WORDS = 256, 200_000
#: A word, as :data:`words.WORD` has it, in workers.
_WORD = re.compile(r"\w+")
_PARTED = re.compile(r"(\w+)")


#: Bits of a :func:`membership` filter.
FILTER_BITS = 2**24


def membership(values: DataFrame, column: str) -> Broadcast:
    """A filter of fixed size that workers ask whether a text may be one of ``values``; it never misses one: a bit for each checksum."""
    return _filter_of(values.where(F.col(column).isNotNull()).select((F.crc32(F.encode(F.col(column), "UTF-8")) % FILTER_BITS).alias("bit")))


def _filter_of(bits: DataFrame) -> Broadcast:
    """The filter with the given bits (column ``bit``), put together in Spark: 512 bitmaps of 4 KB at most reach the driver."""
    bit = F.col("bit") + 1
    maps = bits.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place"))
    maps = maps.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    size = 4096
    out = bytearray(FILTER_BITS // 8)
    for row in maps.collect():
        out[(row.bucket - 1) * size : row.bucket * size] = row.bits
    return bits.sparkSession.sparkContext.broadcast(bytes(out))


def _possible(bits: bytes, text: str) -> bool:
    at = zlib.crc32(text.encode()) % FILTER_BITS
    return bool(bits[at >> 3] >> (at & 7) & 1)


_PLAIN = str.maketrans({**dict(zip(words.ACCENTED, words.PLAIN, strict=True)), "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"})


class _Plain(dict):
    """Folds of words in the common Latin letters, as :func:`words.fold` has them; None for any other word."""

    def __missing__(self, word: str) -> str | None:
        if len(self) > HELD_WORDS:
            self.clear()
        plain = word.lower()
        plain = plain if plain.isascii() else plain.translate(_PLAIN)
        self[word] = plain = plain if plain.isascii() else None
        return plain


def token_array(text: Column) -> Column:
    """Words of a text in order: array of ``gap``, ``word``, ``s``, ``e``. Nothing leaves the row."""
    # The last gap has no word behind it.
    zipped = F.zip_with(F.split(text, words.WORD, -1), words.words(text), lambda g, w: F.struct(g.alias("gap"), w.alias("word")))

    def place(p: Column, at: Column) -> Column:
        s = (at + F.length(p["gap"])).cast("int")
        return F.struct(p["gap"].alias("gap"), p["word"].alias("word"), s.alias("s"), (s + F.length(p["word"])).cast("int").alias("e"))

    def placed(parts: Column) -> Column:
        return F.zip_with(parts, running(F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["word"]))), place)

    return let(F.filter(zipped, lambda p: p["word"].isNotNull()), placed)


def tokens(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``n``, ``word``, ``s``, ``e``, ``gap``: every word with its place and the gap before it."""
    rows = texts.select(key, F.posexplode(token_array(F.col(text))).alias("n", "p"))
    return rows.select(key, "n", "p.word", "p.s", "p.e", "p.gap")


def window_array(toks: Column, longest: int = 3) -> Column:
    """Runs of 1 to ``longest`` words of an array of :func:`token_array`: ``s``, ``e``, ``k``, ``phrase``."""
    return let(toks, lambda t: _windows(t, longest))


def _windows(toks: Column, longest: int) -> Column:
    ahead = [F.slice(toks, F.lit(k + 1), F.greatest(F.lit(0), F.size(toks) - k)) for k in range(longest)]
    zipped = F.arrays_zip(*[x.alias(f"t{k}") for k, x in enumerate(ahead)])

    def runs(t: Column) -> Column:
        first = t["t0"]
        out = [F.struct(first["s"].alias("s"), first["e"].alias("e"), F.lit(1).alias("k"), first["word"].alias("phrase"))]
        joined, whole = first["word"], F.lit(True)
        for k in range(1, longest):
            x = t[f"t{k}"]
            whole = whole & F.coalesce(x["gap"].rlike(r"^[ \t]+$"), F.lit(False))
            joined = F.concat(joined, F.lit(" "), x["word"])
            run = F.struct(first["s"].alias("s"), x["e"].alias("e"), F.lit(k + 1).alias("k"), joined.alias("phrase"))
            out.append(F.when(whole, run))
        return F.filter(F.array(*out), lambda r: r.isNotNull())

    return F.flatten(F.transform(zipped, runs))


def windows(texts: DataFrame, key: str, longest: int = 3, text: str = "text") -> DataFrame:
    """Runs of 1 to ``longest`` words parted by blanks or tabs only: ``key``, ``s``, ``e``, ``k``, ``phrase`` (single spaces)."""
    tokenized = texts.select(key, token_array(F.col(text)).alias("t"))
    return tokenized.select(key, F.explode(window_array(F.col("t"), longest)).alias("r")).select(key, "r.*")


def entries(dictionary: DataFrame, surface_key: Column) -> DataFrame:
    """One row per key: the first entity declared and whether several entries share the key."""
    keyed = dictionary.select(surface_key.alias("lookup"), "surface", "entity", "ord")
    best = keyed.groupBy("lookup").agg(
        F.min_by(F.struct("surface", "entity"), "ord").alias("first"), F.count("*").alias("n_entries")
    )
    return best.select("lookup", "first.surface", "first.entity", "n_entries")


def exact_and_folded(dictionary: DataFrame) -> DataFrame:
    """One row per folded surface: ``folded``, its first entry, and the entries of each surface as a map ``exact``."""
    exact = entries(dictionary, F.col("surface"))
    named = F.struct("surface", "entity", "n_entries")
    per_fold = exact.groupBy(words.fold(F.col("lookup")).alias("folded")).agg(
        F.map_from_entries(F.collect_list(F.struct("lookup", named.alias("entry")))).alias("exact")
    )
    folded = entries(dictionary, words.fold(F.col("surface")))
    return per_fold.join(folded.select(F.col("lookup").alias("folded"), named.alias("first")), "folded")


def remnants(text: str, most: int) -> set[str]:
    """All that is left of a text when up to ``most`` characters go, the first one excepted."""
    out = reached = {text}
    for _ in range(most):
        reached = {x[:i] + x[i + 1 :] for x in reached for i in range(1, len(x))}
        out = out | reached
    return out


def _cuts(size: int) -> list[tuple[int, int]]:
    """Start and end of the three pieces of a text of ``size`` characters."""
    ends = [size * k // 3 for k in range(4)]
    return list(zip(ends, ends[1:], strict=False))


def name_keys(name: str) -> set[str]:
    """Keys of a folded name: itself with up to two characters less; a long one by its three pieces."""
    if len(name) <= LONG_NAME:
        return remnants(name, FUZZY_EDITS)
    return {f"{len(name)}/{k}/{name[s:e]}" for k, (s, e) in enumerate(_cuts(len(name)))}


def phrase_keys(phrase: str, blanks: int) -> set[str]:
    """Keys of a folded run of ``blanks`` + 1 words, of which one is a key of every name within two edits.

    A name has no blank, so an alignment deletes each blank or puts a letter in its place:
    either way the run loses it, and only the other edits may cost it a letter. The first
    characters are the same and stay. Two edits leave one of three pieces of a long name whole,
    and shift it by two places at most.
    """
    joined = phrase.replace(" ", "")
    keys = remnants(joined, FUZZY_EDITS - blanks) if len(joined) <= LONG_NAME + FUZZY_EDITS else set()
    return keys | phrase_pieces(phrase)


def phrase_pieces(phrase: str) -> set[str]:
    """The keys of :func:`phrase_keys` for names that are looked up by pieces."""
    keys = set()
    for size in range(max(LONG_NAME + 1, len(phrase) - FUZZY_EDITS), len(phrase) + FUZZY_EDITS + 1):
        for k, (s, e) in enumerate(_cuts(size)):
            shifts = range(max(0, s - FUZZY_EDITS), s + FUZZY_EDITS + 1)
            keys |= {f"{size}/{k}/{phrase[at : at + e - s]}" for at in shifts}
    return keys


#: Sums of letters times powers of an odd number, modulo 2^64: what is left when letters go has its sum from sums of pieces.
_BASE = 0x9E3779B97F4A7C15
_BACK, _BACK_TWICE = (np.uint64(pow(_BASE, -k, 2**64)) for k in (1, 2))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def remnant_bits(texts: list[str], initials: list[str], most: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Filter bits of all :func:`remnants` of texts of one length: a row per text, and the places that go for each column.

    The first character of a name as it is written counts as well.
    """
    size = len(texts[0])
    letters = np.array(texts, f"<U{size}").view(np.uint32).reshape(len(texts), size).astype(np.uint64)
    powers = np.array([pow(_BASE, k + 1, 2**64) for k in range(size)], np.uint64)
    upto = np.zeros((len(texts), size + 1), np.uint64)
    np.cumsum(letters * powers, axis=1, out=upto[:, 1:])
    sums, gone = [upto[:, -1:]], [()]
    if most >= 1 and size > 1:
        sums.append(upto[:, 1:-1] + (upto[:, -1:] - upto[:, 2:]) * _BACK)
        gone += [(k,) for k in range(1, size)]
    if most >= 2 and size > 2:
        i, j = (x + 1 for x in np.triu_indices(size - 1, 1))
        sums.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * _BACK + (upto[:, -1:] - upto[:, j + 1]) * _BACK_TWICE)
        gone += list(zip(i.tolist(), j.tolist(), strict=True))
    first = np.array([ord(x) for x in initials], np.uint64)[:, None] * _MIX
    mixed = np.concatenate(sums, axis=1) + first
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return (mixed >> np.uint64(65 - FILTER_BITS.bit_length())).astype(np.int64), gone


def _bits_of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filter bits of all :func:`name_keys` of rows with ``surface``, ``folded``."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            some = batch.slice(start, 500)
            bits: set[int] = set()
            for surface, folded in zip(*(some[c].to_pylist() for c in ("surface", "folded")), strict=True):
                if len(folded) > LONG_NAME:
                    bits |= {zlib.crc32((surface[:1] + x).encode()) % FILTER_BITS for x in name_keys(folded)}
                elif folded:
                    bits.update(remnant_bits([folded], [surface[0]], FUZZY_EDITS)[0].ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64())], names=["bit"])


def key_filter(names: DataFrame) -> Broadcast:
    """The filter of all keys of the names (``surface``)."""
    folded = names.select("surface").distinct().select("surface", words.fold(F.col("surface")).alias("folded"))
    return _filter_of(folded.mapInArrow(_bits_of_names, "bit long"))


def known_keys(surfaces: list[str], folded: list[str], k: list[int], bits: bytes, pieces: bool) -> dict[int, set[str]]:
    """Row -> those :func:`phrase_keys`, with the first character of the surface, that a filter of names may hold.

    Rows without any are left out. Without ``pieces`` no name is long enough to be looked up by its pieces.
    """
    out: dict[int, set[str]] = {}
    alike: dict[tuple[int, int], list[int]] = {}
    joined = [x.replace(" ", "") for x in folded]
    for row, (text, n) in enumerate(zip(joined, k, strict=True)):
        if text and len(text) <= LONG_NAME + FUZZY_EDITS:
            alike.setdefault((len(text), FUZZY_EDITS + 1 - n), []).append(row)
    held = np.frombuffer(bits, np.uint8)
    for (_, most), rows in alike.items():
        at, gone = remnant_bits([joined[r] for r in rows], [surfaces[r][0] for r in rows], most)
        for x, y in zip(*(v.tolist() for v in np.nonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)), strict=True):
            text = joined[rows[x]]
            left = "".join([text[i:j] for i, j in zip((0, *(g + 1 for g in gone[y])), (*gone[y], len(text)), strict=True)])
            out.setdefault(rows[x], set()).add(surfaces[rows[x]][0] + left)
    for row, text in enumerate(folded if pieces else []):
        if len(text) + FUZZY_EDITS > LONG_NAME:
            found = {surfaces[row][:1] + x for x in phrase_pieces(text)}
            if found := {x for x in found if _possible(bits, x)}:
                out[row] = out.get(row, set()) | found
    return out


def _keyed(known: Broadcast | None = None, pieces: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``keys`` of each row's ``folded``, with its ``surface``; names without a filter ``known``, else phrases of ``k`` words.

    Keys that are not in the filter are left out, and rows without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                surface, folded, k = (some[c].to_pylist() for c in ("surface", "folded", "k"))
                if known is None:
                    keys = {row: {s[:1] + x for x in name_keys(f)} for row, (s, f) in enumerate(zip(surface, folded, strict=True))}
                else:
                    keys = known_keys(surface, folded, k, known.value, pieces)
                at = pa.array(list(keys), pa.int32())
                columns = [pa.array([list(x) for x in keys.values()], pa.list_(pa.string())), some["surface"].take(at), some["folded"].take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["keys", "surface", "folded"])

    return run


def _fuzzy(c: str) -> Column:
    return ~F.col(c).contains(" ") & (F.length(c) >= FUZZY_LENGTH)


_KEYED = "keys array<string>, surface string, folded string"


def _keys_of_names(known: DataFrame) -> DataFrame:
    """``key``, ``surface``, ``name`` (folded): every key of every name of ``known`` (``surface``)."""
    names = known.select("surface").distinct().select("surface", words.fold(F.col("surface")).alias("folded"), F.lit(None).cast("int").alias("k"))
    return names.mapInArrow(_keyed(), _KEYED).select(F.explode("keys").alias("key"), "surface", F.col("folded").alias("name"))


def _near(phrases: DataFrame, known: DataFrame, stopwords: list[str]) -> DataFrame:
    """``phrase``, ``surface``, ``edits`` of phrases and names that share a key and are one or two edits apart."""
    names = known.select("surface").distinct()
    rest = phrases.where((F.length("phrase") >= FUZZY_LENGTH) & ~F.lower("phrase").isin(stopwords))
    initial = F.substring("surface", 1, 1).alias("initial")
    rest = rest.select(F.col("phrase").alias("surface"), "folded", "k", initial).join(names.select(initial).distinct(), "initial", "left_semi")
    by_name = materialize(_keys_of_names(names), "name-keys")
    by_phrase = rest.mapInArrow(_keyed(key_filter(names)), _KEYED).select(F.explode("keys").alias("key"), F.col("surface").alias("phrase"), F.col("folded").alias("word"))
    return by_phrase.join(by_name, "key").withColumn("edits", F.levenshtein("word", "name", FUZZY_EDITS)).where("edits > 0")


def close_phrases(phrases: DataFrame, dictionary: DataFrame, stopwords: list[str]) -> DataFrame:
    """``phrase`` of ``phrases`` (``phrase``, ``folded``, ``k`` words, at most 3) and ``surface``, ``entity`` of the nearest name.

    Names are surfaces of one word of at least five letters; a phrase is near with one or two
    edits between the folded forms, the same first character, at least five characters and no
    stop-word of its own. Equal keys meet, in whose sense a name and a phrase share a remnant;
    only those are compared. The nearest name wins, then the first declared.
    """
    known = dictionary.where(_fuzzy("surface")).select("surface", "entity", "ord")
    near = _near(phrases, known, stopwords)
    best = near.join(known, "surface").groupBy("phrase").agg(F.min_by(F.struct("surface", "entity"), F.struct("edits", "ord")).alias("m"))
    return best.select("phrase", "m.surface", "m.entity")


def near_names(phrases: DataFrame, surfaces: DataFrame, stopwords: list[str]) -> DataFrame:
    """``phrase``, ``surface``, ``edits``: every name near to a phrase, in the sense of :func:`close_phrases`."""
    near = _near(phrases, surfaces.where(_fuzzy("surface")), stopwords)
    return near.groupBy("phrase", "surface").agg(F.min("edits").alias("edits"))


class _Gaps(dict):
    """Whether what stands between two words is blanks and tabs only."""

    def __missing__(self, gap: str) -> bool:
        if len(self) > HELD_WORDS:
            self.clear()
        self[gap] = only = bool(gap) and not gap.strip(" \t")
        return only


class _Runs(dict):
    """Runs of words met so far, by number: ``phrase`` with single blanks and ``flags``; only some are ever folded.

    A run of one word is looked up by the word, a longer one by the number of the run before it and that of its last word.
    ``fresh`` are the numbers of words that are new since it was emptied, ``first`` and ``size`` the first character of a
    word and the length of its fold, -1 where workers cannot fold it.
    """

    def __init__(self, flag_word: Callable[[str], int], flag_run: Callable[[str, str | None], int] | None = None) -> None:
        super().__init__()
        self._flag_word, self._flag_run, self._plain = flag_word, flag_run, _Plain()
        self.drop()

    def drop(self) -> None:
        self.clear()
        self.fresh: list[int] = []
        self.phrase: list[str] = []
        self.first, self.size = array("i"), array("i")
        self.flags = bytearray()

    def __missing__(self, which: str | tuple[int, int]) -> int:
        self[which] = number = len(self.phrase)
        if isinstance(which, str):
            self.phrase.append(which)
            self.fresh.append(number)
            # Filters hold folds, and words as they stand where workers cannot fold them.
            plain = self._plain[which]
            self.flags.append(self._flag_word(which if plain is None else plain))
            first, size = ord(which[0]), -1 if plain is None else len(plain)
        else:
            phrase = f"{self.phrase[which[0]]} {self.phrase[which[1]]}"
            self.phrase.append(phrase)
            self.flags.append(self._flag_run(phrase, self.folded(phrase)))
            first = size = -1
        self.first.append(first)
        self.size.append(size)
        return number

    def folded(self, phrase: str) -> str | None:
        """The fold of a phrase; None if it has letters that workers cannot fold."""
        parts = [self._plain[w] for w in phrase.split(" ")]
        return None if None in parts else " ".join(parts)

    def flagged(self, numbers: np.ndarray, flag: int) -> np.ndarray:
        return (np.frombuffer(self.flags, np.uint8)[numbers] & flag) > 0

    def longer(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Numbers of the runs ``before``, each with one word more."""
        pairs, back = np.unique(before << 32 | last, return_inverse=True)
        found = np.array([self[x >> 32, x & 0xFFFFFFFF] for x in pairs.tolist()], np.int64)
        return found[back]


def _numbered(texts: list[str | None], runs: _Runs, gaps: _Gaps) -> tuple[np.ndarray, ...]:
    """Of every word of some texts: the text, the word's number, start, end, and whether only blanks part it from the word before it."""
    row, word, near, size, count = [], [], [], [], []
    for text in texts:
        parts = _PARTED.split(text or "")
        found = parts[1::2]
        count.append(len(found))
        if found:
            word += [runs[w] for w in found]
            near.append(False)
            near += [gaps[g] for g in parts[2:-1:2]]
            size += map(len, parts[:-1])
    row = np.repeat(np.arange(len(texts)), count)
    size = np.array(size, np.int64)
    upto = np.cumsum(size)
    # Places count from the start of their own text.
    first = np.cumsum(count) - count
    base = np.concatenate([[0], upto[1::2]])[first[row]] if len(row) else row
    ends = upto[1::2] - base
    return row, np.array(word, np.int64), ends - size[1::2], ends, np.array(near, bool)


#: A letter that workers cannot fold: no digit, sign of a word or common Latin letter, in either case.
_ODD = re.compile(rf"[^\W0-9A-Za-z_{''.join(sorted({*words.ACCENTED, *'ßæœþ'}))}{''.join(sorted({c.upper() for c in (*words.ACCENTED, *'æœþ') if len(c.upper()) == 1 and c.upper().lower() == c}))}]")


def _odd_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[str] = set()
    plain = _Plain()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and not text.isascii() and _ODD.search(text):
                held.update(w for w in _WORD.findall(text) if not w.isascii() and plain[w] is None)
            if len(held) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["word"])
                held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["word"])


def vocabulary_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``folded``: every distinct word of the texts that workers cannot fold, folded once."""
    found = texts.select(text).mapInArrow(_odd_words, "word string").distinct()
    return found.withColumn("folded", words.fold(F.col("word")))


def affixes(names: DataFrame) -> DataFrame:
    """``folded``, ``pre``, ``suf``: every beginning and end of the names of the fuzzy pass."""
    folded = names.where(_fuzzy("surface")).select(words.fold(F.col("surface")).alias("name")).distinct()
    cut = folded.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n"))
    pre = cut.select(F.substring("name", F.lit(1), F.col("n")).alias("folded"), F.lit(True).alias("pre"), F.lit(False).alias("suf"))
    suf = cut.select(F.substring("name", F.length("name") - F.col("n") + 1, F.col("n")).alias("folded"), F.lit(False).alias("pre"), F.lit(True).alias("suf"))
    return pre.unionByName(suf).groupBy("folded").agg(F.max("pre").alias("pre"), F.max("suf").alias("suf"))


_PRE, _SUF = 1, 2


class _Shapes:
    """First characters of names with the lengths that folds near to them have."""

    def __init__(self, shapes: list[tuple[str, int]]) -> None:
        self._firsts = np.array(sorted({ord(c) for c, _ in shapes}), np.int64)
        # Lengths beyond the longest share the last column, first characters of no name the last row.
        self._fits = np.zeros((len(self._firsts) + 1, max((n for _, n in shapes), default=0) + FUZZY_EDITS + 2), bool)
        for c, n in shapes:
            self._fits[np.searchsorted(self._firsts, ord(c)), max(0, n - FUZZY_EDITS) : n + FUZZY_EDITS + 1] = True

    def fit(self, known: _Runs, *run: np.ndarray) -> np.ndarray:
        """Whether runs of the words ``run`` begin like a name and are as long as it, but for two edits; those that cannot be folded may be."""
        first, size = np.frombuffer(known.first, np.int32)[run[0]], [np.frombuffer(known.size, np.int32)[x] for x in run]
        at = np.searchsorted(self._firsts, first)
        at[np.append(self._firsts, -1)[at] != first] = len(self._firsts)
        odd = np.logical_or.reduce([x < 0 for x in size])
        total = np.clip(sum(size) + len(run) - 1, 0, self._fits.shape[1] - 1)
        return odd | self._fits[at, total]


def _near_runs(high: int, shapes: list[tuple[str, int]], before: Broadcast, behind: Broadcast, keys: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # Folding gives a letter four at most.
    most = high + FUZZY_EDITS + 16

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, suf, bits, gaps, like = before.value, behind.value, keys.value, _Gaps(), _Shapes(shapes)

        def sides(word: str) -> int:
            at = zlib.crc32(word.encode()) % FILTER_BITS
            return _PRE * (pre[at >> 3] >> (at & 7) & 1) + _SUF * (suf[at >> 3] >> (at & 7) & 1)

        known = _Runs(sides)
        held: set[tuple[int, str]] = set()
        met: set[tuple[int, ...]] = set()

        def rows() -> pa.RecordBatch:
            k, phrase = zip(*held, strict=True) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(phrase, pa.string())], names=["k", "phrase"])

        def keep(found: list[tuple[int, ...]]) -> None:
            """Holds those of the new words and runs that share a key with a name, and those whose letters workers cannot fold."""
            phrases, folded, k = [], [], []
            word = known.phrase
            for run in found:
                phrase = word[run[0]] if len(run) == 1 else f"{word[run[0]]} {word[run[1]]}" if len(run) == 2 else f"{word[run[0]]} {word[run[1]]} {word[run[2]]}"
                if FUZZY_LENGTH <= len(phrase) <= most:
                    plain = phrase.lower() if phrase.isascii() else known.folded(phrase)
                    if plain is None:
                        held.add((len(run), phrase))
                    elif len(plain) <= high + FUZZY_EDITS:
                        phrases.append(phrase)
                        folded.append(plain)
                        k.append(len(run))
            for row in known_keys(phrases, folded, k, bits, high > LONG_NAME):
                held.add((k[row], phrases[row]))

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                _, word, _, _, near = _numbered(batch.column(0).slice(start, TEXTS).to_pylist(), known, gaps)
                begins, ends = known.flagged(word, _PRE), known.flagged(word, _SUF)
                two = np.nonzero(near[1:] & (begins[:-1] | ends[1:]))[0]
                two = two[like.fit(known, word[two], word[two + 1])]
                three = np.nonzero(near[1:-1] & near[2:] & begins[:-2] & ends[2:])[0]
                three = three[like.fit(known, word[three], word[three + 1], word[three + 2])]
                fresh = np.array(known.fresh, np.int64)
                found = {(x >> 32, x & 0xFFFFFFFF) for x in np.unique(word[two] << 32 | word[two + 1]).tolist()}
                found |= set(zip(*(word[three + j].tolist() for j in range(3)), strict=True))
                found -= met
                keep([*((x,) for x in fresh[like.fit(known, fresh)].tolist()), *found])
                known.fresh.clear()
                met |= found
                if len(met) > HELD_WORDS or len(known) > HELD_WORDS:
                    met.clear()
                    known.drop()
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return runs


def _near_phrases(texts: DataFrame, vocabulary: DataFrame, names: DataFrame, high: int, text: str) -> DataFrame:
    """Distinct ``phrase``, ``k`` of one to three words that a name may be near to.

    A word or run shares a key with the name. Each blank costs an edit. So of two words one is
    an exact beginning or end of the name, and of three the first and the last are. Workers ask
    filters for both, which let a few others through; what is near is verified later.
    """
    cut = affixes(names)
    parts = materialize(cut.select(F.col("folded").alias("word"), "pre", "suf").unionByName(vocabulary.join(cut, "folded").select("word", "pre", "suf")), "parts")
    sides = [membership(parts.where(side), "word") for side in ("pre", "suf")]
    fuzzy = names.where(_fuzzy("surface"))
    known = key_filter(fuzzy)
    shapes = fuzzy.select(F.substring("surface", 1, 1).alias("first"), F.length(words.fold(F.col("surface"))).alias("n")).distinct().collect()
    return texts.select(text).mapInArrow(_near_runs(high, [tuple(r) for r in shapes], *sides, known), "k int, phrase string")


def near_candidates(texts: DataFrame, vocabulary: DataFrame, names: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    """Distinct ``phrase``, ``k``, ``folded`` that a name of ``low`` to ``high`` folded letters may be near to; ``vocabulary`` as :func:`vocabulary_of` has it."""
    single = vocabulary.select(F.col("word").alias("phrase"), F.lit(1).alias("k"))
    found = single.unionByName(_near_phrases(texts, vocabulary, names, high, text).select("phrase", "k")).distinct()
    near = F.length("folded").between(low - FUZZY_EDITS, high + FUZZY_EDITS) & (F.length("phrase") >= FUZZY_LENGTH)
    return found.withColumn("folded", words.fold(F.col("phrase"))).where(near)


_WHOLE, _BEGUN = 1, 2


def _begun_runs(longest: int, whole: Broadcast, begun: Broadcast, heads: Broadcast, shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_bits, some_bits, head_bits, gaps = whole.value, begun.value, heads.value, _Gaps()

        def flags(_: str, folded: str | None) -> int:
            return _WHOLE + _BEGUN if folded is None else _WHOLE * _possible(all_bits, folded) + _BEGUN * _possible(some_bits, folded)

        # Most words begin no phrase and are never folded.
        known = _Runs(lambda word: flags(word, known.folded(word)) if _possible(head_bits, word) else 0, flags)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                row, word, s, e, near = _numbered(some.column(1).to_pylist(), known, gaps)
                at, run, places, last, numbers = np.arange(len(word)), word, [], [], []
                for k in range(1, longest + 1):
                    if k > 1:
                        # The run goes on where a phrase does and only blanks part it from the next word.
                        on = known.flagged(run, _BEGUN) & (at + k - 1 < len(word))
                        on[on] = near[at[on] + k - 1]
                        at, run = at[on], known.longer(run[on], word[at[on] + k - 1])
                    hit = known.flagged(run, _WHOLE)
                    places.append(at[hit])
                    last.append(at[hit] + k - 1)
                    numbers.append(run[hit])
                places, last = np.concatenate(places), np.concatenate(last)
                which, number = np.unique(np.concatenate(numbers), return_inverse=True)
                taken = pa.array(number, pa.int32())
                key = some.column(0).take(pa.array(row[places], pa.int32()))
                columns = [key, pa.array(s[places], pa.int32()), pa.array(e[last], pa.int32())]
                phrases = [known.phrase[n] for n in which.tolist()]
                columns += [pa.array(x, pa.string()).take(taken) for x in (phrases, [known.folded(p) for p in phrases])]
                yield pa.RecordBatch.from_arrays(columns, schema=shape.set(0, shape.field(0).with_type(key.type)))
                if len(known) > HELD_WORDS:
                    known.drop()

    return runs


def begun_spans(texts: DataFrame, vocabulary: DataFrame, begun: DataFrame, key: str, longest: int, text: str = "text") -> DataFrame:
    """``key``, ``s``, ``e``, ``phrase``, ``folded`` of windows that fold to a phrase of ``begun`` (``folded``), and a few others.

    Workers ask filters whether a run of words is such a phrase or begins one. Where they cannot fold its letters, a run
    goes through if its first word begins a phrase.
    """
    parts = F.split("folded", " ")
    heads = begun.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), " "))).alias("folded"), F.size(parts).alias("n"))
    heads = heads.where(F.size(F.split("folded", " ")) < F.col("n"))
    first = begun.select(parts[0].alias("folded")).distinct()
    words_of = first.select(F.col("folded").alias("word")).unionByName(vocabulary.join(first, "folded").select("word"))
    filters = [membership(begun, "folded"), membership(heads, "folded"), membership(words_of, "word")]
    rows = texts.select(key, text)
    kinds = [T.StructField(key, rows.schema[key].dataType), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]
    kinds += [T.StructField("phrase", T.StringType()), T.StructField("folded", T.StringType())]
    shape = pa.schema([(key, pa.null()), ("s", pa.int32()), ("e", pa.int32()), ("phrase", pa.string()), ("folded", pa.string())])
    found = rows.mapInArrow(_begun_runs(longest, *filters, shape), T.StructType(kinds))
    return found.withColumn("folded", F.coalesce("folded", words.fold(F.col("phrase"))))


def match(texts: DataFrame, dictionary: DataFrame, key: str, stopwords: list[str], text: str = "text") -> DataFrame:
    """Windows of texts with the entity of the first pass that hits: exact, folded, fuzzy.

    ``dictionary`` has ``surface``, ``entity``, ``ord`` (declaration order). A key shared by
    several entries is reported as ``first_name``. Windows of up to three words (or as many as
    the longest surface has) count in every pass; a window that is a stop-word never matches
    fuzzily. Words are folded once each, near windows are looked for once each, and only runs of
    words that may be a known or near window leave the workers. Texts are read three times
    and never shuffled as long as what they meet is small enough for the session to broadcast.
    """
    named = materialize(exact_and_folded(dictionary), "surfaces")
    longest, low, high = extents(dictionary)
    vocabulary = materialize(vocabulary_of(texts, text), "vocabulary")
    if high is None:
        fuzzy = dictionary.select(F.col("surface").alias("phrase"), "surface", "entity").limit(0)
    else:
        found = near_candidates(texts, vocabulary, dictionary, low, high, text)
        unknown = found.join(named.select("folded"), "folded", "left_anti")
        fuzzy = close_phrases(unknown, dictionary, stopwords)
    fuzzy = materialize(fuzzy, "close-phrases")

    begun = named.select("folded").unionByName(fuzzy.select(words.fold(F.col("phrase")).alias("folded")))
    spans = begun_spans(texts, vocabulary, begun, key, longest, text)

    by_fold = spans.join(named, "folded", "left")
    by_word = by_fold.join(fuzzy.select("phrase", F.struct("surface", "entity", F.lit(1).cast("long").alias("n_entries")).alias("close")), "phrase", "left")
    exact = F.try_element_at("exact", F.col("phrase"))
    chosen = F.coalesce(exact, F.col("first"), F.col("close"))
    shared = F.coalesce(exact["n_entries"], F.col("first.n_entries"), F.lit(1)) > 1
    pass_name = F.when(shared, "first_name").when(exact.isNotNull(), "exact").when(F.col("first").isNotNull(), "normalized").otherwise("fuzzy")
    return by_word.where(chosen.isNotNull()).select(
        key, "s", "e", "phrase", chosen["surface"].alias("surface"), chosen["entity"].alias("entity"), pass_name.alias("pass_name")
    )


def disjoint(matched: DataFrame, key: str) -> DataFrame:
    """Matches without overlap, longest extent first, then leftmost."""
    return overlap.disjoint(matched.select(key, "s", "e", "surface", "entity", "pass_name"), key)


def extents(dictionary: DataFrame) -> tuple[int, int | None, int | None]:
    """Words of the longest window and the shortest and longest folded name of the fuzzy pass: one aggregated row."""
    size = F.when(_fuzzy("surface"), F.length(words.fold(F.col("surface"))))
    row = dictionary.agg(F.max(F.size(words.words(F.col("surface")))).alias("k"), F.min(size).alias("low"), F.max(size).alias("high")).first()
    return max(row.k or 1, 1 if row.high is None else FUZZY_EDITS + 1), row.low, row.high
