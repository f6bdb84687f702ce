"""Novel names: texts are read once in the workers, and only words that may be names leave them.

What :mod:`candidates` says about capitalised words is told here text by text, in one pass over
its words, so that no table of all words is stored, shuffled or sorted.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.operators import candidates, scan

_PARTED = re.compile(r"(\w+)")
#: White space as column expressions have it.
_BLANK = " \t\n\x0b\f\r"
#: :data:`candidates.NOT_PROSE` for workers; an address begins where its letters do or behind another match.
_NOT_PROSE = re.compile(
    r"(?:(?<![\w.+\-])[\w.+\-]|(?<=\w)[.+\-])[\w.+\-]*+@[\w\-]++(?:\.[\w\-]++)++"
    rf"|(?<!\w)\w++://[^{_BLANK}]++|(?<!\w)\w++(?:[.\-]\w++)++"
)
_LINE = str.maketrans("", "", candidates.LINE_SIGNS + candidates.OPENERS)
_ITEM = str.maketrans("", "", candidates.ITEM_SIGNS)
_BULLET = str.maketrans("", "", " \t" + candidates.ITEM_SIGNS + "_")
_INDENT = str.maketrans("", "", " \t")
_NUMBER = str.maketrans("", "", " \t*_")
_DIGITS = re.compile("[0-9]+")
#: Distinct words, and distinct gaps, whose reading a worker keeps.
HELD = 200_000


class _Shapes(dict):
    """Of a word: 1 if it is capitalised, 2 if it is in lower case, else 0; and its lower and its folded form."""

    def __missing__(self, word: str) -> tuple[int, str, str]:
        if len(self) > HELD:
            self.clear()
        kinds = {unicodedata.category(c) for c in word[1:]}
        first = unicodedata.category(word[0])
        shape = 1 if first == "Lu" and kinds == {"Ll"} else 2 if first == "Ll" and kinds <= {"Ll"} else 0
        low = word.lower()
        self[word] = out = (shape, low, low.replace("ß", "ss"))
        return out


class _Places(dict):
    """Of a gap: whether the word behind it opens a line, sentence or quotation, and an item of a list; numbers of items aside."""

    def __missing__(self, which: tuple[str, bool]) -> tuple[bool, bool]:
        if len(self) > HELD:
            self.clear()
        gap, first = which
        lead = gap.rpartition("\n")[2]
        fresh = first or "\n" in gap
        opens_line = fresh and not lead.translate(_LINE)
        bullet = fresh and len(lead.translate(_ITEM)) < len(lead) and not lead.translate(_BULLET)
        unquoted = gap.rstrip(candidates.OPENERS)
        bare = unquoted.rstrip(_BLANK)
        opens_sentence = len(bare) < len(unquoted) and bare.rstrip(candidates.CLOSERS)[-1:] in (".", "!", "?")
        self[which] = out = (opens_line or bullet or opens_sentence or len(unquoted) < len(gap), bullet)
        return out


def _numbered(k: int, found: list[str], gaps: list[str]) -> bool:
    """Whether the number of a list item stands before word ``k``: a word itself, alone in its line."""
    gap, before = gaps[k], gaps[k - 1]
    return (
        k > 0 and gap[:1] in (".", ")") and _DIGITS.fullmatch(found[k - 1]) is not None and (k == 1 or "\n" in before)
        and not before.rpartition("\n")[2].translate(_INDENT) and not gap[1:].translate(_NUMBER)
    )


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        elif s < e:
            out.append((s, e))
    return out


def _covered(ranges: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether a single range covers each span."""
    ranges = sorted(ranges)
    starts, upto, furthest = [s for s, _ in ranges], [], 0
    for _, e in ranges:
        furthest = max(furthest, e)
        upto.append(furthest)
    found = (bisect_right(starts, s) for s, _ in spans)
    return [at > 0 and upto[at - 1] >= e for at, (_, e) in zip(found, spans, strict=True)]


def _candidates(text: str, live: list[tuple[int, int]], stopwords: set[str], shapes: _Shapes, places: _Places) -> Iterator[tuple]:
    """(word, s, e, gap, cuts, context, at) of each capitalised word of a text that the text itself does not explain."""
    parts = _PARTED.split(text)
    found, gaps = parts[1::2], parts[:-1:2]
    if not found:
        return
    read = [shapes[w] for w in found]
    titled = [k for k, x in enumerate(read) if x[0] == 1]
    if not titled:
        return
    starts, at = [], 0
    for gap, word in zip(gaps, found, strict=True):
        at += len(gap)
        starts.append(at)
        at += len(word)
    n_title = Counter(read[k][2] for k in titled)
    n_lower = Counter(x[2] for x in read if x[0] == 2)
    # Words in what is no prose count for nothing.
    for m in _NOT_PROSE.finditer(text):
        for w in _PARTED.findall(m[0]):
            if shapes[w][0] == 2:
                n_lower[shapes[w][2]] -= 1

    # Runs of capitalised words of which each stands more often in lower case.
    suppressed: set[int] = set()
    run: list[int] = []
    for k in [*titled, -1]:
        if not run or k != run[-1] + 1 or not gaps[k] or gaps[k].strip(" \t"):
            if run and all(n_lower[read[j][2]] > n_title[read[j][2]] for j in run):
                suppressed.update(run)
            run = []
        run.append(k)

    # Words that owe the capital to their place, wherever they stand.
    every: dict[str, tuple[bool, bool]] = {}
    for k in titled:
        opens, listed = places[gaps[k], k == 0]
        if not listed and _numbered(k, found, gaps):
            opens, listed = True, True
        a, b = every.get(found[k], (True, False))
        every[found[k]] = (a and opens, b or listed)
    words = set(found)
    noise = {w for w, (opens, listed) in every.items() if opens and (listed or shapes[w][1] in words)}

    left = [k for k in titled if k not in suppressed and found[k] not in noise and read[k][1] not in stopwords]
    inside = _covered(live, [(starts[k], starts[k] + len(found[k])) for k in left])
    united = _united(live)
    ends = [e for _, e in united]
    for k, hidden in zip(left, inside, strict=True):
        if hidden:
            continue
        s, e = starts[k], starts[k] + len(found[k])
        near = k > 0 and gaps[k] != "" and not gaps[k].strip(" \t")
        lo = s - len(gaps[k]) if near else s
        cuts = []
        for a, b in united[bisect_right(ends, lo) :]:
            if a >= e:
                break
            cuts.append({"s": max(a, lo), "e": min(b, e)})
        from_ = max(0, s - candidates.CONTEXT)
        yield found[k], s, e, gaps[k] if near else None, cuts, text[from_ : e + candidates.CONTEXT], s - from_


_CUTS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_CANDIDATE = [("word", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("gap", pa.string()), ("cuts", _CUTS), ("context", pa.string()), ("at", pa.int32())]
_CANDIDATE_TYPE = "word string, s int, e int, gap string, cuts array<struct<s: int, e: int>>, context string, at int"


def _read(stopwords: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, places, stop = _Shapes(), _Places(), set(stopwords)
        for batch in batches:
            for start in range(0, batch.num_rows, scan.TEXTS):
                some = batch.slice(start, scan.TEXTS)
                texts = some.column(1).to_pylist()
                lists = [set(x or ()) - {None, ""} for x in some.column(2).to_pylist()]
                live: list[list[tuple[int, int]]] = [[] for _ in texts]
                for k, _, s, e in scan.found_in(texts, lists, False):
                    live[k].append((s, e))
                row, rows = [], []
                for k, text in enumerate(texts):
                    new = list(_candidates(text, live[k], stop, shapes, places))
                    row += [k] * len(new)
                    rows += new
                columns = list(zip(*rows, strict=True)) or [()] * len(_CANDIDATE)
                arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _CANDIDATE, strict=True)]
                keys = some.column(0).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *arrays], schema=pa.schema([pa.field(batch.schema.names[0], keys.type), *_CANDIDATE]))

    return run


def unexplained(blinded: DataFrame, key: str, stopwords: list[str]) -> DataFrame:
    """Capitalised words that neither stop-words, nor their ``text``, nor its own surrogates (``values``) explain.

    ``key``, ``word``, ``s``, ``e``, ``context``, ``at``, the ``gap`` to the word before where that
    is blanks and tabs only, and ``cuts``: what surrogates cover of gap and word.
    """
    rows = blinded.select(key, "text", "values").where(F.col(key).isNotNull() & F.col("text").isNotNull())
    shape = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(_CANDIDATE_TYPE).fields])
    return rows.mapInArrow(_read(stopwords), shape)


def _pieces(run: list[tuple]) -> Iterator[tuple[int, int, str]]:
    """(s, e, value) of what a run of adjacent confirmed words (s, e, word, gap, cuts) leaves outside of its cuts."""
    at = run[0][0]
    text = "".join([run[0][2], *(part for _, _, word, gap, _ in run[1:] for part in (gap, word))])
    end, last = run[-1][1], at
    cuts = _united([(c["s"], c["e"]) for x in run for c in x[4]])
    for s, e in [*cuts, (end, end)]:
        piece = text[max(last, at) - at : max(s, at) - at]
        bare = piece.strip(" \t")
        if bare:
            begin = max(last, at) + len(piece) - len(piece.lstrip(" \t"))
            yield begin, begin + len(bare), bare
        last = e


def _grown(shape: pa.Schema):
    """Rows in order of their key and place as names; a run is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, held, kind = None, [], pa.null()

        def rows(out: list[tuple]) -> pa.RecordBatch:
            fields = shape.set(0, shape.field(0).with_type(kind))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(fields)], schema=fields)

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for key, *word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, _, _, gap, _ = word
                if held and (key != whose or gap is None or held[-1][1] + len(gap) != s):
                    out += [(whose, *x) for x in _pieces(held)]
                    held = []
                held.append(word)
                whose = key
            yield rows(out)
        if held:
            yield rows([(whose, *x) for x in _pieces(held)])

    return run


def grown_names(confirmed: DataFrame, key: str) -> DataFrame:
    """``key``, ``s``, ``e``, ``value``: adjacent words of :func:`unexplained` as one, less what surrogates cover."""
    rows = confirmed.select(key, "s", "e", "word", "gap", "cuts").repartition(key).sortWithinPartitions(key, "s")
    kind = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL("s int, e int, value string").fields])
    shape = pa.schema([(key, pa.null()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.string())])
    return rows.mapInArrow(_grown(shape), kind)
