"""Many values in one scan, against plain search; novel names against a reading word by word."""

import random
import re

from pyspark.sql import functions as F

from maskwell.operators import passes, rewrite, scan


def brute(text, values, whole=True):
    out = set()
    for v in values:
        for at in range(len(text) - len(v) + 1):
            before, after = text[at - 1 : at], text[at + len(v) : at + len(v) + 1]
            if text.startswith(v, at) and not (whole and (re.fullmatch(r"\w", before) or re.fullmatch(r"\w", after))):
                out.add((v, at, at + len(v)))
    return out


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r[0], set()).add((r.value, r.s, r.e))
    return out


def test_nested_and_overlapping_values_equal_plain_search(spark, monkeypatch):
    rnd = random.Random(4)
    parts = ["a", "b", "ab", "a b", "+", "é", "_", "日本", "🙂", "7"]
    texts = ["".join(rnd.choice([*parts, " ", " ", ". "]) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    values = sorted({"".join(rnd.choice([*parts, " "]) for _ in range(rnd.randint(1, 5))).strip() for _ in range(150)} - {""})
    frame = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "id long, text string")
    known = spark.createDataFrame([(v,) for v in [*values, *values[:3], None, ""]], "value string")
    worded = [v for v in values if re.search(r"\w", v)]
    want = {k: w for k, t in enumerate(texts) if (w := brute(t, worded))}
    assert found(scan.places(frame, "id", known)) == want and sum(map(len, want.values())) > 500
    keyed = frame.select(F.struct("id", F.lit("x").alias("n")).alias("leaf"), "text")
    assert {k.id: v for k, v in found(scan.places(keyed, "leaf", known)).items()} == want

    lists = spark.createDataFrame([(k, [rnd.choice(values) for _ in range(9)] + [None, ""]) for k in range(0, 130, 2)], "id long, values array<string>")
    mine = {r.id: {v for v in r["values"] if v} for r in lists.collect()}
    for whole in (True, False):
        want = {k: w for k, t in enumerate(texts) if (w := brute(t, mine.get(k, ()), whole))}
        assert found(scan.listed_places(frame, "id", lists, whole=whole)) == want
    assert scan.places(frame.limit(0), "id", known).count() == scan.places(frame, "id", known.limit(0)).count() == 0


def test_a_text_with_ten_thousand_values_is_shuffled_once(spark):
    names = [f"name{k} of{k % 7}" for k in range(10_000)]
    text = ", ".join(names) + " and name5 of5x"
    frame = spark.createDataFrame([(1, text), (2, "name5 of5"), (3, "of5 name5")], "id long, text string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names] + [("name5",), ("of5, name6",)], "value string")
    got = found(scan.places(frame, "id", known))
    assert len(got[1]) == 10_000 + 3 and got[2] == {("name5 of5", 0, 9), ("name5", 0, 5)} and got[3] == {("name5", 4, 9)}
    leaks = rewrite.leaks(frame, "id", "text", known)
    assert leaks.count() == 10_002 + 2 + 1
    plan = scan.places(frame, "id", known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_injected_ranges_overlap(spark):
    blinded = spark.createDataFrame([(1, "Bernd Vogtland met Vogtland Berg")], "id long, text string")
    session = spark.createDataFrame([(1, "Bernd Vogt"), (1, "Vogtland"), (1, "land met"), (2, "met")], "id long, surrogate string")
    got = {(r.s, r.e) for r in passes.injected_ranges(blinded, "id", session).collect()}
    assert got == {(0, 10), (6, 14), (10, 18), (19, 27)}


def plain_names(text, surrogates, stopwords, harmless):
    """Capitalised words of one text without line starts, doubts or punctuation, grown together and cut."""
    live = [m.span() for s in surrogates for m in re.finditer(f"(?={re.escape(s)})", text) for m in [re.compile(re.escape(s)).match(text, m.start())]]
    out, last = [], None
    for m in re.finditer(r"\w+", text):
        fits = re.fullmatch(r"[A-ZÄÖÜ][a-zäöüß]+", m[0]) and m[0].lower() not in stopwords and m[0] not in harmless
        if not fits or any(s < m.end() and m.start() < e for s, e in live):
            last = None
        elif last is not None and text[out[-1][1] : m.start()] == " ":
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
            last = m
    return sorted((s, e, text[s:e]) for s, e in out)


def test_novel_names_equal_a_plain_reading(spark):
    rnd = random.Random(9)
    names = ["Xaver", "Yvonne", "Zeno", "Quirin", "Ulf"]
    others = ["walks", "near", "the", "and", "Die", "Haus", "Bernd Vogt", "Vogt"]
    texts = ["so " + " ".join(rnd.choice(names + others) for _ in range(rnd.randint(1, 25))) for _ in range(80)]
    blinded = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    session = spark.createDataFrame([(k, s) for k in range(80) for s in ("Bernd Vogt", "Vogt")], "id long, surrogate string")
    harmless = spark.createDataFrame([("Haus",)], "word string")
    rows = passes.novel_names(blinded, "id", session, harmless, ["die"], lambda word, context: F.lit(True))
    got = {}
    for r in rows.collect():
        got.setdefault(r.id, []).append((r.s, r.e, r.value))
    want = {k: n for k, t in enumerate(texts) if (n := plain_names(t, ["Bernd Vogt", "Vogt"], ["die"], {"Haus"}))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 60
