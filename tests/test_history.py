"""Versions and as-of joins against plain loops; replays with what was known at each text's time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwell.operators import dictionary, history, passes, replay
from maskwell.shared import materialize

START = datetime(2024, 1, 1)
STOP = ["the", "und"]
NAME = "surface string, entity long, ord long, valid_from timestamp, valid_to timestamp"


def day(n):
    return None if n is None else START + timedelta(days=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_follow_the_log(spark):
    log = [
        ("a", day(5), 1, "x", None), ("a", day(9), 2, "y", False), ("a", day(9), 3, "z", False), ("a", day(12), 4, None, True),
        ("a", day(20), 5, "again", False), ("b", None, 1, "always", False), ("b", day(3), 2, None, True),
        ("c", None, 1, "old", False), ("c", None, 2, "kept", False), (None, day(1), 1, "nobody", False), ("d", day(1), 1, None, True),
    ]
    changes = spark.createDataFrame(log, "k string, at timestamp, seq long, v string, removed boolean")
    got = rows(history.versions(changes, ["k"], order="seq").select("k", "v", "valid_from", "valid_to"))
    want = [
        ("a", "x", day(5), day(9)), ("a", "z", day(9), day(12)), ("a", "again", day(20), None),
        ("b", "always", None, day(3)), ("c", "kept", None, None),
    ]
    assert got == sorted(want, key=str)
    assert history.versions(changes.limit(0), ["k"], order="seq").count() == 0


def test_as_of_equals_a_loop(spark):
    """A key with thousands of short versions, overlapping ones, ends inside seconds, times outside the blocks."""
    rng = random.Random(3)
    kept, n = [], 0
    for k in range(6):
        for _ in range(3000 if k == 0 else 8):
            start = START + timedelta(microseconds=rng.randrange(3 * 10**13 if k else 10**10))
            end = start + timedelta(microseconds=rng.randrange(1, 10 ** rng.randrange(1, 14)))
            kept.append((f"k{k}", n, start, end))
            n += 1
    kept += [("k1", n, None, START), ("k2", n + 1, START, None), ("k3", n + 2, None, None), (None, n + 3, None, None)]
    kept += [("k4", n + 4, datetime(1700, 1, 1), datetime(1750, 1, 1)), ("k4", n + 5, datetime(2300, 1, 1), datetime(2400, 1, 1))]
    asked = [(i, f"k{rng.randrange(7)}", START + timedelta(microseconds=rng.randrange(3 * 10**13))) for i in range(300)]
    asked += [(1000 + i, "k0", START + timedelta(microseconds=rng.randrange(10**10))) for i in range(200)]
    asked += [(2000 + i, k, t) for i, (k, _, s, e) in enumerate(kept[:60] + kept[-6:]) for t in (s, e)]
    asked += [(3000 + y, "k4", datetime(y, 1, 1)) for y in (1699, 1700, 1749, 1750, 1900, 2299, 2300, 2399, 2400)] + [(1, None, START), (2, "k3", None)]
    left = spark.createDataFrame(asked, "i long, k string, t timestamp")
    right = spark.createDataFrame(kept, "k string, v long, valid_from timestamp, valid_to timestamp")
    got = rows(history.as_of(left, right, ["k"], "t").select("i", "k", "t", "v"))
    inside = lambda t, s, e: (s is None or s <= t) and (e is None or t < e)
    want = [(i, k, t, v) for i, k, t in asked if k and t for k2, v, s, e in kept if k2 == k and inside(t, s, e)]
    assert len(want) > 500 and got == sorted(want, key=str)


def test_covers_are_exact_and_small(spark):
    rng = random.Random(5)
    ends = []
    for _ in range(200):
        a = rng.randrange(10**9)
        ends.append((datetime.fromtimestamp(a), datetime.fromtimestamp(a + rng.randrange(1, 10 ** rng.randrange(1, 9)))))
    pieces = history.cover(F.col("a"), F.col("b"))
    found = spark.createDataFrame(ends, "a timestamp, b timestamp").select(F.unix_seconds("a").alias("a"), F.unix_seconds("b").alias("b"), pieces.alias("p"))
    for row in found.collect():
        held = sorted((x.block * 16**x.level, (x.block + 1) * 16**x.level) for x in row.p)
        assert held[0][0] == row.a and held[-1][1] == row.b + 1
        assert all(x[1] == y[0] for x, y in zip(held, held[1:], strict=False))
        assert len(held) <= 31 * history.LEVELS


NAMES = [
    ("Nordlicht", 1, 1, None, day(10)), ("Nordlicht", 2, 2, day(5), None), ("Müller", 3, 3, day(2), day(8)), ("Muller", 4, 4, day(6), None),
    ("Berg Verein", 5, 5, day(3), day(9)), ("Hauser", 6, 6, None, None), ("Hausen", 7, 7, day(4), day(6)), ("Langer Zug Nach Osten", 8, 8, day(1), None),
]
TEXTS = [
    "Nordlicht met Muller and MÜLLER in the Berg Verein", "Nord Licht, Nordlich and Hausan. Hauser", "the Langer Zug Nach Osten",
    "", None, "Muller Muller\tBerg Verein Hausen",
]


@pytest.fixture(scope="module")
def dated(spark):
    data = [(d * 10 + k, text, day(d)) for d in range(12) for k, text in enumerate(TEXTS)]
    return spark.createDataFrame([*data, (999, TEXTS[0], None)], "doc long, text string, at timestamp")


def test_matches_equal_those_of_the_dictionary_of_the_day(spark, dated):
    names = spark.createDataFrame(NAMES, NAME)
    columns = ["doc", "s", "e", "phrase", "surface", "entity", "pass_name"]
    got = rows(replay.match_as_of(dated, "doc", "at", names, STOP).select(*columns))
    want = []
    for d in (0, 5, 7, 9):
        then = names.where(F.coalesce(F.col("valid_from") <= F.lit(day(d)), F.lit(True)) & F.coalesce(F.col("valid_to") > F.lit(day(d)), F.lit(True)))
        want += rows(dictionary.match(dated.where(F.col("at") == F.lit(day(d))), then.drop("valid_from", "valid_to"), "doc", STOP).select(*columns))
    days = {0, 5, 7, 9}
    assert [r for r in got if r[0] // 10 in days] == sorted(want, key=str)
    assert {r[6] for r in got} == {"exact", "normalized", "fuzzy", "first_name"} and all(r[0] != 999 for r in got)


def test_a_replay_finds_what_was_recorded_then(spark):
    """Each day's texts are recorded with that day's tables; a replay with the tables' history gives the same spans."""
    names = spark.createDataFrame(NAMES, NAME)
    surrogates = [(e, f"Werk {e}", s, None, day(7)) for s, e, *_ in NAMES if e != 2] + [(e, f"Haus {e}", s, day(7), None) for s, e, *_ in NAMES if e != 3]
    surrogates = spark.createDataFrame(surrogates, "entity long, surrogate string, canonical string, valid_from timestamp, valid_to timestamp")
    items = [
        (1, "Petra Kunze", "person", "Vora Nacha", day(1), day(9)), (2, "Kunze Petra", "person", "Vorb Nachb", day(4), None),
        (3, "Kunze", "person", "Vorc", day(6), None), (4, "Abel GmbH", "organization", "Firma GmbH", None, day(6)),
    ]
    items = spark.createDataFrame(items, "item_id long, value string, entity_type string, surrogate string, valid_from timestamp, valid_to timestamp")
    lines = ["Petra Kunze and Kunze, Petra with Muller: a@b.example", "Abel GmbH, Abel, Hausan and Nord Licht: +49 170 1234567", "a@b.example Kunze Petra Kunze"]
    data = [(d * 10 + k, text, day(d)) for d in (0, 7) for k, text in enumerate(lines)]
    texts = spark.createDataFrame(data, "doc long, text string, at timestamp")
    recorded, log = [], []
    for d in (0, 7):
        today = F.lit(day(d))
        then = lambda df: df.where(F.coalesce(F.col("valid_from") <= today, F.lit(True)) & F.coalesce(F.col("valid_to") > today, F.lit(True))).drop("valid_from", "valid_to")
        found, minted = passes.deterministic_spans(texts.where(F.col("at") == today), "doc", then(names), then(surrogates), then(items), STOP)
        recorded += rows(found.select("doc", "s", "e", "layer", "surrogate", "real"))
        log += [(r.kind, r.value, r.ordinal, r.surrogate, day(d), day({0: 7}.get(d))) for r in minted.collect()]
    contacts = spark.createDataFrame(log, "kind string, value string, ordinal long, surrogate string, valid_from timestamp, valid_to timestamp")
    replayed = replay.spans_as_of(texts, "doc", "at", names, surrogates, items, STOP, contacts)
    replayed = materialize(replayed.select("doc", "s", "e", "layer", "surrogate", "real"), "replayed")
    assert rows(replayed) == sorted(recorded, key=str)
    assert {r[3] for r in recorded} == {"dictionary", "pair", "contact"}

    first = spark.createDataFrame(recorded, replayed.schema)
    assert {tuple(r)[2:] for r in replay.drift(first, replayed, "doc").collect()} == {(0, 0, 0)}
    altered = first.where("layer <> 'pair'").withColumn("surrogate", F.when(F.col("layer") == "contact", "other").otherwise(F.col("surrogate")))
    total = replay.drift(altered, replayed, "doc").agg(F.sum("n_same"), F.sum("n_lost"), F.sum("n_new"), F.sum("n_changed")).first()
    count = lambda layer: sum(r[3] == layer for r in recorded)
    assert tuple(total) == (count("dictionary"), 0, count("pair"), count("contact"))

    unmapped = replay.spans_as_of(texts, "doc", "at", names, surrogates, items, STOP, contacts.where("kind <> 'email'"))
    mails = unmapped.where("real = 'a@b.example'").select("surrogate").distinct().collect()
    assert len(mails) == 1 and mails[0][0]


def test_texts_of_one_split_are_replayed_by_all_tasks(spark, monkeypatch):
    """However the table lies in its file, no task reads more than its share of the texts."""
    prose = F.concat_ws(" ", F.lit("Petra Kunze"), *[F.sha2(F.concat("id", F.lit(f"/{k}")), 512) for k in range(10)])
    texts = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc"), F.lit(day(5)).alias("at"), prose.alias("text"))
    shares = []

    class Seen(Exception):
        pass

    def watched(texts, *args):
        shares.extend(r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect())
        raise Seen

    monkeypatch.setattr(replay, "match_as_of", watched)
    with pytest.raises(Seen):
        replay.spans_as_of(texts, "doc", "at", *[None] * 3, STOP)
    assert sum(shares) == 6000 and max(shares) < 4500
